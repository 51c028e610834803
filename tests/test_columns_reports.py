"""Column choice, validation, reports, sources and sinks."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillmask import ENTITY_OPTIONS, STYLE_ENTITY_TAGS, anonymise
from quillmask.catalogue import CSV_NA_TOKENS, DEFAULT_ENTITY_TYPES, types_for_labels
from quillmask.operators.annotations import attach_entities, attach_tokens
from quillmask.operators.columns import output_name, output_names, text_columns, threshold_steps
from quillmask.sources.readers import load_table, read_csv
from quillmask.sources.row_index import read_parquet_with_index, with_row_index
from quillmask.sources.writers import DATA, DETECTIONS, RESIDUALS, STATS, write_outputs


def test_text_columns():
    assert text_columns(["id", "Comments", "Free_Text", "context"]) == ["Comments", "Free_Text", "context"]
    assert text_columns(["a", "b"]) == ["a"]


def test_output_names():
    assert output_name(["notes"], "notes") == "notes_Anonymised"
    assert output_name(["notes", "NOTES_anonymised"], "notes") == "notes_Anonymised_1"
    assert output_name(["n", "n_Anonymised", "n_Anonymised_1"], "n") == "n_Anonymised_2"
    assert output_names(["a", "A b"], ["a", "A b"]) == {"a": "a_Anonymised", "A b": "A b_Anonymised"}


def test_options():
    assert len(ENTITY_OPTIONS) == 10
    assert types_for_labels(["Phone numbers"]) == ["PHONE_NUMBER"]
    assert set(ENTITY_OPTIONS.values()) - set(DEFAULT_ENTITY_TYPES) == {"LOCATION", "DATE_TIME", "ORGANIZATION"}
    assert len(threshold_steps()) == 17 and threshold_steps()[0] == 0.1 and threshold_steps()[-1] == 0.9
    with pytest.raises(ValueError):
        types_for_labels(["Shoe sizes"])


def test_validation_fails_early(spark):
    df = spark.range(1).withColumn("text", F.lit("x"))
    for bad in (
        dict(columns=[]),
        dict(columns=["nope"]),
        dict(entity_types=[]),
        dict(entity_types=["NOPE"]),
        dict(threshold=1.5),
        dict(columns=["text", "text"]),
    ):
        with pytest.raises(ValueError):
            anonymise(df, **bad)


def test_several_columns_and_odd_names(spark):
    df = spark.createDataFrame([Row(**{"my text.1": "Mr X", "note`s": "AB1 2DD", "n": 5})])
    result = anonymise(df, style=STYLE_ENTITY_TAGS)
    assert result.data.columns == ["my text.1", "note`s", "n", "my text.1_Anonymised", "note`s_Anonymised"]
    assert tuple(result.data.first())[3:] == ("<PERSON>", "<POSTCODE>")


def test_numbers_are_treated_as_text(spark):
    df = spark.createDataFrame([(7700900123, True), (None, None)], "phone_text bigint, note boolean")
    got = anonymise(df, style=STYLE_ENTITY_TAGS).data.collect()
    assert [tuple(r)[2:] for r in got] == [("<PHONE_NUMBER>", "true"), ("", "")]


def test_report_schemas(spark):
    df = spark.createDataFrame([(0, "Mr X met Bob")], "row_index int, text string")
    result = anonymise(df, row_index="row_index")
    assert [(f.name, f.dataType.simpleString()) for f in result.detections().schema] == [
        ("source_column", "string"), ("output_column", "string"), ("row_index", "int"), ("entity_type", "string"),
        ("score", "double"), ("original_text", "string"), ("start", "int"), ("end", "int"),
    ]
    assert [(f.name, f.dataType.simpleString()) for f in result.residuals().schema] == [
        ("source_column", "string"), ("output_column", "string"), ("row_index", "int"), ("label", "string"), ("text", "string"),
    ]
    assert result.stats().columns == [
        "records_processed", "columns_anonymised", "pii_entities_detected",
        "rows_with_possible_residual_items", "processed_cells", "total_cells",
    ]


def test_stats_count_cells_not_rows(spark):
    df = spark.createDataFrame([("see Bob", "see Tim"), ("Mr X", None)], "text string, note string")
    row = anonymise(df).stats().first()
    assert tuple(row) == (2, 2, 1, 2, 4, 4)


def test_stats_of_an_empty_table(spark):
    assert tuple(anonymise(spark.createDataFrame([], "text string")).stats().first()) == (0, 1, 0, 0, 0, 0)


def test_outputs(spark, tmp_path):
    df = spark.createDataFrame(
        [(0, "Mr X; met Bob", float("nan")), (1, None, 1.5)], "id int, text string, v double"
    )
    paths = write_outputs(anonymise(df, key="id"), str(tmp_path / "out"), str(tmp_path / "stage"))
    assert set(paths) == {DATA, DETECTIONS, RESIDUALS, STATS}
    data = spark.read.parquet(paths[DATA]).orderBy("id").collect()
    assert [tuple(r) for r in data] == [(0, "Mr X; met Bob", None, "<REDACTED>; met Bob"), (1, None, 1.5, "")]
    quiet = anonymise(df.filter("id = 1"), key="id")
    paths = write_outputs(quiet, str(tmp_path / "out2"), str(tmp_path / "stage2"), with_report=False)
    assert set(paths) == {DATA, STATS}


def test_csv_source(spark, tmp_path):
    tokens = [t for t in CSV_NA_TOKENS if t]
    lines = ["id,flag,amount,Remark"] + [f"{i},True,1.5,{t}" for i, t in enumerate(tokens)]
    lines += ['98,False,N/A,"two\nlines, ""quoted"""', "007,true,2e3,na"]
    path = tmp_path / "Table.CSV"
    path.write_text("\n".join(lines) + "\n")
    df = load_table(spark, str(path))
    assert [t for _, t in df.dtypes] == ["bigint", "boolean", "double", "string"]
    rows = {r["id"]: r for r in df.collect()}
    assert all(rows[i]["Remark"] is None for i in range(len(tokens)) if i != 7)
    assert rows[98]["Remark"] == 'two\nlines, "quoted"' and rows[98]["amount"] is None
    typed = read_csv(spark, str(path), schema="id string, flag string, amount double, Remark string")
    assert {r["id"] for r in typed.collect()} >= {"007", "98"}


def test_workbooks_are_refused(spark):
    with pytest.raises(ValueError):
        load_table(spark, "/tmp/x.XLSX")


def test_row_index_by_file(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1000).repartition(7).write.parquet(path)
    rows = read_parquet_with_index(spark, path).collect()
    assert sorted(r["row_index"] for r in rows) == list(range(1000))
    plain = [r["id"] for r in spark.read.parquet(path).withColumn("f", F.col("_metadata.file_path")).withColumn("p", F.col("_metadata.row_index")).orderBy("f", "p").collect()]
    assert [r["id"] for r in sorted(rows, key=lambda r: r["row_index"])] == plain


def test_row_index_by_order(spark):
    df = spark.range(0, 500).select((F.lit(499) - F.col("id")).alias("k")).repartition(5)
    rows = with_row_index(df, ["k"]).collect()
    assert all(r["k"] == r["row_index"] for r in rows) and len(rows) == 500


def test_annotations(spark):
    df = spark.createDataFrame(
        [(0, "Sarah Jones saw Tenant in Leeds"), (1, "Sarah Jones"), (2, "nobody")], "id int, text string"
    )
    ents = spark.createDataFrame(
        [(0, "text", 0, 5, "PERSON"), (0, "text", 6, 11, "PER"), (0, "text", 16, 22, "PERSON"),
         (0, "text", 26, 31, "GPE"), (1, "text", 0, 11, "PRODUCT"), (1, "other", 0, 1, "PERSON")],
        "id int, source_column string, start int, end int, label string",
    )
    toks = spark.createDataFrame(
        [(1, "text", 0, 5, "Sarah", "PROPN"), (1, "text", 6, 11, "Jones", "PROPN"), (0, "text", 16, 22, "Tenant", "PROPN"),
         (2, "text", 0, 6, "nobody", "PROPN")],
        "id int, source_column string, start int, end int, text string, pos string",
    )
    joined = attach_tokens(attach_entities(df, ents, "id", {"text": "ents"}), toks, "id", {"text": "toks"})
    result = anonymise(
        joined, columns=["text"], key="id", style=STYLE_ENTITY_TAGS, entities={"text": "ents"}, tokens={"text": "toks"},
        entity_types=["PERSON", "LOCATION"],
    )
    assert [tuple(r) for r in sorted(result.data.collect())] == [
        (0, "Sarah Jones saw Tenant in Leeds", "<PERSON> saw Tenant in <LOCATION>"),
        (1, "Sarah Jones", "Sarah Jones"),
        (2, "nobody", "nobody"),
    ]
    assert [(r["id"], r["label"], r["text"]) for r in result.residuals().collect()] == [
        (1, "POSSIBLE_MISSED_NAME (model tagged PRODUCT)", "Sarah Jones")
    ]
