"""The registered queries: each takes (spark, folder of parquet tables)."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmask import STYLE_ENTITY_TAGS, STYLE_GENERIC, anonymise
from quillmask import catalogue as cat
from quillmask.catalogue import DEFAULT_CATALOGUE
from quillmask.functions import algebra
from quillmask.functions.spans import find_matches
from quillmask.operators.allowed import attach_allowed
from quillmask.operators.annotations import attach_annotations, attach_entities, dictionary_entities
from quillmask.operators.detection import candidates, raw_matches
from quillmask.operators.lemmas import with_lemma_table
from quillmask.operators.quality import review_sample, span_scores, threshold_sweep
from quillmask.operators.residual import findings_of
from quillmask.operators.span_tables import islands, uncovered, with_exact_label
from quillmask.operators.sql_functions import register_functions
from quillmask.plans import staging
from suite.comments import comments
from quillmask.sources.quarantine import read_csv_quarantined
from quillmask.sources.readers import read_csv, read_parquet, read_parquet_stream
from quillmask.sources.row_index import read_csv_with_index, read_parquet_with_index, with_row_index
from quillmask.sources.writers import DATA, DETECTIONS, RESIDUALS, STATS, nan_to_null, write_outputs
from quillmask.streaming.streams import detection_counts, read_stream_outputs, write_stream, write_stream_outputs
from suite.relations import (
    ALLOWED_SQL,
    CUSTOMER_NOTES_SQL,
    DICTIONARY_SQL,
    ENTITIES_SPARK,
    EVENT_MESSAGE_SQL,
    FAULTY_LINES_SQL,
    FORMS,
    FORMS_NOTES_SQL,
    LARGE_DICTIONARY_SQL,
    MEASURES_SQL,
    NA_SQL,
    OVERLAP_SQL,
    TOKEN_POS_SPARK,
)

Query = Callable[[SparkSession, str], DataFrame]

# Numbers that no detector may redact in residual_own_allow_list.
OWN_ALLOWED = tuple(f"0191 {a} {b}" for a in range(100, 110) for b in range(1000, 1010))
ALL_TYPES = tuple(cat.ENTITY_OPTIONS.values())
DETECTORS = {d.name: d for d in DEFAULT_CATALOGUE.detectors}
SPAN = ["entity_type", "start", "end", "score"]


# Tasks that a table's rows are dealt out to, for tables of a single row group.
PARTITIONS = int(os.environ["SUITE_PARTITIONS"]) if "SUITE_PARTITIONS" in os.environ else None
# Short rows that one task gets otherwise: a row group holds a million of them, which is many minutes of detection.
TASK_ROWS = 8192
# Lines of a CSV file with quoted line breaks, which one task writes and one reads.
FILE_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name_: str, *columns: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name_}.parquet", list(columns) or None, PARTITIONS)


def task_count(rows: DataFrame) -> int:
    """As many tasks as rows of a few words need; counting reads the files' footers only."""
    return PARTITIONS or max(1, -(-rows.count() // TASK_ROWS))


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of a few words, which are small to read and long to search, dealt out to more tasks."""
    tasks = task_count(rows)
    return rows if PARTITIONS or tasks == 1 else rows.repartition(tasks)


def shared_folder(spark: SparkSession) -> str:
    """A folder for what a query stores; a local session without one gets its own."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.master.startswith("local"):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="quillmask-"))
    return staging.shared_folder(spark)


def comment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comments(dealt(table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority")))


def spark_sql(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Run a shared relation: identifier quotes differ, tables come as arguments."""
    for table_name in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {table_name}\b", rf"\1 {{{table_name}}}", sql)
    return spark.sql(sql.replace('"', "`"), **tables)


def rows_of(df: DataFrame, keys: list[str], array: str, *fields: str) -> DataFrame:
    """One row per array element; the array is an expression to keep it computed once."""
    return df.select(*keys, F.explode(F.expr(f"filter({array}, e -> e is not null)")).alias("e")).select(
        *keys, *[f"e.{f}" for f in fields]
    )


# Detectors ------------------------------------------------------------------


def documents_matches(detector: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents", "doc_id", "text")
        found = docs.select("doc_id", F.expr(raw_matches("text", DETECTORS[detector])).alias("found"))
        return rows_of(found, ["doc_id"], "found", "start", "end", "text").withColumn("detector", F.lit(detector))

    return run


def residual_long_digits_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    pattern = [p for p in cat.RESIDUAL_PATTERNS if p.label == "LONG_DIGIT_SEQUENCE"]
    found = docs.select("doc_id", F.expr(findings_of("text", pattern)).alias("found"))
    return rows_of(found, ["doc_id"], "found", "label", "start", "end", "text")


def cells(df: DataFrame) -> DataFrame:
    """Comments as one row per cell."""
    stacked = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("source_column"), F.coalesce(c, F.lit("")).alias("t"))
                for c in ("notes", "description")
            ]
        )
    )
    return df.select("row_id", stacked.alias("c")).select("row_id", "c.source_column", "c.t")


CELL = ["row_id", "source_column"]


def comment_matches(*detectors: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = ", ".join(
            f"transform({raw_matches('t', DETECTORS[d])}, m -> named_struct('detector', '{d}', "
            f"'start', m.start, 'end', m.end, 'text', m.text))"
            for d in detectors
        )
        hits = cells(comment_table(spark, sf_dir)).select(*CELL, F.expr(f"concat({found})").alias("found"))
        return rows_of(hits, CELL, "found", "detector", "start", "end", "text")

    return run


# Scoring and span algebra ---------------------------------------------------


def scored_cells(spark: SparkSession, sf_dir: str, threshold: float) -> DataFrame:
    base = cells(comment_table(spark, sf_dir))
    on = DEFAULT_CATALOGUE.active(ALL_TYPES, threshold)
    return base.withColumn("spans", F.expr(candidates("t", on, DEFAULT_CATALOGUE, ALL_TYPES, threshold)))


def context_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(scored_cells(spark, sf_dir, 0.0), CELL, "spans", *SPAN, "text")


def dedup_same_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = scored_cells(spark, sf_dir, 0.0).withColumn("kept", F.expr(algebra.drop_contained("spans")))
    return rows_of(kept, CELL, "kept", *SPAN, "text")


def threshold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = scored_cells(spark, sf_dir, 0.6).withColumn("kept", F.expr(algebra.drop_contained("spans")))
    return rows_of(kept, CELL, "kept", *SPAN, "text")


def low_threshold(spark: SparkSession, sf_dir: str):
    """All types at a threshold low enough for spans to overlap and clash."""
    return anonymise(
        cells(comment_table(spark, sf_dir)),
        columns=["t"],
        entity_types=ALL_TYPES,
        style=STYLE_ENTITY_TAGS,
        threshold=0.2,
        key=CELL,
    )


def step_rows(result, step: str, keys: list[str], *fields: str) -> DataFrame:
    """Rows of one working column, over all source columns."""
    parts = [
        f"transform({getattr(c, step)}, s -> named_struct('source_column', '{c.source}', 's', s))"
        for c in result.cells
    ]
    flat = result.wide.select(*keys, F.explode(F.expr(f"concat({', '.join(parts)})")).alias("r"))
    source = [] if "source_column" in keys else ["r.source_column"]
    return flat.select(*keys, *source, *[f"r.s.{f}" for f in fields])


def merge_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return step_rows(low_threshold(spark, sf_dir), "merged", CELL, *SPAN)


def conflict_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return step_rows(low_threshold(spark, sf_dir), "spans", CELL, *SPAN)


def redact_low_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = low_threshold(spark, sf_dir)
    return result.data.select(*CELL, F.col(result.output_columns[0]).alias("redacted"))


# Annotations ----------------------------------------------------------------


def annotated(spark: SparkSession, sf_dir: str, tokens: bool = False, **settings):
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority")
    df, tasks = comments(orders), task_count(orders)
    entities = spark.sql(ENTITIES_SPARK, comments=df)
    given = {"entities": {"notes": "ents_n", "description": "ents_d"}}
    if tokens:
        tagged = spark.sql(TOKEN_POS_SPARK, comments=df)
        given["tokens"] = {"notes": "toks_n", "description": "toks_d"}
        joined = attach_annotations(df, entities, tagged, "row_id", given["entities"], given["tokens"], tasks)
    else:
        joined = attach_entities(df, entities, "row_id", given["entities"], tasks)
    settings = {"entity_types": ALL_TYPES, "threshold": 0.45, **settings}
    return anonymise(
        joined, columns=["notes", "description"], style=STYLE_ENTITY_TAGS, key="row_id", **given, **settings
    )


def allow_list_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return step_rows(annotated(spark, sf_dir), "detections", ["row_id"], *SPAN, "text")


def annotation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allow_list_filter(spark, sf_dir).filter(F.col("score") == cat.MODEL_SCORE)


def merge_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return step_rows(annotated(spark, sf_dir), "joined", ["row_id"], *SPAN)


def redact_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotated(spark, sf_dir).data.select("row_id", "notes_Anonymised", "description_Anonymised")


def missed_rows(result, keys: list[str]) -> DataFrame:
    flat = step_rows(result, "findings", keys, "start", "end", "label", "text", "scope")
    return flat.filter(F.col("scope") == "input").drop("scope")


def missed_names_off_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = annotated(spark, sf_dir, tokens=True, entity_types=cat.DEFAULT_ENTITY_TYPES)
    return missed_rows(result, ["row_id"])


def customer_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    customer = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    return spark_sql(spark, CUSTOMER_NOTES_SQL, customer=customer, nation=nation, region=region)


def gazetteer_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary too large for a broadcast, with a term that every note holds."""
    shared_folder(spark)
    dictionary = spark_sql(spark, LARGE_DICTIONARY_SQL, ids=spark.range(200_000))
    return dictionary_entities(customer_notes(spark, sf_dir), "note", "c_custkey", dictionary, broadcast_bytes=1 << 20)


def context_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with scores lifted by other forms of the context words."""
    notes = spark_sql(spark, FORMS_NOTES_SQL, customer=dealt(table(spark, sf_dir, "customer", "c_custkey")))
    forms = spark.createDataFrame(list(FORMS.items()), "form string, lemma string")
    own = with_lemma_table(DEFAULT_CATALOGUE, forms)
    on = own.active(ALL_TYPES, 0.0)
    spans = notes.withColumn("spans", F.expr(candidates("note", on, own, ALL_TYPES, 0.0)))
    return rows_of(spans, ["c_custkey"], "spans", *SPAN, "text")


def gazetteer_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    notes = customer_notes(spark, sf_dir)
    dictionary = spark_sql(spark, DICTIONARY_SQL, nation=nation, region=region)
    return dictionary_entities(notes, "note", "c_custkey", dictionary)


# Redaction and reports ------------------------------------------------------


def standard(spark: SparkSession, sf_dir: str, **settings):
    """The recommended run over the comments."""
    settings = {"style": STYLE_ENTITY_TAGS, "threshold": cat.INTERACTIVE_THRESHOLD, **settings}
    return anonymise(comment_table(spark, sf_dir), row_index="row_id", **settings)


def redact_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standard(spark, sf_dir, style=STYLE_GENERIC).data.select("row_id", "notes_Anonymised", "description_Anonymised")


def redact_entity_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standard(spark, sf_dir).data.select("row_id", "notes_Anonymised", "description_Anonymised")


def redact_two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standard(spark, sf_dir).data


def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter on output columns."""
    return standard(spark, sf_dir).data.filter(
        "notes_Anonymised <> notes OR description_Anonymised <> description"
    )


def flagged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = standard(spark, sf_dir).residual_flags()
    return flagged.select("row_index", "source_column", F.size("findings").cast("long").alias("n_findings"))


def residual_own_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an own list allows stays in clear and is flagged for review."""
    own = replace(DEFAULT_CATALOGUE, allow_list=("Mr Brown", *OWN_ALLOWED))
    result = standard(spark, sf_dir, catalogue=own, key="row_id")
    flat = step_rows(result, "findings", ["row_id"], "label", "text", "scope")
    return flat.filter("scope = 'output'").drop("scope")


def detection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standard(spark, sf_dir).detections()


def residual_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standard(spark, sf_dir).residuals()


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standard(spark, sf_dir).stats()


def residual_tag_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only e-mails are redacted, so tags already in the text stay and must not be flagged."""
    result = standard(spark, sf_dir, entity_types=["EMAIL_ADDRESS"], key="row_id")
    return step_rows(result, "findings", ["row_id"], "label", "text")


def missed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missed_rows(standard(spark, sf_dir), ["row_id"])


def written(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    return write_outputs(standard(spark, sf_dir), shared_folder(spark))


def outputs_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(written(spark, sf_dir)[DATA])


def outputs_detection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(written(spark, sf_dir)[DETECTIONS])


def outputs_residual_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(written(spark, sf_dir)[RESIDUALS])


# Whole texts ----------------------------------------------------------------


def document_run(spark: SparkSession, sf_dir: str, columns: list[str], **settings):
    settings = {"style": STYLE_ENTITY_TAGS, "threshold": 0.45, **settings}
    return anonymise(table(spark, sf_dir, "documents", *columns), key="doc_id", **settings)


def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text column is picked by its name."""
    result = document_run(spark, sf_dir, [], entity_types=ALL_TYPES)
    return result.data


def detections_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = document_run(spark, sf_dir, ["doc_id", "text"], entity_types=ALL_TYPES).detections()
    return found.drop("source_column", "output_column")


def residuals_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_run(spark, sf_dir, ["doc_id", "text"]).residuals().select("doc_id", "label", "text")


def redact_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return anonymise(turns, entity_types=ALL_TYPES, style=STYLE_ENTITY_TAGS, threshold=0.45).data


def redact_pages_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return anonymise(pages, columns=["html"], style=STYLE_ENTITY_TAGS, threshold=0.45).data


def redact_pages_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No column name suggests free text, so the first column is taken."""
    pages = table(spark, sf_dir, "pages")
    return anonymise(pages, style=STYLE_ENTITY_TAGS, threshold=0.45).data


# Sources and sinks ----------------------------------------------------------


def csv_na_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export to CSV, read back: quoted line breaks survive, null tokens and types are found."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    path = shared_folder(spark) + ".csv"
    spark.sql(NA_SQL.replace("FROM orders", "FROM {orders}"), orders=orders).write.csv(
        path, header=True, quote='"', escape='"'
    )
    return read_csv(spark, path)


def write_in_files(lines: DataFrame, keys: DataFrame, path: str) -> str:
    """Lines in the order of k as files that follow one another, each with the header line, whose k is -1; gives their glob.

    One task sorts and one reads FILE_ROWS lines or so, cut by quantiles of the keys.
    """
    files = max(1, -(-keys.count() // FILE_ROWS))
    cuts = [i / files for i in range(1, files)]
    bounds = keys.approxQuantile(keys.columns[0], cuts, 0.1 / files) if cuts else []
    part = reduce(lambda n, b: n + (F.col("k") >= b).cast("int"), bounds, F.lit(0))
    headers = lines.filter("k = -1").crossJoin(lines.sparkSession.range(files).select(F.col("id").cast("int").alias("part")))
    dealt = lines.filter("k <> -1").withColumn("part", part).unionByName(headers).withColumn("part", F.lpad(F.col("part").cast("string"), 9, "0"))
    dealt.repartition(files, "part").sortWithinPartitions("part", "k").select("part", "line").write.partitionBy("part").text(path)
    return f"{path}/part=*"


def csv_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good and faulty rows of files that follow one another, each with its place in them."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    lines = spark_sql(spark, FAULTY_LINES_SQL, orders=orders)
    path = write_in_files(lines, orders.select("o_orderkey"), shared_folder(spark) + ".csv")
    good, bad = read_csv_quarantined(spark, path, "row_id bigint, amount bigint, remark string")
    nothing = F.lit(None).cast("string")
    return good.select("row_index", "row_id", "amount", "remark", nothing.alias("reason")).unionByName(
        bad.select("row_index", F.lit(None).cast("bigint").alias("row_id"), F.lit(None).cast("bigint").alias("amount"), F.col("record").alias("remark"), "reason")
    )


def sql_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run as SQL text: redacted cells, their spans and what may be left."""
    register_functions(spark, style=STYLE_ENTITY_TAGS, threshold=cat.INTERACTIVE_THRESHOLD)
    return spark.sql(
        """SELECT row_id, source_column, quillmask_redact(t) AS redacted, size(quillmask_detect(t)) AS n_spans,
          array_join(array_sort(transform(quillmask_leftovers(t), f -> concat(f.label, '=', f.text))), '|') AS leftovers FROM {cells}""",
        cells=cells(comment_table(spark, sf_dir)),
    )


def nan_to_null_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_totalprice")
    sql = MEASURES_SQL.replace("FROM orders", "FROM {orders}").replace("{nan}", "double('NaN')")
    return nan_to_null(spark.sql(sql, orders=orders))


def row_index_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of the rows of CSV files that are split into blocks."""
    path = shared_folder(spark) + ".csv"
    table(spark, sf_dir, "orders", "o_orderkey").coalesce(1).sortWithinPartitions("o_orderkey").write.csv(path, header=True)
    return read_csv_with_index(spark, path, multi_line=False)


def row_index_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_folder(spark)
    return read_parquet_with_index(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", "row_index")


def row_index_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_folder(spark)
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    return with_row_index(orders, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "row_index")


# Review aids and streams ----------------------------------------------------


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = standard(spark, sf_dir, entity_types=ALL_TYPES, threshold=cat.MIN_THRESHOLD).detections()
    return threshold_sweep(found)


def qa_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_sample(comment_table(spark, sf_dir).select("row_id", "notes"), "row_id")


def qa_sample_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections to review: so many of each type, by a key of several columns, text among them."""
    found = standard(spark, sf_dir, entity_types=ALL_TYPES).detections().drop("output_column")
    return review_sample(found, ["source_column", "row_index", "start", "end"], size=25, seed=7, strata="entity_type")


def span_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = comment_table(spark, sf_dir)
    found = anonymise(df, threshold=0.45, key="row_id").detections()
    people = spark.sql(ENTITIES_SPARK, comments=df).filter("label IN ('PERSON', 'PER')")
    mobiles = rows_of(
        cells(df).select(*CELL, F.expr(raw_matches("t", DETECTORS["uk_mobile"])).alias("found")), CELL, "found", "start", "end"
    )
    gold = people.select(*CELL, F.lit("PERSON").alias("entity_type"), "start", "end").unionByName(
        mobiles.withColumn("entity_type", F.lit("PHONE_NUMBER"))
    )
    return span_scores(found, gold, CELL)


# Span tables ----------------------------------------------------------------


def span_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of all types as a table, before overlaps are resolved."""
    return step_rows(low_threshold(spark, sf_dir), "detections", CELL, *SPAN)


def islands_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps joined by windows over the table of spans, without the texts."""
    shared_folder(spark)
    return islands(span_table(spark, sf_dir), [*CELL, "entity_type"], score=F.max("score"))


def range_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words outside all detections, with the label of the annotation of exactly their place."""
    shared_folder(spark)
    df = comment_table(spark, sf_dir)
    words = rows_of(cells(df).select(*CELL, F.expr(find_matches("t", cat.WORD)).alias("w")), CELL, "w", "start", "end")
    outside = uncovered(words, span_table(spark, sf_dir), CELL)
    return with_exact_label(outside, spark.sql(ENTITIES_SPARK, comments=df), CELL)


def allow_list_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of 100,000 allowed texts; half of the mobile numbers of one kind of comment are among them."""
    df = comment_table(spark, sf_dir)
    allowed = spark.range(100_000).selectExpr(ALLOWED_SQL)
    columns = {"notes": "allowed_n", "description": "allowed_d"}
    settings = {"style": STYLE_ENTITY_TAGS, "threshold": cat.INTERACTIVE_THRESHOLD, "key": "row_id"}
    listed = attach_allowed(df, anonymise(df, **settings), allowed, columns)
    return anonymise(listed, allowed=columns, **settings).data


def redact_partial_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of two types that overlap in part: the earlier one ends where the later starts."""
    notes = spark_sql(spark, OVERLAP_SQL, customer=dealt(table(spark, sf_dir, "customer", "c_custkey")))
    return anonymise(notes, entity_types=ALL_TYPES, style=STYLE_ENTITY_TAGS, threshold=0.45).data


def stream_of(spark: SparkSession, sf_dir: str, name_: str) -> DataFrame:
    """A table as a stream; it may be one file or a folder of files."""
    return read_parquet_stream(spark, f"{sf_dir}/{name_}.parquet")


def stream_anonymise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a stream, drained into files and read back."""
    turns = stream_of(spark, sf_dir, "conversations")
    result = anonymise(turns, entity_types=ALL_TYPES, style=STYLE_ENTITY_TAGS, threshold=0.45)
    out = shared_folder(spark)
    write_stream(result.data, f"{out}/data", f"{out}/checkpoint", available_now=True).awaitTermination()
    return spark.read.parquet(f"{out}/data")


def stream_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data, detections and findings of a stream of comments that comes in four parts, stopped after two of them."""
    out = shared_folder(spark)
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority")
    orders.repartition(4, "o_orderkey").write.parquet(f"{out}/orders")
    tasks = max(1, task_count(orders) // 4)

    def drain(parts: str) -> None:
        source = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", parts)
        write_stream_outputs(
            comments(source.parquet(f"{out}/orders").repartition(tasks)), f"{out}/outputs", f"{out}/checkpoint", available_now=True,
            key="row_id", row_index="row_id", style=STYLE_ENTITY_TAGS, threshold=cat.INTERACTIVE_THRESHOLD,
        ).awaitTermination()

    drain("part-0000[01]*")
    drain("part-*")
    found = read_stream_outputs(spark, f"{out}/outputs")
    null = F.lit(None).cast("string")
    rows = [
        found[DATA].select(F.lit("data").alias("output"), F.lit(c).alias("source_column"), "row_id", null.alias("label"), F.col(f"{c}_Anonymised").alias("text"))
        for c in ("notes", "description")
    ]
    rows.append(found[DETECTIONS].selectExpr("'detection'", "source_column", "row_index", "entity_type", "original_text"))
    rows.append(found[RESIDUALS].selectExpr("'finding'", "source_column", "row_index", "label", "text"))
    counted = found[STATS].agg(F.sum("pii_entities_detected").cast("string").alias("n"), F.sum("records_processed").alias("rows"))
    rows.append(counted.selectExpr("'counters'", "CAST(NULL AS string)", "rows", "CAST(NULL AS string)", "n"))
    return reduce(DataFrame.union, rows)


def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections per hour over a stream of event messages; only closed windows are out."""
    messages = stream_of(spark, sf_dir, "events").selectExpr("cast(ts AS timestamp) AS ts", f"{EVENT_MESSAGE_SQL} AS message")
    result = anonymise(messages, key="ts", threshold=0.45)
    out = shared_folder(spark)
    counts = detection_counts(result, "ts", "1 hour", "2 hours")
    write_stream(counts, f"{out}/data", f"{out}/checkpoint", available_now=True).awaitTermination()
    starts = F.col("window_start").cast("timestamp_ntz").alias("window_start")
    return spark.read.parquet(f"{out}/data").select(starts, "entity_type", "detections")


QUERIES: dict[str, Query] = {
    "detect_email_documents": documents_matches("email"),
    "detect_phone_intl_documents": documents_matches("phone_international"),
    "detect_bare_digits_documents": documents_matches("code_bare"),
    "residual_long_digits_documents": residual_long_digits_documents,
    "detect_postcode": comment_matches("uk_postcode"),
    "detect_nino_strict": comment_matches("nino_strict"),
    "detect_nino_flex": comment_matches("nino_flexible"),
    "detect_mobile": comment_matches("uk_mobile"),
    "detect_landline": comment_matches("uk_landline"),
    "detect_housing_ref": comment_matches("ref_bh", "ref_rep", "ref_tenancy", "ref_customer", "ref_job"),
    "detect_access_code": comment_matches("code_labelled", "code_bare"),
    "detect_name_label": comment_matches("name_label"),
    "detect_title_name": comment_matches("title_name"),
    "detect_dates": comment_matches("date_iso", "date_numeric", "date_month_name", "date_month_first", "date_month_year", "date_timestamp"),
    "context_boost": context_boost,
    "dedup_same_type": dedup_same_type,
    "threshold_filter": threshold_filter,
    "allow_list_filter": allow_list_filter,
    "annotation_join": annotation_join,
    "merge_overlaps": merge_overlaps,
    "conflict_resolution": conflict_resolution,
    "merge_adjacent": merge_adjacent,
    "redact_generic": redact_generic,
    "redact_entity_tags": redact_entity_tags,
    "redact_two_columns": redact_two_columns,
    "redact_low_threshold": redact_low_threshold,
    "redact_annotated": redact_annotated,
    "detection_report": detection_report,
    "residual_flags": residual_flags,
    "residual_tag_guard": residual_tag_guard,
    "run_stats": run_stats,
    "missed_names": missed_names,
    "missed_names_off_label": missed_names_off_label,
    "gazetteer_detect": gazetteer_detect,
    "changed_rows": changed_rows,
    "flagged_rows": flagged_rows,
    "residual_own_allow_list": residual_own_allow_list,
    "outputs_data": outputs_data,
    "outputs_detection_report": outputs_detection_report,
    "outputs_residual_flags": outputs_residual_flags,
    "redact_documents": redact_documents,
    "detections_documents": detections_documents,
    "residuals_documents": residuals_documents,
    "redact_conversations": redact_conversations,
    "redact_pages_html": redact_pages_html,
    "redact_pages_fallback": redact_pages_fallback,
    "csv_na_normalise": csv_na_normalise,
    "nan_to_null": nan_to_null_query,
    "row_index_csv": row_index_csv,
    "row_index_by_file": row_index_by_file,
    "row_index_by_order": row_index_by_order,
    "threshold_sweep": sweep,
    "qa_sample": qa_sample,
    "span_eval": span_eval,
    "stream_anonymise": stream_anonymise,
    "stream_window_counts": stream_window_counts,
    "stream_outputs": stream_outputs,
    "islands_relational": islands_relational,
    "range_anti_join": range_anti_join,
    "allow_list_table": allow_list_table,
    "qa_sample_strata": qa_sample_strata,
    "redact_partial_overlap": redact_partial_overlap,
    "gazetteer_large": gazetteer_large,
    "context_lemmas": context_lemmas,
    "csv_quarantine": csv_quarantine,
    "sql_redact": sql_redact,
}
