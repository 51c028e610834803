"""Tables of one row group are dealt out to tasks; streams read tables of one file or of many."""

import pytest
from pyspark.sql import functions as F

from quillmask.functions.spans import ascii_pattern, find_matches
from suite import queries


def test_short_rows_of_one_row_group_fill_several_tasks(spark, sf, monkeypatch):
    monkeypatch.setattr(queries, "TASK_ROWS", 100)
    for frame in (queries.comment_table(spark, sf), queries.redact_partial_overlap(spark, sf)):
        assert frame.rdd.getNumPartitions() >= 2
    rows = queries.comment_table(spark, sf)
    assert rows.rdd.getNumPartitions() == 15 and rows.select("row_id").distinct().count() == rows.count() == 1500


@pytest.mark.parametrize("files", [1, 3])
def test_streams_read_tables_that_are_folders(spark, sf, tmp_path, files):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    turns.repartition(files).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.stream_anonymise(spark, str(tmp_path)).count() == turns.count()


def test_streams_read_tables_that_are_files(spark, sf, tmp_path):
    """Of several files side by side only the one that is named; folders keep their partition columns."""

    def drained(folder, name):
        query = queries.stream_of(spark, folder, "events").writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name)

    events = spark.read.parquet(f"{sf}/events.parquet")
    assert sorted(drained(sf, "of_a_file").collect()) == sorted(events.collect())
    events.withColumn("day", F.dayofmonth("ts")).write.partitionBy("day").parquet(f"{tmp_path}/events.parquet")
    parts = drained(str(tmp_path), "of_a_folder")
    assert parts.count() == events.count() and parts.filter(F.dayofmonth("ts") == F.col("day")).count() == events.count()


def test_matches_in_plain_and_other_texts(spark):
    """The pattern for ASCII, the Unicode one, and texts that hold the mark between matches."""
    assert ascii_pattern(r"(?iU)\bREF \d+\b") == r"(?i)\bREF \d+\b" and ascii_pattern(r"(?U)\d") == r"\d"
    assert ascii_pattern(r"(?iU)[’a]") is None and ascii_pattern(r"(?U)\p{L}") is None and ascii_pattern(r"\d") is None
    pattern = r"(?iU)\b\d{2}k\b"
    cases = {
        "": [],
        "12k": [(0, 3, "12k")],
        "a 12K,34k b": [(2, 5, "12K"), (6, 9, "34k")],
        "é 12K ٣٤k 56k9": [(2, 5, "12K"), (6, 9, "٣٤k")],
        "\0 12k \0\0 34K\0": [(2, 5, "12k"), (9, 12, "34K")],
        "\0none": [],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: [(m.start, m.end, m.text) for m in r.m] for r in df.select("t", F.expr(find_matches("t", pattern)).alias("m")).collect()}
    assert got == cases
