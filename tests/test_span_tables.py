"""Span tables, allow-list tables and samples against plain models."""

import random

import pytest
from pyspark.sql import functions as F

from quillmask import anonymise
from quillmask.operators.allowed import attach_allowed
from quillmask.operators.quality import review_sample
from quillmask.operators.span_tables import islands, uncovered, with_exact_label


def spans(spark, rows):
    return spark.createDataFrame(rows, "cell string, start int, end int")


def random_rows(seed, cells=6, n=60, length=90):
    lot = random.Random(seed)
    out = []
    for c in range(cells):
        for _ in range(lot.randrange(n)):
            start = lot.randrange(length)
            out.append((f"c{c}", start, start + lot.choice([0, 1, 2, 5, 9, 40])))
    return out


@pytest.mark.parametrize("bin_size", [1, 7, 512])
def test_uncovered_equals_a_comparison_of_all(spark, bin_size):
    own, targets = random_rows(1), random_rows(2, n=9)
    got = uncovered(spans(spark, own), spans(spark, targets), "cell", bin_size).collect()
    want = [r for r in own if not any(t[0] == r[0] and t[1] <= r[1] and r[2] <= t[2] for t in targets)]
    assert sorted(map(tuple, got)) == sorted(want) and want
    assert uncovered(spans(spark, own), spans(spark, []), "cell", bin_size).count() == len(own)
    assert uncovered(spans(spark, []), spans(spark, targets), "cell", bin_size).count() == 0


@pytest.mark.parametrize("slack", [-1, 0, 1])
@pytest.mark.parametrize("bin_size", [1, 7, 512])
def test_islands_equal_a_loop(spark, slack, bin_size):
    rows = [r for r in random_rows(3, n=25, length=200)]
    want = []
    for start_cell in sorted({r[0] for r in rows}):
        reach, open_at, n = None, None, 0
        for _, start, end in sorted(r for r in rows if r[0] == start_cell):
            if reach is None or start > reach + slack:
                if open_at is not None:
                    want.append((start_cell, open_at, reach, n))
                open_at, reach, n = start, end, 1
            else:
                reach, n = max(reach, end), n + 1
        want.append((start_cell, open_at, reach, n))
    got = islands(spans(spark, rows), "cell", slack, bin_size, n=F.count("*")).collect()
    # equal spans without a character are one island
    assert sorted(tuple(r)[:3] for r in got) == sorted({w[:3] for w in want})
    assert sum(r["n"] for r in got) == len(rows)


def test_one_cell_of_many_spans_is_not_one_task(spark):
    """100,000 spans of one cell, one island, walked in many bins; nothing is joined by range."""
    n = 100_000
    chain = spark.range(n).selectExpr("'x' AS cell", "cast(id * 3 AS int) AS start", "cast(id * 3 + 4 AS int) AS end")
    assert [tuple(r) for r in islands(chain, "cell", n=F.count("*")).collect()] == [("x", 0, 3 * n + 1, n)]
    words = spark.range(n).selectExpr("'x' AS cell", "cast(id * 3 AS int) AS start", "cast(id * 3 + 1 AS int) AS end")
    targets = spark.range(n // 2).selectExpr("'x' AS cell", "cast(id * 6 AS int) AS start", "cast(id * 6 + 2 AS int) AS end")
    left = uncovered(words, targets, "cell")
    assert left.count() == n // 2 and left.filter("start % 6 = 0").count() == 0
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "hashpartitioning(cell" in plan and "__bin" in plan


def test_spans_are_found_once(spark):
    """However often a plan reads them, and with a shuffle only where no cell is wider than a bin."""
    seen = spark.sparkContext.accumulator(0)

    def counted(rows):
        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return spans(spark, rows).mapInArrow(count, "cell string, start int, end int")

    for rows in (random_rows(4), [("a", 0, 3), ("a", 600, 700), ("a", 2, 700), ("b", 1, 2)]):
        before = seen.value
        joined = islands(counted(rows), "cell", n=F.count("*"))
        assert sum(r["n"] for r in joined.collect()) == len(rows) and seen.value - before == len(rows)
        before = seen.value
        assert uncovered(counted(rows), counted(rows), "cell").count() == 0 and seen.value - before == 2 * len(rows)
    short = islands(spans(spark, random_rows(4)), "cell", n=F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert short.count("Exchange hashpartitioning") == 1 and "Join" not in short


def test_spans_without_a_place_are_left_out(spark):
    """And columns keep their order and values, whatever their names."""
    rows = spark.createDataFrame([("a", "x", 0, 2, 7), ("a", "y", None, 2, 8), (None, "z", 0, 2, 9), ("a", "w", 9, 12, 10)], "cell string, `__kind` string, start int, `end` int, `a.b` int")
    left = uncovered(rows, spans(spark, [("a", 9, 12), ("a", None, 99), (None, 0, 9)]), "cell")
    assert left.columns == rows.columns and [tuple(r) for r in left.collect()] == [("a", "x", 0, 2, 7)]
    assert sorted(tuple(r) for r in islands(rows, "cell", n=F.count("*")).collect()) == [("a", 0, 2, 1), ("a", 9, 12, 1)]


def test_exact_label_takes_the_greatest(spark):
    own = spans(spark, [("a", 0, 2), ("a", 0, 3), ("b", 0, 2)])
    named = spark.createDataFrame([("a", 0, 2, "X"), ("a", 0, 2, "Z"), ("a", 0, 2, None)], "cell string, start int, end int, label string")
    got = {(r.cell, r.start, r.end): r.label for r in with_exact_label(own, named, "cell").collect()}
    assert got == {("a", 0, 2): "Z", ("a", 0, 3): None, ("b", 0, 2): None}


def test_allowed_texts_from_a_table(spark):
    df = spark.createDataFrame([(0, "Mr Brown, Mr Green"), (1, "mr brown"), (2, None), (3, "Mr Green")], "id int, text string")
    terms = spark.createDataFrame([("Mr Brown",), ("mr green",), (None,), ("Mr Brown",)], "term string")
    listed = attach_allowed(df, anonymise(df, key="id"), terms, {"text": "fine"})
    result = anonymise(listed, key="id", allowed={"text": "fine"})
    assert result.data.columns == ["id", "text", "text_Anonymised"]
    got = {r["id"]: r["text_Anonymised"] for r in result.data.collect()}
    assert got == {0: "Mr Brown, <REDACTED>", 1: "<REDACTED>", 2: "", 3: "<REDACTED>"}
    with pytest.raises(ValueError, match="key"):
        attach_allowed(df, anonymise(df), terms, {"text": "fine"})


def test_samples_do_not_depend_on_partitions(spark):
    rows = [(f"k{i % 300}", "ab"[i % 2] if i % 5 else None, i) for i in range(900)]
    df = spark.createDataFrame(rows, "name string, kind string, n int")
    for how in ({}, {"strata": "kind"}, {"strata": ["kind", "name"], "size": 1}):
        settings = {"size": 40, "seed": 3, **how}
        first = sorted(map(str, review_sample(df, ["name", "n"], **settings).collect()))
        again = sorted(map(str, review_sample(df.repartition(7).orderBy("n"), ["name", "n"], **settings).collect()))
        assert first == again and first
    each = review_sample(df, "name", size=40, strata="kind").groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in each} == {"a": 40, "b": 40, None: 40}
    assert review_sample(df, "name", size=40, seed=1).count() == 40
