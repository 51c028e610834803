"""Hard negatives against SQL and against a plain search."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmask.llm import blocks, negatives


def plain(rows, scale, positives, k, low=50, high=95):
    """Rows of the result by comparing every anchor with every row."""
    whole = [
        (n, i, np.floor(np.array(v, float) * scale).astype(int), label)
        for n, (i, v, label) in enumerate(rows)
        if i is not None and label is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()
    ]
    out = []
    for n, i, v, label in whole:
        if i % 50:
            continue
        scored = sorted((-int(v @ w), j, other) for m, j, w, other in whole if j != i and len(w) == len(v))
        for p, mate, _ in [s for s in scored if s[2] == label][:positives]:
            inside = [(s, j) for s, j, other in scored if other != label and low * -p <= 100 * -s <= high * -p]
            out += [(i, mate, r, j, -p, -s) for r, (s, j) in enumerate(inside[:k], 1)]
    return sorted(out)


def mined(df, scale, **how):
    found = negatives.mine(df, F.col("vec_id") % 50 == 0, scale, F.col("label"), **how)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[n] for n in names) for r in found.collect())


def test_equals_sql(spark, sf):
    got = negatives.op11_slot_negatives(spark, sf).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.sql(negatives.ORACLE).df()[list(got.columns)]
    keys = list(got.columns)
    assert len(got) and got.sort_values(keys).reset_index(drop=True).equals(want.sort_values(keys).reset_index(drop=True))


@pytest.mark.parametrize("positives,k", [(5, 3), (2, 1), (400, 50)])
def test_equals_a_plain_search(spark, monkeypatch, positives, k):
    """Ties, repeated rows, odd vectors, and blocks so small that every window crosses many."""
    monkeypatch.setattr(blocks, "BLOCK", 16)
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "QUERY_BLOCK", 2)
    lot, nan = np.random.default_rng(1), float("nan")
    rows = [(i, [float(x) for x in lot.integers(-3, 4, 4)], "abc"[int(lot.integers(0, 3)) if i % 2 else 0]) for i in range(260)]
    rows += [(50, [1.0, 1.0, 2.0, 0.0], "a"), (50, [1.0, 1.0, 2.0, 0.0], "a"), (50, [-1.0, 0.0, 2.0, 3.0], "b"), (7, rows[7][1], rows[7][2])]
    rows += [(300, None, "a"), (350, [1.0, nan, 0.0, 0.0], "a"), (400, [1.0, None, 0.0, 0.0], "a"), (450, [2.0, 1.0, 0.0, 1.0], None)]
    rows += [(None, [9.0, 9.0, 9.0, 9.0], "a"), (500, [], "a"), (501, [], "a"), (502, [], "b"), (550, [3.0, 1.0], "a"), (551, [1.0, 1.0], "a"), (552, [1.0, 0.0], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    for name in ("row", "lot", "block", "dim", "mates", "limits", "slot"):
        df = df.withColumn(name, F.lit("x"))
    got = mined(df, 8, positives=positives, negatives=k)
    assert got and got == plain(rows, 8, positives, k)
    assert mined(df.limit(0), 8) == []


def test_large_values_stay_exact(spark):
    rows = [(i, [float(2**28 + i * 977), float(2**27 - i)], "a" if i % 3 else "b") for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert mined(df, 1) == plain(rows, 1, 5, 3)


def test_shares_of_a_score():
    for p in (0, 1, 99, 100, 101, -1, -99, -101, 7**20, -(7**20)):
        assert negatives.hundredths(p, 95) == 95 * p // 100


def test_shares_of_a_score_in_sql(spark):
    values = [0, 1, 99, 100, 101, -1, -99, -101, 7**20, -(7**20), 2**62]
    rows = spark.createDataFrame([(v,) for v in values], "p long").selectExpr("p", f"{negatives.hundredths_sql('p', 95)} AS x").collect()
    assert all(r.x == 95 * r.p // 100 for r in rows)
