"""Operators that SQL can express are held against it."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmask.llm import mixing, topk


def same(got, sql, **views):
    con = duckdb.connect()
    for name, path in views.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    want = con.sql(sql).df()[list(got.columns)]
    keys = list(got.columns)
    assert got.sort_values(keys).reset_index(drop=True).equals(want.sort_values(keys).reset_index(drop=True))


def test_mix_equals_sql(spark, sf):
    same(mixing.op5_pareto_mix(spark, sf).toPandas(), mixing.ORACLE, documents=f"{sf}/documents.parquet")


def test_mix_meets_targets_and_reruns_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.decisions(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    assert (got.taken <= 3 * got["size"]).all()
    for _, part in got.groupby("source"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= part["size"].max() / 2 + 1
    assert abs(got.groupby("source").target.first().sum() - got["size"].sum()) < 1e-6 * got["size"].sum()
    again = mixing.decisions(docs.repartition(5)).toPandas()
    assert dict(zip(again.doc_id, again.taken)) == dict(zip(got.doc_id, got.taken))


def test_mix_odd_rows(spark, odd, odd_rows, empty):
    got = mixing.decisions(odd).toPandas()
    assert len(got) == len(odd_rows)
    assert sorted(got["size"]) == sorted(len((t or "").split()) for _, t, _, _ in odd_rows)
    assert (got[got["size"] == 0].taken == 0).all()
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns and mixed.count() == got.copies.sum()
    assert mixing.decisions(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_cut_takes_a_part_of_equal_rows(spark, make, tmp_path):
    rows = [(7 if i % 3 else i, "w " * (9 if i % 3 else 4 + i % 5), "en", "a") for i in range(300)]
    rows += [(None if i % 2 else i, "w " * (3 + i % 4 // 2), "en", None) for i in range(200)]
    rows += [(i, "w " * 20, "en", "c") for i in range(1000, 1040)]
    for k, other in enumerate([[], [(5, "w " * 3000, "fr", "d")]]):
        path = str(tmp_path / f"docs{k}.parquet")
        make(rows + other).select("doc_id", "text", "source").repartition(7).write.parquet(path)
        docs = spark.read.parquet(path)
        got = mixing.decisions(docs)
        same(got.withColumn("doc_id", F.col("doc_id").cast("double")).toPandas(), f"SELECT * REPLACE (doc_id::DOUBLE AS doc_id) FROM ({mixing.ORACLE})", documents=f"{path}/*.parquet")
        taken = {r.source: r.taken for r in mixing.mixed(docs).groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("taken")).collect()}
        for r in mixing.source_targets(docs.select("source", mixing.words(F.col("text")).alias("size"))).collect():
            assert abs(taken.get(r.source, 0) - r.target) <= docs.filter(F.col("source").eqNullSafe(F.lit(r.source))).agg(F.max(mixing.words(F.col("text")))).first()[0] / 2 + 1


def test_targets_stop_at_three_times(spark, make):
    docs = make([(i, "w " * (5 if i < 2 else 100), "en", "a" if i < 2 else "b") for i in range(20)])
    got = mixing.decisions(docs).toPandas().groupby("source_size").target.first()
    assert got[10] == 30.0 and got[1800] == 1780.0


def test_top_k_equals_sql(spark, sf):
    same(topk.op6_top_k(spark, sf).toPandas(), topk.ORACLE, embeddings=f"{sf}/embeddings.parquet")


@pytest.mark.parametrize("k", [1, 3, 500])
def test_top_k_odd_vectors(spark, k):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 4), 1.0, -0.5]) for i in range(40)] + [(100, [1.0, nan, 0.0]), (101, [inf, 0.0, 0.0]), (102, None)]
    rows += [(103, []), (104, [1.0, None, 2.0]), (None, [9.0, 9.0, 9.0]), (120, [1.0, 2.0]), (140, [-1.0, 3.0]), (20, [0.0, 1.0, -0.5])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, block string")
    got = topk.search(df, F.col("vec_id") % 20 == 0, k, 64).collect()
    whole = [(i, np.floor(np.array(v) * 64).astype(int)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = set()
    for i, v in whole:
        if i % 20 == 0:
            scored = sorted((-int(v @ w), j) for j, w in whole if j != i and len(w) == len(v))[:k]
            want |= {(i, -s, j) for s, j in scored}
    assert {(r.query_id, r.score, r.vec_id) for r in got} == want
    assert topk.search(df.limit(0), F.col("vec_id") % 20 == 0, k, 64).count() == 0


def test_repeated_query_rows_have_lists_of_their_own(spark):
    """Different and equal vectors under one query id, and candidates that repeat."""
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (40, [1.0, 1.0]), (40, [1.0, 1.0])] + [(i, [float(i), float(-i)]) for i in range(1, 9)] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 20 == 0, 3, 1).collect())
    want = []
    for i, v in rows:
        if i % 20 == 0:
            scored = sorted((-int(v[0] * w[0] + v[1] * w[1]), j) for j, w in rows if j != i)[:3]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    assert len(got) == 12 and got == sorted(want)


def block_of(x, ids=None):
    x = np.asarray(x, np.int64)
    ids = np.arange(len(x)) if ids is None else np.asarray(ids)
    return topk.Block(x.shape[1], len(x), ids.astype(np.int64).tobytes(), ids.astype(np.int64).tobytes(), [""] * len(x), [[]] * len(x), "<i8", x.tobytes())


@pytest.mark.parametrize("scale", [1, 2**24])
def test_bounds_never_lose_a_neighbour(scale):
    random = np.random.default_rng(3)
    x = random.integers(-30, 30, (700, 12)) * scale + random.integers(0, 2, (700, 12))
    x[100:300] = x[0]
    ids = np.arange(0, 700, 50)
    for i, near, scores in topk.Lists(block_of(x)).nearest(block_of(x[ids], ids), 20):
        every = sorted((-int(x[ids[i]] @ x[j]), j) for j in range(700) if j != ids[i])[:20]
        assert [(-s, j) for s, j in every] == list(zip(scores.tolist(), near.tolist()))


def test_reading_stops_before_the_lists_end():
    """A cluster around the query stands out after a few entries of each list."""
    random = np.random.default_rng(4)
    x = random.integers(-5, 5, (4000, 8))
    x[:30] = 100 + random.integers(0, 5, (30, 8))
    lists = topk.Lists(block_of(x))
    found = list(lists.nearest(block_of(x[:1], [0]), 20))
    assert lists.depth < 400
    assert found[0][1].tolist() == [j for _, j in sorted((-int(x[0] @ x[j]), j) for j in range(1, 4000))[:20]]
