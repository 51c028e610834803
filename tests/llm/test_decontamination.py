"""Benchmark windows against SQL and against a plain search of every window in every text."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from quillmask.llm import decontamination as m


def plain(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = m.words(text)
        size = min(window, len(w))
        for s in range(len(w) - size + 1) if w else ():
            windows.setdefault((size, tuple(w[s : s + size])), set()).add("" if item is None else str(item))
    sizes = {size for size, _ in windows}
    out = []
    for doc, text in docs:
        w = m.words(text)
        hit, found = set(), set()
        for size in sizes:
            for s in range(len(w) - size + 1):
                own = windows.get((size, tuple(w[s : s + size])))
                if own:
                    hit.update(range(s, s + size))
                    found |= own
        names = ",".join(sorted(found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


def found(docs, items, **how):
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return [tuple(r[n] for n in names) for r in m.digests(m.contamination(docs, items, **how)).collect()]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def test_equals_sql(spark, sf):
    got = m.op13_prefix_join(spark, sf).toPandas()
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = con.sql(m.ORACLE).df()[list(got.columns)]
    assert got.contaminated.any() and not got.contaminated.all()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(want.sort_values("doc_id").reset_index(drop=True))


@pytest.mark.parametrize("seed,window,shingle", [(1, 10, 3), (2, 4, 2), (3, 10, 1), (4, 3, 3)])
def test_equals_a_plain_search(spark, make, seed, window, shingle):
    """Few different words, so shingles repeat, windows overlap and almost match."""
    lot = random.Random(seed)
    letters = "a b c D é".split()

    def text(n):
        return lot.choice([" ", "-", "\n"]).join(lot.choice(letters[: lot.randrange(1, 6)]) for _ in range(n))

    items = [(k, text(lot.randrange(1, 30))) for k in range(12)]
    items += [(3, "one more text of item three, with words that only it has in it"), (None, "no name no id no number at all here is it"), (50, None), (51, ""), (52, "...")]
    items += [(k, items[k][1]) for k in range(3)] + [(60, "zeta"), (61, "Alpha BETA")]
    docs = [(k, text(lot.randrange(1, 200))) for k in range(60)]
    for k in range(40):
        whole = (lot.choice(items)[1] or "").split()
        cut = whole[lot.randrange(3) :][: lot.randrange(1, 30)]
        docs.append((100 + k, " ".join([text(lot.randrange(1, 9)), *cut, text(lot.randrange(1, 9))])))
    docs += [(200, None), (201, ""), (202, "!?"), (203, "alpha, beta zeta"), (203, "alpha, beta zeta"), (None, items[0][1]), (204, "x " * 5000 + (items[1][1] or ""))]
    rows = make([(i, t, "en", "a") for i, t in docs])
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS item", "'x' AS words", "0 AS hash", "1 AS place")
    got = found(rows, benchmark, window=window, shingle=shingle)
    assert in_order(got) == in_order(plain(docs, items, window))


def test_no_document_and_no_item(spark, make, odd, empty):
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert found(empty, items) == []
    got = found(odd, items.limit(0))
    assert len(got) == odd.count() and not any(r[5] for r in got)
    assert sum(r[5] for r in found(odd, items)) == 2


def test_ranges_and_items(make, spark):
    items = spark.createDataFrame([(7, "a b c d e f g h i j k l")], "item_id long, text string")
    docs = make([(1, "x x a b c d e f g h i j k z", "en", "a"), (2, "a b c d e f g h i", "en", "a")])
    got = {r.doc_id: ([(x.start, x.end) for x in r.ranges], r["items"]) for r in m.contamination(docs, items).collect()}
    assert got == {1: ([(2, 13)], ["7"]), 2: ([], [])}


def test_marks_hold_all_and_little_else(spark):
    lot = np.random.default_rng(4).integers(-(2**63), 2**63, 3000)
    marks = m.marks_of(spark.createDataFrame([(int(x),) for x in lot], "hash long").repartition(5))
    assert marks.may_hold(lot.view(np.uint64)).all()
    assert marks.may_hold(np.random.default_rng(5).integers(-(2**63), 2**63, 9000).view(np.uint64)).mean() < 0.1
