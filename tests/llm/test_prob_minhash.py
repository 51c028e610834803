"""Near-duplicates against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmask.llm import prob_minhash as m


def brute(rows, threshold=m.SIMILARITY):
    """doc_id to class id by comparing all pairs of (doc_id, text)."""
    counts = [m.weighted(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or m.probability_jaccard(counts[i], counts[j]) >= threshold - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    classes = {}
    for i, (doc, _) in enumerate(rows):
        classes.setdefault(find(i), []).append(doc)
    return {doc: min(c) for c in classes.values() for doc in c}


def test_signature_estimates_probability_jaccard():
    lot = random.Random(5)
    base = [f"w{lot.randrange(400)}" for _ in range(600)]
    for cut in (0, 30, 150, 400):
        other = base[cut:] + [f"v{k}" for k in range(cut)]
        a, b = " ".join(base), " ".join(other)
        s = m.signatures([m.words(a), m.words(b)])
        want = m.probability_jaccard(m.weighted(a), m.weighted(b))
        assert abs((s[0] == s[1]).mean() - want) < 0.15


def test_similarity_against_its_definition():
    a, b = m.Counter({"x": 3, "y": 1, "z": 2, "s": 1}), m.Counter({"x": 1, "y": 4, "w": 2, "s": 1})
    every, shared = a.keys() | b.keys(), a.keys() & b.keys()
    want = sum(1 / sum(max(a[y] / a[x], b[y] / b[x]) for y in every) for x in shared)
    assert m.probability_jaccard(a, b) == pytest.approx(want)


def test_signatures_do_not_depend_on_the_block():
    texts = [m.words(t) for t in ("a", "a b c d e f g", "x " * 50, "q w e r t y u i o p " * 20)]
    whole = m.signatures(texts)
    assert all((m.signatures([t])[0] == whole[k]).all() for k, t in enumerate(texts))
    assert (m.signatures([m.words("A")])[0] == whole[0]).all()


def test_tables_equal_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in m.op3_prob_minhash(spark, sf).collect()}
    assert got == brute(rows)


def test_chains_and_near_misses(spark, make):
    """A family whose members lie on both sides of the threshold, in buckets of many classes."""
    lot = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(60):
        text = list(base)
        for _ in range(lot.randrange(9)):
            text[lot.randrange(120)] = f"x{k}"
        rows.append((100 + k, " ".join(text)))
    rows += [(300 + k, rows[k % 3][1]) for k in range(40)]
    got = {r.doc_id: r.class_id for r in m.near_duplicates(make([(i, t, "en", "a") for i, t in rows])).collect()}
    assert got == brute(rows)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    scratch = m.Scratch(spark)
    first = m.components(edges, scratch)
    assert {r.label for r in first.collect()} == {0} and first.count() == 41
    more = spark.createDataFrame([(39, 77), (77, 80), (90, 91)], "a long, b long")
    got = {r.node: r.label for r in m.contracted(first, more, scratch).collect()}
    assert got == {**dict.fromkeys([*range(41), 77, 80], 0), 90: 90, 91: 90}


def family(n, seed, words=100, most=24):
    """A base text and copies with up to most words replaced."""
    lot = random.Random(seed)
    base = [f"w{k}" for k in range(words)]
    rows = []
    for k in range(n):
        text = list(base)
        for _ in range(int(lot.random() ** 2 * most)):
            text[lot.randrange(words)] = f"x{lot.randrange(10**6)}"
        rows.append((k, " ".join(text)))
    return rows


def linked(rows, threshold=m.SIMILARITY):
    counts = [m.weighted(t) for _, t in rows]
    return [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if m.probability_jaccard(counts[i], counts[j]) >= threshold - 1e-9]


def test_recall_on_a_large_family(spark, make):
    """Linked pairs, by comparing all, that end up in one class: all in the exact form, nearly all in stars."""
    rows = family(400, 6)
    pairs = linked(rows)
    docs = make([(i, t, "en", "a") for i, t in rows])
    got = {r.doc_id: r.class_id for r in m.near_duplicates(docs).collect()}
    recall = sum(got[a] == got[b] for a, b in pairs) / len(pairs)
    lone = {i for p in pairs for i in p} - {i for p in pairs for i in p if got[p[0]] == got[p[1]]}
    print("pairs", len(pairs), "recall", recall, "texts with no mate found", len(lone))
    assert recall >= 0.98 and len(lone) <= 2
    exact = {r.doc_id: r.class_id for r in m.near_duplicates(docs, exact=True).collect()}
    assert exact == brute(rows)


def test_no_link_of_a_large_family_is_left_out(spark, make):
    """Default classes equal those of comparing all pairs, in families that fill several blocks."""
    for n, seed in ((400, 6), (300, 9)):
        rows = family(n, seed)
        got = {r.doc_id: r.class_id for r in m.near_duplicates(make([(i, t, "en", "a") for i, t in rows])).collect()}
        assert got == brute(rows)


def test_blocks_meet_across_lots(spark, make, monkeypatch):
    """Small blocks and lots, so that members meet in every way there is."""
    for name, value in (("MEMBERS", 4), ("LARGE", 3), ("SPREAD", 2)):
        monkeypatch.setattr(m, name, value)
    rows = family(120, 11)
    got = {r.doc_id: r.class_id for r in m.near_duplicates(make([(i, t, "en", "a") for i, t in rows])).collect()}
    assert got == brute(rows)


def test_bounds_of_likeness():
    """Products of tables: equal to the definition without repeated runs, never below it with them."""
    lot = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(40):
        text = base[lot.randrange(8) :] * (1 + (k % 4 == 0))
        for _ in range(lot.randrange(9)):
            text[lot.randrange(len(text))] = f"x{lot.randrange(5)}"
        texts.append(" ".join(text))
    texts += ["a", "a b", "a b c d e " * 9]
    bound, certain = m.likeness_bounds([m.words(t) for t in texts])
    counts = [m.weighted(t) for t in texts]
    want = np.array([[m.probability_jaccard(a, b) for b in counts] for a in counts])
    assert 0 < certain.sum() < certain.size
    np.fill_diagonal(want, 0)  # a text is not compared with itself
    np.fill_diagonal(bound, 0)
    assert np.allclose(bound[certain], want[certain], atol=1e-12) and (bound >= want - 1e-9).all()


def test_rows_of_a_family_do_not_grow_with_its_square(spark, make, monkeypatch):
    """Many texts that are alike by signature and not linked: meetings give fewer links than there are members."""
    rows = family(240, 5, words=60, most=30)
    given = []
    real = m.contracted
    monkeypatch.setattr(m, "contracted", lambda label, links, scratch: (given.append(links.count()), real(label, links, scratch))[1])
    asked = []
    checked = m.verified
    monkeypatch.setattr(m, "verified", lambda pairs, *rest: (asked.append(pairs.count()), checked(pairs, *rest))[1])
    got = {r.doc_id: r.class_id for r in m.near_duplicates(make([(i, t, "en", "a") for i, t in rows])).collect()}
    assert got == brute(rows)
    assert len(asked) == 2 and len(given) == 3 and given[2] < len(rows)


def test_repeated_runs_in_blocks(spark, make, monkeypatch):
    """Texts with runs of several weights meet in small blocks, also blocks cut by bytes."""
    for name, value in (("MEMBERS", 8), ("LARGE", 6), ("SPREAD", 2), ("BLOCK_BYTES", 3000), ("WIDTH", 64)):
        monkeypatch.setattr(m, name, value)
    rows = [(i, f"{t} {t}" if i % 3 else f"{t} {t} {t[:200]}") for i, t in family(90, 3, words=50, most=14)]
    docs = make([(i, t, "en", "a") for i, t in rows])
    assert {r.doc_id: r.class_id for r in m.near_duplicates(docs).collect()} == brute(rows)
    assert {r.doc_id: r.class_id for r in m.near_duplicates(docs, exact=True).collect()} == brute(rows)


def test_exact_threshold_through_a_third_text(spark, make):
    """h and y are each at 0.8 from x and at 0.6 from each other."""
    w = [f"w{k}" for k in range(14)]
    rows = [(1, " ".join(w[:12])), (2, " ".join(w)), (3, " ".join(w[2:]))]
    got = {r.doc_id: r.class_id for r in m.near_duplicates(make([(i, t, "en", "a") for i, t in rows])).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def test_odd_rows(odd, empty):
    got = m.near_duplicates(odd).collect()
    classes = {r.doc_id: r.class_id for r in got}
    assert len(got) == odd.count()
    assert classes[5] == classes[6] == 5 and classes[2] == classes[3] == 2 and classes[4] == 4 and classes[7] == 7
    assert classes[None] is None
    kept = m.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda i: -1 if i is None else i)
    assert ids == [None, 1, 2, 4, 5, 7, 9]
    assert m.near_duplicates(empty).count() == 0 and m.one_of_each(empty).count() == 0


def test_bands_cover_whole_texts(spark):
    long = " ".join(f"t{k}" for k in range(3000))
    df = spark.createDataFrame([(long + " end",), (long + " other",)], "text string").select(m.sign("text").bands.alias("b"))
    a, b = (np.array(r.b) for r in df.collect())
    assert 0 < (a == b).sum() <= m.BANDS and spark.range(1).select(m.sign(F.lit(None).cast("string")).bands.alias("b")).first().b == []
