"""Language model against plain recursions; the pipeline stage by stage."""

import math
from collections import Counter
from zlib import crc32

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmask.llm import hmm


def small_states(seed=1):
    states = hmm.States(np.full(hmm.CLASSES, 1 / hmm.CLASSES), seed)
    random = np.random.default_rng(seed)
    states.start = random.dirichlet(np.ones(hmm.STATES))
    states.move = random.dirichlet(np.ones(hmm.STATES), hmm.STATES)
    return states


def plain_forward(states, codes):
    a, total = states.start * states.emit[codes[0]], 0.0
    for c in codes[1:]:
        total += math.log10(a.sum())
        a = (a / a.sum()) @ states.move * states.emit[c]
    return total + math.log10(a.sum())


def some_codes(seed=2):
    random = np.random.default_rng(seed)
    return [random.integers(0, hmm.CLASSES, n).astype(np.uint16) for n in (1, 7, 3, 30, 7, 1, 12)]


def test_likelihood_is_exact():
    states, texts = small_states(), some_codes()
    got = hmm.Layout(texts).likelihoods(states)
    assert got == pytest.approx([plain_forward(states, t) for t in texts], rel=1e-12)


def test_expected_counts_against_plain_posteriors():
    states, texts = small_states(), some_codes()
    start, move, emit, likely = hmm.Layout(texts).expected(states)
    want_start, want_move, want_emit = np.zeros_like(start), np.zeros_like(move), np.zeros_like(emit)
    for t in texts:
        f = [states.start * states.emit[t[0]]]
        for c in t[1:]:
            f.append(f[-1] @ states.move * states.emit[c] * hmm.CLASSES)
        b = [np.ones(hmm.STATES)]
        for c in t[:0:-1]:
            b.insert(0, states.move @ (states.emit[c] * b[0]) * hmm.CLASSES)
        z = f[-1].sum()
        for k, c in enumerate(t):
            want_emit[c] += f[k] * b[k] / z
            if k:
                want_move += f[k - 1][:, None] * states.move * (states.emit[c] * b[k])[None, :] * hmm.CLASSES / z
        want_start += f[0] * b[0] / z
    assert start == pytest.approx(want_start, rel=1e-3, abs=1e-4)
    assert move == pytest.approx(want_move, rel=1e-3, abs=1e-4)
    assert np.allclose(emit, want_emit, rtol=1e-3, atol=1e-4)
    assert likely == pytest.approx(sum(plain_forward(states, t) for t in texts), rel=1e-5)


def base_scores(rows):
    texts = [[*(t or "").encode().lower().split(), b""] for _, t in rows]
    held = [i is not None and crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for t, h in zip(texts, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [
        (i, h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        for (i, _), t, h in zip(rows, texts, held, strict=True)
    ]


@pytest.mark.parametrize("head", [hmm.HEAD_WORDS, 4200])
def test_base_score_and_gain(spark, sf, monkeypatch, head):
    monkeypatch.setattr(hmm, "HEAD_WORDS", head)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {x[0]: x for x in base_scores(rows)}
    got = hmm.op1_hmm(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        i, held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_training_raises_the_likelihood(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sums = [hmm.score(docs, F.lit(False), rounds=k).agg(F.sum("score")).first()[0] for k in (0, 1, 4)]
    assert sums[0] < sums[1] < sums[2] < 0


def test_words_of_a_class_sum_to_one():
    head = [(f"w{k}".encode(), 10) for k in range(hmm.CLASS_WORDS)] + [(b"rareabc", 3), (b"moreabc", 2)]
    k = hmm.suffix_class(b"rareabc")
    v = hmm.Vocabulary(head, {k: (7, 3)}, 5, 10 * hmm.CLASS_WORDS + 7, hmm.CLASS_WORDS + 3)
    within = [10 ** v.encode(w)[2] for w in ("rareabc", "moreabc")]
    unknown = 10 ** v.encode("neverabc")[2]
    assert within[0] == pytest.approx(4 / 11) and within[1] == pytest.approx(3 / 11) and unknown == pytest.approx(1 / 11)
    # the third known word has count 2, and its add-one share is the rest
    assert sum(within) + unknown + 3 / 11 == pytest.approx(1)


def test_odd_rows(odd, odd_rows, empty):
    got = hmm.score(odd, F.coalesce(F.col("doc_id") == 6, F.lit(False)), rounds=1).collect()
    assert len(got) == len(odd_rows) and all(r.score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {1}
    by_id = {r.doc_id: r for r in got}
    assert by_id[5].score == pytest.approx(by_id[6].score) and by_id[6].n_known == by_id[6].n_tokens
    assert hmm.score(empty, F.lit(False), rounds=1).count() == 0
    untrained = hmm.score(odd, F.lit(True), rounds=1).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in untrained)


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    frames, seen = {"": docs}, docs
    for name, stage in corpus_pipeline.STAGES:
        seen = frames[name] = stage(spark, seen, sf).persist()
        if name != "encoding":
            assert seen.columns == docs.columns
    ids = {name: [r.doc_id for r in f.select("doc_id").collect()] for name, f in frames.items()}
    clean = [i for i in ids[""] if labels.get(i) == 0]
    assert len(set(clean) - set(ids["toxicity"])) <= 0.05 * len(clean)
    assert set(ids["language"]) <= set(ids["toxicity"]) and len(ids["language"]) >= 0.9 * len(ids["toxicity"])
    assert set(ids["near_duplicates"]) <= set(ids["language"]) and len(set(ids["near_duplicates"])) == len(ids["near_duplicates"])
    assert set(ids["mixing"]) <= set(ids["near_duplicates"])
    assert max(Counter(ids["mixing"]).values()) <= 3
    assert sorted(ids["encoding"]) == sorted(ids["mixing"])
    assert frames["encoding"].filter("NOT round_trip").count() == 0


def test_pipeline_of_odd_and_empty_documents(spark, sf, odd, empty):
    for docs, least in ((odd, 1), (empty, 0)):
        seen = docs
        for name, stage in corpus_pipeline.STAGES:
            seen = stage(spark, seen, sf)
            assert name == "encoding" or seen.columns == docs.columns
        assert seen.count() >= least or not least


def test_run_equals_its_stages(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "ids", "n_pieces", "score", "round_trip"] and got.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def words_frame(spark, times):
    """(word, c) of words w00000, w00001, ... with the given counts."""
    rows = [(f"w{i:05}".encode(), c) for i, c in enumerate(times)]
    return spark.createDataFrame(rows, "word binary, c long").repartition(7)


@pytest.mark.parametrize("kind", ["zipf", "equal", "two", "few", "none"])
def test_frequent_words_are_cut_by_histograms(spark, monkeypatch, kind):
    monkeypatch.setattr(hmm, "HEAD_WORDS", 300)
    monkeypatch.setattr(hmm, "CLASS_WORDS", 200)
    times = {
        "zipf": [50_000 // (i + 1) + 1 for i in range(3000)],
        "equal": [1_000_000] * 900,
        "two": [9] * 100 + [8] * 900,
        "few": [3, 1, 2] * 50,
        "none": [],
    }[kind]
    counts = words_frame(spark, times)
    whole = sorted(((w.encode(), c) for w, c in ((f"w{i:05}", c) for i, c in enumerate(times))), key=lambda r: (-r[1], r[0]))
    got = hmm.head_words(counts, len(times))
    assert got == whole[: len(got)]
    assert min(200, len(times)) <= len(got) <= 300
    cut = hmm.head_cut(counts)
    assert sum(c > cut for c in times) <= 300 and (cut == 0 or sum(c >= cut for c in times) > 300)


def test_which_words_are_sent_changes_no_score(spark, monkeypatch):
    random = np.random.default_rng(4)
    texts = [" ".join(f"w{w}" for w in random.zipf(1.3, 400) % 9000) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = []
    for head in (32_768, 4_200):
        monkeypatch.setattr(hmm, "HEAD_WORDS", head)
        rows = hmm.score(docs, F.col("doc_id") % 3 == 2, rounds=1).orderBy("doc_id").collect()
        found.append([tuple(r) for r in rows])
    for a, b in zip(*found, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-6)


def test_scores_of_the_model_by_value(spark):
    random = np.random.default_rng(5)
    texts = [" ".join(f"w{w}" for w in random.zipf(1.5, random.integers(0, 60)) % 300) for _ in range(50)] + ["", "new words w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.score for r in hmm.score(docs, F.col("doc_id") % 4 == 3, rounds=2).collect()}
    training = [t for i, t in enumerate(texts) if i % 4 != 3]
    counts = Counter(w for t in training for w in t.split())
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    frequency = np.zeros(hmm.CLASSES)
    frequency[: len(ranked)] = [counts[w] for w in ranked]
    frequency[hmm.END] = len(training)
    place = {w: i for i, w in enumerate(ranked)}

    def codes(text):
        last = [hmm.CLASS_WORDS + crc32(w.encode()[-hmm.SUFFIX :]) % hmm.SUFFIX_CLASSES for w in text.split()]
        return np.array([place.get(w, c) for w, c in zip(text.split(), last, strict=True)] + [hmm.END], np.uint16)

    states = hmm.States((frequency + 1) / (frequency + 1).sum())
    for _ in range(2):
        sums = [hmm.Layout([codes(t)]).expected(states)[:3] for t in training]
        states.update(*[sum(part) for part in zip(*sums, strict=True)])
    for i, text in enumerate(texts):
        assert got[i] == pytest.approx(plain_forward(states, codes(text)), rel=1e-4)
