"""Learned models: held-out accuracy, odd rows, and what they must not look at."""

import random

import numpy as np
from pyspark.sql import functions as F

from quillmask.llm import languages, toxicity

EN = "the house is on the hill and the river runs through that valley with cold water".split()
FR = "la maison est sur la colline et le fleuve traverse cette vallée avec une eau froide".split()
DE = "das haus steht auf dem hügel und der fluss fließt durch dieses tal mit kaltem wasser".split()


def text_of(words, n, lot):
    return " ".join(lot.choice(words) for _ in range(n))


def some_texts():
    lot = random.Random(3)
    return [(k, text_of(w, 40, lot), name, "s") for k, (w, name) in enumerate([(EN, "en"), (FR, "fr"), (DE, "de")] * 12)]


def test_held_out_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = languages.op9_language_mixture(spark, sf).join(docs, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == docs.count() and 0 < len(held) < len(got) / 2
    assert (held.lang == held.lang_pred).mean() >= 0.95
    assert got.score.between(0, 1).all()


def test_mixtures_and_single_languages(spark, make):
    model = languages.train(make(some_texts()), F.lit(True))
    lot = random.Random(8)
    both = model.shares(text_of(EN, 300, lot) + " " + text_of(DE, 100, lot))
    assert set(both) == {"en", "de"} and 0.6 < both["en"] < 0.9
    assert model.best(text_of(FR, 30, lot)) == ("fr", 1.0, "fr")


def plain_shares(p, n, rounds=20000):
    share = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(rounds):
        share = share * (p.T @ (n / (p @ share))) / n.sum()
    return share, float(n @ np.log(p @ share))


def test_shares_and_sets_against_plain_elimination(make):
    rows = some_texts() + [(90 + k, text_of(EN[:6] + FR[:6], 40, random.Random(k)), "xx", "s") for k in range(6)]
    model = languages.train(make(rows), F.lit(True))
    lot = random.Random(11)
    sizes = set()
    for case in range(30):
        text = " ".join(text_of(w, lot.choice([0, 3, 20, 80]), lot) for w in (EN, FR, DE)) + (" la" if case % 2 else " the")
        buckets, n = model.counts(text)
        p, held = model.p[buckets], list(range(len(model.names)))
        penalty = 0.5 * np.log(n.sum())
        share, reached = plain_shares(p, n)
        grid = [(a / 20, b / 20, c / 20, 1 - (a + b + c) / 20) for a in range(21) for b in range(21 - a) for c in range(21 - a - b)]
        assert reached >= max(float(n @ np.log(p @ np.abs(g))) for g in grid) - 1e-6
        close = False
        while len(held) > 1:
            rest = [k for k in range(len(held)) if k != int(np.argmin(share))]
            less, likely = plain_shares(p[:, [held[k] for k in rest]], n)
            close |= abs(reached - likely - penalty) < 3 * languages.TOLERANCE
            if reached - likely > penalty:
                break
            held, share, reached = [held[k] for k in rest], less, likely
        got = model.shares(text)
        assert close or set(got) == {model.names[k] for k in held}, text
        sizes.add(len(got))
        mixed = np.array([got.get(name, 0.0) for name in model.names])
        assert close or float(n @ np.log(p @ mixed)) >= reached - 3 * languages.TOLERANCE
    assert len(sizes) >= 2


def test_texts_in_no_learned_language_leave_the_pipeline(spark, sf, make):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols = docs.columns
    last = docs.agg(F.max("doc_id")).head()[0]
    junk = ["zxqv kkjw qqpx vvbn zzxk", "Η γρήγορη καφέ αλεπού πηδάει πάνω από το σκυλί", "日本語のテキスト"]
    strange = spark.createDataFrame([(last + 1 + k, t) for k, t in enumerate(junk)], "doc_id long, text string")
    both = docs.unionByName(strange, allowMissingColumns=True)
    kept = corpus_pipeline.drop_unidentified(spark, both, sf)
    assert kept.columns == cols
    left = {r.doc_id for r in both.join(kept, "doc_id", "left_anti").collect()}
    assert left == {last + 1 + k for k in range(len(junk))} | {r.doc_id for r in docs.filter("text is null or not text rlike '[a-zA-Z]'").collect()}


def test_language_of_odd_rows(spark, odd, make, empty):
    got = {r.doc_id: r for r in languages.identify(odd, F.col("doc_id") != 5).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4))
    assert got[None].lang_pred in ("en", "fr")
    assert languages.identify(empty, F.lit(True)).count() == 0
    nothing = languages.identify(odd, F.lit(False)).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_language_ignores_lang_and_ids(make):
    rows = some_texts()
    learn = F.col("doc_id") < 30
    plain = {r.doc_id: r.lang_pred for r in languages.identify(make(rows), learn).collect()}
    blind = [(i, t, lang if i < 30 else None, "z") for i, t, lang, _ in rows]
    assert plain == {r.doc_id: r.lang_pred for r in languages.identify(make(blind), learn).collect()}


def lots(n, seed):
    lot = random.Random(seed)
    for k in range(n):
        words = [lot.choice(EN + FR) for _ in range(lot.randrange(5, 300))]
        toxic = k % 4 == 0
        if toxic:
            words.insert(lot.randrange(len(words)), lot.choice(["grumblewort", "snotnosed", "lowlife"]) + lot.choice(["", "s", "ish"]))
        yield " ".join(words), int(toxic)


def test_one_word_in_a_long_text_and_misspellings():
    model = toxicity.Model().fit(*map(list, zip(*lots(300, 1), strict=True)))
    texts, labels = map(list, zip(*lots(200, 2), strict=True))
    got = np.array(model.scores(texts)) >= 0.5
    assert (got == np.array(labels)).mean() >= 0.97
    assert min(model.scores(["you grumbelwort", "snot-nosed one", "lowlive"])) > max(model.scores(["the cold river", ""]))
    assert model.scores([None, "", " . ! "]) == [0.0, 0.0, 0.0]
    assert model.scores(texts[:5]) == [model.scores([t])[0] for t in texts[:5]]


def plain_odds(model, words):
    """Log odds of a run of words from its averaged n-gram vectors, gram by gram."""
    grams = []
    for word in words:
        data = b" " + word.encode() + b" "
        grams += [data[i : i + n] for n in toxicity.GRAMS for i in range(len(data) - n + 1)]
    rows = []
    for gram in grams:
        h = len(gram)
        for byte in gram:
            h = (h * 16777619 & 0xFFFFFFFF) ^ byte
        rows.append((h * 2654435769 & 0xFFFFFFFF) >> 15)
    vector = model.table[rows].astype(float).mean(axis=0)
    logits = model.weights @ vector + model.bias
    return logits[1] - logits[0]


def test_scores_against_every_run_of_words():
    model = toxicity.Model().fit(*map(list, zip(*lots(120, 4), strict=True)))
    for text in ["grumblewort", "a snotnosed lowlife", "La maison, the hill", "fleuve über dem hügel", *[t for t, _ in lots(6, 9)]]:
        words = text.lower().encode().translate(toxicity.TO_WORDS).decode().split()[:40]
        runs = [plain_odds(model, words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)]
        assert np.isclose(model.scores([" ".join(words)])[0], 1 / (1 + np.exp(-max(runs))), atol=1e-4)


def test_clean_words_change_no_score():
    texts, labels = map(list, zip(*lots(200, 6), strict=True))
    model = toxicity.Model().fit(texts, labels)
    before = np.array(model.scores(texts))
    for changed in ([f"the {t}" for t in texts], [f"{t} river" for t in texts]):
        after = np.array(model.scores(changed))
        assert ((before >= 0.5) == (after >= 0.5)).all() and (after[before >= 0.5] == before[before >= 0.5]).all()


def test_training_is_repeatable():
    texts, labels = map(list, zip(*lots(60, 5), strict=True))
    one, two = toxicity.Model().fit(texts, labels), toxicity.Model().fit(texts, labels)
    assert (one.table == two.table).all() and one.scores(texts) == two.scores(texts)


def test_toxicity_query(spark, sf):
    got = toxicity.op10_toxicity(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    both = got.merge(labels, on="doc_id")
    assert (both.toxic == both.predicted).mean() > 0.9


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (7, 0, 1), (7, 0, 0), (9, None, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd, labels, F.lit(True))
    scored = odd.withColumn("score", toxicity.scorer(spark, model)("text")).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert all(r.score == 0 for r in scored if r.doc_id in (2, 3, 4))
    assert toxicity.train(odd, labels.limit(0), F.lit(True)) is None
    none = toxicity.scorer(spark, None)
    assert {r.score for r in odd.select(none("text").alias("score")).collect()} == {0.0}
    assert empty.select(none("text")).count() == 0


def test_sample_is_bounded(spark, odd):
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(10)], "doc_id long, quality int, toxic int")
    assert toxicity.sample(odd, labels, F.lit(True), 1, "doc_id", "text").count() <= 2
