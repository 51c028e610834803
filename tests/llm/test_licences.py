"""Licence scan against a plain search."""

import random
import re

from quillmask.llm import licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def brute(text):
    words = WORD.findall((text or "").translate(FOLD))
    starts, labels = [], set()
    for phrase, label in licences.BASE_PHRASES:
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += found
        labels |= {label} if found else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_base_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in licences.op8_licence_scan(spark, sf).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_templates_are_found_with_small_changes():
    index = licences.Index()
    for label, text, _ in licences.TEMPLATES:
        noise = "lorem the of and in is " * 30
        assert label in index.scan(noise + text.upper() + " " + noise)[5].split(",")
    long = licences.TEMPLATES[1][1]
    assert "apache-2.0" in index.scan(long.replace("obtain a copy", "get a nice copy"))[5]


def test_key_phrases_are_mandatory():
    index = licences.Index()
    text = licences.TEMPLATES[4][1].replace("hereby granted, free of charge", "hereby granted, at some charge")
    assert "mit" not in index.scan(text)[5].split(",")
    assert index.scan("license licensed under the rights of the public version 2 0")[5] == ""


def plain_match(index, t, words):
    """The best row of template words by comparing every pair of places with every other."""
    text, weights = index.texts[t], index.weights[t]
    pairs = [(i, p) for i in range(len(words)) for p in range(len(text)) if words[i] == text[p]]
    best, reached = 0.0, {}
    for i, p in pairs:
        ways = [(0.0, i - p)]
        ways += [w for (h, o), w in reached.items() if h < i and o < p and abs((i - h) - (p - o)) <= index.drift]
        weight, start = max(ways, key=lambda w: w[0])
        reached[i, p] = (weight + weights[p], start)
        if weight + weights[p] >= index.least[t]:
            part = words[max(0, start - index.drift) : max(0, i + len(text) - p + index.drift)]
            if all(any(part[k : k + len(key)] == key for k in range(len(part))) for key in index.keys[t]):
                best = max(best, weight + weights[p])
    return best / sum(weights)


def test_index_against_a_plain_aligner():
    """The pruned index finds what aligning every template with the whole text finds, with edits anywhere."""
    index, lot = licences.Index(), random.Random(5)
    found = 0
    for case in range(60):
        parts = []
        for label, text, _ in lot.sample(licences.TEMPLATES, 2):
            words = licences.words_of(text)
            for _ in range(lot.randrange(0, 7)):
                k = lot.randrange(len(words) + 1)
                if lot.random() < 0.5:
                    words.insert(k, lot.choice([b"new", b"the", b"license", b"of"]))
                elif words:
                    del words[k % len(words)]
            parts += [*[b"the", b"of", b"x", b"license"] * lot.randrange(4), *words]
        at = {}
        for i, w in enumerate(parts):
            if w in index.known:
                at.setdefault(w, []).append(i)
        want = {}
        for t, label in enumerate(index.labels):
            if share := plain_match(index, t, parts):
                want[label] = max(want.get(label, 0), min(1.0, share))
        got = index.templates_in(parts, at)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
        found += len(got)
    assert found > 40


def test_inserted_and_deleted_words():
    """Words put in or left out outside the key phrases, all along each template."""
    index = licences.Index()
    for label, text, keys in licences.TEMPLATES:
        words = licences.words_of(text)
        inside = {k + o for key in map(licences.words_of, keys) for k in licences.starts_of(words, key) for o in range(len(key) - 1)}
        free = [k for k in range(len(words) - 1) if k not in inside]
        chosen = set(free[:: max(1, len(free) // 5)][:5])
        longer = [x for k, w in enumerate(words) for x in ((w, b"zzz") if k in chosen else (w,))]
        assert label in index.scan(b" ".join(longer).decode())[5].split(","), longer
    mit = [text for label, text, _ in licences.TEMPLATES if label == "mit"][-1]
    for gone in ("hereby", "charge"):
        assert "mit" not in index.scan(mit.replace(gone, ""))[5].split(",")
    assert "mit" in index.scan(mit.replace("associated ", "").replace("to deal ", "").replace("limitation ", "").replace("modify,", ""))[5]


def test_own_templates(make):
    own = (("house", "This text belongs to the house of examples and may be read by anyone", ("house of examples",)),)
    rows = [(1, "note: this text belongs to the big house of examples and may be read", "en", "a"), (2, "MIT License", "en", "a")]
    got = {r.doc_id: r.labels for r in licences.scan(make(rows), templates=own).collect()}
    assert got == {1: "house", 2: ""}


def test_odd_rows(odd, odd_rows, empty):
    got = licences.scan(odd).collect()
    assert sorted(r.n_words for r in got) == sorted(brute(t)[0] for _, t, _, _ in odd_rows)
    assert {r.doc_id: r.labels for r in got}[1] == "reserved"
    assert all(r.score == 0 and r.first_word is None for r in got if r.doc_id in (2, 3, 4))
    assert licences.scan(empty).count() == 0
