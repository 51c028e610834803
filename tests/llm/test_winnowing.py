"""Fingerprints against a plain re-computation."""

import hashlib

from quillmask.llm import winnowing as w


def kept_of(h, gram=w.GRAM, window=w.WINDOW):
    """(position, hash) of the kept runs, given word hashes."""
    if not h:
        return []
    if len(h) < gram:
        a = 0
        for x in h:
            a = (a * w.BASE + x) % w.MODULUS
        return [(0, a)]
    runs = [sum(pow(w.BASE, gram - 1 - j, w.MODULUS) * h[i + j] for j in range(gram)) % w.MODULUS for i in range(len(h) - gram + 1)]
    out = []
    for i in range(max(1, len(runs) - window + 1)):
        part = runs[i : i + window]
        low = min(part)
        at = i + max(j for j, x in enumerate(part) if x == low)
        if (at, low) not in out:
            out.append((at, low))
    return out


def test_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    words = rows.selectExpr(
        "doc_id", rf"transform(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0), x -> pmod(xxhash64(x), {w.WORD_MODULUS}L)) AS h"
    )
    got = {r.doc_id: r.fingerprint for r in w.fingerprints(rows).withColumnRenamed("id", "doc_id").collect()}
    for r in words.collect():
        assert got[r.doc_id] == " ".join(f"{x:X}@{at}" for at, x in kept_of(r.h))


def test_edited_texts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    order = sorted(((r.doc_id, r.text) for r in rows.collect()), reverse=True)
    got = {r.doc_id: r for r in w.op7_winnowing(spark, sf).collect()}
    assert len(got) == len(order)
    nearer = 0
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        m = len(text) // 2
        edited = text[: len(text) - m] + after[:m]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1
        nearer += got[i].near_edited >= got[i].near_next
    assert nearer > 0.9 * len(order)


def test_odd_rows(spark, odd, odd_rows, empty):
    got = w.edited_fingerprints(odd).collect()
    assert len(got) == len(odd_rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[5].fingerprint == by_id[6].fingerprint and by_id[5].n_chars == len(odd_rows[4][1])
    assert by_id[2].fingerprint == by_id[3].fingerprint == by_id[4].fingerprint == ""
    assert by_id[2].n_chars == 0 and by_id[6].near_next == 1.0  # 6 is followed by 5
    assert sum(r.doc_id == 7 for r in got) == 2
    assert w.edited_fingerprints(empty).count() == 0


def test_single_document(spark, make):
    (row,) = w.edited_fingerprints(make([(1, "abcd", "en", "a")])).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_shared_passage_is_always_found(spark, make):
    passage = " ".join(f"shared{i}" for i in range(w.GRAM + w.WINDOW - 1))
    docs = [(k, " ".join(f"x{k}y{j}" for j in range(k)) + " " + passage + " " + "z " * k, "en", "a") for k in range(30)]
    sets = [set(r.hashes) for r in w.fingerprints(make(docs)).collect()]
    assert all(a & b for a in sets for b in sets)
