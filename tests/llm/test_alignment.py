"""Token alignment against the tokenizer libraries and a plain comparison of byte ranges."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillmask.llm import alignment as m

FILES = m.files_of(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def plain(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups) from whole texts and all overlapping ranges."""
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    signs = m.byte_signs()
    held = []
    for t in texts:
        a = tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        a_bytes = [bytes(signs[c] for c in tok.id_to_token(k)) for k in a]
        b_bytes = [bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if not t or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + t).encode():
            held.append(None)
            continue
        ranges = []
        for ids, parts in ((a, a_bytes), (b, b_bytes)):
            at, own = 0, []
            for k, x in zip(ids, parts):
                own.append((k, at, at + len(x)))
                at += len(x)
            ranges.append(own)
        links = Counter()
        start = 0
        for x, lo, hi in ranges[0]:
            while ranges[1][start][2] <= lo:
                start += 1
            k = start
            while k < len(ranges[1]) and ranges[1][k][1] < hi:
                links[x, ranges[1][k][0]] += 1
                k += 1
        both = sorted({r[2] for r in ranges[0]} & {r[2] for r in ranges[1]})
        groups, lo = [], 0
        for hi in both:
            groups.append("|".join(",".join(str(k) for k, s, e in own if lo <= s and e <= hi) for own in ranges) if len(t) < 3000 else "")
            lo = hi
        held.append((len(a), len(b), len(both), links, ";".join(groups)))
    total = sum((h[3] for h in held if h), Counter())
    most = Counter()
    for (_, y), n in total.items():
        most[y] = max(most[y], n)
    out = []
    for h in held:
        if h is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            best = sum(n for p, n in h[3].items() if total[p] == most[p[1]])
            out.append((h[0], h[1], h[2], sum(h[3].values()), best, sum(n * total[p] for p, n in h[3].items()), h[4]))
    return out


def check(rows, texts):
    for r, want in zip(rows, plain(texts), strict=True):
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == want[:6]
        if want[6] and not want[6].startswith(";"):
            assert r.groups_sha256 == hashlib.sha256(want[6].encode()).hexdigest()
        assert bool(r.groups_sha256) == (want[2] > 0)


def test_tables_equal_the_libraries(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = sorted(m.op12_token_alignment(spark, sf).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == sorted(docs)
    check(got, [docs[r.doc_id] for r in got])


@pytest.mark.parametrize("head", [m.HEAD_PAIRS, 40, 0])
def test_odd_texts(spark, make, odd, empty, head):
    """Whatever part of the counts is sent to the tasks, results are the same."""
    lot = random.Random(3)
    signs = ["a", "b", "é", "  ", " ", "\n", "\t", "…", "日本", "👍🏽", "naïve", "don't", "<|endoftext|>", "</s>", "<0x41>", "1234", "é", " ", "᠎", "ﬁ", "\x00x"]
    texts = ["".join(lot.choice(signs) for _ in range(lot.randrange(1, 40))) for _ in range(120)]
    texts += ["▁", "a ▁b", " ", "  x", "x  ", "Hello  world", None, "", "The same words here", "The same words here", "w" * 5000]
    texts += [r[1] for r in odd.select("doc_id", "text").collect()]
    got = sorted(m.compared(make([(i, t, "en", "a") for i, t in enumerate(texts)]), FILES, head_pairs=head).collect(), key=lambda r: r.doc_id)
    check(got, texts)
    assert m.compared(empty, FILES, head_pairs=head).count() == 0


def test_walk_on_random_ends():
    lot = random.Random(9)
    for n in (1, 2, 5, 40, 700):
        for share in (0.02, 0.3, 0.9):
            a = [k for k in range(1, n) if lot.random() > share] + [n]
            b = [k for k in range(1, n) if lot.random() > share] + [n]
            if share == 0.02:
                b = sorted(set(a) - {lot.choice(a[:-1] or [0])})
            a_inner, b_inner, left, right = m.walk(np.array(a), np.array(b))
            assert a_inner == [i for i, x in enumerate(a) if x not in b] and b_inner == [j for j, x in enumerate(b) if x not in a]
            starts = [0, *a], [0, *b]
            every = {(i, j) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < b[j] and starts[1][j] < a[i]}
            single = {(i, j) for i, j in every if a[i] == b[j] and starts[0][i] == starts[1][j]}
            pairs = list(zip(left, right, strict=True))
            assert len(pairs) == len(set(pairs)) and set(pairs) == every - single


def test_probes_are_few_on_a_long_stretch():
    class Ends(bytes):
        looks = 0

        def __getitem__(self, k):
            Ends.looks += 1
            return super().__getitem__(k)

    ends = np.arange(1, 100_001, dtype=np.int32)
    other = ends.copy()
    other[77_777] = 0
    assert m.walk(ends, ends) == ([], [], [], [])
    assert m.stretch(Ends(ends.tobytes()), Ends(ends.tobytes()), 0, 0) == 100_000
    assert m.stretch(Ends(ends.tobytes()), Ends(other.tobytes()), 0, 0) == 77_777
    assert m.stretch(Ends(ends.tobytes()), Ends(other.tobytes()), 77_777, 77_777) == 0
    assert Ends.looks < 200
