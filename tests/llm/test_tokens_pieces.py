"""Token counts against the library, pieces against a plain search."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmask.llm import pieces, token_counts
from quillmask.llm.common import shared_folder

JSON = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
SIGNS = ["a", " ", "\n", "\t", "é", "1", ",", "'s", "᠎", "\x1c", "<|endoftext|>", "日", " x", "\x85", "▁", "😀", "the "]


def odd_texts(n, seed=4):
    lot = random.Random(seed)
    return ["".join(lot.choice(SIGNS) for _ in range(lot.randrange(30))) for _ in range(n)]


@pytest.fixture(scope="module")
def codec():
    with open(MODEL, "rb") as file:
        return pieces.Codec(file.read())


def test_counts_equal_the_library(spark, sf):
    library = Tokenizer.from_file(JSON)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in token_counts.op2_token_cache(spark, sf).collect():
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False))
        assert r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 1024)


def test_pieces_of_texts_add_up():
    library, texts = Tokenizer.from_file(JSON), odd_texts(3000)
    want = [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.Tokenizer(JSON).counter().counts(texts) == want


def test_other_tokenizers_count_whole_texts():
    texts = odd_texts(50)
    lower = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = token_counts.Counter(token_counts.Tokenizer(public_tokenizers.path("word_bpe_49k.json"))).counts(texts)
    assert got == [len(e) for e in lower.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert token_counts.Counter(token_counts.Tokenizer(MODEL)).counts(texts) == [len(model.encode(t)) for t in texts]


def test_only_misses_are_encoded(spark, odd, odd_rows, empty):
    cache = shared_folder(spark)
    first = sorted(token_counts.token_counts(odd, JSON, cache).collect(), key=str)
    held = spark.read.parquet(cache)
    assert held.count() == len({t or "" for _, t, _, _ in odd_rows}) and len(first) == len(odd_rows)
    # a marked entry shows that a count came from the cache
    marked = held.withColumn("n_tokens", F.col("n_tokens") + 1000)
    other = shared_folder(spark)
    marked.filter(F.col("n_tokens") > 1001).write.parquet(other)
    again = {r.doc_id: r.n_tokens for r in token_counts.token_counts(odd, JSON, other).collect()}
    want = {r.doc_id: r.n_tokens for r in first}
    assert all(again[i] == want[i] + (1000 if want[i] > 1 else 0) for i in again)
    assert spark.read.parquet(other).count() == held.count()
    # hits are told from misses, and repeated entries count once
    other = shared_folder(spark)
    marked.filter(F.col("n_tokens") > 1001).unionAll(marked.filter(F.col("n_tokens") > 1001)).write.parquet(other)
    told = token_counts.token_counts(odd, JSON, other).collect()
    assert len(told) == len(odd_rows) and all(r.from_cache == (r.n_tokens > 1000) for r in told)
    assert {r.from_cache for r in told} == {True, False} and not any(r.from_cache for r in first)
    assert all(r.from_cache for r in token_counts.token_counts(odd, JSON, other).collect())
    # entries of another tokenizer are not used
    assert token_counts.token_counts(odd, MODEL, cache).filter("n_tokens > 1000000").count() == 0
    assert spark.read.parquet(cache).count() == 2 * held.select("content").distinct().count()
    assert token_counts.token_counts(empty, JSON, cache).count() == 0
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in first}[2] == (0, 0)


def search(codec, text):
    """Best score over all ways to cut a word, by all substrings."""
    gains = {codec.written[k].decode(): codec.scores[k] for _, (_, k, _) in codec.automaton.iter(text)}
    score = [0.0]
    for end in range(1, len(text) + 1):
        ways = [score[i] + gains[p] for i in range(end) if (p := text[i:end].replace(pieces.BLANK, " ")) in gains]
        score.append(max([score[-1] + codec.unknown, *ways]))
    return score[-1]


def test_best_path_against_all_cuts(codec):
    for text in ["▁the", "▁▁understanding", "▁日本語x", "▁aaaaaaa", "▁ñandúes", "\n\t", "▁" + "internationalisation" * 3]:
        ids, score = codec.best(text)
        assert score == search(codec, text)
        assert b"".join(codec.written[k] for k in ids).decode() == text.replace(pieces.BLANK, " ")


def test_words_put_together_are_the_best_whole(codec):
    for text in odd_texts(200, 9):
        if text and pieces.BLANK not in text:
            spaced = pieces.BLANK + text.replace(" ", pieces.BLANK)
            assert codec.encode(text)[1] == pytest.approx(codec.best(spaced)[1])


def test_round_trip(spark, sf, codec, odd, odd_rows, empty):
    for text in odd_texts(2000, 6) + ["", " ", "▁", "▁ ▁", "\x00"]:
        assert codec.decode(codec.encode(text)[0].tolist()) == text
    assert pieces.op4_sentencepiece(spark, sf).filter("NOT round_trip").count() == 0
    got = pieces.encode(odd, MODEL)
    back = got.select("doc_id", pieces.decoder(spark, MODEL)("ids").alias("t")).collect()
    assert sorted((r.t for r in back)) == sorted(t or "" for _, t, _, _ in odd_rows)
    assert {r.doc_id: r.n_pieces for r in got.collect()}[3] == 0
    assert pieces.encode(empty, MODEL).count() == 0


def test_ids_equal_the_library(spark, sf):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("NOT contains(text, '▁')")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in pieces.encode(docs, MODEL).collect()}
    assert got.keys() == texts.keys() and len(got) > 100
    for i, text in texts.items():
        assert got[i].ids == library.encode(text or "")
        assert got[i].n_pieces == len(got[i].ids)


def test_odd_ids_equal_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    with open(MODEL, "rb") as file:
        merging = pieces.codec_of(file.read())
    lot = random.Random(11)
    runs = ["".join(lot.choice("abeinrst ,1日本") for _ in range(lot.randrange(400))) for _ in range(300)]
    texts = [t for t in odd_texts(2000, 7) if pieces.BLANK not in t]
    for text in ["the and License", " " * 37 + "x", "internationalisation" * 50, "a" * 999, *runs, *texts]:
        ids, score = merging.encode(text)
        assert ids.tolist() == library.encode(text)
        assert merging.decode(ids.tolist()) == text
    ids, score = merging.encode("the License")
    assert score == sum(library.get_score(int(k)) for k in ids)
