"""Token counts with a digest cache.

The cache is a Parquet table of (tokenizer, content, n_tokens): digests of the
tokenizer (file and library version) and of a normalised text, and its count.
Texts are joined to it by digest; only distinct texts that it lacks are encoded,
and they are appended. Copies are folded before texts are shuffled.

Normalising may not change a count: it only turns a null text into an empty one.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows are
counted each, encoded once; an empty table leaves the cache as it is; other
columns are not looked at. If two runs append the same text at once, its equal
entries are folded on reading; a lost executor leaves no part of an append. What
a run stores and joins grows with its own texts, not with the cache, of which it
scans the digests.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmask.llm.common import documents, q, shared_folder, small_batches, stored

CACHE = "tokenizer string, content binary, n_tokens bigint"
LIMIT = 1024
MEMO = 600_000  # remembered pieces of text in a worker; more are counted anew

# A blank between two characters that are no white space by any definition: byte-level
# pre-tokenising always starts a new token there, so counts on both sides add up.
CUT = re.compile(r"(?<=[^\s\u180e])(?= [^\s\u180e])")
UNCLEAR = re.compile(r"(?:^|[\s\u180e]) | (?:[\s\u180e]|$)")


COUNTERS: dict[str, Counter] = {}


class Tokenizer:
    """A tokenizer file with what identifies it; loads in any process."""

    def __init__(self, path: str):
        self.kind = os.path.splitext(path)[1]
        with open(path, "rb") as file:
            self.content = file.read()
        if self.kind == ".json":
            import tokenizers as library
        elif self.kind == ".model":
            import sentencepiece as library
        else:
            raise ValueError(f"no library for {path}")
        version = f"{library.__name__} {library.__version__} ".encode()
        self.digest = hashlib.sha256(version + self.content).hexdigest()

    def counter(self) -> Counter:
        """The worker's counter, kept from task to task with what it remembers."""
        if self.digest not in COUNTERS:
            COUNTERS.clear()
            COUNTERS[self.digest] = Counter(self)
        return COUNTERS[self.digest]


class Counter:
    """Counts tokens of texts in one process."""

    def __init__(self, tokenizer: Tokenizer):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.memo: dict[str, int] = {}
        self.adds_up = False
        if tokenizer.kind == ".json":
            import tokenizers

            text = tokenizer.content.decode()
            encoder = tokenizers.Tokenizer.from_str(text)
            encoder.no_padding()
            encoder.no_truncation()
            self.encode = lambda texts: [len(e) for e in encoder.encode_batch_fast(texts, add_special_tokens=False)]
            said = json.loads(text)
            split = said.get("pre_tokenizer") or {}
            plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
            added = [t["content"] for t in said.get("added_tokens", ())]
            self.adds_up = plain and said.get("normalizer") is None and not any(re.search(r"\s", t) for t in added)
        else:
            import sentencepiece

            encoder = sentencepiece.SentencePieceProcessor(model_proto=tokenizer.content)
            self.encode = lambda texts: [len(e) for e in encoder.encode(texts, num_threads=1)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.adds_up:
            return self.encode(texts)
        cut = [pieces(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        missing = list(set().union(*cut) - self.memo.keys())
        self.memo.update(zip(missing, self.encode(missing), strict=True))
        return [sum(map(self.memo.__getitem__, c)) for c in cut]


def pieces(text: str) -> list[str]:
    """A text cut where the counts of its parts add up."""
    if UNCLEAR.search(text):
        return CUT.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + r for r in rest]]


def encoder_of(spark: SparkSession, tokenizer: Tokenizer):
    shared = spark.sparkContext.broadcast(tokenizer)  # one file of fixed size
    small_batches(spark)

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = shared.value.counter()
        for batch in batches:
            yield pa.array(counter.counts(batch.to_pylist()), pa.int64())

    return count


def token_counts(docs: DataFrame, tokenizer_path: str, cache: str, id_col="doc_id", text_col="text", limit=LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, from_cache) of every row; adds to the cache.

    The cache is read once, and only entries of this run's texts are kept from it.
    """
    spark = docs.sparkSession
    tokenizer = Tokenizer(tokenizer_path)
    text = F.coalesce(q(text_col), F.lit(""))
    digested = docs.select(q(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("content"))
    spark.createDataFrame([], CACHE).write.mode("ignore").parquet(cache)
    held = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == tokenizer.digest)
    wanted = held.join(digested.select("content").distinct(), "content", "left_semi")
    hits = stored(wanted.groupBy("content").agg(F.min("n_tokens").alias("n_tokens")))
    distinct = digested.groupBy("content").agg(F.first("text").alias("text"))
    misses = distinct.join(hits, "content", "left_anti")
    counted = stored(misses.select("content", encoder_of(spark, tokenizer)("text").alias("n_tokens")))
    counted.select(F.lit(tokenizer.digest).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache)
    known = hits.withColumn("from_cache", F.lit(True)).unionByName(counted.withColumn("from_cache", F.lit(False)))
    rows = digested.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes"))
    over = (F.col("n_tokens") > limit).alias("over_limit")
    return rows.join(known, "content").select("doc_id", "n_bytes", "n_tokens", over, "from_cache")


def op2_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own for every run, so that no run leans on another."""
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), shared_folder(spark))
