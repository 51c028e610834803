"""Toxicity from averaged subword embeddings and a linear softmax.

A text's words are cut into byte n-grams with the blanks around them, hashed
into an embedding table. The vector of a run of words is the average of its
n-gram vectors, and a linear softmax over that vector gives the run's
probability. A document is as toxic as its most toxic run, as one insult in a
long clean text would be averaged away otherwise. No n-gram crosses a blank, so
the log odds of a run are a weighted mean of those of its words: the maximum over
all runs, of any length and from any start, is that over single words, and only
these are computed. Clean words before or after a text change nothing. Table and
softmax are trained jointly by gradient steps in numpy; a misspelled word shares
most n-grams with its origin.

Training reads at most SAMPLE_ROWS labelled rows of either class, those with the
smallest hash of their id; scoring covers every row and whole texts.

Defined cases: null texts and texts without words have score 0; without labelled
rows of both classes every score is 0; null labels are ignored, of several
labels of an id the largest counts, of several texts of an id the smallest is
learned from; repeated rows are scored each; a text of any length is scored
whole, cut up BLOCK characters of texts at a time or, if longer, alone; of equal
words in training the first counts; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmask.llm.common import documents, fold_of, q, small_batches

SAMPLE_ROWS = 2000
GRAMS = (3, 4, 5)
BUCKETS = 2**17
DIM = 12
EPOCHS = 6
BATCH = 16
WARM = 1  # first epochs, in which random words carry their document's label
RATE = 0.3
BLOCK = 512 * 1024  # bytes of text that are cut up at once

TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def cut(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-gram buckets and the numbers of their words, and the document of each word."""
    parts = [b" " + b" ".join((t or "").lower().encode("utf-8", "surrogatepass").translate(TO_WORDS).split()) for t in texts]
    data = b"".join(p for p in parts if len(p) > 1) + b" "
    b = np.frombuffer(data, np.uint8)
    blank = b == 32
    word = np.cumsum(blank, dtype=np.int32) - 1  # number of the word that a byte, or the blank before it, belongs to
    counts = np.array([p.count(b" ") if len(p) > 1 else 0 for p in parts], np.int64)
    doc_of_word = np.repeat(np.arange(len(parts)), counts)
    buckets, owners = [], []
    wide = b.astype(np.uint32)
    for n in GRAMS:
        size = len(b) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n, np.uint32)
        good = np.ones(size, bool)
        for j in range(n):
            h = (h * np.uint32(16777619)) ^ wide[j : j + size]
            if 0 < j < n - 1:
                good &= ~blank[j : j + size]
        at = np.flatnonzero(good)
        h = h[at] * np.uint32(2654435769)
        buckets.append((h >> np.uint32(32 - 17)).astype(np.int32))
        owners.append(word[at])
    if not buckets or not counts.sum():
        return np.zeros(0, np.int32), np.zeros(0, np.int64), doc_of_word
    return np.concatenate(buckets), np.concatenate(owners), doc_of_word


class Model:
    """Embedding table, softmax weights and bias; trained by fit."""

    def __init__(self, seed: int = 7):
        self.random = np.random.default_rng(seed)
        self.table = (self.random.random((BUCKETS, DIM), np.float32) - 0.5) * np.float32(0.2)
        self.weights = (self.random.random((2, DIM), np.float32) - 0.5) * np.float32(0.2)
        self.bias = np.zeros(2, np.float32)
        self.sums = [np.full(BUCKETS, 1e-4, np.float32), np.full((2, DIM), 1e-4, np.float32), np.full(2, 1e-4, np.float32)]

    def margins(self) -> tuple[np.ndarray, float]:
        """What each n-gram adds to the log odds, and the log odds of nothing."""
        return self.table @ (self.weights[1] - self.weights[0]), float(self.bias[1] - self.bias[0])

    def step(self, grams: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> None:
        """One gradient step (Adagrad) over words; owner numbers them from 0, in order."""
        n = len(labels)
        size = np.bincount(owner, minlength=n).astype(np.float32)
        starts = np.cumsum(size.astype(np.int64)) - size.astype(np.int64)
        hidden = np.add.reduceat(self.table[grams], starts, axis=0) / size[:, None]
        logits = hidden @ self.weights.T + self.bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), labels] -= 1
        to_hidden = (p @ self.weights) / size[:, None]
        used, place = np.unique(grams, return_inverse=True)
        each = to_hidden[owner]
        change = np.stack([np.bincount(place, weights=each[:, d], minlength=len(used)) for d in range(DIM)], axis=1).astype(np.float32)
        self.sums[0][used] += (change**2).mean(axis=1)
        self.table[used] -= np.float32(RATE) * change / np.sqrt(self.sums[0][used])[:, None]
        for k, (value, slope) in enumerate(((self.weights, p.T @ hidden / n), (self.bias, p.mean(axis=0))), 1):
            self.sums[k] += slope**2
            value -= np.float32(RATE / 3) * slope / np.sqrt(self.sums[k])

    def fit(self, texts: list[str], labels: list[int], batch: int = BATCH) -> Model:
        y = np.array(labels)
        for epoch in range(EPOCHS):
            order = self.random.permutation(len(texts))
            for k in range(0, len(order), batch):
                rows = order[k : k + batch]
                grams, owner, doc = cut([texts[i] for i in rows])
                full = np.flatnonzero(np.bincount(owner, minlength=len(doc)))
                if not len(full):
                    continue
                if epoch < WARM:
                    lots = self.random.random(len(doc))
                else:
                    lots = self.word_margins(grams, owner, len(doc))
                chosen = top_words(lots, doc, full, 8 if epoch < WARM else 1)
                number = np.full(len(doc), -1)
                number[chosen] = np.arange(len(chosen))
                keep = np.flatnonzero(number[owner] >= 0)
                keep = keep[np.argsort(number[owner[keep]], kind="stable")]
                self.step(grams[keep], number[owner[keep]], y[rows][doc[chosen]])
        return self

    def word_margins(self, grams: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        gain, base = self.margins()
        size = np.bincount(owner, minlength=n)
        return np.bincount(owner, weights=gain[grams], minlength=n) / np.maximum(size, 1) + base

    def scores(self, texts: list[str | None]) -> list[float]:
        """Probability of the most toxic word of each text."""
        gain, base = self.margins()
        out: list[float] = []
        for block in blocks(texts):
            grams, owner, doc = cut(block)
            best = np.full(len(block), -np.inf)
            size = np.bincount(owner, minlength=len(doc))
            margin = np.bincount(owner, weights=gain[grams], minlength=len(doc)) / np.maximum(size, 1) + base
            np.maximum.at(best, doc[size > 0], margin[size > 0])
            out += (1 / (1 + np.exp(-np.clip(best, -500, 500)))).tolist()
        return [0.0 if s < 1e-200 else s for s in out]


def top_words(lots: np.ndarray, doc: np.ndarray, full: np.ndarray, n: int) -> np.ndarray:
    """The n highest words of each document, in order of word."""
    order = full[np.lexsort((-lots[full], doc[full]))]
    d = doc[order]
    first = np.searchsorted(d, d)
    return np.sort(order[np.arange(len(d)) - first < n])


def blocks(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts in runs of about BLOCK characters; a longer one is a run of its own."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if size >= BLOCK:
            yield run
            run, size = [], 0
    if run:
        yield run


def sample(docs: DataFrame, labels: DataFrame, learn: Column, rows: int, id_col: str, text_col: str) -> DataFrame:
    """At most rows labelled texts of either class, by hash of the id; learn reads label_id."""
    known = labels.filter(q("toxic").isNotNull() & q(id_col).isNotNull()).groupBy(q(id_col).alias("label_id"))
    known = known.agg(F.max(q("toxic")).alias("y")).filter(learn)
    lots = [F.xxhash64("label_id"), F.col("label_id")]
    taken = known.filter("y = 1").orderBy(*lots).limit(rows).unionAll(known.filter("y = 0").orderBy(*lots).limit(rows))
    texts = docs.select(q(id_col).alias("id"), q(text_col).alias("text")).filter("text is not null")
    # twice SAMPLE_ROWS ids at most
    joined = texts.join(F.broadcast(taken), F.col("id") == F.col("label_id"))
    return joined.groupBy("label_id", "y").agg(F.min("text").alias("text"))


def train(docs, labels, learn: Column, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    got = sample(docs, labels, learn, rows, id_col, text_col).toArrow().sort_by("label_id").to_pydict()
    return Model().fit(got["text"], got["y"]) if len(set(got["y"])) == 2 else None


def scorer(spark: SparkSession, model: Model | None):
    """An expression builder: text to probability."""
    small_batches(spark)
    if model is not None:
        model.sums = []
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = shared.value
        for batch in batches:
            texts = batch.to_pylist()
            yield pa.array(held.scores(texts) if held else [0.0] * len(texts), pa.float64())

    return score


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = scorer(spark, train(docs, labels, fold_of(F.col("label_id"), 5) != 0))
    scored = docs.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
