"""Language identification as a mixture of languages in each document.

Learning counts hashed byte trigrams of the words of all training documents per
language. A document is a mixture: expectation-maximisation estimates the share
of each language from the trigram likelihoods, until the shares are within
TOLERANCE of the best log-likelihood, and the set of languages is chosen by
penalised likelihood (BIC): the weakest language is dropped as long as that
lowers the penalty by more than it costs. The language with the largest
share is the prediction, its share the score.

Defined cases: a null text or one without letters gets `und` and score 0; equal
shares go to the smaller name; rows with null language or null text are not
learned from; without any training row, every text is `und`; repeated rows are
scored each; a text of any length is counted whole, at most BUCKETS different
trigrams of it are fitted; other columns are not looked at.

A further value, gain, is the mean log-likelihood of a trigram under the chosen
shares less that of buckets drawn at random. Text in no learned language is less
likely than chance, so its gain is below 0.

The model is one row of BUCKETS numbers a language, so it grows with the number
of languages, not with the documents.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmask.llm.common import documents, fold_of, q, small_batches

BUCKETS = 2**15
TOLERANCE = 0.02  # of log-likelihood, below the smallest penalty for which it could matter
SMOOTHING = 0.5
UNKNOWN = "und"
NO_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    return text is not None and any(map(str.isalpha, text))


def grams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams centred on a word's byte."""
    data = b" " + text.lower().encode("utf-8", "surrogatepass").translate(NO_LETTERS) + b" "
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    a = ((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761)
    return (a >> np.uint32(17))[b[1:-1] != 32]


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of one task's rows, by language."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
            total += np.bincount(grams(text), minlength=BUCKETS)
    for lang, total in sums.items():
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(total[used], pa.int64())],
            ["lang", "bucket", "n"],
        )


class Model:
    """Log-probabilities per bucket and language; languages in order of name."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        smooth = counts + SMOOTHING
        self.p = smooth / smooth.sum(axis=0)
        self.log_p = np.log(self.p)

    def fit(self, p: np.ndarray, n: np.ndarray, shares: np.ndarray, enough: float = -np.inf) -> tuple[np.ndarray, float, float]:
        """Shares of the languages in p, the log-likelihood they reach, and how much more any shares could.

        Ends where that is at most TOLERANCE, or where no shares can reach enough.
        The bound is Jensen's inequality over the gradient; it falls to 0 with the rounds.
        """
        total = n.sum()
        while True:
            mixed = p @ shares
            ratio = (p.T @ (n / mixed)) / total
            reached = float(n @ np.log(mixed))
            left = float(total * np.log(max(1.0, ratio.max())))
            if left <= TOLERANCE or reached + left <= enough:
                return shares, reached, left
            shares = shares * ratio

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Trigram buckets of a text and their counts; none without a letter."""
        g = grams(text) if self.names and has_letter(text) else np.zeros(0, np.int64)
        n = np.bincount(g, minlength=BUCKETS)
        buckets = np.flatnonzero(n)
        return buckets, n[buckets].astype(np.float64)

    def shares_of(self, buckets: np.ndarray, n: np.ndarray) -> dict[int, float]:
        """The chosen languages with their shares."""
        p = self.p[buckets]
        held = np.arange(len(self.names))
        penalty = 0.5 * np.log(n.sum())
        alone = n @ self.log_p[buckets]
        best = int(alone.argmax())
        share, reached, left = self.fit(p, n, np.full(len(held), 1 / len(held)), alone[best] + penalty)
        # no set of several languages can reach more than all of them together
        if reached + left - alone[best] <= penalty:
            return {best: 1.0}
        while len(held) > 1:
            rest = np.delete(np.arange(len(held)), np.argmin(share))
            start = share[rest] + 1e-6
            less, likely, left = self.fit(p[:, held[rest]], n, start / start.sum(), reached - penalty)
            if reached - likely > penalty:
                break
            held, share, reached = held[rest], less, likely
        return {int(k): float(s) for k, s in zip(held, share, strict=True)}

    def shares(self, text: str | None) -> dict[str, float]:
        """The chosen languages of a text with their shares; empty if there is none."""
        buckets, n = self.counts(text)
        return {self.names[k]: s for k, s in self.shares_of(buckets, n).items()} if len(n) else {}

    def gain(self, buckets: np.ndarray, n: np.ndarray, shares: dict[int, float]) -> float:
        """Mean log-likelihood of a trigram over that of a random bucket."""
        mixed = self.p[buckets][:, list(shares)] @ np.array(list(shares.values()))
        return float(n @ np.log(mixed) / n.sum() + np.log(BUCKETS))

    def judged(self, text: str | None) -> tuple[str, float, str, float | None]:
        """Language of the largest share, that share, all chosen languages, gain."""
        buckets, n = self.counts(text)
        if not len(n):
            return UNKNOWN, 0.0, "", None
        found = self.shares_of(buckets, n)
        k = min(found, key=lambda k: (-found[k], k))
        return self.names[k], min(1.0, found[k]), ",".join(self.names[i] for i in sorted(found)), self.gain(buckets, n, found)

    def best(self, text: str | None) -> tuple[str, float, str]:
        return self.judged(text)[:3]


def train(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count over all rows for which learn holds; only sums reach the driver."""
    small_batches(docs.sparkSession)
    rows = docs.filter(learn & q(lang_col).isNotNull() & q(text_col).isNotNull())
    rows = rows.select(q(lang_col).alias("lang"), q(text_col).alias("text"))
    sums = (
        rows.mapInArrow(counted, "lang string, bucket int, n bigint")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    langs = sums["lang"].to_pylist()
    names = sorted(set(langs))
    counts = np.zeros((BUCKETS, len(names)))
    place = {name: k for k, name in enumerate(names)}
    counts[sums["bucket"].to_numpy(), [place[x] for x in langs]] = sums["n"].to_numpy()
    return Model(names, counts)


def predictor(spark: SparkSession, model: Model):
    """An expression builder: text to struct(lang_pred, score, languages, gain)."""
    shared = spark.sparkContext.broadcast(model)
    small_batches(spark)

    @F.arrow_udf("struct<lang_pred: string, score: double, languages: string, gain: double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judged = functools.partial(Model.judged, shared.value)
        for batch in batches:
            rows = [judged(t) for t in batch.to_pylist()]
            parts = list(zip(*rows, strict=True)) or [(), (), (), ()]
            kinds = [pa.string(), pa.float64(), pa.string(), pa.float64()]
            columns = [pa.array(part, kind) for part, kind in zip(parts, kinds, strict=True)]
            yield pa.StructArray.from_arrays(columns, ["lang_pred", "score", "languages", "gain"])

    return predict


def identify(docs: DataFrame, learn: Column, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """(doc_id, lang_pred, score, languages, gain) of every row, learned where learn holds."""
    predict = predictor(docs.sparkSession, train(docs, learn, text_col, lang_col))
    return docs.select(q(id_col).alias("doc_id"), predict(q(text_col)).alias("p")).select("doc_id", "p.*")


def op9_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fold = fold_of(F.col("doc_id"), 5)
    found = identify(docs, fold != 0)
    return found.select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score", "languages", "gain")
