"""Hidden Markov language model over whole texts.

Tokens are words (A-Z as a-z) and one end for each text. Every known word has a
class: the CLASS_WORDS most frequent ones are classes of their own, all others
fall into SUFFIX_CLASSES by their last bytes. Latent states emit classes, and a
word is drawn from its class by its count, so the state model has a fixed size
while the counts grow with the corpus. Unknown words are one more word of their
class.

Baum-Welch trains the states: each task sums expected counts over the encoded
texts of its partition, Spark adds them up, the driver normalises them. The
scaled forward recursion then gives the exact likelihood of every text.

Counts of the HEAD_WORDS most frequent words are sent to all tasks (fixed size),
so only rarer words are joined to the count table, and none of them is frequent.

Defined cases: null and empty texts are the end token alone; a null id belongs
to no held-out fold; without training rows all words are unknown and both scores
are those of an untrained model; repeated rows are scored each; other columns
are not looked at. Of words of equal count the smaller one is a class of its own
first; which of the rarer words are sent and which joined changes no score. A
very long text is a block of its own, held by one task with 8 numbers a token.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmask.llm.common import documents, fold_of, q, small_batches, stored

HEAD_WORDS = 32_768
CLASS_WORDS = 4_096
SUFFIX_CLASSES = 1_024
SUFFIX = 3
STATES = 8
ROUNDS = 5
BLOCK = 600_000  # tokens that a recursion runs over at once
FLUSH = 200_000  # distinct words a task counts before it passes them on
UNIT = 2.0**20  # expected counts are added up as whole multiples of 1 / UNIT
CLASSES = CLASS_WORDS + SUFFIX_CLASSES + 1
END = CLASSES - 1


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of one task's texts; a word may come several times."""

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(split(text))
        if len(counts) >= FLUSH:
            yield out(counts)
            counts = Counter()
    yield out(counts)


class Vocabulary:
    """Frequent words with their counts, and the sizes of the suffix classes."""

    def __init__(self, head: list[tuple[bytes, int]], inside: dict[int, tuple[int, int]], texts: int, words: int, types: int):
        self.place = {w: i for i, (w, _) in enumerate(head)}
        self.tokens = words + texts
        self.types = types + (texts > 0)
        self.texts = texts
        count = np.array([c for _, c in head] or [0], np.float64)
        code = np.arange(len(count))
        for i in range(CLASS_WORDS, len(head)):
            code[i] = suffix_class(head[i][0])
        self.code = code.astype(np.uint16)
        self.log = np.log10(count + 1)
        total = np.ones(SUFFIX_CLASSES)
        seen = np.zeros(SUFFIX_CLASSES)
        for k, (n, v) in inside.items():
            total[k - CLASS_WORDS] += n + v
            seen[k - CLASS_WORDS] = n
        self.class_log = np.log10(total)
        own = np.arange(len(count)) < CLASS_WORDS
        self.within = np.where(own, 0.0, self.log - self.class_log[np.where(own, 0, code - CLASS_WORDS)])
        frequency = np.zeros(CLASSES)
        frequency[: min(len(head), CLASS_WORDS)] = count[: min(len(head), CLASS_WORDS)]
        frequency[CLASS_WORDS : CLASS_WORDS + SUFFIX_CLASSES] = seen
        frequency[END] = texts
        self.share = (frequency + 1) / (frequency + 1).sum()

    def encode(self, text: str | None):
        """(codes, log10 sum of head counts, log10 within classes, rare words, head words)."""
        words = split(text)
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        known = at >= 0
        codes = np.empty(len(words) + 1, np.uint16)
        codes[:-1] = self.code[at]
        rare = [words[i] for i in np.flatnonzero(~known)]
        rare_codes = np.fromiter(map(suffix_class, rare), np.int64, len(rare))
        codes[:-1][~known] = rare_codes
        codes[-1] = END
        held = at[known]
        log = float(self.log[held].sum() + np.log10(self.texts + 1))
        within = float(self.within[held].sum() - self.class_log[rare_codes - CLASS_WORDS].sum())
        return codes, log, within, Counter(rare), len(held) + (self.texts > 0)


def suffix_class(word: bytes) -> int:
    return CLASS_WORDS + crc32(word[-SUFFIX:]) % SUFFIX_CLASSES


class States:
    """Start, transition and emission probabilities of the latent states."""

    def __init__(self, share: np.ndarray, seed: int = 11):
        random = np.random.default_rng(seed)
        self.share = share
        self.start = np.full(STATES, 1 / STATES)
        self.move = np.full((STATES, STATES), 0.2 / (STATES - 1))
        np.fill_diagonal(self.move, 0.8)
        noise = random.gamma(1.0, 1.0, (len(share), STATES)) + 0.05
        self.emit = share[:, None] * noise
        self.emit /= self.emit.sum(axis=0)

    def update(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        """Normalise expected counts; every class keeps a share in every state."""
        self.start = (start + 1) / (start + 1).sum()
        self.move = (move + 1) / (move + 1).sum(axis=1, keepdims=True)
        emit = emit + 50 * self.share[:, None]
        self.emit = emit / emit.sum(axis=0)


class Layout:
    """Texts of a block side by side: all first tokens, all second tokens, and so on."""

    def __init__(self, texts: list[np.ndarray]):
        sizes = np.array([len(t) for t in texts])
        self.order = np.argsort(-sizes, kind="stable")
        sizes = sizes[self.order]
        self.active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, sizes[0] + 1), side="left")
        self.offset = np.concatenate([[0], np.cumsum(self.active)])
        joined = np.concatenate([texts[i] for i in self.order])
        step = np.arange(len(joined)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.text = np.repeat(np.arange(len(sizes)), sizes)
        self.place = self.offset[step] + self.text
        self.codes = np.empty(len(joined), np.int64)
        self.codes[self.place] = joined

    def forward(self, states: States, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward variables, their scales, and the emissions."""
        e = states.emit.astype(kind)[self.codes]
        move = states.move.astype(kind)
        alpha, scale = np.empty_like(e), np.empty(len(e), kind)
        before = None
        for t, n in enumerate(self.active):
            at = slice(self.offset[t], self.offset[t] + n)
            a = e[at] * (states.start.astype(kind) if before is None else before[:n] @ move)
            s = a.sum(axis=1)
            a /= s[:, None]
            alpha[at], scale[at], before = a, s, a
        return alpha, scale, e

    def likelihoods(self, states: States) -> np.ndarray:
        """log10 likelihood of each text, in the order given."""
        _, scale, _ = self.forward(states, np.float64)
        out = np.empty(len(self.order))
        logs = np.log10(scale)[self.place]
        out[self.order] = np.add.reduceat(logs, np.flatnonzero(np.diff(self.text, prepend=-1)))
        return out

    def expected(self, states: States):
        """Expected starts, moves and emissions, and the log10 likelihood."""
        alpha, scale, e = self.forward(states, np.float32)
        back = states.move.T.astype(np.float32)
        moves = np.zeros((STATES, STATES))
        beta = np.ones_like(alpha)
        e /= scale[:, None]
        for t in range(len(self.active) - 1, 0, -1):
            n = self.active[t]
            at, prior = slice(self.offset[t], self.offset[t] + n), slice(self.offset[t - 1], self.offset[t - 1] + n)
            w = beta[at] * e[at]
            moves += alpha[prior].T @ w
            beta[prior] = w @ back
        beta *= alpha
        emitted = np.stack([np.bincount(self.codes, weights=beta[:, k], minlength=CLASSES) for k in range(STATES)], axis=1)
        return beta[: self.active[0]].sum(axis=0), moves * states.move, emitted, float(np.log10(scale).sum(dtype=np.float64))


def blocks(codes: Iterator[pa.Array]) -> Iterator[list[np.ndarray]]:
    """Encoded texts in runs of about BLOCK tokens; a longer text is a run of its own."""
    run, size = [], 0
    for batch in codes:
        for data in batch.to_pylist():
            run.append(np.frombuffer(data, np.uint16))
            size += len(run[-1])
            if size >= BLOCK:
                yield run
                run, size = [], 0
    if run:
        yield run


def head_cut(counts: DataFrame) -> int:
    """The least count that at most HEAD_WORDS words exceed, from histograms of the counts.

    The first has 16 steps an octave, the second only the counts of one step, so
    neither grows with the number of words.
    """
    step = F.floor(F.log2("c") * 16)
    above = 0
    for at, n in sorted(counts.groupBy(step).count().collect(), reverse=True):
        if above + n > HEAD_WORDS:
            break
        above += n
    else:
        return 0
    for c, n in sorted(counts.filter(step == at).groupBy("c").count().collect(), reverse=True):
        if above + n > HEAD_WORDS:
            return c
        above += n
    raise AssertionError("a step has as many words as its counts")


def head_words(counts: DataFrame, types: int) -> list[tuple[bytes, int]]:
    """Frequent words with their counts, the most frequent first, equal ones by word.

    At most HEAD_WORDS, but all classes of their own. Words as frequent as the
    least ones are joined like rarer words, unless classes are still to be named.
    """
    cut = head_cut(counts)
    head = counts.filter(F.col("c") > cut).collect()
    missing = min(CLASS_WORDS, types) - len(head)
    if missing > 0:
        # Written first, so that tasks and not the driver merge the tied words.
        head += stored(counts.filter(F.col("c") == cut).orderBy("word").limit(missing)).collect()
    return sorted(((bytes(w), c) for w, c in head), key=lambda r: (-r[1], r[0]))


def vocabulary(training: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary and the stored table (word, c) of all training words. training: (text)."""
    counts = stored(training.mapInArrow(count_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("c")))
    texts = training.count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = head_words(counts, total[1])
    inside = {}
    if total[1] > CLASS_WORDS:
        word, c = head[CLASS_WORDS - 1]
        later = (F.col("c") < c) | ((F.col("c") == c) & (F.col("word") > F.lit(bytearray(word))))
        suffix = F.crc32(F.substring("word", -SUFFIX, SUFFIX)) % SUFFIX_CLASSES + CLASS_WORDS
        rows = counts.filter(later).groupBy(suffix.cast("int").alias("k")).agg(F.sum("c"), F.count("*")).collect()
        inside = {k: (n, v) for k, n, v in rows}
    return Vocabulary(head, inside, texts, total[0], total[1]), counts


def encoded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """docs (doc_id, held_out, text) as stored codes, with the sums over frequent words."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocab)  # HEAD_WORDS entries at most
    kind = "codes binary, n_tokens bigint, head_known bigint, head_log double, within double, rare array<binary>, times array<bigint>"

    @F.arrow_udf(spark.createDataFrame([], kind).schema)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = shared.value
        for batch in batches:
            rows = [v.encode(t) for t in batch.to_pylist()]
            sizes = np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])]).astype(np.int32)
            words = pa.array([w for r in rows for w in r[3]], pa.binary())
            times = pa.array([n for r in rows for n in r[3].values()], pa.int64())
            yield pa.StructArray.from_arrays(
                [
                    pa.array([r[0].tobytes() for r in rows], pa.binary()),
                    pa.array([len(r[0]) for r in rows], pa.int64()),
                    pa.array([r[4] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.float64()),
                    pa.array([r[2] for r in rows], pa.float64()),
                    pa.ListArray.from_arrays(pa.array(sizes), words),
                    pa.ListArray.from_arrays(pa.array(sizes), times),
                ],
                ["codes", "n_tokens", "head_known", "head_log", "within", "rare", "times"],
            )

    found = docs.select("doc_id", "held_out", encode("text").alias("e")).select("doc_id", "held_out", "e.*")
    return stored(found.withColumn("row", F.monotonically_increasing_id()))


def trained(codes: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> States:
    """Baum-Welch over all rows of codes (codes binary)."""
    states = States(vocab.share)
    spark = codes.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(states)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((1 + STATES + CLASSES, STATES))
            for block in blocks(b.column(0) for b in batches):
                start, move, emit, _ = Layout(block).expected(shared.value)
                sums += np.concatenate([start[None], move, emit])
            used = np.flatnonzero(sums.any(axis=1))
            whole = np.rint(sums[used] * UNIT).astype(np.int64)
            offsets = pa.array(np.arange(len(used) + 1, dtype=np.int32) * STATES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(whole.ravel(), pa.int64()))], ["k", "v"]
            )

        parts = codes.mapInArrow(expect, "k int, v array<bigint>")
        sums = parts.groupBy("k").agg(*[F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(STATES)]).toArrow()
        total = np.zeros((1 + STATES + CLASSES, STATES))
        total[sums["k"].to_numpy()] = np.stack([sums[f"v{j}"].to_numpy() for j in range(STATES)], axis=1) / UNIT
        states.update(total[0], total[1 : 1 + STATES], total[1 + STATES :])
        shared.unpersist()
    return states


def likelihoods(codes: DataFrame, states: States) -> DataFrame:
    """(row, log10) of every encoded text, by the forward recursion."""
    shared = codes.sparkSession.sparkContext.broadcast(states)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[int] = []

        def noted():
            for batch in batches:
                rows.extend(batch.column(0).to_pylist())
                yield batch.column(1)

        for block in blocks(noted()):
            own = rows[: len(block)]
            del rows[: len(block)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int64()), pa.array(Layout(block).likelihoods(shared.value), pa.float64())], ["row", "log10"]
            )

    return codes.select("row", "codes").mapInArrow(forward, "row bigint, log10 double")


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Scores of every row, learned from the rows for which held_out does not hold."""
    small_batches(docs.sparkSession)
    rows = docs.select(q(id_col).alias("doc_id"), held_out.alias("held_out"), q(text_col).alias("text"))
    vocab, counts = vocabulary(rows.filter(~F.col("held_out")).select("text"))
    codes = encoded(rows, vocab)
    states = trained(codes.filter(~F.col("held_out")).select("codes"), vocab, rounds)
    logs = likelihoods(codes, states)
    rare = codes.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("n"))
    joined = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("rare_log"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"),
    )
    narrow = codes.select("row", "doc_id", "held_out", "n_tokens", "head_known", "head_log", "within")
    every = narrow.join(logs, "row").join(joined, "row", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return every.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("head_log") + rare_log - F.col("n_tokens") * F.log10(F.lit(float(vocab.tokens + vocab.types + 1)))).alias("base_score"),
        (F.col("log10") + F.col("within") + rare_log).alias("score"),
    )


def op1_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), fold_of(F.col("doc_id"), 7) == 2)
