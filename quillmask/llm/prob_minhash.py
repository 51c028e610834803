"""Near-duplicates by ProbMinHash, banding and verification.

A text is its runs of GRAM words with their counts as weights. Every run arrives
at the times of a Poisson process whose rate is its weight, at a random component
of the signature each time; a component keeps the run that arrives first. Runs
that are later than the last first arrival can change nothing any more and stop
early. Two components are equal with the probability Jaccard similarity of the
two texts. Texts that share a band of components are candidates, and candidates
are verified by their exact similarity.

Equal texts are folded before anything is compared. First every bucket of candidates
compares its members with one of them, its hub, in two rounds with other hubs; that
joins most of a family in work that is in proportion to the members of its buckets.
Members of one class need no comparing; buckets of one class are done. In the others
every two members of different classes meet, so no pair that shares a band is left
out: members lie in blocks of MEMBERS signatures, blocks of one and the same class
never meet, and a meeting of two blocks is one row and one small array comparison.
Members that are alike to one of another class by their signatures meet again in
blocks, with their texts: products of tables of runs give the likenesses of all pairs
of a meeting (of texts with repeated runs, bounds that few pairs pass), and only links
that join two classes become rows, fewer than there are members. The meetings of a bucket
are dealt over tasks. Their number grows with the square of the members outside its
large classes, which is the nature of the job; memory and rows do not.

Members whose signatures agree in fewer than LEAST_ALIKE components (one byte of
each is kept) with all others they meet do not bring their texts; a pair at
SIMILARITY is lost by that with a probability of 3e-8. With exact=True the texts of
all pairs that share a band are compared whatever their signatures.

Defined cases: null texts are empty; texts without words are alike only to
equal ones; a text of fewer words than a run is one run; equal texts are always
of one class; the class id is the smallest doc_id of the class (nulls only if
there is no other); repeated rows belong to one class; texts of any length are
signed and compared as a whole, in the memory of one text; of equal rows one stays; other columns are not
looked at. Words are separated by white space, A-Z counts as a-z.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmask.llm.common import Scratch, documents, q, small_batches, stored

GRAM = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 4
COMPONENTS = BANDS * ROWS
BLOCK = 256 * 1024  # characters of text that are signed at once
LEAST_ALIKE = 76  # of COMPONENTS
MEMBERS = 128  # of a bucket that lie in one block
BLOCK_BYTES = 1 << 20  # of their texts
WIDTH = 1024  # runs of words whose table is multiplied at once
LARGE = 64  # members of one class in a bucket that get blocks of their own
SPREAD = 16  # blocks of a bucket that one task compares with all others
SLACK = 1e-9  # of sums of fractions
HELD = 64  # texts whose runs a task remembers

U = np.uint64
ODD = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
STEP = 0x5851F42D4C957F2D  # multiplier of the rolling word hash


def mix(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit number for each number."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(texts: list[list[bytes]]) -> np.ndarray:
    """One hash for each word of all texts."""
    data = np.frombuffer(b" ".join(b" ".join(t) for t in texts if t) + b" ", np.uint8)
    if len(data) < 2:
        return np.zeros(0, np.uint64)
    blank = data == 32
    starts = np.concatenate([[0], np.flatnonzero(blank)[:-1] + 1])
    back = pow(STEP, -1, 2**64)
    powers = np.cumprod(np.concatenate([[U(1)], np.full(len(data) - 1, U(STEP))]))
    inverse = np.cumprod(np.concatenate([[U(1)], np.full(len(data) - 1, U(back))]))
    value = np.where(blank, U(0), mix(data.astype(np.uint64) + U(1)) * powers)
    return mix(np.add.reduceat(value, starts) * inverse[starts])


def runs(texts: list[list[bytes]], gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, weight) of every distinct run of words of each text."""
    sizes = np.array([len(t) for t in texts])
    doc = np.repeat(np.arange(len(texts)), sizes)
    # a gap of empty words behind each text, so that short texts have a run
    at = np.arange(len(doc)) + doc * (gram - 1)
    padded = np.zeros(len(doc) + len(texts) * (gram - 1), np.uint64)
    padded[at] = word_hashes(texts)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(doc)) - first[doc]
    good = (place <= sizes[doc] - gram) | ((place == 0) & (sizes[doc] < gram))
    at, doc = at[good], doc[good]
    h = np.zeros(len(at), np.uint64)
    for j in range(gram):
        h += padded[at + j] * ODD[j % len(ODD)] + U(j)
        h = mix(h)
    _, index, weight = np.unique(mix(h + doc.astype(np.uint64) * ODD[0]), return_index=True, return_counts=True)
    return h[index], doc[index], weight.astype(np.float64)


def signatures(texts: list[list[bytes]]) -> np.ndarray:
    """The run that arrives first at each component, texts x COMPONENTS."""
    run, doc, weight = runs(texts)
    first = np.full(len(texts) * COMPONENTS, np.inf)
    winner = np.zeros(len(texts) * COMPONENTS, np.uint64)
    time = np.zeros(len(run))
    n = 0
    while len(run):
        draw = mix(run + U(n * int(ODD[1]) % 2**64))
        time = time - np.log((((draw >> U(11)).astype(np.float64)) + 0.5) / 2**53) / weight
        component = doc * COMPONENTS + (mix(draw ^ ODD[2]) % U(COMPONENTS)).astype(np.int64)
        early = np.flatnonzero(time < first[component])
        # of several that arrive at once the earliest is written last
        early = early[np.lexsort((run[early], -time[early]))]
        first[component[early]] = time[early]
        winner[component[early]] = run[early]
        limit = first.reshape(-1, COMPONENTS).max(axis=1)
        on = time < limit[doc]
        run, doc, weight, time = run[on], doc[on], weight[on], time[on]
        n += 1
    return winner.reshape(-1, COMPONENTS)


def band_keys(signed: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, texts x BANDS."""
    rows = signed.reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * ODD[3], rows.shape[:2])
    for j in range(ROWS):
        key = mix(key + rows[:, :, j] * ODD[j])
    return np.ascontiguousarray(key).view(np.int64)


SIGNED = T.StructType([T.StructField("bands", T.ArrayType(T.LongType(), False)), T.StructField("signature", T.BinaryType())])


@F.arrow_udf(SIGNED)
def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Band keys and a byte of each component of each text; none for a text without words."""
    for batch in batches:
        sizes, keys, low = [0], [np.zeros(0, np.int64)], []
        for block in blocks(batch):
            full = [t for t in block if t]
            signed = signatures(full) if full else np.zeros((0, COMPONENTS), np.uint64)
            keys.append(band_keys(signed).ravel())
            own = iter([x.tobytes() for x in (signed & U(255)).astype(np.uint8)])
            low += [next(own) if t else b"" for t in block]
            sizes += [BANDS if t else 0 for t in block]
        bands = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(np.concatenate(keys), pa.int64()))
        yield pa.StructArray.from_arrays([bands, pa.array(low, pa.binary())], SIGNED.names)


def blocks(texts: pa.Array) -> Iterator[list[list[bytes]]]:
    """Words of texts in runs of about BLOCK characters; a longer text is a run of its own."""
    run, size = [], 0
    for text in texts:
        run.append(words(text.as_py()))
        size += sum(map(len, run[-1])) + len(run[-1])
        if size >= BLOCK:
            yield run
            run, size = [], 0
    if run:
        yield run


@F.arrow_udf(T.IntegerType())
def agreeing(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """In how many components two signatures agree."""
    for left, right in batches:
        a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, COMPONENTS) for x in (left, right))
        yield pa.array((a == b).sum(axis=1).astype(np.int32), pa.int32())


def weighted(text: str | None, gram: int = GRAM) -> Counter:
    w = words(text)
    if 0 < len(w) < gram:
        return Counter([tuple(w)])
    return Counter(zip(*[w[j:] for j in range(gram)], strict=False))


def probability_jaccard(a: Counter, b: Counter) -> float:
    """Sum over shared x of 1 / sum over y of max(a[y] / a[x], b[y] / b[x])."""
    shared = a.keys() & b.keys()
    if not shared:
        return 0.0
    if max(a.values()) == 1 and max(b.values()) == 1:
        return len(shared) / (len(a) + len(b) - len(shared))
    every = list(a.keys() | b.keys())
    x = np.array([a[k] for k in every], np.float64)
    y = np.array([b[k] for k in every], np.float64)
    order = np.argsort(np.divide(y, x, out=np.full(len(x), np.inf), where=x > 0), kind="stable")
    x, y = x[order], y[order]
    ratio = np.divide(y, x, out=np.full(len(x), np.inf), where=x > 0)
    both = (x > 0) & (y > 0)
    below = np.searchsorted(ratio, ratio[both], side="right")
    xs, ys = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(y)])
    return float(np.sum(1 / (xs[below] / x[both] + (ys[-1] - ys[below]) / y[both])))


@F.arrow_udf(T.DoubleType())
def similarity(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    runs_of = functools.lru_cache(HELD)(weighted)
    for left, right in batches:
        yield pa.array([probability_jaccard(runs_of(a), runs_of(b)) for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.float64())


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Stored (node, label) of every node of links (a, b); the label is its class's smallest node."""
    own = Scratch(links.sparkSession)
    both = own.stored(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = own.stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        lower = own.stored(lower)
        # a label is a node itself: take over the label it has by now
        jump = lower.select(F.col("node").alias("at"), F.col("label").alias("further"))
        after = own.stored(lower.join(jump, F.col("label") == F.col("at")).select("node", "old", F.least("label", "further").alias("label")))
        labels = after.select("node", "label")
        if not after.filter("label <> old").limit(1).count():
            found = scratch.stored(labels)
            own.clear()
            return found
        own.clear(both, after)


def contracted(label: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) after the links (a, b) have joined classes; only classes are nodes here."""
    if label is None:
        return components(links, scratch)
    for end in ("a", "b"):
        of = label.select(F.col("node").alias(end), F.col("label").alias(f"{end}_class"))
        links = links.join(of, end, "left").withColumn(f"{end}_class", F.coalesce(f"{end}_class", end))
    between = links.select(F.col("a_class").alias("a"), F.col("b_class").alias("b")).filter("a <> b").distinct()
    joined = components(between, scratch)
    known = label.join(joined.select(F.col("node").alias("label"), F.col("label").alias("into")), "label", "left")
    fresh = joined.join(label.select("node"), "node", "left_anti")
    return scratch.stored(known.select("node", F.coalesce("into", "label").alias("label")).unionByName(fresh))


def with_label(members: DataFrame, label: DataFrame | None) -> DataFrame:
    """(bucket, node, label, lone): the class of each member, and whether it is of none yet."""
    if label is None:
        return members.select("bucket", "node", F.col("node").alias("label"), F.lit(True).alias("lone"))
    joined = members.select("bucket", "node").join(label, "node", "left")
    return joined.select("bucket", "node", F.coalesce("label", "node").alias("label"), F.col("label").isNull().alias("lone"))


def memberships(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Stored (bucket, node) of the buckets of at least two texts, one of each set of members."""
    buckets = scratch.stored(nodes.filter("size(bands) > 0").select("node", F.explode("bands").alias("bucket")))
    sets = buckets.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("node").alias("low"), F.bit_xor(F.xxhash64("node")).alias("set"), F.bit_xor(F.hash("node")).alias("set2")
    )
    kept = sets.filter("n > 1").groupBy("n", "low", "set", "set2").agg(F.min("bucket").alias("bucket")).select("bucket")
    return scratch.stored(buckets.join(scratch.stored(kept), "bucket"))


def starred(members: DataFrame, label: DataFrame | None, by_bucket: bool, scratch: Scratch) -> DataFrame:
    """Stored (bucket, node, label, hub, hub_label) of the buckets of several classes.

    Hubs are the first by a hash of the node, so the buckets of a family mostly
    have the same, or of node and bucket. Members of a class come before lone
    ones: its other members then need not be compared with the hub.
    """
    own = with_label(members, label)
    order = F.shiftrightunsigned(F.xxhash64("node", "bucket") if by_bucket else F.xxhash64("node"), 2)
    order = order + F.when(F.col("lone"), F.lit(2**62)).otherwise(F.lit(0))
    hubs = own.groupBy("bucket").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.min_by("node", order).alias("hub"), F.min_by("label", order).alias("hub_label")
    )
    hubs = hubs.filter("low <> high").select("bucket", "hub", "hub_label")
    return scratch.stored(own.join(scratch.stored(hubs), "bucket"))


def blocks_of(batch: pa.RecordBatch, i: int, content: str) -> tuple[np.ndarray, np.ndarray, list]:
    """Nodes and contents of the members of two blocks that meet, and which of them are to be compared.

    Those are of different classes and of different blocks, if there are two; each pair once.
    """
    names = ("block",) if batch["same"][i].as_py() else ("block", "other")
    met = [batch[name][i].values for name in names]
    node, label = (np.concatenate([rows.field(c).to_numpy(zero_copy_only=False) for rows in met]) for c in ("node", "label"))
    block = np.repeat(np.arange(len(met)), [len(rows) for rows in met])
    pairs = np.triu(label[:, None] != label[None, :], 1)
    if len(met) > 1:
        pairs &= block[:, None] != block[None, :]
    return node, label, [c for rows in met for c in rows.field(content).to_pylist()], np.nonzero(pairs)


MEMBER, PAIR = "bucket bigint, node bigint", "a bigint, b bigint"


def two_columns(schema: str, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [np.concatenate([np.zeros(0, np.int64), *[pair[k] for pair in found]]) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in schema.split(", ")])


def alike_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of meetings of blocks of signatures, the members that are alike to one of another class."""
    for batch in batches:
        found = []
        for i in range(batch.num_rows):
            node, _, low, (x, y) = blocks_of(batch, i, "signature")
            signature = np.frombuffer(b"".join(low), np.uint8).reshape(-1, COMPONENTS)
            near = (signature[x] == signature[y]).sum(axis=1) >= LEAST_ALIKE
            alike = np.unique(np.concatenate([x[near], y[near]]))
            found.append((np.full(len(alike), batch["bucket"][i].as_py(), np.int64), node[alike]))
        yield two_columns(MEMBER, found)


def sums_of_shared(doc: np.ndarray, code: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums of the first text's values over the codes that it shares with the second, n x n; a code comes once in a text."""
    shared = np.bincount(code)[code] > 1
    _, code = np.unique(code[shared], return_inverse=True)
    doc, value = doc[shared], value[shared]
    total = np.zeros((n, n))
    for low in range(0, int(code.max(initial=-1)) + 1, WIDTH):
        here = (code >= low) & (code < low + WIDTH)
        own, held = np.zeros((n, WIDTH), np.float32), np.zeros((n, WIDTH), np.float32)
        own[doc[here], code[here] - low] = value[here]
        held[doc[here], code[here] - low] = 1
        total += own @ held.T
    return total


def likeness_bounds(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(bound, certain), n x n: no likeness is above its bound, and where that is certain it is the bound.

    With p, q the weights over their sums and m the sum of min(p, q), the likeness is at most the
    sum of max(p, q) over shared runs, which is that of p and of q less m, divided by 2 - m.
    """
    n = len(texts)
    run, doc, weight = runs(texts)
    _, code = np.unique(run, return_inverse=True)
    size, single = np.bincount(doc, weight, n), np.ones(n, bool)
    single[doc[weight > 1]] = False
    # a run that comes k times is k things, so shared things are the smaller weights
    times = weight.astype(np.int64)
    every = np.repeat(np.arange(len(run)), times)
    copy = np.arange(len(every)) - np.repeat(np.cumsum(times) - times, times)
    _, thing = np.unique(code[every] * (int(times.max(initial=0)) + 1) + copy, return_inverse=True)
    least = sums_of_shared(doc[every], thing, np.ones(len(every)), n)
    certain = single[:, None] & single[None, :]
    bound = least / (size[:, None] + size[None, :] - least)
    if not single.all():
        shared = sums_of_shared(doc, code, weight, n) / size[:, None]
        m = least / np.maximum(size[:, None], size[None, :])
        bound = np.where(certain, bound, (shared + shared.T - m) / (2 - m))
    return bound, certain


def linked_members(threshold: float):
    """Function of meetings of blocks of texts: links of members of different classes, as many as join all that are linked."""

    def links(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
        node, label, texts, (x, y) = blocks_of(batch, i, "text")
        if not len(x):
            return node[:0], node[:0]
        bound, certain = likeness_bounds([words(t) for t in texts])
        maybe = bound[x, y] >= threshold - SLACK
        x, y = x[maybe], y[maybe]
        runs_of = functools.lru_cache(None)(lambda k: weighted(texts[k]))
        _, root = np.unique(label, return_inverse=True)
        kept: list[tuple[int, int]] = []
        # certain links first: what they join needs no comparing
        for k in np.argsort(~certain[x, y], kind="stable"):
            a, b = int(x[k]), int(y[k])
            if root[a] == root[b] or not (certain[a, b] or probability_jaccard(runs_of(a), runs_of(b)) >= threshold - SLACK):
                continue
            root[root == root[b]] = root[a]
            kept.append((a, b))
        ends = np.array(kept, np.int64).reshape(-1, 2)
        return np.minimum(node[ends[:, 0]], node[ends[:, 1]]), np.maximum(node[ends[:, 0]], node[ends[:, 1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield two_columns(PAIR, [links(batch, i)])

    return run


def met(members: DataFrame, contents: DataFrame, function, schema: str, scratch: Scratch) -> DataFrame:
    """Stored rows that function finds in the meetings of the blocks of each bucket.

    members: (bucket, node, label); contents: (node, a column that function reads, its size in bytes).
    """
    small_batches(members.sparkSession)
    content = contents.columns[1]
    sized = members.select("bucket", "node", "label").join(contents.select("node", "size"), "node")
    large = members.groupBy("bucket", "label").count().filter(F.col("count") >= LARGE).select("bucket", "label", F.col("label").alias("own"))
    dealt = scratch.stored(sized.join(large, ["bucket", "label"], "left"))
    sizes = dealt.groupBy("bucket", "own").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("size") / BLOCK_BYTES)).alias("blocks"))
    many = scratch.stored(sizes.filter("blocks > 1").withColumnRenamed("bucket", "at").withColumnRenamed("own", "class"))
    dealt = dealt.join(many, (F.col("bucket") == F.col("at")) & F.col("own").eqNullSafe(F.col("class")), "left")
    block = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1)))
    full = dealt.select("bucket", "own", block.alias("block_id"), "node", "label").join(contents.select("node", content), "node")
    packed = full.groupBy("bucket", "own", "block_id").agg(F.collect_list(F.struct("node", "label", content)).alias("block"))
    packed = scratch.stored(packed.withColumn("id", F.monotonically_increasing_id()))
    # a bucket of one block meets itself; of several, each lot of SPREAD blocks meets all
    counts = packed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    counts = scratch.stored(counts.select("bucket", F.ceil(F.col("n") / SPREAD).alias("lots")))
    itself = packed.filter("own IS NULL").select("bucket", "block", F.col("block").alias("other"), F.lit(True).alias("same"))
    several = packed.join(counts, "bucket")
    one = several.withColumn("lot", F.pmod(F.xxhash64("id"), "lots"))
    all_ = several.select(
        "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot"),
        F.col("id").alias("other_id"), F.col("own").alias("other_own"), F.col("block").alias("other"),
    )
    pairs = one.join(all_, ["bucket", "lot"]).filter("id < other_id AND (own IS NULL OR other_own IS NULL OR own <> other_own)")
    every = itself.unionByName(pairs.select("bucket", "block", "other", F.lit(False).alias("same")))
    return scratch.stored(every.mapInArrow(function, schema).distinct())


def meetings(left: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float, exact: bool, scratch: Scratch) -> DataFrame:
    """(a, b): links that join all members of a bucket that are linked; left: (bucket, node, label).

    Signatures only tell which members are worth bringing their texts.
    """
    if not exact:
        signed = nodes.select("node", "signature", F.lit(COMPONENTS).alias("size"))
        left = left.join(met(left, signed, alike_members, MEMBER, scratch), ["bucket", "node"], "left_semi")
    given = texts.select("node", "text", F.octet_length("text").alias("size"))
    return met(left, given, linked_members(threshold), PAIR, scratch)


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Stored (a, b, likeness) of the distinct pairs whose signatures are alike."""
    for end in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("signature").alias(f"{end}_signature")), end)
    pairs = scratch.stored(pairs.filter(agreeing("a_signature", "b_signature") >= LEAST_ALIKE).select("a", "b"))
    for end in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("node").alias(end), F.col("text").alias(f"{end}_text")), end)
    return scratch.stored(pairs.select("a", "b", similarity("a_text", "b_text").alias("likeness")))


def classes_of(nodes: DataFrame, texts, threshold: float = SIMILARITY, exact: bool = False) -> DataFrame | None:
    """(node, label) of the texts that are linked to others; None if there are none.

    nodes: (node, bands, signature); texts(nodes) gives (node, text).
    """
    scratch = Scratch(nodes.sparkSession)
    label, tested = None, None
    members = memberships(nodes, scratch)
    held = scratch.stored(texts(members.select("node").distinct()))

    def compare(pairs: DataFrame) -> None:
        nonlocal label, tested
        asked = pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        asked = scratch.stored(asked if tested is None else asked.join(tested, ["a", "b"], "left_anti"))
        links = verified(asked, nodes, held, scratch).filter(F.col("likeness") >= threshold - SLACK)
        label = contracted(label, links.select("a", "b"), scratch)
        tested = scratch.stored(asked if tested is None else tested.unionByName(asked))

    for by_bucket in (False, True):
        members = starred(members, label, by_bucket, scratch)
        compare(members.filter("label <> hub_label"))
        scratch.clear(label, tested, held, members)
    left = with_label(members, label)
    mixed = left.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("bucket")
    left = scratch.stored(left.join(mixed, "bucket"))
    if left.limit(1).count():
        label = contracted(label, meetings(left, nodes, held, threshold, exact, scratch), scratch)
    scratch.clear(label)
    return label


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(q(text_col), F.lit(""))
    return docs.select(q(id_col).alias("doc_id"), text_key(text).alias("digest"), text.alias("text"))


def text_classes(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, threshold: float, exact: bool) -> tuple[DataFrame, DataFrame]:
    """Stored (doc_id, digest) of all rows and (digest, label, first_id) of all distinct texts."""
    keyed = keyed_rows(docs, id_col, text_col)
    signed = scratch.stored(keyed.select("doc_id", "digest", sign("text").alias("s")).select("doc_id", "digest", "s.*"))
    folded = signed.groupBy("digest").agg(F.first("bands").alias("bands"), F.first("signature").alias("signature"), F.min("doc_id").alias("first_id"))
    nodes = scratch.stored(folded.withColumn("node", F.monotonically_increasing_id()))

    def texts(wanted: DataFrame) -> DataFrame:
        digests = nodes.join(wanted, "node").select("node", "digest")
        return keyed.join(digests, "digest").groupBy("node").agg(F.first("text").alias("text"))

    label = classes_of(nodes.select("node", "bands", "signature"), texts, threshold, exact)
    joined = nodes.select("node", "digest", "first_id").join(label, "node", "left")
    classes = scratch.stored(joined.select("digest", "first_id", F.coalesce("label", "node").alias("label")))
    scratch.clear(signed, classes)
    return signed.select("doc_id", "digest"), classes


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY, exact: bool = False) -> DataFrame:
    """(doc_id, class_id) of every row."""
    scratch = Scratch(docs.sparkSession)
    rows, classes = text_classes(docs, scratch, id_col, text_col, threshold, exact)
    ids = classes.groupBy("label").agg(F.min("first_id").alias("class_id"))
    members = stored(classes.join(ids, "label").select("digest", "class_id"))
    return rows.join(members, "digest").select("doc_id", "class_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY, exact: bool = False) -> DataFrame:
    """The row of smallest id of each class, with its columns as given; of repeated rows one."""
    scratch = Scratch(docs.sparkSession)
    _, classes = text_classes(docs, scratch, id_col, text_col, threshold, exact)
    best = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "digest"))
    kept = stored(classes.groupBy("label").agg(best.alias("best")).select("best.first_id", F.col("best.digest").alias("kept")))
    scratch.clear()
    row = docs.select(F.struct(*[q(c) for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    found = row.withColumn("digest", text_key(text)).join(kept, F.col("digest") == F.col("kept"))
    found = found.filter(F.col("row").getField(id_col).eqNullSafe(F.col("first_id")))
    return found.groupBy("kept").agg(F.first("row").alias("row")).select("row.*")


def op3_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
