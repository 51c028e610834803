"""Benchmark decontamination by a prefix-filtered join.

A window is WINDOW consecutive words of an item (an item of fewer words is one
window), and a text is hit wherever all words of a window stand in a row. A
window's shingles, runs of SHINGLE words, are ordered by rarity over all texts;
as a window has to be contained whole, its prefix is its one rarest shingle, and
texts need to be joined on that alone. Neighbouring windows mostly share their
rarest shingle, so they form one stretch: a place of the item, with the words
before and after it that its windows reach.

Texts give a row for each place of a prefix shingle, with as many words around it
as a window can reach: a filter of fixed bits for each prefix, whose size is
checked, keeps all other places from becoming rows. Candidates are joined with
the stretches by shingle; length and position bound what can match (the item's
windows must start and end within the text), and comparing the words around gives
the windows that are there whole. Hit ranges of a text are united.

A hot shingle (a passage that a third of all texts hold) is dealt out to SALTS
parts of the join, as stretches are few and repeated in each.

Defined cases: words are runs of letters, digits and characters from U+0080 on, A-Z
as a-z; null and empty texts have no words; items without words have no window;
rows of the benchmark with the same id are one item of several texts; a null
item_id counts as one item, with an empty name; texts of any length are cut as a
whole, in the memory of one text; repeated documents are each reported; empty
tables give no rows, or rows without hits; other columns are not looked at. Equal
64-bit hashes only make candidates: words themselves are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmask.llm.common import Scratch, documents, q

WINDOW = 10
SHINGLE = 3
SALTS = 16
BITS = 16  # of the filter for each prefix
MOST_BITS = 2**28  # of the filter: 32 MB; beyond it more places pass, and the join still decides
SLICE = 2 * 1024 * 1024  # characters of text that are cut up at once
FLUSH = 1_000_000  # distinct shingles a task counts before it passes them on

U = np.uint64
ODD = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
STEP = 0x5851F42D4C957F2D  # multiplier of the rolling word hash
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TO_WORDS).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit number for each number."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(texts: list[list[bytes]]) -> np.ndarray:
    """One hash for each word of all texts."""
    joined = b" ".join(b" ".join(t) for t in texts if t) + b" "
    if len(joined) < 2:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(joined, np.uint8)
    blank = data == 32
    starts = np.concatenate([[0], np.flatnonzero(blank)[:-1] + 1])
    # place within the word, so that a word's hash does not depend on where it stands
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    powers = np.cumprod(np.concatenate([[U(1)], np.full(int(place.max()), U(STEP))]))
    value = np.where(blank, U(0), mix(data.astype(np.uint64) + U(1)) * powers[place])
    return mix(np.add.reduceat(value, starts))


def shingles(texts: list[list[bytes]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, place) of every run of size words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    h = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(h)) - (np.cumsum(sizes) - sizes)[doc]
    at = np.flatnonzero(place <= sizes[doc] - size)
    run = np.full(len(at), U(size))
    for j in range(size):
        run = mix(run * ODD[1] + h[at + j] * ODD[j % 3] + U(j))
    return run, doc[at], place[at]


def slices(texts: Iterator[tuple]) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Ids and words of (id, text), in runs of about SLICE characters; a longer text is a run of its own."""
    ids, held, size = [], [], 0
    for one, text in texts:
        ids.append(one)
        held.append(words(text))
        size += len(text or "")
        if size >= SLICE:
            yield ids, held
            ids, held, size = [], [], 0
    if ids:
        yield ids, held


class Marks:
    """A set of hashes as bits: says no only to what is not in it. Its size is checked, not its content."""

    def __init__(self, n: int):
        bits = 64
        while bits < min(MOST_BITS, BITS * n):
            bits *= 2
        self.shift = U(64 - bits.bit_length() + 1)
        self.bits = np.zeros(bits // 8, np.uint8)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.bits[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 > 0


def marks_of(hashes: DataFrame) -> Marks:
    """The bits of a column of distinct hashes, put together by Spark."""
    marks = Marks(hashes.count())
    shift, size = int(marks.shift), len(marks.bits)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = np.zeros(0, np.uint64)
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> U(shift)
            part = np.unique(np.concatenate([part, at]))
        place, value = np.unique((part >> U(6)).astype(np.int64), return_inverse=True)
        held = np.zeros(len(place), np.uint64)
        np.bitwise_or.at(held, value, U(1) << (part & U(63)))
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(held.view(np.int64))], ["place", "held"])

    parts = hashes.mapInArrow(own, "place bigint, held bigint").groupBy("place").agg(F.bit_or("held").alias("held")).toArrow()
    whole = np.zeros(max(1, size // 8), np.int64)  # at most MOST_BITS
    whole[parts["place"].to_numpy()] = parts["held"].to_numpy()
    marks.bits = whole.view(np.uint8)
    return marks


def item_windows(benchmark: DataFrame, window: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(item, words, size, place, gram, hash): every shingle of every distinct text of the items; size is its window's length."""
    word = T.ArrayType(T.StringType(), False)

    @F.arrow_udf(word)
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[w.decode("utf-8", "surrogatepass") for w in words(t)] for t in batch.to_pylist()], pa.list_(pa.string()))

    @F.arrow_udf(T.ArrayType(T.LongType(), False))
    def hashed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for held, grams in batches:
            out = []
            for w, g in zip(held.to_pylist(), grams.to_pylist(), strict=True):
                out.append(shingles([[x.encode("utf-8", "surrogatepass") for x in w]], g)[0].view(np.int64))
            yield pa.array(out, pa.list_(pa.int64()))

    name = F.coalesce(q(id_col).cast("string"), F.lit("")).alias("item")
    texts = benchmark.select(name, cut(q(text_col)).alias("words")).filter(F.size("words") > 0).distinct()
    sized = texts.withColumn("size", F.least(F.lit(window), F.size("words"))).withColumn("gram", F.least(F.lit(shingle), F.col("size")))
    return sized.select("item", "words", "size", "gram", F.posexplode(hashed("words", "gram")).alias("place", "hash"))


def stretches(items: DataFrame, frequency: DataFrame) -> DataFrame:
    """(hash, gram, size, item, left, right, most_left): one row for each place of a prefix shingle in an item.

    left holds the words before the shingle (nearest first) that its windows
    reach, right those after it; the windows start from first to last words
    before the shingle.
    """
    ranked = items.join(frequency, ["hash", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    per_item = ranked.groupBy("item", "words", "size", "gram").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "n", "hash"))), lambda x: F.struct(x["n"].alias("n"), x["hash"].alias("hash"), x["place"].alias("place"))).alias("all")
    )
    # the rarest shingle of each window; equal ones by hash, then by place
    starts = F.expr("transform(sequence(0, size(words) - size), s -> struct(s AS start, array_min(slice(all, s + 1, size - gram + 1)) AS best))")
    each = per_item.withColumn("w", F.explode(starts)).select("item", "words", "size", "gram", "w.start", "w.best.hash", "w.best.place")
    grouped = each.groupBy("item", "words", "size", "gram", "hash", "place").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    return grouped.select(
        "hash", "gram", "size", "item",
        (F.col("place") - F.col("last")).alias("near"),  # words of the last window before the shingle
        F.expr("reverse(slice(words, first + 1, place - first))").alias("left"),
        F.expr("slice(words, place + 1, gram)").alias("middle"),
        F.expr("slice(words, place + gram + 1, last + size - place - gram)").alias("right"),
    )


def counted(grams: list[int], marks):
    """(hash, gram, n): how often shingles that the marks may hold stand in one task's texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = ((None, t.as_py()) for b in batches for t in b.column(0))
        held = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in grams]

        def out(k: int) -> pa.RecordBatch:
            keys, n = held[k]
            held[k] = keys[:0], n[:0]
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), grams[k], np.int32)), pa.array(n)], ["hash", "gram", "n"])

        for _, block in slices(texts):
            for k, g in enumerate(grams):
                run = shingles(block, g)[0]
                run = run[marks.value.may_hold(run)]
                keys, place = np.unique(np.concatenate([held[k][0], run]), return_inverse=True)
                times = np.concatenate([held[k][1], np.ones(len(run), np.int64)])
                held[k] = keys, np.bincount(place, weights=times, minlength=len(keys)).astype(np.int64)
                if len(keys) >= FLUSH:
                    yield out(k)
        yield from (out(k) for k in range(len(grams)))

    return count


def with_places(docs: DataFrame, grams: list[int], window: int, marks) -> DataFrame:
    """(row, doc_id, n_words, at) of docs (doc_id, text): the places of prefix shingles, with the words around."""
    own = T.StructType([docs.schema["doc_id"]])
    around = ", ".join(f"{n}: array<string>" for n in ("left", "middle", "right"))
    schema = f"{own.simpleString()[7:-1]}, n_words: bigint, at: array<struct<place: int, gram: int, hash: bigint, {around}>>"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        id_type = to_arrow_schema(own).field(0).type
        text = pa.list_(pa.string())
        kind = pa.list_(pa.struct([("place", pa.int32()), ("gram", pa.int32()), ("hash", pa.int64()), ("left", text), ("middle", text), ("right", text)]))
        texts = ((i.as_py(), t.as_py()) for b in batches for i, t in zip(b.column(0), b.column(1), strict=True))
        for ids, block in slices(texts):
            at: list[list[dict]] = [[] for _ in ids]
            for g in grams:
                run, doc, place = shingles(block, g)
                hit = np.flatnonzero(marks.value.may_hold(run))
                for h, d, p in zip(run[hit].view(np.int64).tolist(), doc[hit].tolist(), place[hit].tolist(), strict=True):
                    near = [w.decode("utf-8", "surrogatepass") for w in block[d][max(0, p - window + g) : p + window]]
                    here = min(p, window - g)
                    at[d].append({"place": p, "gram": g, "hash": h, "left": near[:here][::-1], "middle": near[here : here + g], "right": near[here + g :]})
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array([len(t) for t in block], pa.int64()), pa.array(at, kind)], ["doc_id", "n_words", "at"])

    return docs.mapInArrow(find, schema).withColumn("row", F.monotonically_increasing_id())


def hits(found: DataFrame, held: DataFrame) -> DataFrame:
    """(row, item, start, end): ranges of words of texts that are covered by windows of an item."""
    salt = F.pmod(F.xxhash64("row", "at.place"), F.lit(SALTS))
    each = found.select("row", "n_words", F.explode("at").alias("at")).select("row", "n_words", "at.*", salt.alias("salt"))
    spread = held.select(
        "hash", "gram", "size", "item", "near", F.col("left").alias("i_left"), F.col("middle").alias("i_middle"), F.col("right").alias("i_right")
    ).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joined = each.join(spread, ["hash", "gram", "salt"])
    # a window needs size words within the text, some of them before the shingle and some after
    bounds = "n_words >= size AND place >= near AND n_words - place >= size - size(i_left)"
    bounded = joined.filter(bounds).filter("middle = i_middle")

    def same(side: str) -> str:
        pairs = f"zip_with(slice({side}, 1, least(size({side}), size(i_{side}))), slice(i_{side}, 1, least(size({side}), size(i_{side}))), (x, y) -> x = y)"
        return f"coalesce(nullif(array_position({pairs}, false), 0) - 1, least(size({side}), size(i_{side})))"

    reach = bounded.withColumn("before", F.expr(same("left"))).withColumn("after", F.expr(same("right")))
    # windows from before words ahead of the shingle at the earliest, to those that end with what agrees
    latest = F.least(F.col("before"), F.size("i_left"))
    least_before = F.greatest(F.col("near"), F.col("size") - F.col("gram") - F.col("after"))
    whole = reach.withColumn("most_before", latest).withColumn("least_before", least_before).filter("most_before >= least_before")
    return whole.select(
        "row", "item", (F.col("place") - F.col("most_before")).cast("long").alias("start"), (F.col("place") - F.col("least_before") + F.col("size")).cast("long").alias("end")
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", window: int = WINDOW, shingle: int = SHINGLE
) -> DataFrame:
    """(row, doc_id, n_words, ranges, items): the hit ranges of words of every document, and the items they are of."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    items = scratch.stored(item_windows(benchmark, window, shingle, item_col, item_text_col))
    grams = sorted(r.gram for r in items.select("gram").distinct().collect())  # SHINGLE numbers at most
    every = spark.sparkContext.broadcast(marks_of(items.select("hash").distinct()))
    frequency = docs.select(q(text_col).alias("text")).mapInArrow(counted(grams, every), "hash bigint, gram int, n bigint")
    frequency = scratch.stored(frequency.groupBy("hash", "gram").agg(F.sum("n").alias("n")))
    held = scratch.stored(stretches(items, frequency))
    prefixes = spark.sparkContext.broadcast(marks_of(held.select("hash").distinct()))
    named = docs.select(q(id_col).alias("doc_id"), q(text_col).alias("text"))
    found = scratch.stored(with_places(named, grams, window, prefixes))
    covered = hits(found, held).groupBy("row").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("ranges"), F.sort_array(F.collect_set("item")).alias("items")
    )
    covered = scratch.stored(covered)
    scratch.clear(found, covered)
    none = F.expr("array()")
    return found.select("row", "doc_id", "n_words").join(covered, "row", "left").select(
        "row", "doc_id", "n_words",
        F.coalesce("ranges", none.cast("array<struct<start: bigint, end: bigint>>")).alias("ranges"),
        F.coalesce("items", none.cast("array<string>")).alias("items"),
    )


def digests(found: DataFrame) -> DataFrame:
    """Counts and digests in place of ranges and items."""
    covered = F.expr(
        "aggregate(ranges, named_struct('n', 0L, 'to', 0L), (a, r) -> named_struct("
        "'n', a.n + greatest(0L, r.end - greatest(a.to, r.start)), 'to', greatest(a.to, r.end)), a -> a.n)"
    )
    return found.select(
        "row", "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("ranges") > 0).alias("contaminated"),
    )


def op13_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return digests(found).drop("row")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
b AS (
  SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark),
sized AS (SELECT item, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, size, array_to_string(w[s:s + size - 1], ' ') AS text
        FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM sized)),
runs AS (SELECT rid, size, s, array_to_string(w[s:s + size - 1], ' ') AS text
         FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, (SELECT DISTINCT size FROM win))),
hit AS (SELECT rid, size, s, item FROM runs JOIN win USING (size, text)),
hit_words AS (SELECT rid, count(DISTINCT place) AS n_hit
              FROM (SELECT rid, unnest(range(s, s + size)) AS place FROM (SELECT DISTINCT rid, s, size FROM hit)) GROUP BY rid),
hit_items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
              FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
"""
