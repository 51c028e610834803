"""Winnowing fingerprints of documents, in built-in expressions only.

A text's words are hashed, every run of GRAM words gets a polynomial hash, and
of each WINDOW neighbouring runs the smallest hash is kept, the rightmost where
several are smallest. Kept hashes carry their position, so that any passage of
GRAM + WINDOW - 1 words shared by two texts leaves a shared fingerprint.

Defined cases: a null text is an empty one; a text without words has the empty
fingerprint; one of fewer words than a run is hashed as one run, one of fewer
runs than a window is one window. Two empty fingerprints are alike (1.0). Rows
of equal id and text count once in the order of documents and all get the same
result; null ids come last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmask.llm.common import documents, q, stored

GRAM = 5
WINDOW = 8
MODULUS = 2**31 - 1
WORD_MODULUS = 2**28 - 57
BASE = 1_000_003
LOW = 2**32 - 1


def let(name: str, value: str, body: str) -> str:
    """SQL that evaluates value once and names it within body."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def kept(text: str, gram: int = GRAM, window: int = WINDOW) -> str:
    """SQL for the kept hashes of a text: hash * 2^32 + (2^32 - 1 - position).

    The packed order puts small hashes first and, among equals, late positions.
    """
    powers = [pow(BASE, gram - 1 - j, MODULUS) for j in range(gram)]
    run = " + ".join(f"{p}L * {'x' if j == 0 else f'get(h, i + {j})'}" for j, p in enumerate(powers))
    runs = (
        f"CASE WHEN size(h) >= {gram} THEN transform(slice(h, 1, greatest(size(h) - {gram - 1}, 0)), "
        f"(x, i) -> ({run}) % {MODULUS}L * {2**32}L + ({LOW}L - i)) "
        f"WHEN size(h) > 0 THEN array(aggregate(h, 0L, (a, x) -> (a * {BASE}L + x) % {MODULUS}L) * {2**32}L + {LOW}L) "
        "ELSE array() END"
    )
    smallest, width, n = "m0", 1, 0
    steps = []
    while width < window:
        step = min(width, window - width)
        steps.append((f"m{n + 1}", f"transform({smallest}, (x, i) -> least(x, get({smallest}, i + {step})))"))
        smallest, width, n = f"m{n + 1}", width + step, n + 1
    body = f"array_distinct(slice({smallest}, 1, greatest(size({smallest}) - {window - 1}, 1)))"
    for name, value in reversed(steps):
        body = let(name, value, body)
    body = let("m0", runs, body)
    hashes = f"transform(regexp_extract_all({text}, '[^\\\\x20\\\\x09-\\\\x0D]+', 0), w -> pmod(xxhash64(w), {WORD_MODULUS}L))"
    return let("h", hashes, body)


def hashes_of(packed: str) -> str:
    return f"array_distinct(transform({packed}, v -> shiftright(v, 32)))"


def written(packed: str) -> str:
    """hash@position, in order of position."""
    return f"array_join(transform({packed}, v -> concat(hex(shiftright(v, 32)), '@', {LOW}L - (v & {LOW}L))), ' ')"


def likeness(a: str, b: str) -> str:
    """Shared hashes over all hashes of two lists without repeats."""
    both = f"size(array_intersect({a}, {b}))"
    return (
        f"CASE WHEN size({a}) + size({b}) = 0 THEN 1.0D "
        f"ELSE CAST({both} AS double) / (size({a}) + size({b}) - {both}) END"
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, hashes) of every row."""
    base = docs.select(q(id_col).alias("id"), F.coalesce(q(text_col), F.lit("")).alias("text"))
    return base.withColumn("kept", F.expr(kept("text"))).select(
        "id", F.expr(written("kept")).alias("fingerprint"), F.expr(hashes_of("kept")).alias("hashes")
    )


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(q(text_col), F.lit(""))
    key = F.concat(F.coalesce(q(id_col).cast("string"), F.lit("")), F.lit("/"), F.xxhash64(text).cast("string"))
    return docs.select(q(id_col).alias("doc_id"), text.alias("text"), key.alias("key"))


def neighbours(rows: DataFrame) -> DataFrame:
    """Per row the one before and how many characters that one needs of it.

    Rows are dealt by range of id; the order is a window within each range, and
    the ends are joined over one row a range.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = rows.select("doc_id", "key", F.length("text").alias("n")).distinct()
    blocks = stored(
        narrow.repartitionByRange(parts, F.col("doc_id").desc_nulls_last(), F.col("key")).withColumn("block", F.spark_partition_id())
    )
    order = Window.partitionBy("block").orderBy(F.col("doc_id").desc_nulls_last(), "key")
    inside = blocks.select(
        "block", "key", "n", F.lag(F.struct("key", "n")).over(order).alias("before"), F.row_number().over(order).alias("rn")
    )
    ends = blocks.withColumn("rn", F.row_number().over(order)).groupBy("block").agg(F.max_by(F.struct("key", "n"), "rn").alias("last"))
    # as many rows as ranges, bounded by the shuffle partitions
    chain = Window.partitionBy(F.lit(0)).orderBy("block")
    whole = chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("block", F.coalesce(F.lag("last").over(chain), F.last("last").over(whole)).alias("end"))
    return stored(
        inside.join(F.broadcast(ends), "block").select(
            "key", F.coalesce(F.when(F.col("rn") > 1, F.col("before")), F.col("end")).alias("before")
        ).select("key", F.col("before.key").alias("before"), F.floor(F.col("before.n") / 2).cast("int").alias("need"))
    )


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness.

    The edited text ends with the head of the next document by descending id.
    Whole texts are shuffled once, by key; heads travel to the document before.
    """
    rows = keyed(docs, id_col, text_col)
    linked = neighbours(rows)
    one = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    heads = (
        rows.join(linked, "key")
        .withColumn("rn", one)
        .filter("rn = 1")
        .withColumn("hashes", F.expr(hashes_of(kept("text"))))
        .select(
            F.col("before").alias("key"),
            F.expr("substring(text, 1, need)").alias("head"),
            F.col("hashes").alias("next_hashes"),
            F.col("doc_id").alias("next_doc_id"),
        )
    )
    both = rows.join(heads, "key").withColumn("n_chars", F.length("text").cast("long"))
    both = both.withColumn("edited", F.expr("concat(substring(text, 1, CAST(n_chars - floor(n_chars / 2) AS int)), head)"))
    both = both.withColumn("own", F.expr(kept("text"))).withColumn("changed", F.expr(kept("edited")))
    both = both.withColumn("own_hashes", F.expr(hashes_of("own"))).withColumn("changed_hashes", F.expr(hashes_of("changed")))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.expr(written("own")).alias("fingerprint"),
        F.expr(written("changed")).alias("edited_fingerprint"),
        F.expr(likeness("own_hashes", "changed_hashes")).alias("near_edited"),
        F.expr(likeness("own_hashes", "next_hashes")).alias("near_next"),
        "next_doc_id",
    )


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
