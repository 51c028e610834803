"""Hard negatives by slots of score.

Anchors are a stated set of rows. An anchor's positives are its POSITIVES best
other rows of the same label; a positive of score p wants the best NEGATIVES rows
of other labels whose score lies between LOW and HIGH hundredths of p. The
windows of an anchor's positives overlap, so they are not searched one by one:
their upper limits cut the scores into disjoint slots, from one limit down to
the next. While blocks are read, only the best NEGATIVES of every slot are kept
(a combiner in the task, then one in Spark). All rows of a slot beat all rows of
the slots below, so the slots' rows one after the other, from a positive's limit
downwards, are already merged: the first of them, down to its lower limit, are
its negatives.

Positives are looked for in the lots of blocks that hold the anchor's label,
negatives in all blocks.

Defined cases: rows with a null id or label, a null vector, or a null or
non-finite component take no part; a row meets only vectors of its length (an
empty vector only empty ones, at score 0); rows that repeat the anchor's id are
its own, neither positives nor negatives; an anchor that comes in several rows is
mined once for each; ties go to the smaller id; an anchor without positives and a
positive without negatives give no rows (so it is below score 0, where the window
is empty); empty tables give no rows; other columns are not looked at. Scores
must fit a long; vectors of any length are one value in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmask.llm.blocks import BLOCK, QUERY_BLOCK, Best, Block, batch_of, in_lots, lot_counts, meetings, packed, reached, whole_vectors
from quillmask.llm.common import Scratch, q

POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # hundredths of the positive's score


def hundredths(p, part: int):
    """The largest whole number of at most part / 100 of p, without large products."""
    return part * (p // 100) + part * (p % 100) // 100


def hundredths_sql(p: str, part: int) -> str:
    return f"({part} * (({p} - pmod({p}, 100L)) div 100) + {part} * pmod({p}, 100L) div 100)"


def top(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best rows by score of each group; tasks pass on no more than k of a group."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def numbered(blocks: list[Block]) -> tuple[list[np.ndarray], dict[str, int]]:
    """The labels of blocks as numbers, and the number of each."""
    codes: dict[str, int] = {}
    return [b.coded(codes) for b in blocks], codes


def positives_in(k: int):
    def read(asked: list[Block], blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        """(row, vec_id, score) of the k best rows of an anchor's label in a tile."""
        own, codes = numbered(asked)
        kept = [Best(len(anchors.row), k) for anchors in asked]
        for block in blocks:
            labels = block.coded(codes)
            for anchors, label, mates in zip(asked, own, kept, strict=True):
                scores = anchors.products(block)
                alive = (labels[None, :] == label[:, None]) & (block.vec_id[None, :] != anchors.vec_id[:, None])
                ranked = scores if scores.dtype.kind == "f" else scores.astype(np.float64)
                bar = reached(ranked, alive, k, mates.bar.astype(ranked.dtype))
                at, rows = np.nonzero(alive & (ranked >= bar[:, None]))
                mates.add(at, block.vec_id[rows], scores[at, rows].astype(np.int64))
        for anchors, mates in zip(asked, kept, strict=True):
            yield batch_of({"row": [anchors.row[mates.group]], "vec_id": [mates.vec_id], "score": [mates.score]})

    return read


class Slots:
    """The slots of a block of anchors, and the k best rows of other labels met so far in each."""

    def __init__(self, anchors: Block, label: np.ndarray, k: int, low: int, high: int):
        self.anchors, self.label = anchors, label
        limits = [np.array(p, np.int64) for p in anchors.limits]
        upper = [np.unique(hundredths(p, high)) for p in limits]
        self.sizes = np.array([len(u) for u in upper])
        self.upper = np.array([np.pad(u, (0, self.sizes.max() - len(u)), mode="edge") for u in upper])
        self.least = np.array([(-hundredths(-p, low)).min() for p in limits])
        self.first = np.cumsum(self.sizes) - self.sizes  # the number of an anchor's lowest slot
        self.best = Best(int(self.sizes.sum()), k)

    def add(self, block: Block, labels: np.ndarray) -> None:
        scores = self.anchors.products(block)
        kind = scores.dtype if scores.dtype.kind == "f" else np.dtype(np.float64)
        # below the k best of the lowest slot there is nothing to be found; floating point rounds limits and scores alike
        least = np.maximum(self.least, self.best.bar[self.first]).astype(kind)[:, None]
        at, rows = np.nonzero((scores >= least) & (scores <= self.upper[:, -1].astype(kind)[:, None]))
        score = scores[at, rows].astype(np.int64)
        kept = (self.label[at] != labels[rows]) & (self.anchors.vec_id[at] != block.vec_id[rows])
        kept &= (score >= self.least[at]) & (score <= self.upper[at, -1])
        at, rows, score = at[kept], rows[kept], score[kept]
        slot = self.first[at]  # of the smallest limit that is not below the score
        for limit in self.upper.T:
            slot += score > limit[at]
        kept = score >= self.best.bar[slot]
        self.best.add(slot[kept], block.vec_id[rows[kept]], score[kept])

    def rows(self) -> pa.RecordBatch:
        at = np.repeat(np.arange(len(self.sizes)), self.sizes)[self.best.group]
        return batch_of({"row": [self.anchors.row[at]], "slot": [self.best.group - self.first[at]], "vec_id": [self.best.vec_id], "score": [self.best.score]})


def negatives_in(k: int, low: int, high: int):
    def read(asked: list[Block], blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        """(row, slot, vec_id, score) of the k best rows of other labels in each slot of a tile."""
        own, codes = numbered(asked)
        held = [Slots(anchors, label, k, low, high) for anchors, label in zip(asked, own, strict=True)]
        for block in blocks:
            labels = block.coded(codes)
            for slots in held:
                slots.add(block, labels)
        for slots in held:
            yield slots.rows()

    return read


def mine(
    df: DataFrame,
    is_anchor: Column,
    scale: int,
    label: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); is_anchor reads vec_id."""
    scratch = Scratch(df.sparkSession)
    rows = whole_vectors(df, scratch, id_col, vector_col, scale, label)
    anchors = rows.filter(is_anchor)
    lots = scratch.stored(lot_counts(rows))
    lists = scratch.stored(packed(in_lots(rows, lots), BLOCK))
    asked = scratch.stored(packed(in_lots(anchors, lots), QUERY_BLOCK))
    mates = scratch.stored(meetings(asked, lists, positives_in(positives), "row bigint, vec_id bigint, score bigint", same_lot=True))
    pair = F.struct((-F.col("score")).alias("down"), "vec_id", "score")
    best_mates = top(mates, ["row"], positives).groupBy("row").agg(F.sort_array(F.collect_list(pair)).alias("mates"))
    held = scratch.stored(anchors.join(best_mates, "row").withColumn("limits", F.transform("mates", lambda m: m["score"])))

    windows = scratch.stored(packed(held, QUERY_BLOCK))
    slots = "row bigint, slot bigint, vec_id bigint, score bigint"
    near = scratch.stored(meetings(windows, lists, negatives_in(negatives, low, high), slots))
    scratch.clear(held, near)
    kept = top(near, ["row", "slot"], negatives)
    merged = kept.groupBy("row").agg(F.sort_array(F.collect_list(pair)).alias("slots"))

    each = held.select("row", F.col("vec_id").alias("anchor_id"), F.explode("mates").alias("m"))
    each = each.select("row", "anchor_id", F.col("m.vec_id").alias("positive_id"), F.col("m.score").alias("positive_score"))
    each = each.withColumn("most", F.expr(hundredths_sql("positive_score", high)))
    each = each.withColumn("least", F.expr(f"-{hundredths_sql('(-positive_score)', low)}"))
    chosen = F.expr(f"filter(slice(filter(slots, t -> t.score <= most), 1, {negatives}), t -> t.score >= least)")
    found = each.join(merged, "row").select("anchor_id", "positive_id", "positive_score", F.posexplode(chosen).alias("at", "n"))
    return found.select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("n.vec_id").alias("negative_id"), "positive_score",
        F.col("n.score").alias("negative_score"),
    )


def op11_slot_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (q("label") + 1) % 10).otherwise(q("label"))
    return mine(df, F.col("vec_id") % 50 == 0, 256, label)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.rid, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id,
         coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.rid, p.place ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.rid = p.rid AND NOT s.same
    AND 50 * p.score::HUGEINT <= 100 * s.score::HUGEINT AND 100 * s.score::HUGEINT <= 95 * p.score::HUGEINT
  WHERE p.place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
