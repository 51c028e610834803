"""Exact top-k by inner product: aggregation of sorted lists without random access.

Candidates lie in blocks. A block has, for each dimension, its values as a
sorted list; a query reads the lists of its positive components from the top and
those of its negative ones from the bottom, all of them on by one step after the
other. What a step has read is added to what is known of each candidate; unread
values are at their worst for its lower bound, and at the list's frontier for its
upper one. After each step, candidates whose upper bound lies below a query's
k-th best lower bound are out, and those that no query of the block needs leave
it. Reading stops when no candidate but the best k can qualify, or the lists
end; the values not yet read of those that are left resolve their scores.

A task reads a tile: some blocks of candidates, one after the other, for some
blocks of queries. The k best of the blocks before are a query's lower bound in
the next, and lists are read on in one step as deep as searches had to be read
before without any candidate falling out. The best k of a tile are merged by query.

Defined cases: vectors that are null or hold null or non-finite values take no
part, nor do rows with a null id; a query meets only vectors of its length (an
empty one only empty ones, at score 0); every query row has a list of its own, so
a query id that stands in several rows has several; rows that repeat the query's
id are its own and no candidates for it; other repeated rows are candidates each;
ties go to the smaller id; with fewer than k candidates all are returned; an empty
table gives no rows; other columns are not looked at. Scores must fit a long;
bounds of very large values have a margin for rounding, scores have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmask.llm import blocks
from quillmask.llm.blocks import Best, Block, batch_of, best, meetings, packed, reached, whole_vectors
from quillmask.llm.common import Scratch

FIRST_STEP = 64  # entries of each list; every step makes the depth four times as large


class Lists:
    """The sorted lists of one block of candidates."""

    def __init__(self, block: Block):
        self.block = block
        self.depth = self.useful = 0  # that the last search has read, and by which it left half
        self.made: dict[type, tuple[np.ndarray, ...]] = {}

    def of_kind(self, kind: type) -> tuple[np.ndarray, ...]:
        """Twice the values; their places in the lists read from the top, then in those from the bottom; these lists."""
        if kind not in self.made:
            values = np.ascontiguousarray(self.block.values.T)
            n = values.shape[1]
            order = np.argsort(values, axis=1, kind="stable").astype(np.int32)
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, np.arange(n, dtype=np.int32)[None, :], axis=1)
            up = np.take_along_axis(values, order, axis=1).T.astype(kind)
            x = self.block.values.astype(kind)
            self.made[kind] = np.hstack([x, x]), np.hstack([(n - 1 - rank).T, rank.T]), np.hstack([up[::-1], up])
        return self.made[kind]

    def nearest(self, queries: Block, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, candidate ids, scores) of the best k of each query."""
        at, ids, scores = self.found(queries, k, np.full(len(queries.values), -np.inf))
        for i in range(len(queries.values)):
            rows = np.flatnonzero(at == i)
            rows = rows[best(scores[rows], ids[rows], k)]
            yield i, ids[rows], scores[rows]

    def found(self, queries: Block, k: int, bar: np.ndarray, step: int = FIRST_STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate id, score) of all that may be among a query's best k; ``bar`` is a score that each of these reaches.

        ``useful`` is afterwards the depth by which half of the candidates were out for all queries.
        """
        n, kind = len(self.block.values), queries.kind_for(self.block)
        bar, alive = bar.astype(kind), queries.vec_id[:, None] != self.block.vec_id[None, :]
        self.useful = n
        if n <= k or step >= n:
            return self.whole(queries, k, bar, alive)
        q = queries.values.astype(kind)
        both = np.hstack([np.maximum(q, 0), np.minimum(q, 0)])
        values, ranks, lists = self.of_kind(kind)
        margin = kind(0) if queries.exact(self.block) else 2.0**-44 * (np.abs(both) @ np.abs(lists).max(axis=0, initial=0))[:, None]
        left, known, self.depth = np.arange(n), np.zeros((len(q), n), kind), 0
        while len(left) > k and self.depth < n:
            before, self.depth = self.depth, min(n, self.depth + step)
            step = 3 * self.depth
            rank, x = ranks[left], values[left]
            read = rank < self.depth
            known += both @ np.where(read & (rank >= before), x, kind(0)).T
            unread = (~read).astype(kind)
            if not (bar > -np.inf).all():
                bar = reached(known + (both * lists[-1]) @ unread.T - margin, alive, k, bar)
            alive &= known + (both * lists[self.depth - 1]) @ unread.T + margin >= bar[:, None]
            needed = alive.any(axis=0)
            if 2 * np.count_nonzero(needed) < n:
                self.useful = min(self.useful, self.depth)
            left, alive, known = left[needed], alive[:, needed], known[:, needed]
            if (np.count_nonzero(alive, axis=1) <= k).all():
                break
        # what is not read yet of the candidates that are left
        if not queries.exact(self.block):
            known = queries.values.astype(np.int64) @ self.block.values[left].astype(np.int64).T
        elif self.depth < n:
            known = known + both @ np.where(ranks[left] < self.depth, kind(0), values[left]).T
        return self.chosen(alive, left, known)

    def whole(self, queries: Block, k: int, bar: np.ndarray, alive: np.ndarray):
        """The lists read to their ends in one step, so bounds and scores are one."""
        n, self.depth = len(self.block.values), len(self.block.values)
        scores = queries.products(self.block)
        # floating point rounds both alike, so none that reaches the bar is lost
        ranked = scores.astype(bar.dtype, copy=False)
        alive &= ranked >= reached(ranked, alive, k, bar)[:, None]
        return self.chosen(alive, np.arange(n), scores)

    def chosen(self, alive: np.ndarray, left: np.ndarray, scores: np.ndarray):
        at, rows = np.nonzero(alive)
        found = scores[at, rows]
        return at, self.block.vec_id[left[rows]], found if found.dtype == np.int64 else np.rint(found).astype(np.int64)


def search(df: DataFrame, is_query, k: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of every row for which is_query holds; is_query reads vec_id."""
    scratch = Scratch(df.sparkSession)
    rows = whole_vectors(df, scratch, id_col, vector_col, scale)
    lists = scratch.stored(packed(rows, blocks.BLOCK))
    queries = scratch.stored(packed(rows.filter(is_query), blocks.QUERY_BLOCK))

    def read(asked: list[Block], candidates: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        kept, step = [Best(len(own.row), k) for own in asked], FIRST_STEP
        for block in candidates:
            held = Lists(block)
            step = max(FIRST_STEP, step // 4)
            for own, best_of in zip(asked, kept, strict=True):
                best_of.add(*held.found(own, k, best_of.bar, step))
                step = held.useful
        for own, best_of in zip(asked, kept, strict=True):
            at = best_of.group
            yield batch_of({"row": [own.row[at]], "query_id": [own.vec_id[at]], "vec_id": [best_of.vec_id], "score": [best_of.score]})

    near = scratch.stored(meetings(queries, lists, read, "row bigint, query_id bigint, vec_id bigint, score bigint"))
    scratch.clear(near)
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(df, F.col("vec_id") % 20 == 0, 20, 64)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.rid, a.vec_id AS query_id, b.vec_id,
         coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
