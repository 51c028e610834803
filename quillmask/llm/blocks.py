"""Whole vectors in blocks, and the meeting of query blocks with blocks of all rows.

A block is one row: some thousand vectors of equal length as bytes. All meetings
of a length or lot are cut into tiles, groups of query blocks by groups of
blocks, and a tile is read by one task: its query blocks are held and its blocks
come one by one. So every product is one small matrix product, what is found in
one block bounds the search of the next, no pair of vectors ever becomes a row,
and a block is copied once for each group it meets, not once for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmask.llm.common import Scratch, q

BLOCK = 4096
QUERY_BLOCK = 256
TILE_QUERIES, TILE_BLOCKS = 32, 16  # query blocks and blocks of a tile at most
WAVES = 4  # tiles for each task slot, if there are as many meetings
EXACT = 2.0**53  # whole numbers below it are exact as floating point
EXACT_SHORT = 2.0**24  # and as floating point of half the width

FIELDS = ("dim", "size", "row", "vec_id", "label", "limits", "kind", "data")
PACKED = "dim int, lot int, block int, size int, row binary, vec_id binary, label array<string>, limits array<array<bigint>>, kind string, data binary"


def whole_vectors(df: DataFrame, scratch: Scratch, id_col: str, vector_col: str, scale: int, label: Column | None = None) -> DataFrame:
    """Stored (row, vec_id, label, v array<long>, dim) of the rows that take part; row is a number of its own."""
    bad = F.exists(q(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.transform(q(vector_col), lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    kept = df.filter(q(id_col).isNotNull() & q(vector_col).isNotNull() & ~bad)
    label = F.lit("") if label is None else label.cast("string")
    found = kept.select(q(id_col).cast("long").alias("vec_id"), label.alias("label"), v.alias("v")).filter("label is not null")
    return scratch.stored(found.withColumns({"dim": F.size("v"), "row": F.monotonically_increasing_id()}))


def pack(table: pa.Table) -> pa.Table:
    """One row for a block, in order of vec_id."""
    table = table.combine_chunks().sort_by([("vec_id", "ascending"), ("row", "ascending")])
    dim, n = table["dim"][0].as_py(), table.num_rows
    values = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table["v"].chunks] or [np.zeros(0, np.int64)]).astype(np.int64)
    kind = np.result_type(np.min_scalar_type(int(values.min(initial=0))), np.min_scalar_type(int(values.max(initial=0))))
    kind = kind if kind.kind == "i" else np.dtype(np.int64)
    return pa.Table.from_pydict(
        {
            "dim": pa.array([dim], pa.int32()),
            "lot": pa.array([table["lot"][0].as_py()], pa.int32()),
            "block": pa.array([table["block"][0].as_py()], pa.int32()),
            "size": pa.array([n], pa.int32()),
            "row": pa.array([table["row"].to_numpy().astype(np.int64).tobytes()], pa.binary()),
            "vec_id": pa.array([table["vec_id"].to_numpy().astype(np.int64).tobytes()], pa.binary()),
            "label": pa.array([table["label"].to_pylist()], pa.list_(pa.string())),
            "limits": pa.array([table["limits"].to_pylist() if table["limits"].null_count < n else None], pa.list_(pa.list_(pa.int64()))),
            "kind": pa.array([kind.str], pa.string()),
            "data": pa.array([values.astype(kind).tobytes()], pa.binary()),
        }
    )


def lot_counts(rows: DataFrame) -> DataFrame:
    """(dim, lots): so many lots that one holds about BLOCK rows."""
    return rows.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("lots"))


def in_lots(rows: DataFrame, lots: DataFrame) -> DataFrame:
    """Rows with the lot of their label."""
    return rows.join(lots, "dim").withColumn("lot", F.pmod(F.xxhash64("label"), F.col("lots")).cast("int")).drop("lots")


def packed(rows: DataFrame, per_block: int) -> DataFrame:
    """Blocks of about per_block rows of equal length and lot; rows may hold lot and limits.

    A lot with more rows than fit is cut by row number, so a label that holds a
    third of all rows fills many blocks.
    """
    lot = F.col("lot") if "lot" in rows.columns else F.lit(0)
    limits = F.col("limits") if "limits" in rows.columns else F.lit(None).cast("array<bigint>")
    rows = rows.select("dim", lot.alias("lot"), "row", "vec_id", "label", limits.alias("limits"), "v")
    full = rows.groupBy("dim", "lot").agg(F.ceil(F.count("*") / per_block).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    dealt = rows.join(full, ["dim", "lot"]).withColumn("block", block).drop("blocks")
    # dealt by block, not by lot as the join before it: a lot may hold a third of all rows
    return dealt.repartition("dim", "lot", "block").groupBy("dim", "lot", "block").applyInArrow(pack, PACKED)


def _places(blocks: DataFrame, on: list[str]) -> DataFrame:
    """The addresses of blocks with their number and how many there are, by length or lot: a small row for each block."""
    each = Window.partitionBy(*on)
    order = each.orderBy(*[c for c in ("lot", "block") if c not in on])
    return blocks.select("dim", "lot", "block").withColumns({"n": F.row_number().over(order) - 1, "many": F.count("*").over(each)})


def tiles(queries: DataFrame, lists: DataFrame, same_lot: bool = False) -> DataFrame:
    """The rows of both with their tile, in the order in which tasks read them; every query block meets the blocks it has to."""
    spark = queries.sparkSession
    on = ["dim", "lot"] if same_lot else ["dim"]
    asked, there = _places(queries, on), _places(lists, on)
    counts = asked.groupBy(*on).agg(F.max("many").alias("asked")).join(there.groupBy(*on).agg(F.max("many").alias("there")), on)
    pairs = counts.agg(F.sum(F.col("asked") * F.col("there"))).first()[0] or 0
    # as large as tiles may be, or smaller so that there are tiles for all task slots
    share = max(1, pairs // (WAVES * spark.sparkContext.defaultParallelism))
    down = min(TILE_BLOCKS, max(1, int(share**0.5)))
    across = min(TILE_QUERIES, max(1, share // down))
    counts = counts.withColumns({"rows_": F.ceil(F.col("asked") / across), "columns_": F.ceil(F.col("there") / down)})
    needed = max(1, counts.agg(F.sum(F.col("rows_") * F.col("columns_"))).first()[0] or 0)

    def side(rows: DataFrame, places: DataFrame, kind: int, per: int, own: str, other: str) -> DataFrame:
        spread = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows_" if other == "q" else "columns_") - 1))
        sized = places.join(counts.select(*on, "rows_", "columns_"), on)
        addressed = sized.withColumns({own: F.floor(F.col("n") / per), "side": F.lit(kind)}).withColumn(other, spread)
        # tiles of a length or lot go to partitions that follow one another
        tile = F.pmod(F.xxhash64(*on) + F.col("q") * F.col("columns_") + F.col("l"), F.lit(needed)).cast("int")
        addressed = addressed.select("dim", "lot", "block", F.col(on[-1]).alias("of"), "q", "l", "side", tile.alias("tile"))
        return rows.join(addressed, ["dim", "lot", "block"])

    both = side(queries, asked, 0, across, "q", "l").unionByName(side(lists, there, 1, down, "l", "q"))
    order = ["dim", "of", "q", "l", "side", "lot", "block"]
    return both.repartitionById(int(needed), F.col("tile")).sortWithinPartitions(*order).select(*order[1:5], *FIELDS)


def meetings(queries: DataFrame, lists: DataFrame, read: Callable, schema: str, same_lot: bool = False) -> DataFrame:
    """What ``read`` finds in tiles: it takes the query blocks of one and an iterator of its blocks and gives batches."""

    def of_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ({n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)} for batch in batches for i in range(batch.num_rows))
        asked: list[Block] = []
        for (*_, side), part in groupby(rows, key=lambda r: (r["dim"], r["of"], r["q"], r["l"], r["side"])):
            blocks = (Block(*[r[n] for n in FIELDS]) for r in part)
            if side == 0:
                asked = list(blocks)
            elif asked:
                yield from read(asked, blocks)
                asked = []

    return tiles(queries, lists, same_lot).mapInArrow(of_tiles, schema)


class Block:
    """The vectors of one block."""

    def __init__(self, dim: int, size: int, row: bytes, vec_id: bytes, label: list[str], limits: list[list[int]], kind: str, data: bytes):
        self.row = np.frombuffer(row, np.int64)
        self.vec_id = np.frombuffer(vec_id, np.int64)
        self.label, self.limits = label, limits
        self.values = np.frombuffer(data, np.dtype(kind)).reshape(size, dim)
        self.largest = float(np.abs(self.values.astype(np.float64)).max(initial=0))

    def coded(self, codes: dict[str, int]) -> np.ndarray:
        return np.array([codes.setdefault(x, len(codes)) for x in self.label], np.int64)

    def exact(self, other: Block) -> bool:
        """Whether products with the other block are exact in floating point."""
        return self.largest * other.largest * max(1, self.values.shape[1]) < EXACT

    def kind_for(self, other: Block) -> type:
        """The narrowest type of floating point in which products with the other block are exact, else the widest."""
        return np.float32 if self.largest * other.largest * max(1, self.values.shape[1]) < EXACT_SHORT else np.float64

    def products(self, other: Block) -> np.ndarray:
        """Inner products of this block's vectors (rows) with the other's (columns), whole numbers: as floating point where that is exact, else as long."""
        kind = self.kind_for(other) if self.exact(other) else np.int64
        return self.values.astype(kind) @ other.values.astype(kind).T


def best(scores: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller vec_id, in order."""
    places = np.arange(len(scores))
    if len(scores) > k:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return places[np.lexsort((vec_id[places], -scores[places]))][:k]


class Best:
    """The k best (score, vec_id) of each group met so far; groups are numbered from 0."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.group = self.vec_id = self.score = np.zeros(0, np.int64)
        self.bar = np.full(groups, -np.inf)  # the k-th best score of a group, once there is one

    def add(self, group: np.ndarray, vec_id: np.ndarray, score: np.ndarray) -> None:
        group, vec_id, score = np.concatenate([self.group, group]), np.concatenate([self.vec_id, vec_id]), np.concatenate([self.score, score])
        order = np.lexsort((vec_id, -score, group))
        group = group[order]
        kept = np.arange(len(group)) - np.searchsorted(group, group) < self.k
        self.group, self.vec_id, self.score = group[kept], vec_id[order[kept]], score[order[kept]]
        counts = np.bincount(self.group, minlength=len(self.bar))
        full = counts >= self.k
        self.bar[full] = self.score[np.cumsum(counts)[full] - 1]


def reached(scores: np.ndarray, alive: np.ndarray, k: int, bar: np.ndarray) -> np.ndarray:
    """``bar``, or where there is none yet the k-th best score of a row among those alive."""
    n = scores.shape[1]
    if n <= k or (bar > -np.inf).all():
        return bar
    return np.maximum(bar, np.partition(np.where(alive, scores, -np.inf), n - k, axis=1)[:, n - k])


def batch_of(columns: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
    """A batch of long columns from their parts."""
    whole = {n: np.concatenate(parts) if parts else np.zeros(0, np.int64) for n, parts in columns.items()}
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in whole.values()], list(whole))
