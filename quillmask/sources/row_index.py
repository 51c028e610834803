"""0-based row positions without a global single-task window and without shuffling the rows.

The position of a row is its position in a part (a file, a block of a file, a
range) plus the sizes of the parts before. Only these sizes, one row a part, are
brought together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmask.plans.staging import stored
from quillmask.sources.readers import read_csv

# Up to this many parts, their offsets go to every executor as one small table.
BROADCAST_PARTS = 50_000


def _numbered(rows: DataFrame, parts: list[str], sizes: DataFrame, index: str, position) -> DataFrame:
    """Add the rows before a part to a position within it; sizes: (parts, __first, __n).

    Sizes are counted before they are broadcast; beyond the limit they are joined.
    """
    before = W.orderBy(*parts).rowsBetween(W.unboundedPreceding, -1)
    offsets = stored(sizes.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"))
    small = offsets.limit(BROADCAST_PARTS + 1).count() <= BROADCAST_PARTS
    joined = rows.join(F.broadcast(offsets) if small else offsets, parts)
    return joined.withColumn(index, (F.col("__offset") + position).cast("long")).drop(*parts, "__pos", "__offset", "__first")


def read_parquet_with_index(spark: SparkSession, path: str, index: str = "row_index") -> DataFrame:
    """Parquet rows numbered in file order: by file path, then position in the file.

    Parquet knows the position of a row in its file, so only the row counts per
    file are needed on top: no sort, and no shuffle of the data.
    """
    rows = spark.read.parquet(path).select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__pos")
    )
    sizes = rows.groupBy("__file").agg((F.max("__pos") + 1).alias("__n"), F.lit(0).alias("__first"))
    return _numbered(rows, ["__file"], sizes, index, F.col("__pos"))


def read_csv_with_index(spark: SparkSession, path: str, index: str = "row_index", **csv_options) -> DataFrame:
    """CSV rows numbered in file order: by file path, block and position in the block.

    A task reads its blocks one after the other, so a row's place in a block is
    its running number in the task less the one of the block's first row. Both
    passes read the same blocks in the same tasks.
    """
    rows = read_csv(spark, path, located=True, **csv_options)
    return numbered_csv(rows, index, rows)


def numbered_csv(rows: DataFrame, index: str, read: DataFrame) -> DataFrame:
    """Number located rows of CSV files; ``read`` has the place of every row that was read."""
    sizes = read.groupBy("__file", "__block").agg(F.count("*").alias("__n"), F.min("__pos").alias("__first"))
    return _numbered(rows, ["__file", "__block"], sizes, index, F.col("__pos") - F.col("__first"))


def with_row_index(df: DataFrame, order_by: list[str], index: str = "row_index", path: str | None = None) -> DataFrame:
    """Number the rows of any frame in a given order, which should be total.

    The frame is range-partitioned and sorted, stored once (a second run of the
    range partitioning could draw other bounds), and numbered by the position
    in its partition plus the sizes of the partitions before. The stored rows
    are what the result reads; pass ``path`` to choose and later delete it.
    """
    local = F.monotonically_increasing_id()
    rows = stored(
        df.repartitionByRange(*[F.col(c) for c in order_by])
        .sortWithinPartitions(*order_by)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__pos", local.bitwiseAND(F.lit((1 << 33) - 1))),
        path,
    )
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.lit(0).alias("__first"))
    return _numbered(rows, ["__part"], sizes, index, F.col("__pos"))
