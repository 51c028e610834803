"""Span algebra on tables of spans, for spans whose texts are not at hand.

A table has key columns that name a cell, and ``start`` and ``end``. Everything
rests on one walk: how far the spans reach that start before a span. Spans may be long to find, so they are stored once, in
the shared folder, where they stay for the result to read. Cells that begin all
their spans in the first bin of offsets, as most do, are walked by one window
after one shuffle. Others may hold any number of spans, so they are cut into bins:
the furthest end of every bin, carried from bin to bin, and a window within the
bin. Both are equi-partitioned; nothing compares spans with spans, and no cell of
more than a bin is one task.

Spans without a start or with a null in their key are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmask.functions.sql import name
from quillmask.plans.staging import stored

BIN = 512  # code points of a cell whose spans are walked by one task


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _apart(rows: DataFrame, key: list[str], bin_size: int) -> list[tuple[DataFrame, int | None]]:
    """The rows, stored: those of cells in one bin, and those of the others with the size of their bins."""
    known = [F.col(name(c)).isNotNull() for c in (*key, "start")]
    held = stored(rows.filter(reduce(Column.__and__, known)))
    wide = held.filter(F.floor(F.col("start") / bin_size) != 0).select(*[F.col(name(k)) for k in key]).distinct()
    wide = stored(wide)
    if wide.isEmpty():
        return [(held, None)]
    return [(held.join(wide, key, "left_anti"), None), (held.join(wide, key, "left_semi"), bin_size)]


def _carried(rows: DataFrame, key: list[str], value: Column, order: list[Column], bin_size: int | None) -> DataFrame:
    """Rows with ``__before``: the greatest value of the rows of the key that come before, nulls left out.

    ``order`` begins with the start, by which bins are ordered; None for cells that need no bins.
    """
    columns = [F.col(name(k)) for k in key]
    if bin_size is None:
        before = Window.partitionBy(*columns).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("__before", F.max(value).over(before))
    binned = rows.withColumns({"__bin": F.floor(F.col("start") / bin_size).cast("long"), "__value": value})
    tops = binned.groupBy(*columns, "__bin").agg(F.max("__value").alias("__top"))
    earlier = Window.partitionBy(*columns).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.withColumn("__carry", F.max("__top").over(earlier)).drop("__top")
    within = Window.partitionBy(*columns, "__bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    walked = binned.join(carry, [*key, "__bin"]).withColumn("__before", F.greatest("__carry", F.max("__value").over(within)))
    return walked.drop("__bin", "__value", "__carry")


def uncovered(spans: DataFrame, targets: DataFrame, key, bin_size: int = BIN) -> DataFrame:
    """The spans that lie inside no target of their cell, with all their columns.

    Of the targets that start no later than a span, one covers it exactly if the
    furthest end reaches the span's. Repeated spans stay repeated; empty targets
    cover only what is empty at the same place.
    """
    key = _keys(key)
    place = [*key, "start", "end"]
    others = [c for c in spans.columns if c not in place]
    held = F.struct(F.lit(True).alias("__own"), *[F.col(name(c)) for c in others])
    own = spans.select(*[F.col(name(c)) for c in place], F.lit(1).alias("__kind"), held.alias("__row"))
    cover = targets.select(*[F.col(name(c)) for c in place], F.lit(0).alias("__kind"))
    both = own.unionByName(cover, allowMissingColumns=True)
    end = F.when(F.col("__kind") == 0, F.col("end"))
    walked = [_carried(part, key, end, [F.col("start"), F.col("__kind")], size) for part, size in _apart(both, key, bin_size)]
    left = reduce(DataFrame.unionByName, walked).filter("__kind = 1 AND (__before IS NULL OR __before < `end`)")
    return left.select(*[F.col(name(c)) if c in place else F.col("__row")[c].alias(c) for c in spans.columns])


def islands(spans: DataFrame, key, slack: int = -1, bin_size: int = BIN, **aggregates: Column) -> DataFrame:
    """Neighbouring spans of a key joined: (key, start, end, aggregates).

    A span joins what comes before if it starts at most ``slack`` beyond its end:
    -1 joins what overlaps, 0 what touches, 1 what one character parts. An island
    is named by its first span, carried over bins as well, so one island may
    take up a whole huge cell; equal spans without a character are one island.
    """
    key = _keys(key)
    parts = [_islands(part, key, slack, size, aggregates) for part, size in _apart(spans, key, bin_size)]
    return reduce(DataFrame.unionByName, parts)


def _islands(spans: DataFrame, key: list[str], slack: int, bin_size: int | None, aggregates: dict[str, Column]) -> DataFrame:
    order = [F.col("start"), F.col("end")]
    reached = _carried(spans, key, F.col("end"), order, bin_size)
    fresh = F.col("__before").isNull() | (F.col("start") > F.col("__before") + slack)
    opened = reached.withColumn("__fresh", fresh).drop("__before")
    first = F.struct(F.col("start").alias("start"), F.col("end").alias("end"))
    opened = _carried(opened, key, F.when(F.col("__fresh"), first), [*order, F.col("__fresh").desc()], bin_size)
    island = F.when(F.col("__fresh"), first).otherwise(F.col("__before"))
    grouped = opened.withColumn("__island", island).groupBy(*[F.col(name(k)) for k in key], "__island")
    joined = grouped.agg(F.max("end").alias("end"), *[c.alias(n) for n, c in aggregates.items()])
    return joined.select(*[F.col(name(k)) for k in key], F.col("__island.start").alias("start"), "end", *aggregates)


def with_exact_label(spans: DataFrame, labelled: DataFrame, key, label: str = "label") -> DataFrame:
    """Spans with the label of the annotation that has exactly their place, the greatest of several, else null."""
    key = _keys(key)
    on = [*key, "start", "end"]
    named = labelled.groupBy(*[F.col(name(c)) for c in on]).agg(F.max(F.col(name(label))).alias(label))
    return spans.join(named, on, "left")
