"""Tuning aids of the review loop: threshold sweep, review sample, span scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmask.functions.sql import name
from quillmask.operators.columns import threshold_steps


def threshold_sweep(detections: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """Detections per type that reach each threshold.

    Scores take few values, so spans are counted per type and score first; only
    those counts are spread over the thresholds.
    """
    steps = threshold_steps() if thresholds is None else thresholds
    counts = detections.groupBy("entity_type", "score").agg(F.count(F.lit(1)).alias("n"))
    reached = F.filter(F.lit(steps), lambda t: t <= F.col("score"))
    return (
        counts.select("entity_type", "n", F.explode(reached).alias("threshold"))
        .groupBy("entity_type", "threshold")
        .agg(F.sum("n").alias("detections"))
    )


def review_sample(df: DataFrame, key, size: int = 500, seed: int = 0, strata=()) -> DataFrame:
    """A reproducible sample for review: the rows whose key has the smallest digests.

    The key is any column or columns; its digest is the md5 of seed and key as
    text, so the sample can be redone anywhere and does not depend on how rows
    are dealt out. With ``strata`` it is so many rows of each stratum (a type, a
    label; null is one). Tasks pass on no more than ``size`` rows of a stratum.
    Rows of equal keys are ordered by all their columns that have an order.
    """
    key, strata = ([x] if isinstance(x, str) else list(x) for x in (key, strata))
    parts = [F.coalesce(F.col(name(k)).cast("string"), F.lit("")) for k in key]
    order = [F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), *[F.col(name(k)) for k in key]]
    order += [F.col(name(f.name)) for f in df.schema.fields if f.name not in key and not f.dataType.typeName() in ("map", "variant")]
    if not strata:
        return df.orderBy(*order).limit(size)
    place = F.row_number().over(Window.partitionBy(*[F.col(name(s)) for s in strata]).orderBy(*order))
    return df.withColumn("__place", place).filter(F.col("__place") <= size).drop("__place")


def span_scores(found: DataFrame, gold: DataFrame, key) -> DataFrame:
    """Precision and recall per type against spans known to be right."""
    key = [key] if isinstance(key, str) else list(key)
    on = [*key, "entity_type", "start", "end"]
    both = (
        found.select(*on).distinct().withColumn("__found", F.lit(1))
        .join(gold.select(*on).distinct().withColumn("__gold", F.lit(1)), on, "full_outer")
    )
    hit = F.count(F.when(F.col("__found").isNotNull() & F.col("__gold").isNotNull(), 1))
    n_found, n_gold = F.count("__found"), F.count("__gold")
    return both.groupBy("entity_type").agg(
        hit.alias("true_positives"),
        (n_found - hit).alias("false_positives"),
        (n_gold - hit).alias("false_negatives"),
        F.round(hit / F.when(n_found > 0, n_found), 4).alias("precision"),
        F.round(hit / F.when(n_gold > 0, n_gold), 4).alias("recall"),
    )
