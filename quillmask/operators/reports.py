"""The reports: detections, residual findings and run counters."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.functions.sql import name

if TYPE_CHECKING:
    from quillmask.operators.anonymise import Anonymised


def check_identity(result: "Anonymised") -> None:
    if not result.key and result.row_index is None:
        raise ValueError("reports need rows to be told apart: pass key or row_index to anonymise")


def _position(result: "Anonymised") -> list[Column]:
    """Caller keys, then the row position if there is one."""
    check_identity(result)
    columns = [F.col(name(k)) for k in result.key if k != "row_index"]
    if result.row_index is not None:
        columns.append(F.col(name(result.row_index)).alias("row_index"))
    return columns


def _position_names(result: "Anonymised") -> list[str]:
    names = [k for k in result.key if k != "row_index"]
    return names + (["row_index"] if result.row_index is not None else [])


def detection_report(result: "Anonymised") -> DataFrame:
    """One row per reported span, before overlaps are resolved.

    The exploded array is an expression, not a bare column; otherwise the
    optimiser adds a size filter and pushes a second copy of the detection
    below the projection.
    """

    def of(c) -> Column:
        return F.transform(
            F.col(c.detections),
            lambda s: F.struct(
                F.lit(c.source).alias("source_column"),
                F.lit(c.output).alias("output_column"),
                s["entity_type"].alias("entity_type"),
                F.round(s["score"], 3).alias("score"),
                s["text"].alias("original_text"),
                s["start"].alias("start"),
                s["end"].alias("end"),
            ),
        )

    rows = F.concat(*[of(c) for c in result.cells])
    flat = result.wide.select(*_position(result), F.explode(rows).alias("d"))
    head, keys = _split_position(result)
    return flat.select(
        *keys,
        "d.source_column",
        "d.output_column",
        *head,
        "d.entity_type",
        "d.score",
        "d.original_text",
        "d.start",
        "d.end",
    )


def residual_report(result: "Anonymised") -> DataFrame:
    """One row per finding; offsets are left out as they refer to different texts."""

    def of(c) -> Column:
        return F.transform(
            F.col(c.findings),
            lambda f: F.struct(
                F.lit(c.source).alias("source_column"),
                F.lit(c.output).alias("output_column"),
                f["label"].alias("label"),
                f["text"].alias("text"),
            ),
        )

    rows = F.concat(*[of(c) for c in result.cells])
    flat = result.wide.select(*_position(result), F.explode(rows).alias("f"))
    head, keys = _split_position(result)
    return flat.select(*keys, "f.source_column", "f.output_column", *head, "f.label", "f.text")


def flagged_cells(result: "Anonymised") -> DataFrame:
    """One row per cell with findings."""
    rows = F.concat(
        *[
            F.when(
                F.size(c.findings) > 0,
                F.array(
                    F.struct(
                        F.lit(c.source).alias("source_column"),
                        F.lit(c.output).alias("output_column"),
                        F.col(c.findings).alias("findings"),
                    )
                ),
            ).otherwise(F.array())
            for c in result.cells
        ]
    )
    flat = result.wide.select(*_position(result), F.explode(rows).alias("f"))
    head, keys = _split_position(result)
    return flat.select(*keys, "f.source_column", "f.output_column", *head, "f.findings")


def _split_position(result: "Anonymised") -> tuple[list[str], list[Column]]:
    head = ["row_index"] if result.row_index is not None else []
    keys = [F.col(name(n)) for n in _position_names(result) if n != "row_index"]
    return head, keys


COUNTERS = """records_processed bigint, columns_anonymised bigint, pii_entities_detected bigint,
  rows_with_possible_residual_items bigint, processed_cells bigint, total_cells bigint"""


def counter_columns(result: "Anonymised") -> list[Column]:
    """What a run counts over its rows, as aggregates."""
    spans = sum((F.size(c.detections).cast("long") for c in result.cells), F.lit(0).cast("long"))
    flags = sum(((F.size(c.findings) > 0).cast("long") for c in result.cells), F.lit(0).cast("long"))
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(spans), F.lit(0)).alias("spans"), F.coalesce(F.sum(flags), F.lit(0)).alias("flags")]


def counters(result: "Anonymised", rows, spans, flags) -> tuple:
    """The six counters in order, from numbers or columns."""
    n = len(result.cells)
    return rows, n, spans, flags, rows * n, rows * n


def run_stats(result: "Anonymised") -> DataFrame:
    """Six counters in one row; partial sums per task, then one tiny merge."""
    sums = result.wide.agg(*counter_columns(result))
    names = [c.split()[0] for c in COUNTERS.split(",")]
    columns = counters(result, F.col("rows"), F.col("spans"), F.col("flags"))
    return sums.select(*[(c if isinstance(c, Column) else F.lit(c)).cast("long").alias(n) for n, c in zip(names, columns, strict=True)])
