"""Which columns to treat, and what to call the results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.catalogue import (
    ENTITY_OPTIONS,
    MAX_THRESHOLD,
    MIN_THRESHOLD,
    OUTPUT_SUFFIX,
    TEXT_COLUMN_KEYWORDS,
    THRESHOLD_STEP,
)


def text_columns(names: list[str]) -> list[str]:
    """Columns whose name suggests free text; the first column if none does."""
    lowered = [(name, name.lower()) for name in names]
    hits = [name for name, low in lowered if any(word in low for word in TEXT_COLUMN_KEYWORDS)]
    return hits if hits else list(names[:1])


def output_name(taken: list[str], source: str) -> str:
    """First free name for the anonymised copy of ``source``.

    Spark resolves names without regard to case, so collisions are tested that way.
    """
    used = {name.lower() for name in taken}
    base = source + OUTPUT_SUFFIX
    if base.lower() not in used:
        return base
    n = 1
    while f"{base}_{n}".lower() in used:
        n += 1
    return f"{base}_{n}"


def output_names(existing: list[str], sources: list[str]) -> dict[str, str]:
    """Output column per source column; names handed out count as taken."""
    taken = list(existing)
    names: dict[str, str] = {}
    for source in sources:
        names[source] = output_name(taken, source)
        taken.append(names[source])
    return names


def as_text(column: Column) -> Column:
    """Null becomes the empty text; everything else its string form."""
    return F.coalesce(column.cast("string"), F.lit(""))


def check_selection(df: DataFrame, columns, entity_types, known_types, threshold: float) -> None:
    """Fail while the plan is built, not in the middle of a run."""
    if not columns:
        raise ValueError("select at least one column to anonymise")
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    if len(set(columns)) != len(columns):
        raise ValueError("a column is selected twice")
    check_options(entity_types, known_types, threshold)


def check_options(entity_types, known_types, threshold: float) -> None:
    """The part of the check that needs no frame."""
    if not entity_types:
        raise ValueError("select at least one entity type to anonymise")
    unknown = sorted(set(entity_types) - set(known_types) - set(ENTITY_OPTIONS.values()))
    if unknown:
        raise ValueError(f"unknown entity types: {unknown}")
    if not 0.0 <= threshold <= 1.0:
        raise ValueError(f"threshold must lie in [0, 1], not {threshold}")


def threshold_steps() -> list[float]:
    """The selectable score thresholds."""
    n = round((MAX_THRESHOLD - MIN_THRESHOLD) / THRESHOLD_STEP)
    return [round(MIN_THRESHOLD + i * THRESHOLD_STEP, 2) for i in range(n + 1)]
