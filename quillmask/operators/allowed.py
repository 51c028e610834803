"""Allow-lists that are tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.functions.sql import name
from quillmask.operators.anonymise import Anonymised


def attach_allowed(df: DataFrame, found: Anonymised, allowed: DataFrame, columns: dict[str, str], term: str = "term") -> DataFrame:
    """Add to ``df`` a column of allowed texts for each source column, for ``anonymise(allowed=columns)``.

    ``found`` is a run over ``df`` without the list, with a ``key`` that tells rows
    apart; ``allowed`` is a table of any size. Only texts that were detected meet
    it, in a semi-join on the text: by its size the table is broadcast or both
    sides shuffle, where adaptive execution splits the partitions of a text that
    many cells hold. What is kept of a row is bounded by its own spans.
    """
    if not found.key:
        raise ValueError("a table of allowed texts needs the key of the rows")
    key = list(found.key)
    spans = found.detections().select(*[F.col(name(k)) for k in key], "source_column", F.col("original_text").alias("__text"))
    terms = allowed.select(F.col(name(term)).alias("__text")).filter("__text IS NOT NULL")
    held = spans.join(terms, "__text", "left_semi")
    lists = held.groupBy(*[F.col(name(k)) for k in key]).agg(
        *[F.collect_set(F.when(F.col("source_column") == source, F.col("__text"))).alias(target) for source, target in columns.items()]
    )
    return df.join(lists, key, "left")
