"""CSV files with faulty rows: the good rows as a table, the faulty ones apart, none lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmask.functions.sql import name
from quillmask.sources.readers import CSV_OPTIONS, LOCATION, infer_types, located_at, na_to_null
from quillmask.sources.row_index import numbered_csv

TOO_MANY = "more fields than the header"
UNCLOSED = "unclosed quote"
MISFIT = "no "

_RECORD = "__record"
# A whole quoted field, and the beginning of one that never ends.
_QUOTED = r'(^|,)"[^"]*+(?:""[^"]*+)*+"'
_OPEN = r'(^|,)"'


def _reason(record: Column, header: list[str], target: T.StructType | None) -> Column:
    """Why a row is faulty, null for a good one; ``record`` is the raw text of a row of other than the header's fields."""
    # Always true: Spark refuses queries that read nothing but raw records.
    read = F.octet_length(F.coalesce(F.col(name(header[0])), F.lit(""))) >= 0
    plain = F.regexp_replace(record, _QUOTED, "$1")
    fields = F.length(plain) - F.length(F.replace(plain, F.lit(","), F.lit(""))) + 1
    misfits = [
        F.when(F.col(name(f.name)).isNotNull() & F.col(name(f.name)).try_cast(f.dataType).isNull(), F.lit(f.name))
        for f in (target.fields if target else [])
        if not isinstance(f.dataType, T.StringType)
    ]
    misfit = F.concat_ws(", ", *misfits) if misfits else F.lit("")
    typed = F.when(misfit != "", F.concat(F.lit(MISFIT), misfit))
    return F.when(read & plain.rlike(_OPEN), UNCLOSED).when(read & (fields > len(header)), TOO_MANY).otherwise(typed)


def read_csv_quarantined(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    infer: bool = True,
    multi_line: bool = True,
    index: str = "row_index",
) -> tuple[DataFrame, DataFrame]:
    """Good rows and faulty rows of CSV files with a header row; together they are all rows.

    Good rows are as :func:`read_csv` gives them, missing fields null, plus
    ``index``, their position over all files. Faulty are rows with more fields
    than the header, rows whose quote never ends and, with a ``schema``, rows
    with a value that is none of its column's type. They come with ``file``,
    ``index``, ``reason`` and ``record``, their raw text (for values of a wrong
    type the fields joined again). Nothing is shuffled but the sizes of blocks.
    """
    options = {**CSV_OPTIONS, "multiLine": multi_line}
    header = spark.read.options(**options).csv(path, inferSchema=False).columns
    if not header:
        raise ValueError(f"no header row in {path}")
    fields = [T.StructField(c, T.StringType()) for c in [*header, _RECORD]]
    raw = located_at(
        spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=_RECORD).schema(T.StructType(fields)).csv(path)
    )
    target = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    clean = na_to_null(raw, header).withColumn("__reason", _reason(F.col(_RECORD), header, target))
    rows = numbered_csv(clean.withColumn("file", F.col(LOCATION[0])), index, raw)
    good = rows.filter("__reason IS NULL").drop("__reason", _RECORD, "file")
    if target is not None:
        good = good.select(*[F.col(name(f.name)).cast(f.dataType).alias(f.name) for f in target.fields], index)
    elif infer:
        good = infer_types(good, (index,))
    whole = F.to_csv(F.struct(*[F.col(name(c)) for c in header]))
    bad = rows.filter("__reason IS NOT NULL").select(
        "file", index, F.col("__reason").alias("reason"), F.coalesce(_RECORD, whole).alias("record")
    )
    return good, bad
