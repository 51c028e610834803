"""Table sources: CSV with the usual null tokens, and every format Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmask.catalogue import CSV_NA_TOKENS
from quillmask.functions.sql import name

_FORMATS = {"parquet": "parquet", "orc": "orc", "json": "json", "jsonl": "json", "ndjson": "json"}


def na_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null out the null tokens of CSV files in string columns."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    chosen = texts if columns is None else [c for c in texts if c in columns]
    return df.withColumns(
        {c: F.when(~F.col(name(c)).isin(*CSV_NA_TOKENS), F.col(name(c))) for c in chosen}
    )


def infer_types(df: DataFrame, but: tuple[str, ...] = ()) -> DataFrame:
    """Give string columns the narrowest type that fits every value; ``but`` stay as they are.

    Whole numbers become long, else decimal of 38 digits, else stay strings, so
    that none loses a digit; then come double and boolean. One aggregation over
    the table; pass a schema to skip it.
    """

    def tests(c: str) -> dict:
        value = F.trim(F.col(name(c)))
        whole = value.rlike(r"^[+-]?\d+$")
        return {
            "bigint": whole & value.try_cast("bigint").isNotNull(),
            "decimal(38,0)": whole & value.try_cast("decimal(38,0)").isNotNull(),
            "string": whole,
            "double": value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"),
            "boolean": value.rlike("^(True|TRUE|true|False|FALSE|false)$"),
        }

    columns = [c for c in df.columns if c not in but]
    # every() skips nulls, which fit any type
    fits = df.agg(
        *[
            F.coalesce(F.every(F.when(F.col(name(c)).isNotNull(), test)), F.lit(False)).alias(f"{i}_{kind}")
            for i, c in enumerate(columns)
            for kind, test in tests(c).items()
        ]
    ).first()
    chosen = {
        c: next((kind for kind in tests(c) if fits[f"{i}_{kind}"]), "string") for i, c in enumerate(columns)
    }
    return df.select(
        *[F.trim(F.col(name(c))).cast(k).alias(c) if k != "string" else F.col(name(c)) for c, k in chosen.items()],
        *but,
    )


LOCATION = ("__file", "__block", "__pos")
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "nullValue": ""}


def located_at(raw: DataFrame) -> DataFrame:
    """Add where each row was read: file, block and running number."""
    place = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return raw.select("*", *[p.alias(c) for p, c in zip(place, LOCATION, strict=True)])


def _strings(spark: SparkSession, path: str, multi_line: bool, located: bool) -> DataFrame:
    """All fields as strings; a row with text beyond the last column fails the query."""
    options = {**CSV_OPTIONS, "multiLine": multi_line}
    header = spark.read.options(**options).csv(path, inferSchema=False).columns
    surplus = "__surplus"
    fields = [T.StructField(c, T.StringType()) for c in [*header, surplus]]
    raw = spark.read.options(**options).schema(T.StructType(fields)).csv(path)
    if located:
        raw = located_at(raw)
    message = F.concat(F.lit("a row has more fields than the header, from: "), F.col(surplus))
    return raw.filter(F.when(F.col(surplus).isNull(), True).otherwise(F.raise_error(message).cast("boolean"))).drop(surplus)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    infer: bool = True,
    multi_line: bool = True,
    located: bool = False,
) -> DataFrame:
    """CSV with a header row; null tokens become null.

    A row with more fields than the header fails the query; missing fields are null.

    Quoted line breaks (``multi_line``) make a file unsplittable; turn it off
    for large files without them. Pass a ``schema`` to avoid the inference pass.
    ``located`` adds where a row was read: file, block and running number.
    """
    kept = LOCATION if located else ()
    raw = _strings(spark, path, multi_line, located)
    clean = na_to_null(raw, [c for c in raw.columns if c not in kept])
    if schema is not None:
        target = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return clean.select(*[F.col(name(f.name)).cast(f.dataType).alias(f.name) for f in target.fields], *kept)
    return infer_types(clean, kept) if infer else clean


def load_table(spark: SparkSession, source: str, **csv_options) -> DataFrame:
    """Any table: ``.csv`` by suffix in any case, other files by suffix, else a catalog table."""
    suffix = source.rstrip("/").rsplit(".", 1)[-1].lower() if "." in source else ""
    if suffix == "csv":
        return read_csv(spark, source, **csv_options)
    if suffix in _FORMATS:
        return spark.read.format(_FORMATS[suffix]).load(source)
    if suffix in ("xlsx", "xls"):
        raise ValueError("workbooks are a single-machine format; export to CSV or parquet first")
    if "/" in source:
        return spark.read.parquet(source)
    return spark.table(source)


def read_parquet(
    spark: SparkSession, path: str, columns: list[str] | None = None, partitions: int | None = None
) -> DataFrame:
    """Parquet; ``partitions`` deals the rows out anew.

    Detection is bound by CPU and a row group is one task, so a small file may
    keep most cores idle; inputs with row groups for every core need no dealing.
    """
    df = spark.read.parquet(path)
    if columns is not None:
        df = df.select(*columns)
    return df if partitions is None else df.repartition(partitions)


def read_parquet_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet as a stream; ``path`` is one file or a folder of files, with partition columns or without.

    A streaming source takes a path without wildcards for the root of its
    partition columns, which a file cannot be; so a file is named by a wildcard
    that it alone matches.
    """
    schema = spark.read.parquet(path).schema
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if files.exists(target) and files.getFileStatus(target).isFile():
        folder, _, last = path.rpartition("/")
        path = f"{folder}/{{{last}}}" if folder else f"{{{last}}}"
    return spark.readStream.schema(schema).parquet(path)
