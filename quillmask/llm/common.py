"""What the operators share: stored intermediates, small Arrow batches, keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 512


def shared_folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``, which all executors reach.

    Only a local session without the setting gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = tempfile.mkdtemp(prefix="quillmask-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored intermediates of one operation that are deleted when they are done with."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.held: list[tuple[DataFrame, str]] = []

    def stored(self, df: DataFrame, **options: str) -> DataFrame:
        path = shared_folder(self.spark)
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((out, path))
        return out

    def clear(self, *kept: DataFrame) -> None:
        """Delete everything but the given frames, through the file system that holds it."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        for out, path in self.held:
            if not any(out is k for k in kept):
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(conf).delete(target, True)
        self.held = [(out, path) for out, path in self.held if any(out is k for k in kept)]


def small_batches(spark: SparkSession) -> None:
    """Documents can be long, so few of them travel to Python at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def q(name: str) -> Column:
    """A top-level column by its literal name."""
    return F.col("`" + name.replace("`", "``") + "`")


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's text modulo parts; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(-1))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
