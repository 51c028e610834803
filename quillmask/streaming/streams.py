"""The same transform on unbounded input.

Anonymising a row needs nothing but the row, so :func:`quillmask.anonymise`
takes a streaming frame as it is. Here are the two ends around it: a query that
writes redacted rows, one that writes all outputs, and windowed counts of what
was found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmask.operators.anonymise import Anonymised, anonymise
from quillmask.sources.writers import numbers, paths_of, publish, published, write_run


def write_stream(
    frame: DataFrame,
    destination: str,
    checkpoint: str,
    file_format: str = "parquet",
    available_now: bool = False,
    trigger: str = "1 minute",
) -> StreamingQuery:
    """Start a query that appends a stream to files.

    The checkpoint must lie in shared storage, so a restarted query goes on
    where the lost one stopped and writes each row once.
    """
    writer = frame.writeStream.format(file_format).outputMode("append").option(
        "checkpointLocation", checkpoint
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
    return writer.start(destination)


def write_stream_outputs(
    frame: DataFrame,
    destination: str,
    checkpoint: str,
    available_now: bool = False,
    trigger: str = "1 minute",
    report_destination: str | None = None,
    file_format: str = "parquet",
    with_report: bool = True,
    **settings,
) -> StreamingQuery:
    """Start a query that writes data, detection report, residual flags and counters of a stream.

    Every micro-batch is anonymised once (``settings`` are those of
    :func:`quillmask.anonymise`), stored, written into a folder of its number and
    published. A batch that is run again after a failure replaces what it left;
    one that was published already is left alone, so outputs hold each row once.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if published(spark, destination, number):
            return
        result = anonymise(batch, **settings)
        paths = write_run(result, destination, f"batch-{number:020d}", None, report_destination, file_format, with_report)
        publish(spark, destination, number, paths)

    writer = frame.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
    return writer.start()


def read_stream_outputs(spark: SparkSession, destination: str, file_format: str = "parquet") -> dict[str, DataFrame]:
    """Each output over all published batches; an output that no batch wrote is left out."""
    known = numbers(spark, destination)
    paths: dict[str, list[str]] = {}
    for batch in paths_of(spark, destination, *known) if known else ():
        for output, path in batch.items():
            paths.setdefault(output, []).append(path)
    return {output: spark.read.format(file_format).load(every) for output, every in paths.items()}


def detection_counts(
    result: Anonymised, event_time: str, window: str = "10 minutes", late: str = "1 hour"
) -> DataFrame:
    """Detections per type and time window; windows close once ``late`` has passed.

    The time column must be among the keys of the result. Counting is partial
    per task, so a window with very many events still shuffles one row per task.
    """
    # on all rows, so that rows without detections move the time on as well
    found = result.on(result.wide.withWatermark(event_time, late)).detections()
    return (
        found.groupBy(F.window(event_time, window), "entity_type")
        .agg(F.count(F.lit(1)).alias("detections"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "entity_type",
            "detections",
        )
    )
