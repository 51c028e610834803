"""The outputs of a run, published together.

A run writes into a folder of its own below the destination. When all outputs are
there, one small file in ``_published`` names their paths; readers go by the
latest, so they see a whole run or the one before it, never half of one. A run
that failed leaves nothing that counts; the next one deletes its folder.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmask.functions.sql import name
from quillmask.operators import reports
from quillmask.operators.anonymise import Anonymised
from quillmask.plans.staging import delete, shared_folder, stored

DATA = "anonymised_data"
DETECTIONS = "detection_report"
RESIDUALS = "residual_flags"
STATS = "run_stats"
PUBLISHED = "_published"


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN has no place in the outputs; write null instead."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(name(c)), F.col(name(c))) for c in floats}) if floats else df


def write_outputs(
    result: Anonymised,
    destination: str,
    staging: str | None = None,
    report_destination: str | None = None,
    file_format: str = "parquet",
    with_report: bool = True,
) -> dict[str, str]:
    """Write data, detection report, residual flags and counters; return their paths.

    Detection runs once: the wide frame is stored first (at ``staging``, else in
    the shared folder) and the outputs read only the columns they need from it;
    the counters are summed up while the stage is written. The stage holds raw
    personal data and is deleted at the end, also after a failure. So do the
    reports; ``report_destination`` puts them elsewhere and ``with_report=False``
    keeps detected texts out of stage and outputs. Residual flags are only written
    if there are any. Outputs of earlier runs stay where they are.
    """
    spark = result.wide.sparkSession
    number = max(numbers(spark, destination), default=-1) + 1
    paths = write_run(result, destination, f"run-{uuid.uuid4().hex}", staging, report_destination, file_format, with_report)
    publish(spark, destination, number, paths)
    return paths


def write_run(
    result: Anonymised,
    destination: str,
    run: str,
    staging: str | None = None,
    report_destination: str | None = None,
    file_format: str = "parquet",
    with_report: bool = True,
) -> dict[str, str]:
    """Write the outputs of one run into its folder, in place of what it may have left; nothing is published."""
    reports.check_identity(result)
    spark = result.wide.sparkSession
    folders = [f"{destination}/{run}", f"{report_destination or destination}/{run}"]
    path = staging or shared_folder(spark)
    needed = [c for c in dict.fromkeys([*result.original_columns, *result.key, result.row_index]) if c]
    working = [F.col(x) for c in result.cells for x in (c.redacted, c.findings)]
    # the counters need the number of detections, only the report needs what they say
    found = [F.col(c.detections) if with_report else F.transform(c.detections, lambda x: F.lit(0)).alias(c.detections) for c in result.cells]
    for folder in dict.fromkeys(folders):
        delete(spark, folder)
    try:
        seen = Observation()
        wide = result.wide.select(*[F.col(name(c)) for c in needed], *working, *found)
        stage = stored(wide.observe(seen, *reports.counter_columns(result)), path)
        counted = spark.createDataFrame([reports.counters(result, **seen.get)], reports.COUNTERS)
        return _write(result.on(stage), counted, *folders, file_format, with_report)
    except BaseException:
        for folder in dict.fromkeys(folders):
            delete(spark, folder)
        raise
    finally:
        delete(spark, path)


def _write(done: Anonymised, counted: DataFrame, data_to: str, reports_to: str, file_format: str, with_report: bool) -> dict[str, str]:
    paths = {DATA: f"{data_to}/{DATA}"}
    _save(nan_to_null(done.data), paths[DATA], file_format)
    if with_report:
        paths[DETECTIONS] = f"{reports_to}/{DETECTIONS}"
        _save(nan_to_null(done.detections()), paths[DETECTIONS], file_format)
    residuals = done.residuals()
    if not residuals.isEmpty():
        paths[RESIDUALS] = f"{reports_to}/{RESIDUALS}"
        _save(residuals, paths[RESIDUALS], file_format)
    paths[STATS] = f"{reports_to}/{STATS}"
    _save(counted, paths[STATS], file_format)
    return paths


def _save(df: DataFrame, path: str, file_format: str) -> None:
    df.write.format(file_format).save(path)


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def numbers(spark: SparkSession, destination: str) -> list[int]:
    """The numbers of the published runs."""
    folder, files = _file_system(spark, f"{destination}/{PUBLISHED}")
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def published(spark: SparkSession, destination: str, number: int) -> bool:
    path, files = _file_system(spark, f"{destination}/{PUBLISHED}/{number:020d}.json")
    return files.exists(path)


def paths_of(spark: SparkSession, destination: str, *runs: int) -> list[dict[str, str]]:
    """The paths of the outputs of published runs, in order of their numbers; one small file each."""
    files = [f"{destination}/{PUBLISHED}/{n:020d}.json" for n in runs]
    rows = spark.read.schema("number long, paths map<string, string>").json(files).collect()
    return [dict(r.paths) for r in sorted(rows, key=lambda r: r.number)]


def publish(spark: SparkSession, destination: str, number: int, paths: dict[str, str]) -> None:
    """Make a run the one that readers see: a file is written aside and renamed in one step."""
    aside, files = _file_system(spark, f"{destination}/{PUBLISHED}/.{number}-{uuid.uuid4().hex}")
    out = files.create(aside, True)
    try:
        out.write(bytearray(json.dumps({"number": number, "paths": paths}).encode()))
    finally:
        out.close()
    final, _ = _file_system(spark, f"{destination}/{PUBLISHED}/{number:020d}.json")
    if not files.rename(aside, final):
        files.delete(aside, False)
        raise FileExistsError(f"run {number} of {destination} is published already")


def read_outputs(spark: SparkSession, destination: str, file_format: str = "parquet") -> dict[str, DataFrame]:
    """The outputs of the latest published run."""
    known = numbers(spark, destination)
    if not known:
        raise FileNotFoundError(f"no run is published in {destination}")
    (paths,) = paths_of(spark, destination, known[-1])
    return {output: spark.read.format(file_format).load(path) for output, path in paths.items()}
