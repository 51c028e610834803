"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the local cores. Every
query runs over whole tables into a sink that reads all rows and keeps none.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

os.environ.setdefault("SUITE_PARTITIONS", os.environ.get("BENCH_CPUS", "8"))

from suite.queries import QUERIES, table  # noqa: E402

HEADLINE = (
    "redact_two_columns",
    "redact_generic",
    "redact_entity_tags",
    "missed_names",
    "changed_rows",
    "detection_report",
    "residual_flags",
    "run_stats",
    "outputs_detection_report",
    "redact_annotated",
    "missed_names_off_label",
    "gazetteer_detect",
    "redact_documents",
    "detections_documents",
    "residuals_documents",
    "redact_conversations",
    "redact_pages_html",
    "csv_na_normalise",
    "row_index_by_order",
    "threshold_sweep",
    "span_eval",
    "stream_anonymise",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="quillmask-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    table(spark, folder, "region").count()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    cells = 2 * spark.read.parquet(f"{folder}/orders.parquet").count()
    full = seconds.get("outputs_detection_report")
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "full_run_cells": cells,
                "full_run_cells_per_sec": round(cells / full, 1) if full else None,
            }
        )
    )


if __name__ == "__main__":
    main()
