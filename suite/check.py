"""Compare registered queries with their SQL: ``python -m suite.check [folder] [query ...]``."""

from __future__ import annotations

import math
import sys
import tempfile
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from suite.oracle import build
from suite.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="quillmask-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark: SparkSession, folder: str, key: str, sql: str) -> tuple[bool, str]:
    started = time.time()
    df = QUERIES[key](spark, folder)
    got = bag(df.columns, df.collect())
    spark_seconds = time.time() - started
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    started = time.time()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = bag(names, cursor.fetchall())
    note = f"{sum(got.values())} rows, spark {spark_seconds:.1f}s, duckdb {time.time() - started:.1f}s"
    if sorted(names) != sorted(df.columns):
        return False, f"{note}; columns {sorted(df.columns)} vs {sorted(names)}"
    if got != want:
        return False, f"{note}; only spark {list((got - want).items())[:3]}; only sql {list((want - got).items())[:3]} of {sum(want.values())}"
    return True, note


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = session()
    sql = build()
    bad = 0
    for key in sys.argv[2:] or QUERIES:
        try:
            ok, note = compare(spark, folder, key, sql[key])
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + key, note, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
