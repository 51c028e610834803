import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def run(spark):
    """Anonymise a list of texts and give the result with row keys 0, 1, ..."""
    from quillmask import anonymise

    def go(texts, **settings):
        df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
        settings.setdefault("key", "id")
        return anonymise(df, columns=["text"], **settings)

    return go


@pytest.fixture
def redacted(run):
    def go(texts, **settings):
        return [r[2] for r in sorted(run(texts, **settings).data.collect())]

    return go


@pytest.fixture
def spans(run):
    """Per text the set of (type, score, start, end, text)."""

    def go(texts, **settings):
        out = [set() for _ in texts]
        for r in run(texts, **settings).detections().collect():
            out[r["id"]].add((r["entity_type"], r["score"], r["start"], r["end"], r["original_text"]))
        return out

    return go
