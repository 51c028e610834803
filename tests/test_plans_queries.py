"""Plans stay free of shuffles and Python; registered queries equal their SQL."""

import pytest

from quillmask import anonymise
from suite.check import compare
from suite.oracle import build
from suite.queries import QUERIES

SQL = build()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cell_pipeline_neither_shuffles_nor_runs_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    result = anonymise(docs, key="doc_id")
    for df in (result.data, result.detections(), result.residuals()):
        plan = plan_of(df)
        assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_reports_read_only_needed_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = plan_of(anonymise(docs, key="doc_id").detections())
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert schema.strip() == "struct<doc_id:bigint,text:string>"


def test_detection_runs_once_per_report(spark, sf):
    """No filter or projection carries a second copy of the search."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = plan_of(anonymise(docs, key="doc_id", entity_types=["UK_POSTCODE"]).detections())
    assert one.count("GIR ?0AA") == 4  # test, matches, and two ways to the texts between


def test_unwanted_and_hopeless_detectors_are_left_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = plan_of(anonymise(docs, key="doc_id", entity_types=["ACCESS_CODE"], threshold=0.7).detections())
    assert "combination" in plan and r"\b\d{4,6}\b)" not in plan and "Mrs" not in plan


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query_equals_sql(spark, sf, key):
    ok, note = compare(spark, sf, key, SQL[key])
    assert ok, note
