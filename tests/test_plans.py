"""Plan assertions: no Python UDFs, map-side top-k, no single-partition windows."""

import pytest

from shelfcast import catalog
from shelfcast.operators.features import feature_frame, serving_features
from shelfcast.sources import sales_view
from tests.conftest import SF_SMALL

PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


MODEL_QUERIES = {"forecast_next_7_days", "model_metrics", "sku_context_model", "sample_forecast",
                 "linear_metrics", "linear_folds", "linear_forecast", "linear_sample_forecast"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - MODEL_QUERIES))
def test_no_python_in_plans(spark, name):
    df = catalog.QUERIES[name](spark, SF_SMALL)
    plan = _plan(df)
    assert not any(n in plan for n in PY_NODES), name


def test_serving_uses_map_side_top_k(spark):
    plan = _plan(serving_features(sales_view(spark, SF_SMALL), "reference"))
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("name", ["serving_features", "serving_features_aligned", "inventory_plan", "alerts"])
def test_latest_row_jobs_read_the_sales_once(spark, name):
    plan = _plan(catalog.QUERIES[name](spark, SF_SMALL))
    assert plan.rfind("Aggregate") < plan.find("WindowGroupLimit")   # aggregates only meet the rows that the top-k left
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    for table in ("lineitem", "part", "supplier", "nation", "region"):
        assert sum(f"/{table}.parquet" in line for line in scans) == 1, table


def test_feature_windows_are_partitioned(spark):
    s = sales_view(spark, SF_SMALL)
    plan = _plan(feature_frame(s))
    assert "SinglePartition" not in plan and "_chunk" in plan


def test_building_a_query_only_reads_schemas(spark, monkeypatch):
    """Building a plan starts no job but the one per table in which Parquet footers give the schema."""
    from pyspark.sql.readwriter import DataFrameReader
    reads, parquet = [], DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *p, **o: reads.append(p) or parquet(self, *p, **o))
    tracker, group = spark.sparkContext.statusTracker(), "build-only"
    spark.sparkContext.setJobGroup(group, group)
    try:
        for name in ("sales_scan", "training_frame", "alerts", "respond"):
            catalog.QUERIES[name](spark, SF_SMALL)
        assert len(tracker.getJobIdsForGroup(group)) <= len(reads)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("name", ["prompt_context", "respond", "explain_summary", "alerts"])
def test_generated_code_compiles(spark, name):
    """No headline query falls back from generated code that is too large."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        catalog.QUERIES[name](spark, SF_SMALL).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
