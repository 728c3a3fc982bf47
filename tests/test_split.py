"""Exact time split and contiguous folds (O5, M2) against a global row_number."""

import datetime as dt
import os
import random
import shutil

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfcast import catalog
from shelfcast.operators import split
from shelfcast.operators.features import training_frame
from shelfcast.operators.split import contiguous_folds, time_split
from shelfcast.sources import sales_view
from tests.conftest import SF_SMALL

ORDER = ["date", "product_id", "src_order", "src_line"]


def test_time_split_is_exact(spark):
    tf = training_frame(sales_view(spark, SF_SMALL))
    n = tf.count()
    sp = time_split(tf, 0.2)
    assert sp.where(F.col("split") == "train").count() == int(n * (1 - 0.2))
    ranked = tf.withColumn("_r", F.row_number().over(Window.orderBy(*ORDER)))
    want = ranked.select(*ORDER, F.when(F.col("_r") <= int(n * 0.8), "train").otherwise("val").alias("split"))
    assert sp.select(*ORDER, "split").exceptAll(want).count() == 0


def test_time_split_plan_has_no_single_partition_exchange(spark):
    tf = training_frame(sales_view(spark, SF_SMALL))
    sp = time_split(tf, 0.2)
    plan = sp._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_folds_are_contiguous_kfold_blocks(spark):
    tf = training_frame(sales_view(spark, SF_SMALL))
    tr = time_split(tf, 0.2).where(F.col("split") == "train")
    n = tr.count()
    folds = contiguous_folds(tr, 3)
    sizes = {r.fold: r["count"] for r in folds.groupBy("fold").count().collect()}
    want = [n // 3 + (1 if i < n % 3 else 0) for i in range(3)]
    assert [sizes[i] for i in range(3)] == want
    w = Window.orderBy(*ORDER)
    seq = [r.fold for r in folds.withColumn("_r", F.row_number().over(w)).orderBy("_r").select("fold").collect()]
    assert seq == sorted(seq)


SALES = "date date, product_id string, store_id string, units_sold double"


def _sizes(df, name):
    return {r[name]: r["count"] for r in df.groupBy(name).count().collect()}


@pytest.mark.parametrize("few", [10_000, 5])
def test_split_of_tables_without_tie_breakers(spark, monkeypatch, few):
    """int(n·0.8) rows train, whatever the keys: equal rows, one product-day, missing dates and products."""
    monkeypatch.setattr(split, "FEW", few)
    monkeypatch.setattr(split, "COPIES", 7)
    day, rnd = dt.date(2024, 1, 1), random.Random(3)
    tables = [
        [(day, "P", "S", 1.0)] * 100,
        [(day, f"P{i % 4}", "S", 1.0) for i in range(100)],
        [(None, "P", "S", 1.0)] * 10,
        [(None if i % 3 else day, None if i % 2 else "P", None if i % 5 else "S", None if i % 7 else 2.0) for i in range(101)],
        [(None if rnd.random() < .2 else day + dt.timedelta(days=rnd.randint(0, 3)), rnd.choice([None, "A", "B"]), rnd.choice(["S", "T"]),
          rnd.choice([None, 1.0, 2.0])) for _ in range(403)],
        [(day, "P", "S", float(i)) for i in range(37)],
        [(day, "P", "S", 1.0)],
        [],
    ]
    for rows in tables:
        df, n = spark.createDataFrame(rows, SALES).repartition(3), len(rows)
        order = sorted(rows, key=split._sorted_key)
        got = time_split(df, 0.2).collect()
        assert sorted((tuple(r)[:4] for r in got if r.split == "train"), key=split._sorted_key) == order[:int(n * 0.8)]
        assert sorted((tuple(r)[:4] for r in got if r.split == "val"), key=split._sorted_key) == order[int(n * 0.8):]
        folds = contiguous_folds(df, 3).collect()
        sizes, at = [n // 3 + (i < n % 3) for i in range(3)], 0
        for i in range(3):
            part = sorted((tuple(r)[:4] for r in folds if r.fold == i), key=split._sorted_key)
            assert part == order[at:at + sizes[i]]
            at += sizes[i]


def test_changed_files_are_seen_after_a_split(spark, tmp_path):
    """No query is answered from what an earlier one has kept."""
    for t in ("region", "nation", "supplier", "part", "lineitem"):
        shutil.copy(f"{SF_SMALL}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    watched = ["training_frame", "time_split", "cv_folds", "metrics_by_horizon", "alerts", "sales_scan"]
    first = {name: catalog.QUERIES[name](spark, str(tmp_path)).count() for name in watched}
    kept = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").orderBy("l_orderkey", "l_linenumber").limit(500).toPandas()
    os.remove(f"{tmp_path}/lineitem.parquet")
    kept.to_parquet(f"{tmp_path}/lineitem.parquet", coerce_timestamps="us")
    spark.catalog.refreshByPath(str(tmp_path))
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == 0
    again = {name: catalog.QUERIES[name](spark, str(tmp_path)).count() for name in watched}
    assert again["sales_scan"] == 500 and again["training_frame"] < first["training_frame"]
    assert again["time_split"] == again["training_frame"] and again["alerts"] < first["alerts"]
