"""Shared steps that must not grow faster than the input: the sales joins, the feature windows, the split, the folds."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfcast import catalog
from shelfcast.operators import sequence
from shelfcast.operators.features import feature_frame
from shelfcast.plans import models
from shelfcast.sources import sales_view
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_sales_joins_do_not_shuffle_while_the_other_tables_are_small(spark):
    assert "hashpartitioning" not in _plan(sales_view(spark, SF_SMALL))


def _mixed(spark):
    rnd = random.Random(3)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randint(0, 40)), p, float(rnd.randint(0, 50)), i)
            for i, p in enumerate(["A"] * 300 + ["B"] * 40 + ["C"] * 41 + [None] * 20)]
    return spark.createDataFrame(rows, "date date, product_id string, units_sold double, src_order long").withColumn("src_line", F.lit(1))


def test_products_are_parted_by_their_rows(spark):
    small, large = sequence.parted(_mixed(spark), 40)
    assert {r.product_id for r in small.collect()} == {"B"} and small.count() == 40
    assert {r.product_id for r in large.collect()} == {"A", "C"} and large.count() == 341


def test_small_and_large_products_have_the_same_positions_and_windows(spark):
    df = _mixed(spark)
    w = Window.partitionBy("product_id").orderBy("date", "src_order", "src_line")
    want = df.where("product_id is not null").select("product_id", "src_order", F.row_number().over(w).cast("long").alias("pos"),
                                                     F.count("*").over(Window.partitionBy("product_id")).alias("n_rows"),
                                                     F.lag("units_sold", 30).over(w).alias("lag_30"), F.lead("units_sold", 7).over(w).alias("demand_t7"))
    for rows in (40, 100, 10**6):
        got = feature_frame(df, chunk_rows=rows, calendar=False).select(want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        got = sequence.with_positions(df, day_rows=rows).select("product_id", "src_order", "pos", "n_rows")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_small_products_need_one_exchange_of_the_rows(spark):
    """Once no product is found large, the rows are exchanged once (they were twice, their days as well)."""
    df = _mixed(spark)
    out = feature_frame(df)
    out.collect()
    final = _plan(out).split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 1, final


@pytest.mark.parametrize("name", ["time_split", "cv_folds", "eval_smape", "prediction_sample", "last_validation_row"])
def test_the_frame_of_a_split_is_computed_once(spark, name):
    files = catalog.QUERIES[name](spark, SF_SMALL).inputFiles()
    assert files and all("training-frame-" in f for f in files)


def test_fold_scores_fit_no_more_than_they_score(spark):
    """The mean RMSE of CrossValidator, with one fit per fold."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import LinearRegression
    from pyspark.ml.tuning import CrossValidator
    fits = []

    class Counted(LinearRegression):
        def _fit(self, rows):
            fits.append(1)
            return super()._fit(rows)

    def estimator(label):
        return Counted(featuresCol="features", labelCol=label, solver="normal")

    rows = spark.range(60).selectExpr("cast(id % 3 as int) fold", "double(id) price", "double(id * id % 31) demand_t2")
    rows = models.assembler(("price",)).transform(rows).cache()
    got = models.fold_rmse(rows, 2, ("price",), estimator)
    assert len(fits) == models.FOLDS
    cv = CrossValidator(estimator=LinearRegression(featuresCol="features", labelCol="demand_t2", solver="normal"), estimatorParamMaps=[{}],
                        evaluator=RegressionEvaluator(metricName="rmse", labelCol="demand_t2"), foldCol="fold").fit(rows)
    assert abs(got - cv.avgMetrics[0]) < 1e-9
    with pytest.raises(ValueError):
        models.fold_rmse(rows.where("fold != 1"), 2, ("price",), estimator)
    rows.unpersist()


def test_horizons_share_the_cores_while_the_frame_is_small():
    assert models.horizons_at_once(4, 12) == 7 and models.horizons_at_once(300, 12) == 4
