"""Model smoke test at sf0.001: tuned path (1-point grid, contiguous folds),
save/load round trip, scoring of every product."""

import glob
import os
import tempfile

from pyspark.sql import functions as F

from shelfcast.operators.features import serving_features, training_frame
from shelfcast.plans.models import (forecast_next_7_days, load_models, models_present, partitions_for, release,
                                    save_models, train_models)
from shelfcast.sources import sales_view
from tests.conftest import SF_SMALL

TINY_GRID = {"maxIter": [3], "maxDepth": [3]}


def test_train_save_load_score(spark):
    s = sales_view(spark, SF_SMALL)
    path = tempfile.mkdtemp(prefix="shelfcast-models-")
    res = train_models(training_frame(s), path=path, tune=True, grid=TINY_GRID)
    assert sorted(res["models"]) == list(range(1, 8))
    m = {r.horizon: r for r in res["metrics"].collect()}
    assert sorted(m) == list(range(1, 8))
    assert all(r.train_rmse >= 0 and r.val_rmse >= 0 for r in m.values())
    # the fitted trees beat a constant-mean predictor on the training rows
    tr = res["split"].where(F.col("split") == "train")
    y_mean = tr.agg(F.avg("demand_t1")).first()[0]
    base = tr.agg(F.sqrt(F.avg(F.pow(F.col("demand_t1") - y_mean, 2)))).first()[0]
    assert m[1].train_rmse < base
    loaded = load_models(path)
    assert sorted(loaded) == list(range(1, 8))
    six = tempfile.mkdtemp(prefix="shelfcast-models-six-")
    save_models({i: loaded[i] for i in range(1, 7)}, six)
    partial = load_models(six)
    fc = forecast_next_7_days(serving_features(s, "reference"), partial)
    rows = fc.collect()
    assert len(rows) == s.select("product_id").distinct().count()
    for r in rows:
        assert sorted(r.forecast) == sorted(f"t+{i}" for i in range(1, 8))
        assert all(v >= 0 for v in r.forecast.values())
        assert r.forecast["t+7"] == 0.0        # absent horizon → 0.0


def test_linear_regressor_in_the_slot_matches_closed_form(spark):
    """A one-feature linear fit has a closed form per horizon."""
    import pytest
    from pyspark.ml.regression import LinearRegression
    s = sales_view(spark, SF_SMALL)
    path = tempfile.mkdtemp(prefix="shelfcast-linear-")
    res = train_models(training_frame(s), path=path, tune=False, features=("price",),
                       estimator=lambda label: LinearRegression(featuresCol="features", labelCol=label, solver="normal"))
    train = res["split"].where(F.col("split") == "train")
    fits = train.agg(*[F.struct(F.regr_slope(f"demand_t{i}", "price").alias("a"), F.regr_intercept(f"demand_t{i}", "price").alias("b"))
                       .alias(str(i)) for i in range(1, 8)]).first()
    loaded = load_models(path)
    one = spark.createDataFrame([("P", 12.5)], "product_id string, price double")
    got = forecast_next_7_days(one, loaded).first().forecast
    for i in range(1, 8):
        want = max(0.0, fits[str(i)]["a"] * 12.5 + fits[str(i)]["b"])
        assert abs(got[f"t+{i}"] - want) < 1e-6
    rmse = train.agg(F.sqrt(F.avg(F.pow(F.col("demand_t1") - (F.col("price") * fits["1"]["a"] + fits["1"]["b"]), 2)))).first()[0]
    assert abs(res["metrics"].where("horizon = 1").first().train_rmse - rmse) < 1e-6
    gone = glob.glob(os.path.join(path, "version-*", "horizon=3", "metadata", "part-*"))
    assert gone
    for f in gone:
        os.remove(f)
    with pytest.raises(Exception):
        load_models(path)       # there, but unreadable


def test_tree_counts_share_a_fit(spark):
    """The same metrics and choice as CrossValidator, which fits every grid point."""
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    from shelfcast.plans.models import fit_horizon, regressor, tree_count_metrics
    rows = spark.range(300).selectExpr("cast(id % 3 as int) fold", "double(id % 17) x", "double((id * 7) % 23) y", "double((id % 17) * 2 + (id * 7) % 23 % 5) demand_t1").cache()
    grid = {"maxIter": [2, 4], "maxDepth": [2], "subsamplingRate": [0.8, 1.0]}
    reg = regressor("demand_t1")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["x", "y"], outputCol="features"), reg])
    b = ParamGridBuilder()
    for name, values in grid.items():
        b = b.addGrid(reg.getParam(name), values)
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=b.build(), evaluator=RegressionEvaluator(metricName="rmse", labelCol="demand_t1"), foldCol="fold").fit(rows)
    want = {tuple((p.name, v) for p, v in m.items()): x for m, x in zip(cv.getEstimatorParamMaps(), cv.avgMetrics)}
    got = tree_count_metrics(pipe.getStages()[0].transform(rows), reg, "demand_t1", grid, 2)
    assert {frozenset(k) for k in got} == {frozenset(k) for k in want}
    for k, x in want.items():
        assert abs(next(v for g, v in got.items() if set(g) == set(k)) - x) < 1e-9
    best = fit_horizon(rows, 1, True, ("x", "y"), grid).stages[-1]
    trees = lambda m: m.toDebugString.split("\n", 1)[1]
    assert trees(best) == trees(cv.bestModel.stages[-1])


def test_tuned_models_takes_the_full_grid(spark, monkeypatch):
    from shelfcast import catalog
    from shelfcast.plans import models
    seen = []
    monkeypatch.setattr(models, "train_models", lambda tf, **k: seen.append(k) or {"metrics": tf.limit(0)})
    monkeypatch.setattr(catalog, "_TRAINED", {})
    catalog.LONG_QUERIES["tuned_models"](spark, SF_SMALL)
    assert seen[0]["tune"] is True and "grid" not in seen[0] and models.GRID == dict(
        maxIter=[100, 150], maxDepth=[4, 6], stepSize=[0.05, 0.1], subsamplingRate=[0.8, 1.0])


def _linear(label):
    from pyspark.ml.regression import LinearRegression
    return LinearRegression(featuresCol="features", labelCol=label, solver="normal")


def test_a_training_that_stops_leaves_the_former_set(spark, monkeypatch):
    """After a stop in the third horizon, loading gives the old seven; a whole set replaces them."""
    import pytest
    from pyspark.ml.util import JavaMLWriter
    tf = training_frame(sales_view(spark, SF_SMALL))
    path = tempfile.mkdtemp(prefix="shelfcast-versions-")
    assert not models_present(path)
    with pytest.raises(ValueError):
        load_models(path)
    train_models(tf, path=path, tune=False, features=("price",), estimator=_linear)
    old = {i: m.stages[-1].coefficients.toArray().tolist() for i, m in load_models(path).items()}
    assert models_present(path) and sorted(old) == list(range(1, 8))
    new = train_models(tf, tune=False, features=("discount",), estimator=_linear)
    saved, save = [], JavaMLWriter.save

    def stopping(self, where):
        if "horizon=3" in where:
            raise RuntimeError("stopped")
        saved.append(where)
        return save(self, where)

    monkeypatch.setattr(JavaMLWriter, "save", stopping)
    with pytest.raises(RuntimeError):
        save_models(new["models"], path)
    monkeypatch.undo()
    assert len(saved) >= 2
    assert {i: m.stages[-1].coefficients.toArray().tolist() for i, m in load_models(path).items()} == old
    assert save_models(new["models"], path) == 2
    assert {i: m.stages[0].getInputCols() for i, m in load_models(path).items()} == {i: ["discount"] for i in range(1, 8)}


def test_release_frees_one_frame_only(spark):
    other = spark.range(10).cache()
    other.count()
    res = train_models(training_frame(sales_view(spark, SF_SMALL)), tune=False, features=("price",), estimator=_linear)
    assert res["metrics"].count() == 7 and os.path.isdir(res["frame"].removeprefix("file:"))
    release(res)
    assert not os.path.isdir(res["frame"].removeprefix("file:")) and other.storageLevel.useMemory
    other.unpersist()


def test_partitions_follow_the_rows():
    assert partitions_for(0, 36) == partitions_for(4_600, 36) == 1
    assert partitions_for(600_000, 36) == 6
    assert partitions_for(20_000_000_000, 36) == 171_662


def test_horizons_are_stored_together(spark, monkeypatch):
    """No model waits until another one is stored, and what is loaded is what was trained."""
    import threading
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import VectorAssembler
    rows = spark.range(40).selectExpr("double(id) x", *[f"double(id * {i} + 1) demand_t{i}" for i in range(1, 8)])
    stage = VectorAssembler(inputCols=["x"], outputCol="features")
    models = {i: PipelineModel([stage, _linear(f"demand_t{i}").fit(stage.transform(rows))]) for i in range(1, 8)}
    all_begun, write = threading.Barrier(7), PipelineModel.write

    def writing(self):
        all_begun.wait(timeout=30)      # broken unless seven are being stored
        return write(self)

    path = tempfile.mkdtemp(prefix="shelfcast-together-")
    monkeypatch.setattr(PipelineModel, "write", writing)
    assert save_models(models, path) == 1
    monkeypatch.undo()
    loaded = load_models(path)
    assert {i: m.stages[-1].coefficients.toArray().tolist() for i, m in loaded.items()} == {
        i: m.stages[-1].coefficients.toArray().tolist() for i, m in models.items()}


def test_fits_at_once_share_the_cores(spark, monkeypatch):
    """M4: seven fits at once have no more partitions each than the cores need; a frame larger than that keeps its own number."""
    from pyspark.ml import PipelineModel
    from shelfcast.plans import models
    assert [models.partitions_per_fit(5, cores, 7) for cores in (4, 7, 8, 12, 64)] == [5, 1, 2, 2, 5]
    assert models.partitions_per_fit(9, 8, 4) == 9 and models.partitions_per_fit(1, 8, 7) == 1 and models.partitions_per_fit(5, 8, 1) == 5
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 400, 1, cores).selectExpr("double(id) x", "if(id < 320, 'train', 'val') split", *[f"double(id * {i}) demand_t{i}" for i in range(1, 8)])
    seen, fit = [], models.fit_horizon
    monkeypatch.setattr(models, "_split_frame", lambda *a: rows)
    monkeypatch.setattr(models, "partitions_for", lambda *a: cores)
    monkeypatch.setattr(models, "fit_horizon", lambda train, *a: seen.append((train.rdd.getNumPartitions(), train.count())) or fit(train, *a))
    res = train_models(rows, tune=False, features=("x",), estimator=_linear)
    assert seen == [(-(-cores // 7), 320)] * 7 and all(isinstance(m, PipelineModel) for m in res["models"].values())
