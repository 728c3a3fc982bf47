"""Registered queries: one entry per operator of the inventory.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
test tables.  Column names match the oracle SQL in ``duck_oracle.py``.
Nested results are flattened to scalar columns where a struct is only a
container, so two engines can be compared value by value.  Sample standard
deviations and averages of non-integer values are reported rounded to
1e-6 (summation order differs between engines in the last bits).
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions.forecast import forecast_total, seven_days
from shelfcast.functions.pynum import py_round
from shelfcast.functions.text import detect_intent
from shelfcast.operators import context as ctxops
from shelfcast.operators import evaluation as ev
from shelfcast.operators import profile as prof
from shelfcast.operators.features import (LAG_COLS, MEAN_COLS, STD_COLS, feature_frame,
                                          layout_features, model_input, serving_features, training_frame)
from shelfcast.operators.requests import requested_features
from shelfcast.operators.snapshot import latest_row, product_info, recent_sales
from shelfcast.operators.split import contiguous_folds, time_split
from shelfcast.plans.decisions import constant_forecast, plan_and_alerts, realised_forecast
from shelfcast.schema import FEATURES_V1, TARGETS
from shelfcast.sources import gaps_view, messages_view, requests_view, sales_view, untied_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
KEYS = ("product_id", "date", "src_order", "src_line")


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _r6(c):
    return py_round(f"`{c}`", 6).alias(c)


# ---------------------------------------------------------------- sources
@query("sales_scan")
def q_sales_scan(spark, sf):
    """The sales view over all test tables."""
    return sales_view(spark, sf)


@query("sku_filter")
def q_sku_filter(spark, sf):
    """Rows of every product somebody asked about (left-semi join)."""
    return prof.sku_filter(sales_view(spark, sf), messages_view(spark, sf))


@query("sku_membership")
def q_sku_membership(spark, sf):
    """P10: requested SKU known? unknown → first SKU."""
    return prof.sku_membership(messages_view(spark, sf), sales_view(spark, sf))


# -------------------------------------------------------------- profiling
@query("zero_profile")
def q_zero_profile(spark, sf):
    return prof.zero_profile(sales_view(spark, sf))


@query("zero_by_product")
def q_zero_by_product(spark, sf):
    return prof.zero_by_product(sales_view(spark, sf))


@query("zero_targets")
def q_zero_targets(spark, sf):
    return prof.zero_targets(training_frame(sales_view(spark, sf)))


@query("sku_list")
def q_sku_list(spark, sf):
    return prof.sku_list(sales_view(spark, sf))


@query("product_info")
def q_product_info(spark, sf):
    """A5/T1."""
    return product_info(sales_view(spark, sf)).withColumn(
        "average_price", py_round("average_price", 6))


@query("sku_catalog")
def q_sku_catalog(spark, sf):
    """O3: first 50 products (a top-k listing), 20 displayed, rest counted."""
    info = product_info(sales_view(spark, sf)).withColumn(
        "average_price", py_round("average_price", 6))
    return prof.sku_catalog(info)


# --------------------------------------------------------------- features
def _ff(spark, sf):
    return feature_frame(sales_view(spark, sf))


@query("lag_features")
def q_lag_features(spark, sf):
    return _ff(spark, sf).select(*KEYS, "units_sold", *LAG_COLS)


@query("rolling_mean")
def q_rolling_mean(spark, sf):
    return _ff(spark, sf).select(*KEYS, "units_sold", *MEAN_COLS)


@query("rolling_std")
def q_rolling_std(spark, sf):
    return _ff(spark, sf).select(*KEYS, "units_sold", *[_r6(c) for c in STD_COLS])


@query("demand_targets")
def q_demand_targets(spark, sf):
    return _ff(spark, sf).select(*KEYS, "units_sold", *TARGETS)


@query("calendar_features")
def q_calendar(spark, sf):
    from shelfcast.functions.calendar import calendar_columns
    return sales_view(spark, sf).select(*KEYS, *calendar_columns(F.col("date")))


@query("date_text")
def q_date_text(spark, sf):
    from shelfcast.functions.calendar import date_text
    return sales_view(spark, sf).select(*KEYS, date_text(F.col("date")).alias("date_text"))


def _tf_out(df):
    drop = {"pos", "n_rows"}
    return df.select(*[_r6(c) if c in STD_COLS else F.col(c) for c in df.columns if c not in drop])


@query("training_frame")
def q_training_frame(spark, sf):
    """W5 + P2."""
    return _tf_out(training_frame(sales_view(spark, sf)))


@query("layout_training_frame")
def q_layout_training_frame(spark, sf):
    """The training frame read from a stored layout, whose windows need no exchange."""
    return _tf_out(layout_features(stored_layout(spark, sf), drop_incomplete=True))


def stored_layout(spark, sf, buckets=16):
    """The sales of the test tables in a layout of its own under the checkpoint folder."""
    from shelfcast.session import scratch
    from shelfcast.sources.layout import store_sales
    path = scratch(spark, "sales-layout")
    return store_sales(sales_view(spark, sf), path.rsplit("/", 1)[1].replace("-", "_"), path, buckets)


@query("dropped_rows")
def q_dropped_rows(spark, sf):
    from shelfcast.operators.features import dropped_rows
    return dropped_rows(sales_view(spark, sf))


@query("model_input")
def q_model_input(spark, sf):
    """The 29-feature manifest, NULL → 0.0."""
    tf = training_frame(sales_view(spark, sf))
    cols = model_input(tf, FEATURES_V1)
    return tf.select(*KEYS, *[py_round(c, 6).alias(n) if n in STD_COLS else c
                              for c, n in zip(cols, FEATURES_V1)])


@query("model_input_calendar")
def q_model_input_calendar(spark, sf):
    """P5 with ``include_calendar``: the calendar columns beside the default manifest."""
    from shelfcast.schema import feature_manifest
    names = [c for c in feature_manifest(include_calendar=True) if c not in STD_COLS]
    tf = training_frame(sales_view(spark, sf))
    return tf.select(*KEYS, *model_input(tf, names))


@query("partial_row_features")
def q_partial_row_features(spark, sf):
    """Latest rows that only give a price; the rest comes from the history."""
    from shelfcast.operators.features import pass_through_features
    s = sales_view(spark, sf)
    given = s.groupBy("product_id").agg((F.max("price") + 1).alias("price"))
    return pass_through_features(given, s)


@query("serving_features")
def q_serving_features(spark, sf):
    """W8/P8 (reference recipe)."""
    s = serving_features(sales_view(spark, sf), mode="reference")
    return s.select(*[_r6(c) if c in STD_COLS else F.col(c) for c in s.columns])


@query("serving_features_aligned")
def q_serving_aligned(spark, sf):
    """W8 aligned mode: the training recipe at the latest row."""
    s = serving_features(sales_view(spark, sf), mode="aligned")
    return s.select(*[_r6(c) if c in STD_COLS else F.col(c) for c in s.columns])


@query("serving_vector")
def q_serving_vector(spark, sf):
    """Manifest-ordered vector; units_sold and demand absent → 0.0."""
    s = serving_features(sales_view(spark, sf), mode="reference")
    cols = model_input(s, FEATURES_V1)
    return s.select("product_id", F.array(*[py_round(c, 6) for c in cols]).alias("feature_vector"))


def _requested(spark, sf, mode):
    out = requested_features(requests_view(spark, sf), sales_view(spark, sf), mode)
    return out.select(*[_r6(c) if c in STD_COLS else F.col(c) for c in out.columns])


@query("requested_features")
def q_requested_features(spark, sf):
    """W8/U1/P8 for requested rows as of their date (reference recipe), products without history included."""
    return _requested(spark, sf, "reference")


@query("requested_features_aligned")
def q_requested_features_aligned(spark, sf):
    """The training recipe for requested rows: only rows strictly before the request."""
    return _requested(spark, sf, "aligned")


@query("latest_row")
def q_latest_row(spark, sf):
    return latest_row(sales_view(spark, sf))


@query("recent_sales")
def q_recent_sales(spark, sf):
    return recent_sales(sales_view(spark, sf), 14)


@query("append_latest")
def q_append_latest(spark, sf):
    """History with the latest row appended again (bag union)."""
    s = sales_view(spark, sf)
    hist = s.select(*KEYS, "units_sold", F.lit(False).alias("appended"))
    last = latest_row(s).select(*KEYS, "units_sold", F.lit(True).alias("appended"))
    return hist.unionByName(last)


@query("forecast_clamp")
def q_forecast_clamp(spark, sf):
    """P9 on a deterministic trend predictor 2·lag_1 − rolling_mean_7."""
    tf = training_frame(sales_view(spark, sf))
    raw = (F.lit(2.0) * F.coalesce(F.col("lag_1"), F.lit(0.0))
           - F.coalesce(F.col("rolling_mean_7"), F.lit(0.0)))
    return tf.select(*KEYS, raw.alias("raw_prediction"),
                     F.greatest(F.lit(0.0), raw).alias("forecast"))


# ------------------------------------------------------------ split / eval
def _kept(spark, sf, *columns):
    """Keys, position and ``columns`` of the training frame, computed once: the look-ups of a boundary and the labelled rows read them."""
    from shelfcast.session import staged
    names = dict.fromkeys([*KEYS, "pos", *columns])
    return staged(training_frame(sales_view(spark, sf)).select(*names), "training-frame")


def _split_frame(spark, sf, *columns):
    return time_split(_kept(spark, sf, *columns), 0.2)


@query("time_split")
def q_time_split(spark, sf):
    return _split_frame(spark, sf).select(*KEYS, "split")


@query("cv_folds")
def q_cv_folds(spark, sf):
    """M2 folds: three contiguous blocks of the time-ordered training rows."""
    train = _split_frame(spark, sf).where(F.col("split") == "train").drop("split")
    return contiguous_folds(train, 3).select(*KEYS, "fold")


UNTIED = ("date", "product_id", "store_id", "units_sold")


@query("time_split_untied")
def q_time_split_untied(spark, sf):
    """O5 on a table without tie-breakers, with missing dates and products and many equal rows."""
    return time_split(untied_view(spark, sf), 0.2).select(*UNTIED, "split")


@query("cv_folds_untied")
def q_cv_folds_untied(spark, sf):
    """M2 folds on the same table: equal rows at a cut are divided by their number."""
    return contiguous_folds(untied_view(spark, sf), 3).select(*UNTIED, "fold")


@query("untied_features")
def q_untied_features(spark, sf):
    """W1, W2, W4 on the same table: string and floating-point tie-breakers, missing dates first."""
    out = feature_frame(untied_view(spark, sf), stds=False, calendar=False)
    return out.select(*UNTIED, "pos", "n_rows", "lag_1", "lag_30", "rolling_mean_7", TARGETS[0], TARGETS[6])


def _baseline():
    """Deterministic predictor for the metric operators: rolling_mean_7 (NULL → 0)."""
    return F.coalesce(F.col("rolling_mean_7"), F.lit(0.0))


def _baseline_frame(spark, sf):
    return _split_frame(spark, sf, *TARGETS, "rolling_mean_7")


def _baseline_preds(spark, sf):
    return ev.long_predictions(_baseline_frame(spark, sf), _baseline())


def _metrics(spark, sf, zero_pairs="skip"):
    return ev.metrics_by_horizon(_baseline_frame(spark, sf), _baseline(), zero_pairs)


@query("metrics_by_horizon")
def q_metrics(spark, sf):
    """A7-A9, A11."""
    m = _metrics(spark, sf)
    return m.select("target", "horizon", *[_r6(c) for c in m.columns if c not in ("target", "horizon")])


@query("eval_metrics")
def q_eval_metrics(spark, sf):
    """RMSE and MAE per horizon for train and validation."""
    m = _metrics(spark, sf)
    return m.select("target", *[_r6(c) for c in ("train_rmse", "train_mae", "val_rmse", "val_mae")])


@query("eval_smape")
def q_eval_smape(spark, sf):
    """A9 in the original 0/0 mode: any y = p = 0 pair makes the mean NaN."""
    m = _metrics(spark, sf, zero_pairs="nan")
    return m.select("target", _r6("train_smape"), _r6("val_smape"))


@query("fit_diagnosis")
def q_fit_diagnosis(spark, sf):
    d = ev.fit_diagnosis(_metrics(spark, sf))
    return d.select("target", "horizon", _r6("rmse_gap"), _r6("mae_gap"), "fit", "note",
                    _r6("val_excess_pct"))


@query("prediction_range")
def q_prediction_range(spark, sf):
    return ev.prediction_range(_baseline_preds(spark, sf))


@query("prediction_sample")
def q_prediction_sample(spark, sf):
    """The 5,000 validation rows with the smallest key hash, all horizons."""
    return ev.prediction_sample(_baseline_frame(spark, sf), _baseline(), list(KEYS), 5000)


@query("last_validation_row")
def q_last_validation_row(spark, sf):
    sp = _split_frame(spark, sf, "units_sold", "inventory_level", *TARGETS)
    v = sp.where(F.col("split") == "val").select(*KEYS, "units_sold", "inventory_level", *TARGETS)
    return ev.last_row(v, ["date", "product_id", "src_order", "src_line"])


# -------------------------------------------------------- forecast shapes
@query("forecast_array")
def q_forecast_array(spark, sf):
    """Map (missing keys → 0), list (first 7) and scalar (repeated)."""
    ff = _ff(spark, sf)
    m = F.map_filter(F.map_from_arrays(F.array(*[F.lit(f"t+{i}") for i in range(1, 8)]),
                                       F.array(*[F.col(t) for t in TARGETS])),
                     lambda k, v: v.isNotNull())
    lst = F.array(*[F.col(t) for t in TARGETS])
    sc = F.coalesce(F.col("rolling_mean_7"), F.lit(0.0))
    return ff.select(*KEYS, seven_days(m, "map").alias("days_from_map"),
                     seven_days(lst, "array").alias("days_from_list"),
                     seven_days(sc, "scalar").alias("days_from_scalar"))


@query("forecast_map")
def q_forecast_map(spark, sf):
    """The ``t+1``…``t+7`` map from seven values (realised next seven days)."""
    from shelfcast.functions.forecast import forecast_map
    tf = training_frame(sales_view(spark, sf))
    return tf.select(*KEYS, forecast_map(F.array(*[F.col(t) for t in TARGETS])).alias("forecast"))


@query("forecast_summary")
def q_forecast_summary(spark, sf):
    """7-day total, /7 average and /size average of a forecast map."""
    cf = constant_forecast(sales_view(spark, sf), as_map=True)
    tot = forecast_total(F.col("forecast"), "map")
    return cf.select("product_id", tot.alias("total_7day"), (tot / 7.0).alias("average_daily"),
                     (tot / F.size("forecast")).alias("average_per_key"))


# ------------------------------------------------ decisions: constant rate
def _constant_decisions(spark, sf, as_map=False):
    return plan_and_alerts(constant_forecast(sales_view(spark, sf), as_map=as_map))


@query("inventory_plan")
def q_inventory_plan(spark, sf):
    """I9 (latest row, constant daily rate, lead 3)."""
    d = _constant_decisions(spark, sf)
    return d.select("product_id", "lead_time_days", "lead_time_demand", "safety_stock",
                    "reorder_point", "reorder_status", "reorder_quantity", "days_to_stockout",
                    F.col("decision_risk").alias("risk_level"), "current_inventory",
                    "recommendation")


@query("alerts")
def q_alerts(spark, sf):
    """AL6/AL7 payload (latest row, constant daily rate)."""
    d = _constant_decisions(spark, sf)
    return d.select("product_id", "risk_level", "alert_message", "overstock_flag",
                    "days_to_stockout", "reorder_needed", "reorder_quantity",
                    "inventory_coverage_days",
                    F.col("forecast_summary.forecast_7day_total").alias("forecast_7day_total"),
                    F.col("forecast_summary.estimated_daily_demand").alias("estimated_daily_demand"),
                    "current_inventory")


@query("status_labels")
def q_status_labels(spark, sf):
    return ctxops.status_labels(_constant_decisions(spark, sf))


# ------------------------------------------ decisions: realised backtest
def _backtest(spark, sf):
    """Plan + alerts at every training row with the realised next 7 days."""
    rf = realised_forecast(training_frame(sales_view(spark, sf)), KEYS)
    return plan_and_alerts(rf, keep=KEYS)


@query("backtest_decisions")
def q_backtest(spark, sf):
    d = _backtest(spark, sf)
    return d.select(*KEYS, "lead_time_demand", "safety_stock", "reorder_point", "reorder_status",
                    "reorder_quantity", "days_to_stockout", "decision_risk", "risk_level",
                    "overstock_flag", "inventory_coverage_days", "current_inventory")


def _bt_col(name, *cols):
    def fn(spark, sf):
        return _backtest(spark, sf).select(*KEYS, *cols)
    fn.__name__ = f"q_{name}"
    QUERIES[name] = fn


_bt_col("lead_time_demand", "lead_time_demand")                       # I1
_bt_col("safety_stock", "safety_stock")                               # I2
_bt_col("reorder_point", "reorder_point")                             # I3
_bt_col("reorder_flag", "reorder_status")                             # I4
_bt_col("reorder_quantity", "reorder_quantity")                       # I5
_bt_col("days_to_stockout", "days_to_stockout")                       # I6 / W9
_bt_col("decision_risk", "decision_risk")                             # I7
_bt_col("recommendation_text", "recommendation")                      # I8
_bt_col("alert_risk", "risk_level")                                   # AL1
_bt_col("alert_message", "alert_message")                             # AL2
_bt_col("overstock", "overstock_flag")                                # AL3
_bt_col("coverage_days", "inventory_coverage_days")                   # AL5


@query("forecast_7day_estimate")
def q_forecast_7day_estimate(spark, sf):
    """AL4: alerts built without a forecast total (estimated from the plan)."""
    from shelfcast.operators.alerts import alerts
    from shelfcast.operators.inventory import inventory_plan
    tf = training_frame(sales_view(spark, sf))
    src = tf.select(*KEYS, F.array(*[F.col(t) for t in TARGETS]).alias("forecast"),
                    F.col("inventory_level").alias("current_inventory"))
    plan = inventory_plan(src, keep=KEYS)
    a = alerts(plan, forecast_7day=None, keep=KEYS)
    return a.select(*KEYS, F.col("forecast_summary.forecast_7day_total").alias("forecast_7day_total"),
                    "overstock_flag", "inventory_coverage_days")


# ------------------------------------------------------ context / answers
def _context(spark, sf, view=sales_view):
    """C2 with the constant-rate forecast as a map (the model stand-in)."""
    from shelfcast.functions.forecast import forecast_map
    from shelfcast.operators.features import product_state
    st = product_state(view(spark, sf), modes=("aligned",), columns=("rolling_mean_7",))
    rate = F.coalesce(F.col("_al_mean_7"), F.lit(0.0))
    fc = ctxops.with_state_forecast(st, forecast_map(F.array_repeat(rate, 7)))
    return ctxops.sku_context(ctxops.decide_for_context(fc))


@query("sku_snapshot")
def q_sku_snapshot(spark, sf):
    """Latest row joined with product info."""
    s = sales_view(spark, sf)
    info = product_info(s).withColumn("average_price", py_round("average_price", 6))
    lr = latest_row(s).select("product_id", "date", "units_sold", "inventory_level", "price")
    return lr.join(info.withColumnRenamed("sku", "product_id"), "product_id")


@query("sku_context")
def q_sku_context(spark, sf):
    """C2/C3 (constant-rate forecast as the model stand-in), flattened."""
    return _flat_context(_context(spark, sf))


def _flat_context(c):
    return c.select(
        "sku", "product_name", "category", "region", "current_inventory",
        _r6("current_price"),
        *[F.col("forecast")[f"t+{i}"].alias(f"forecast_t{i}") for i in range(1, 8)],
        "days_to_stockout", "risk_level", "reorder_needed", "recommended_reorder_quantity",
        "daily_sales_history",
        F.col("metadata.lead_time_days").alias("lead_time_days"),
        F.col("metadata.safety_stock").alias("safety_stock"),
        F.col("metadata.reorder_point").alias("reorder_point"),
        F.col("metadata.lead_time_demand").alias("lead_time_demand"),
        F.col("metadata.inventory_coverage_days").alias("inventory_coverage_days"),
        py_round("metadata.average_price", 6).alias("average_price"))


@query("context_json")
def q_context_json(spark, sf):
    """The context document as JSON text (prices at 1e-6)."""
    c = _context(spark, sf)
    c = c.withColumn("current_price", py_round("current_price", 6)).withColumn(
        "metadata", F.col("metadata").withField("average_price",
                                                py_round("metadata.average_price", 6)))
    return ctxops.context_json(c)


@query("sales_trend")
def q_sales_trend(spark, sf):
    return ctxops.sales_trend(_context(spark, sf))


def _explanations(spark, sf):
    return ctxops.explanations(_context(spark, sf))


@query("explain_forecast")
def q_explain_forecast(spark, sf):
    return _explanations(spark, sf).select("sku", "forecast_explanation", "total_7day", "average_daily")


@query("explain_inventory")
def q_explain_inventory(spark, sf):
    return _explanations(spark, sf).select("sku", "inventory_explanation")


@query("explain_risk")
def q_explain_risk(spark, sf):
    return _explanations(spark, sf).select("sku", "risk_explanation")


@query("explain_summary")
def q_explain_summary(spark, sf):
    return _explanations(spark, sf).select("sku", "summary_explanation")


@query("prompt_context")
def q_prompt_context(spark, sf):
    return ctxops.prompt_context(_context(spark, sf))


@query("detect_intent")
def q_detect_intent(spark, sf):
    m = messages_view(spark, sf)
    return m.select("message_id", "query", detect_intent(F.col("query")).alias("intent"))


@query("respond")
def q_respond(spark, sf):
    """Answers for every message (flattened presence of the parts)."""
    r = ctxops.respond(messages_view(spark, sf), _context(spark, sf))
    return r.select("message_id", "product_id", "intent", "response_text",
                    F.aggregate(F.map_values("forecast"), F.lit(0.0), lambda a, x: a + x).alias("forecast_total"),
                    F.col("inventory.reorder_point").alias("inventory_reorder_point"),
                    F.col("alerts.risk_level").alias("alerts_risk_level"))


# ------------------------------------------------- missing stock, prices, units
@query("gaps_plan")
def q_gaps_plan(spark, sf):
    """I9/AL7 where stock is missing: a forecast, but no plan and no alert."""
    p = plan_and_alerts(constant_forecast(gaps_view(spark, sf)))
    return p.select("product_id", "current_inventory", "lead_time_demand", "safety_stock", "reorder_point", "reorder_status", "reorder_quantity",
                    "days_to_stockout", "decision_risk", "recommendation", "risk_level", "alert_message", "overstock_flag",
                    "inventory_coverage_days", F.col("forecast_summary.forecast_7day_total").alias("forecast_7day_total"))


@query("gaps_context")
def q_gaps_context(spark, sf):
    """C2/C3 with missing values."""
    return _flat_context(_context(spark, sf, gaps_view))


@query("gaps_explanations")
def q_gaps_explanations(spark, sf):
    """C5 with missing values: all four texts and the error."""
    return ctxops.explanations(_context(spark, sf, gaps_view))


@query("gaps_prompt")
def q_gaps_prompt(spark, sf):
    """C6 with missing values."""
    return ctxops.prompt_context(_context(spark, sf, gaps_view))


@query("gaps_respond")
def q_gaps_respond(spark, sf):
    """C7 with missing values: the answers, which parts they carry, and the error."""
    r = ctxops.respond(messages_view(spark, sf), _context(spark, sf, gaps_view))
    return r.select("message_id", "product_id", "intent", "response_text", "error", F.col("forecast").isNotNull().alias("has_forecast"),
                    F.col("inventory.reorder_point").alias("inventory_reorder_point"), F.col("alerts.risk_level").alias("alerts_risk_level"))


# ------------------------------------------------------- model (rows only)
_TRAINED: dict = {}


def _trained(spark, sf, tune=False):
    """Seven GBT models on the full training frame, untuned (the original ``tune=False``
    settings) or by the full grid.  They are saved under the checkpoint folder, keyed
    by the state of the input tables, and shared by the model queries of one application."""
    from shelfcast.plans.models import evaluate_models, load_models, models_present, train_models
    from shelfcast.session import ensure_checkpoint_dir
    from shelfcast.sources.testdata import input_stamp
    stamp = input_stamp(spark, sf)
    key = (spark.sparkContext.applicationId, stamp, tune)
    if key not in _TRAINED:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/shelfcast-models{'-tuned' if tune else ''}/{stamp}"
        tf = training_frame(sales_view(spark, sf))
        if models_present(path):
            _TRAINED[key] = evaluate_models(tf, load_models(path))
        else:
            _TRAINED[key] = train_models(tf, path=path, tune=tune)
    return _TRAINED[key]


@query("forecast_next_7_days")
def q_forecast_next_7_days(spark, sf):
    """Seven-horizon forecast map for every product (model output)."""
    from shelfcast.plans.models import forecast_next_7_days
    res = _trained(spark, sf)
    return forecast_next_7_days(serving_features(sales_view(spark, sf), "reference"), res["models"])


@query("model_metrics")
def q_model_metrics(spark, sf):
    """M5/A11 on the trained models: RMSE/MAE/SMAPE per horizon and split."""
    return _trained(spark, sf)["metrics"]


@query("sku_context_model")
def q_sku_context_model(spark, sf):
    """C2 with the model forecast: plan, alerts and context per product (JSON)."""
    from shelfcast.operators.features import product_state, serving_columns
    from shelfcast.plans.models import forecast_next_7_days
    st = product_state(sales_view(spark, sf), modes=("reference",))
    serving = st.select("*", *serving_columns("reference"))
    fc = forecast_next_7_days(serving, _trained(spark, sf)["models"], keep=st.columns)
    src = fc.withColumn("current_inventory", F.col("latest.inventory_level"))
    return ctxops.context_json(ctxops.sku_context(ctxops.decide_for_context(src)))


@query("sample_forecast")
def q_sample_forecast(spark, sf):
    """M8: forecast from the last validation row (training-style features)."""
    from shelfcast.plans.models import sample_forecast
    res = _trained(spark, sf)
    return sample_forecast(res["split"], res["models"])


# ------------------------------------- the model path with an estimator that SQL can restate
LINEAR_FEATURES = ("rolling_mean_7",)


def _least_squares(label):
    from pyspark.ml.regression import LinearRegression
    return LinearRegression(featuresCol="features", labelCol=label, solver="normal")


def _linear(spark, sf):
    """Seven least-squares models in the regressor slot: trained, stored and loaded like any others."""
    from shelfcast.plans.models import load_models, train_models
    from shelfcast.session import scratch
    path = scratch(spark, "linear-models")
    res = train_models(training_frame(sales_view(spark, sf)), path=path, tune=False, features=LINEAR_FEATURES, estimator=_least_squares)
    return {**res, "models": load_models(path)}


def _seven(fc, *keep):
    return fc.select(*keep, *[py_round(F.col("forecast")[f"t+{i}"], 6).alias(f"t{i}") for i in range(1, 8)])


@query("linear_metrics")
def q_linear_metrics(spark, sf):
    """RMSE, MAE and SMAPE of the seven models per split."""
    m = _linear(spark, sf)["metrics"]
    return m.select("target", "horizon", *[_r6(c) for c in m.columns if c not in ("target", "horizon")])


@query("linear_folds")
def q_linear_folds(spark, sf):
    """M2: the mean RMSE over three contiguous folds per horizon."""
    from shelfcast.plans.models import assembler, fold_rmse, model_frame
    from shelfcast.session import staged
    frame = staged(model_frame(training_frame(sales_view(spark, sf)), LINEAR_FEATURES, extra=("date", "product_id", "pos")), "linear-frame")
    train = time_split(frame, 0.2).where(F.col("split") == "train").drop("split")
    rows = staged(assembler(LINEAR_FEATURES).transform(contiguous_folds(train, 3)).select("features", "fold", *TARGETS), "linear-folds")
    with ThreadPoolExecutor(max_workers=4) as pool:     # driver threads only schedule
        found = list(pool.map(lambda i: (i, fold_rmse(rows, i, LINEAR_FEATURES, _least_squares)), range(1, 8)))
    return spark.createDataFrame(found, "horizon int, rmse double").select("horizon", _r6("rmse"))


@query("linear_forecast")
def q_linear_forecast(spark, sf):
    """Every product's forecast by a stored set without the seventh horizon, which scores 0.0."""
    from shelfcast.plans.models import forecast_next_7_days, load_models, save_models
    from shelfcast.session import scratch
    models, path = _linear(spark, sf)["models"], scratch(spark, "linear-models")
    save_models({i: models[i] for i in range(1, 7)}, path)
    return _seven(forecast_next_7_days(serving_features(sales_view(spark, sf), "reference"), load_models(path)), "product_id")


@query("linear_sample_forecast")
def q_linear_sample_forecast(spark, sf):
    """M8: forecast from the last validation row."""
    from shelfcast.plans.models import sample_forecast
    res = _linear(spark, sf)
    return _seven(sample_forecast(res["split"], res["models"]), "product_id")


def q_tuned_models(spark, sf):
    """M2/M4: the full 16-point, 3-fold grid for all seven horizons; RMSE/MAE/SMAPE per horizon and split."""
    return _trained(spark, sf, tune=True)["metrics"]


#: Queries that train for long; called by name, not registered (README gives the times).
LONG_QUERIES = {"tuned_models": q_tuned_models}
