"""Per-SKU context record, explanations, prompt text and message routing.

C1-C7, T2, T5, X6, X7.  Inputs are DataFrames keyed by ``product_id``; all
joins are equi-joins on that key (AQE broadcasts small sides by measured
size, otherwise sort-merge).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions.forecast import array_sum
from shelfcast.functions.pynum import py_round, with_formats
from shelfcast.functions.text import detect_intent
from shelfcast.schema import CONTEXT, FORECAST_KEYS


def forecast_values(m: Column) -> Column:
    """The seven map values t+1…t+7 in order (missing → 0.0)."""
    return F.array(*[F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0.0)) for k in FORECAST_KEYS])


def with_state_forecast(state: DataFrame, forecast: Column) -> DataFrame:
    """Attach a forecast and the latest stock to ``product_state`` rows."""
    return state.select("*", forecast.alias("forecast"),
                        F.col("latest.inventory_level").alias("current_inventory"))


STATE_KEEP = ("product_id", "_fc", "latest", "first", "average_price", "recent", "n_rows")


def decide_for_context(state_fc: DataFrame, lead_time: int = 3) -> DataFrame:
    """Plan + alerts over state rows, keeping the state for the context."""
    from shelfcast.plans.decisions import plan_and_alerts
    return plan_and_alerts(state_fc.withColumn("_fc", F.col("forecast")), lead_time, keep=STATE_KEEP)


def sku_context(dec: DataFrame, price_given: bool = True) -> DataFrame:
    """One nested context row per product from ``decide_for_context``.

    The current price is the latest row's, also where that is missing; only data
    without a price column (``price_given=False``) falls back to the average.

    One linear plan: no join back to product info, latest row or history —
    they travel in the ``product_state`` columns.
    """
    cat = F.col("first.category")
    price = F.col("latest.price") if price_given else F.coalesce("average_price", F.lit(0.0))
    return dec.select(
        F.col("product_id").alias("sku"),
        F.concat_ws(" - ", F.coalesce(cat, F.lit("Unknown")), F.col("product_id")).alias("product_name"),
        F.coalesce(cat, F.lit("Unknown")).alias("category"),
        F.coalesce(F.col("first.region"), F.lit("Unknown")).alias("region"),
        F.col("latest.inventory_level").alias("current_inventory"),
        price.alias("current_price"),
        F.map_from_arrays(F.array(*[F.lit(k) for k in FORECAST_KEYS]),
                          forecast_values(F.col("_fc"))).alias("forecast"),
        F.col("days_to_stockout"),
        F.col("risk_level"),
        F.col("reorder_status").alias("reorder_needed"),
        F.col("reorder_quantity").alias("recommended_reorder_quantity"),
        F.coalesce(F.col("recent"), F.array().cast("array<double>")).alias("daily_sales_history"),
        F.struct(F.col("lead_time_days"), F.col("safety_stock"), F.col("reorder_point"),
                 F.col("lead_time_demand"), F.col("inventory_coverage_days"),
                 F.coalesce(F.col("average_price"), price).alias("average_price")).alias("metadata"),
        F.col("reorder_point").alias("_rop"),
        F.col("overstock_flag").alias("_overstock"),
        F.col("alert_message").alias("_alert_message"),
        F.col("current_inventory").alias("_inv_rounded"),
    )


def read_context(spark: SparkSession, path: str) -> DataFrame:
    """Context documents (one JSON object per file or line) with the declared schema."""
    return spark.read.schema(CONTEXT).option("multiLine", True).json(path)


def parse_context(docs: DataFrame, column: str = "context_json") -> DataFrame:
    """The context documents of a text column as typed columns."""
    return docs.select(F.from_json(column, CONTEXT).alias("_c")).select("_c.*")


def context_json(ctx: DataFrame) -> DataFrame:
    """The context document as JSON text (``df.write.text`` ready)."""
    fields = [c for c in ctx.columns if not c.startswith("_")]
    return ctx.select(F.col("sku"), F.to_json(F.struct(*fields)).alias("context_json"))


def sales_trend(ctx: DataFrame) -> DataFrame:
    """Last seven values, average and trend of the sales history."""
    a = F.col("daily_sales_history")
    n = F.size(a)
    return ctx.select(
        "sku", n.alias("history_days"),
        F.slice(a, F.greatest(n - 6, F.lit(1)), 7).alias("last_7_days"),
        F.try_divide(array_sum(a), n.cast("double")).alias("average"),
        F.when(n == 0, F.lit(None))
         .when(F.try_element_at(a, F.lit(-1)) > F.try_element_at(a, F.lit(1)), F.lit("Increasing"))
         .when(F.try_element_at(a, F.lit(-1)) < F.try_element_at(a, F.lit(1)), F.lit("Decreasing"))
         .otherwise(F.lit("Stable")).alias("trend"))


# Explanation sentences of the rule-based answers.
_NO_FORECAST = "Cannot generate forecast without latest data."
_NO_INVENTORY = "Cannot generate inventory recommendation without forecast and inventory data."
_NO_SUMMARY = "Unable to generate summary without forecast."
_ERROR_INVENTORY = "Missing forecast or current_inventory in data_inputs"


def explanations(ctx: DataFrame, keep: tuple = ()) -> DataFrame:
    """Forecast, inventory, risk and summary sentences for every product.

    ``keep`` passes further columns (expressions over ``ctx``) through.
    """
    vals = forecast_values(F.col("forecast"))
    total = array_sum(vals)
    base = ctx.select("*", total.alias("_total"), vals.alias("_vals"))
    t = F.col("_total")
    base = base.select("*", (t / 7.0).alias("_avg"), py_round("_total", 2).alias("_total2"),
                       py_round("_total / 7.0D", 2).alias("_avg2"))
    # every number is formatted once, from a column name
    base = with_formats(base, {
        "_t1": ("_total", 1), "_a1": ("_avg", 1), "_t0": ("_total2", 0), "_a21": ("_avg2", 1),
        "_i0": ("_inv_rounded", 0), "_r0": ("_rop", 0), "_q0": ("recommended_reorder_quantity", 0),
        **{f"_v{i}": (f"_vals[{i}]", 1) for i in range(len(FORECAST_KEYS))}})
    day_by_day = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.col(f"_v{i}"))
                                     for i, k in enumerate(FORECAST_KEYS)])
    forecast_text = F.concat(
        F.lit("7-day demand forecast generated. Total expected demand: "), F.col("_t1"),
        F.lit(" units ("), F.col("_a1"), F.lit(" units/day average). Day-by-day: "),
        day_by_day, F.lit("."))
    i0, r0, q0 = F.col("_i0"), F.col("_r0"), F.col("_q0")
    days = F.col("days_to_stockout")
    reorder = F.col("reorder_needed")
    inventory_text = F.concat(
        F.lit("Inventory status: "), i0, F.lit(" units on hand. Reorder point: "),
        r0, F.lit(" units. "),
        F.when(reorder, F.concat(F.lit("REORDER NEEDED. Recommended quantity: "), q0,
                                 F.lit(" units. ")))
         .otherwise(F.lit("No reorder needed at this time. ")),
        F.when(days > 0, F.concat(F.lit("Estimated stockout in "), days.cast("string"), F.lit(" days.")))
         .otherwise(F.lit("Stockout beyond forecast horizon.")))
    risk_text = F.concat(
        F.lit("Risk Level: "), F.col("risk_level"), F.lit(". "), F.col("_alert_message"), F.lit(" "),
        F.when(F.col("_overstock"), F.lit("OVERSTOCK DETECTED: Inventory exceeds 2x forecasted demand."))
         .otherwise(F.lit("")))
    summary_text = F.concat(
        F.lit("OPERATIONAL SUMMARY\nForecast: "), F.col("_t0"),
        F.lit(" units expected over next 7 days ("), F.col("_a21"), F.lit(" units/day).\n"),
        F.lit("Inventory: "), i0, F.lit(" units on hand. Reorder point: "), r0,
        F.lit(" units. "),
        F.when(reorder, F.concat(F.lit("REORDER NEEDED: "), q0, F.lit(" units.\n")))
         .otherwise(F.lit("No reorder needed.\n")),
        F.lit("Risk: "), F.col("risk_level"), F.lit(". Stockout in "), days.cast("string"), F.lit(" days. "),
        F.when(F.col("_overstock"), F.lit("OVERSTOCK detected.")).otherwise(F.lit("")))
    # without stock there is a forecast, but no inventory, risk or summary answer
    missing_inv = F.col("current_inventory").isNull()
    return base.select(
        "sku", *keep,
        forecast_text.alias("forecast_explanation"),
        F.col("_total2").alias("total_7day"), F.col("_avg2").alias("average_daily"),
        F.when(missing_inv, F.lit(_NO_INVENTORY)).otherwise(inventory_text).alias("inventory_explanation"),
        F.when(missing_inv, F.lit(_NO_INVENTORY)).otherwise(risk_text).alias("risk_explanation"),
        F.when(missing_inv, F.lit(_NO_INVENTORY)).otherwise(summary_text).alias("summary_explanation"),
        F.when(missing_inv, F.lit(_ERROR_INVENTORY)).alias("error"),
    )


def respond(messages: DataFrame, ctx: DataFrame) -> DataFrame:
    """Route each (message, product) to the answer of its intent.

    forecast → forecast only; reorder → inventory only; risk → inventory and
    alerts; summary → all three.  Unknown products get the missing-data text.
    """
    parts = (
        F.col("forecast"),
        F.struct("days_to_stockout", "reorder_needed", "recommended_reorder_quantity",
                 F.col("_rop").alias("reorder_point"), F.col("_inv_rounded").alias("current_inventory"))
         .alias("inventory"),
        F.struct("risk_level", F.col("_alert_message").alias("alert_message"),
                 F.col("_overstock").alias("overstock_flag")).alias("alerts"))
    asked = messages.select(F.col("product_id").alias("sku"))
    ex = explanations(ctx.join(asked, "sku", "left_semi"), keep=parts)     # texts only for products that are asked for
    m = (messages.select("message_id", "product_id", "query", detect_intent(F.col("query")).alias("intent"))
         .join(ex.withColumnRenamed("sku", "product_id"), "product_id", "left"))
    i = F.col("intent")
    known, stocked = F.col("forecast").isNotNull(), F.col("error").isNull()
    text = (F.when(i == "forecast", F.coalesce(F.col("forecast_explanation"), F.lit(_NO_FORECAST)))
            .when(i == "reorder", F.coalesce(F.col("inventory_explanation"), F.lit(_NO_INVENTORY)))
            .when(i == "risk", F.coalesce(F.col("risk_explanation"), F.lit(_NO_INVENTORY)))
            .otherwise(F.coalesce(F.col("summary_explanation"), F.lit(_NO_SUMMARY))))
    return m.select(
        "message_id", "product_id", "query", "intent", text.alias("response_text"),
        F.when(known & i.isin("forecast", "summary"), F.col("forecast")).alias("forecast"),
        F.when(known & stocked & i.isin("reorder", "risk", "summary"), F.col("inventory")).alias("inventory"),
        F.when(known & stocked & i.isin("risk", "summary"), F.col("alerts")).alias("alerts"),
        F.when(~known, F.lit("Missing data for the product"))
         .when(i != "forecast", F.col("error")).alias("error"))


def prompt_context(ctx: DataFrame) -> DataFrame:
    """The prompt text per product; empty sections are left out."""
    vals = forecast_values(F.col("forecast"))
    base = ctx.select("*", vals.alias("_pv"))
    base = base.select("*", array_sum(F.col("_pv")).alias("_ptot"),
                       F.size("daily_sales_history").alias("_n"),
                       array_sum(F.col("daily_sales_history")).alias("_hsum"))
    base = with_formats(base, {
        **{f"_p{i}": (f"_pv[{i}]", 2) for i in range(len(FORECAST_KEYS))},
        "_pt": ("_ptot", 2), "_pa": ("_ptot / 7.0D", 2), "_havg": ("_hsum / CAST(_n AS DOUBLE)", 2),
        "_price": ("current_price", 2), "_inv": ("current_inventory", 2), "_qty": ("recommended_reorder_quantity", 2),
        "_ss": ("metadata.safety_stock", 2), "_rop2": ("metadata.reorder_point", 2), "_ltd": ("metadata.lead_time_demand", 2),
        "_cov": ("metadata.inventory_coverage_days", 1)})
    # The labels of the prompt.  The template is one SQL expression (parsed once) over the staged
    # columns above; NULL lines are skipped by concat_ws.
    fc_lines = ", ".join(f"concat('  {k}: ', _p{i}, ' units')" for i, k in enumerate(FORECAST_KEYS))
    item = ("CASE WHEN x IS NULL OR isnan(x) THEN 'nan' "
            "WHEN abs(x) < 1e16 AND x = floor(x) THEN format_string('%.1f', x) "
            "ELSE CAST(x AS STRING) END")
    hist_repr = f"concat('[', array_join(transform(daily_sales_history, x -> {item}), ', '), ']')"
    last7 = "slice(daily_sales_history, greatest(_n - 6, 1), 7)"
    last7_repr = f"concat('[', array_join(transform({last7}, x -> {item}), ', '), ']')"
    first, last = "try_element_at(daily_sales_history, 1)", "try_element_at(daily_sales_history, -1)"
    trend = (f"CASE WHEN {last} > {first} THEN 'Increasing' WHEN {last} < {first} THEN 'Decreasing' "
             "ELSE 'Stable' END")
    prompt = f"""concat_ws('\\n',
      concat('Product Name: ', product_name),
      concat('SKU: ', sku),
      concat('Category: ', category),
      concat('Region: ', region),
      CASE WHEN current_price IS NOT NULL AND current_price != 0 THEN concat('Current Price: $', _price) END,
      '\\nINVENTORY STATUS:',
      concat('Current Inventory: ', coalesce(_inv, 'unknown'), CASE WHEN _inv IS NULL THEN '' ELSE ' units' END),
      concat('Days to Stockout: ', CAST(days_to_stockout AS STRING)),
      concat('Risk Level: ', risk_level),
      CASE WHEN reorder_needed IS NOT NULL THEN concat('Reorder Needed: ', CASE WHEN reorder_needed THEN 'Yes' ELSE 'No' END) END,
      CASE WHEN reorder_needed THEN concat('Recommended Reorder Quantity: ', _qty, ' units') END,
      concat('\\n7-DAY DEMAND FORECAST:\\n', concat_ws('\\n', {fc_lines}),
             '\\n  Total (7-day): ', _pt, ' units', '\\n  Average daily: ', _pa, ' units/day'),
      CASE WHEN _n > 0 THEN concat('\\nRECENT SALES HISTORY (last ', CAST(_n AS STRING), ' days):\\n',
        CASE WHEN _n <= 14 THEN concat('  ', {hist_repr})
             ELSE concat('  Last 7 days: ', {last7_repr}, '\\n  Average: ', _havg,
                         ' units/day\\n  Trend: ', {trend}) END) END,
      concat('\\nADDITIONAL METRICS:\\n', concat_ws('\\n', concat('  Lead Time: ', CAST(metadata.lead_time_days AS STRING), ' days'),
             concat('  Safety Stock: ', _ss, ' units'), concat('  Reorder Point: ', _rop2, ' units'),
             concat('  Lead Time Demand: ', _ltd, ' units'), concat('  Inventory Coverage: ', _cov, ' days'))))"""
    return base.select("sku", F.expr(prompt).alias("prompt"))


def status_labels(decisions: DataFrame) -> DataFrame:
    """T5: Yes/No and horizon labels of the printed summaries."""
    d = F.col("days_to_stockout")
    return decisions.select(
        "product_id",
        F.when(F.col("reorder_status"), "Yes").otherwise("No").alias("reorder_needed_label"),
        F.when(F.col("reorder_status"), "YES - Reorder Needed").otherwise("NO - Sufficient Stock")
         .alias("reorder_status_label"),
        F.when(d > 0, d.cast("string")).otherwise(F.lit("Beyond forecast horizon")).alias("stockout_label"),
        F.upper(F.col("decision_risk")).alias("risk_label"))
