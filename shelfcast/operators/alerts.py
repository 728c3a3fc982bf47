"""Alerts (AL1-AL7): risk class, message, overstock, coverage, payload.

Consumes the *rounded* plan record (``inventory_plan``) and an optional
unrounded 7-day forecast total; one ``select`` for all products.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.pynum import py_fmt, py_round
from shelfcast.functions.text import fill


def alert_risk(days: Column) -> Column:
    """AL1: −1 → LOW; ≤ 2 → HIGH (stocked out included); ≤ 5 → MEDIUM; else LOW."""
    return (F.when(days == -1, F.lit("LOW"))
            .when(days <= 2, F.lit("HIGH"))
            .when(days <= 5, F.lit("MEDIUM"))
            .otherwise(F.lit("LOW")))


# Alert sentences.
_URGENT_DAYS = "URGENT: Critical inventory level. Stockout expected in {d} day(s). "
_URGENT_NOW = "URGENT: Critical inventory level. Immediate action required. "
_URGENT_QTY = "Recommended reorder: {q} units."
_WARNING = "WARNING: High risk detected. Stockout expected in {d} day(s). Monitor closely."
_ALERT_DAYS = "ALERT: Reorder recommended. Stockout expected in {d} day(s). "
_ALERT_NOW = "ALERT: Reorder recommended. "
_ALERT_QTY = "Recommended quantity: {q} units."
_NOTICE_DAYS = "NOTICE: Medium risk. Stockout expected in {d} day(s). Continue monitoring."
_NOTICE = "NOTICE: Medium risk level. Continue monitoring inventory."
_INFO_REORDER = "INFO: Consider reordering. Recommended quantity: {q} units."
_INFO_HEALTHY = "INFO: Inventory levels are healthy. No immediate action required."
_INFO_DAYS = "INFO: Low risk. Stockout expected in {d} day(s)."
_INFO_ADEQUATE = "INFO: Inventory levels are adequate."


def alert_message(risk: Column, days: Column, reorder: Column, qty_text: Column) -> Column:
    """AL2: message by (risk, reorder, days).

    ``qty_text`` is the quantity printed with no decimals (``py_fmt(q, 0)``).
    """
    d, q = days.cast("string"), qty_text
    r = F.upper(risk)
    high = F.when(reorder, F.concat(
        F.when(days > 0, fill(_URGENT_DAYS, d=d, q=q)).otherwise(F.lit(_URGENT_NOW)),
        fill(_URGENT_QTY, d=d, q=q))).otherwise(fill(_WARNING, d=d, q=q))
    medium = F.when(reorder, F.concat(
        F.when(days > 0, fill(_ALERT_DAYS, d=d, q=q)).otherwise(F.lit(_ALERT_NOW)),
        fill(_ALERT_QTY, d=d, q=q))).otherwise(
        F.when(days > 0, fill(_NOTICE_DAYS, d=d, q=q)).otherwise(F.lit(_NOTICE)))
    low = (F.when(reorder, fill(_INFO_REORDER, d=d, q=q))
           .when(days == -1, F.lit(_INFO_HEALTHY))
           .when(days > 0, fill(_INFO_DAYS, d=d, q=q))
           .otherwise(F.lit(_INFO_ADEQUATE)))
    return F.when(r == "HIGH", high).when(r == "MEDIUM", medium).otherwise(low)


def overstock(inv: Column, f7: Column) -> Column:
    """AL3: stock strictly above twice the 7-day forecast; no forecast → false."""
    return F.when(f7 <= 0, F.lit(False)).otherwise(inv > F.lit(2.0) * f7)


def forecast_7day_estimate(f7: Column, inv: Column, days: Column, ltd: Column) -> Column:
    """AL4: the given total, else a stock/days rate, else LTD/3 per day, else 0."""
    est = (F.when((days > 0) & (days <= 7), (inv / days.cast("double")) * F.lit(7.0))
           .when(ltd > 0, (ltd / F.lit(3.0)) * F.lit(7.0))
           .otherwise(F.lit(0.0)))
    return F.coalesce(f7, est)


def coverage_days(inv: Column, f7: Column) -> Column:
    """AL5 (unrounded): stock / daily demand, −1 when not computable."""
    daily = f7 / F.lit(7.0)
    return F.when((f7 > 0) & (daily > 0), inv / daily).otherwise(F.lit(-1.0))


ALERT_COLUMNS = ("risk_level", "alert_message", "overstock_flag", "days_to_stockout",
                 "reorder_needed", "reorder_quantity", "inventory_coverage_days",
                 "forecast_summary", "current_inventory")


def alerts(plan: DataFrame, forecast_7day: str | None = "forecast_7day",
           keep: tuple[str, ...] | list[str] = ("product_id",)) -> DataFrame:
    """AL7: the alert payload for every plan row.

    Absent columns take the defaults of the original payload builder:
    inventory 0, days −1, reorder false, quantity 0, lead-time demand 0.  A
    row whose stock is missing has no alert: all its payload fields are NULL.
    """
    cols = set(plan.columns)

    def get(name, default):
        return F.coalesce(F.col(name), F.lit(default)) if name in cols else F.lit(default)

    inv = (F.col("current_inventory") if "current_inventory" in cols else F.lit(0.0)).cast("double")
    days = get("days_to_stockout", -1).cast("int")
    reorder = get("reorder_status", False).cast("boolean")
    qty = get("reorder_quantity", 0.0).cast("double")
    ltd = get("lead_time_demand", 0.0).cast("double")
    given = (F.col(forecast_7day).cast("double") if forecast_7day and forecast_7day in cols
             else F.lit(None).cast("double"))
    base = plan.select(*[F.col(c) for c in keep], inv.alias("_inv"), days.alias("_days"),
                       reorder.alias("_reorder"), qty.alias("_qty"),
                       forecast_7day_estimate(given, inv, days, ltd).alias("_f7"))
    inv, days, reorder, qty, f7 = (F.col(c) for c in ("_inv", "_days", "_reorder", "_qty", "_f7"))
    base = base.select("*", alert_risk(days).alias("_risk"), py_fmt("_qty", 0).alias("_qty_s"),
                       coverage_days(inv, f7).alias("_cov"))
    risk, cov = F.col("_risk"), F.col("_cov")
    payload = {
        "risk_level": risk,
        "alert_message": alert_message(risk, days, reorder, F.col("_qty_s")),
        "overstock_flag": overstock(inv, f7),
        "days_to_stockout": days,
        "reorder_needed": reorder,
        "reorder_quantity": py_round("_qty", 2),
        "inventory_coverage_days": F.when(cov > 0, py_round("_cov", 2)).otherwise(F.lit(-1.0)),
        "forecast_summary": F.struct(
            py_round("_f7", 2).alias("forecast_7day_total"),
            F.when(f7 > 0, py_round("_f7 / 7.0D", 2)).otherwise(F.lit(0.0)).alias("estimated_daily_demand")),
        "current_inventory": py_round("_inv", 2),
    }
    known = inv.isNotNull()
    return base.select(*[F.col(c) for c in keep], *[F.when(known, v).alias(n) for n, v in payload.items()])
