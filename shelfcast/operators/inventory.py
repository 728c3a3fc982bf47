"""Inventory decision (I1-I9): one ``select`` over all products.

Input columns: ``forecast`` (map ``t+i`` → double, ``array<double>`` or a
scalar daily rate), ``current_inventory`` DOUBLE, ``lead_time_days`` INT.
Decisions use unrounded doubles in the original operation order; only the
output record is rounded (Python rounding, see ``functions.pynum``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.forecast import array_sum, forecast_kind, map_value, seven_days
from shelfcast.functions.pynum import py_fmt, py_round
from shelfcast.functions.text import fill
from shelfcast.schema import DEFAULT_LEAD_TIME, FORECAST_KEYS, HORIZONS


def lead_time_demand(f: Column, kind: str, lead: Column) -> Column:
    """Demand over the lead time, floored at 0.

    map: keys t+1..t+min(lead, 7), missing keys count 0; array: the first
    ``lead`` values (Python slice, so a negative lead drops from the end);
    scalar: value × lead.
    """
    if kind == "map":
        total = F.aggregate(
            F.slice(F.array(*[map_value(f, k) for k in FORECAST_KEYS]), 1,
                    F.greatest(F.least(lead, F.lit(HORIZONS)), F.lit(0))),
            F.lit(0.0), lambda acc, x: acc + x)
    elif kind == "array":
        vals = F.transform(f, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
        n = F.when(lead >= 0, lead).otherwise(F.greatest(F.size(vals) + lead, F.lit(0)))
        total = array_sum(F.slice(vals, 1, n))
    else:
        total = F.coalesce(f.cast("double"), F.lit(0.0)) * lead.cast("double")
    return F.greatest(F.lit(0.0), total)


def safety_stock(ltd: Column) -> Column:
    """I2."""
    return F.greatest(F.lit(0.0), F.lit(0.2) * ltd)


def reorder_point(ltd: Column, ss: Column) -> Column:
    """I3."""
    return F.greatest(F.lit(0.0), ltd + ss)


def reorder_quantity(inv: Column, rop: Column) -> Column:
    """(rop − inv) + 50 % of rop when at/below the reorder point."""
    return F.when(inv <= rop, F.greatest(F.lit(0.0), (rop - inv) + rop * F.lit(0.5))) \
            .otherwise(F.lit(0.0))


def days_to_stockout(days: Column, inv: Column) -> Column:
    """First day whose cumulative demand reaches the stock.

    0 when the stock is already ≤ 0, −1 when it lasts beyond the forecast.
    A single left fold keeps the running sum in the original order.
    """
    init = F.struct(F.lit(0.0).alias("cum"), F.lit(0).alias("day"), F.lit(-1).alias("hit"))

    def step(acc, x):
        cum = acc["cum"] + x
        day = acc["day"] + 1
        hit = F.when((acc["hit"] == -1) & (cum >= inv), day).otherwise(acc["hit"])
        return F.struct(cum.alias("cum"), day.alias("day"), hit.alias("hit"))

    return F.when(inv <= 0, F.lit(0)).otherwise(
        F.aggregate(days, init, step, lambda acc: acc["hit"]))


def decision_risk(inv: Column, rop: Column, days: Column, lead: Column) -> Column:
    """Lower-case risk of the decision; none without stock."""
    return (F.when(inv <= rop,
                   F.when((days > 0) & (days <= lead), F.lit("high")).otherwise(F.lit("medium")))
            .when(inv <= rop * F.lit(1.2), F.lit("medium"))
            .when(inv.isNotNull(), F.lit("low")))


# Recommendation sentences (placeholders filled below).
_URGENT = "URGENT: Reorder immediately! Current inventory ({inv}) is below reorder point ({rop}). "
_REORDER = "Reorder recommended. Current inventory ({inv}) is at or below reorder point ({rop}). "
_CONSIDER = ("Consider reordering. Current inventory ({inv}) is at reorder point ({rop}). "
             "Recommended reorder quantity: {qty} units.")
_HEALTHY = ("Inventory level is healthy. Current inventory ({inv}) is above reorder point ({rop}). "
            "No action needed.")
_MONITOR = ("Monitor inventory closely. Current inventory ({inv}) is above reorder point ({rop}) "
            "but should be watched. ")
_STATUS = "Inventory status: Current inventory ({inv}) is above reorder point ({rop})."
_EXPECTED = "Stockout expected in {days} days. "
_ESTIMATED = "Estimated stockout in {days} days."
_QTY = "Recommended reorder quantity: {qty} units."


def recommendation_text(reorder: Column, qty: Column, risk: Column, days: Column,
                        inv: Column, rop: Column) -> Column:
    """I8: message by (reorder, risk, days).

    ``inv``, ``rop`` and ``qty`` are the *formatted* numbers (unrounded values
    printed with one decimal, ``py_fmt(x, 1)``); pass them as columns of a
    previous projection so each number is formatted once per row.
    """
    p = dict(inv=inv, rop=rop, qty=qty, days=days.cast("string"))
    stockout = F.when(days > 0, fill(_EXPECTED, **p)).otherwise(F.lit(""))
    estimated = F.when(days > 0, fill(_ESTIMATED, **p)).otherwise(F.lit(""))
    return (F.when(reorder & (risk == "high"),
                   F.concat(fill(_URGENT, **p), stockout, fill(_QTY, **p)))
            .when(reorder & (risk == "medium"),
                  F.concat(fill(_REORDER, **p), stockout, fill(_QTY, **p)))
            .when(reorder, fill(_CONSIDER, **p))
            .when(risk == "low", fill(_HEALTHY, **p))
            .when(risk == "medium", F.concat(fill(_MONITOR, **p), estimated))
            .otherwise(fill(_STATUS, **p)))


PLAN_COLUMNS = ("lead_time_demand", "safety_stock", "reorder_point", "reorder_status",
                "reorder_quantity", "days_to_stockout", "risk_level",
                "current_inventory", "recommendation")


def inventory_plan(df: DataFrame, forecast: str = "forecast",
                   inventory: str = "current_inventory", lead_time: str | None = "lead_time_days",
                   keep: tuple[str, ...] | list[str] = ("product_id",),
                   default_lead_time: int = DEFAULT_LEAD_TIME) -> DataFrame:
    """The recommendation record for every row of ``df``.

    Output: ``keep`` columns + ``lead_time_days`` + the nine plan fields.
    """
    kind = forecast_kind(df, forecast)
    f = F.col(forecast)
    inv = F.col(inventory).cast("double")
    lead = (F.col(lead_time).cast("int") if lead_time and lead_time in df.columns
            else F.lit(default_lead_time))
    base = df.select(*[F.col(c) for c in keep], f.alias("_f"), inv.alias("_inv"),
                     lead.alias("lead_time_days"))
    f, inv, lead = F.col("_f"), F.col("_inv"), F.col("lead_time_days")
    ltd = lead_time_demand(f, kind, lead)
    s1 = base.select("*", ltd.alias("_ltd"),
                     days_to_stockout(seven_days(f, kind), inv).alias("days_to_stockout"))
    s2 = s1.select("*", safety_stock(F.col("_ltd")).alias("_ss"))
    s3 = s2.select("*", reorder_point(F.col("_ltd"), F.col("_ss")).alias("_rop"))
    rop, days = F.col("_rop"), F.col("days_to_stockout")
    s4 = s3.select("*", (inv <= rop).alias("reorder_status"),
                   reorder_quantity(inv, rop).alias("_qty"),
                   decision_risk(inv, rop, days, lead).alias("risk_level"))
    s5 = s4.select("*", py_fmt("_inv", 1).alias("_inv_s"), py_fmt("_rop", 1).alias("_rop_s"),
                   py_fmt("_qty", 1).alias("_qty_s"))
    reorder, qty, risk = F.col("reorder_status"), F.col("_qty"), F.col("risk_level")
    return s5.select(
        *[F.col(c) for c in keep], lead,
        py_round("_ltd", 2).alias("lead_time_demand"),
        py_round("_ss", 2).alias("safety_stock"),
        py_round("_rop", 2).alias("reorder_point"),
        reorder,
        F.when(reorder, py_round("_qty", 2)).otherwise(F.lit(0.0)).alias("reorder_quantity"),
        days,
        risk,
        py_round("_inv", 2).alias("current_inventory"),
        recommendation_text(reorder, F.col("_qty_s"), risk, days, F.col("_inv_s"),
                            F.col("_rop_s")).alias("recommendation"),
    )
