"""Decision jobs: forecast providers → inventory plan → alerts.

Three forecast providers feed the same decision operators (SURVEY §7.3):

* ``constant``: the latest row's mean of the previous 7 rows, as a scalar
  daily rate (the aligned ``rolling_mean_7``);
* ``realised``: the seven actual future values (perfect-foresight
  backtest over every training row);
* ``model``: the seven direct-horizon models (``plans.models``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.forecast import forecast_kind, forecast_map, forecast_total
from shelfcast.operators.alerts import alerts
from shelfcast.operators.features import product_state
from shelfcast.operators.inventory import inventory_plan
from shelfcast.schema import DEFAULT_LEAD_TIME, HORIZONS, TARGETS


def constant_forecast(sales: DataFrame, as_map: bool = False) -> DataFrame:
    """(product_id, forecast, current_inventory) at the latest row.

    The daily rate is the latest row's mean of its previous 7 rows; as a
    scalar (X3) or as the map ``t+1..t+7`` a model would return (X5).
    """
    st = product_state(sales, modes=("aligned",), columns=("rolling_mean_7",), profile=False)
    rate = F.coalesce(F.col("_al_mean_7"), F.lit(0.0))
    fc = forecast_map(F.array_repeat(rate, HORIZONS)) if as_map else rate
    return st.select("product_id", fc.alias("forecast"),
                     F.col("latest.inventory_level").alias("current_inventory"))


def plan_and_alerts(forecasts: DataFrame, lead_time: int = DEFAULT_LEAD_TIME,
                    keep=("product_id",)) -> DataFrame:
    """Plan + alert payload per row, with the 7-day total of the forecast."""
    kind = forecast_kind(forecasts, "forecast")
    src = forecasts.select(*keep, "forecast", "current_inventory",
                           forecast_total(F.col("forecast"), kind).alias("forecast_7day"),
                           F.lit(lead_time).alias("lead_time_days"))
    plan = (inventory_plan(src, keep=(*keep, "forecast_7day"))
            .withColumnRenamed("risk_level", "decision_risk"))
    return alerts(plan, keep=(*keep, "lead_time_days", "lead_time_demand", "safety_stock",
                              "reorder_point", "reorder_status", "decision_risk",
                              "recommendation", "forecast_7day"))


def realised_forecast(training: DataFrame, keys=("product_id", "date", "src_order", "src_line")) -> DataFrame:
    """Every training row with its seven realised future values as a list
    (perfect-foresight backtest provider)."""
    return training.select(*keys, F.array(*[F.col(t) for t in TARGETS]).alias("forecast"),
                           F.col("inventory_level").alias("current_inventory"))
