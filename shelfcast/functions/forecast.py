"""Forecast shapes: map ``t+1..t+7``, array, or scalar — as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.schema import FORECAST_KEYS, HORIZONS


def forecast_kind(df: DataFrame, col: str = "forecast") -> str:
    dt = df.schema[col].dataType
    if isinstance(dt, T.MapType):
        return "map"
    if isinstance(dt, T.ArrayType):
        return "array"
    if isinstance(dt, T.NumericType):
        return "scalar"
    raise TypeError(f"unsupported forecast type {dt.simpleString()}")


def map_value(m: Column, key: str) -> Column:
    """Value of one horizon, 0.0 for a missing key (or a NULL value)."""
    return F.coalesce(F.try_element_at(m, F.lit(key)).cast("double"), F.lit(0.0))


def seven_days(f: Column, kind: str) -> Column:
    """The daily forecast as ``array<double>`` of at most 7 days."""
    if kind == "map":
        return F.array(*[map_value(f, k) for k in FORECAST_KEYS])
    if kind == "array":
        return F.slice(F.transform(f, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))), 1, HORIZONS)
    return F.array_repeat(F.coalesce(f.cast("double"), F.lit(0.0)), HORIZONS)


def array_sum(a: Column) -> Column:
    """Left-to-right sum, the order of a Python ``for``/``sum`` loop."""
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def forecast_total(f: Column, kind: str) -> Column:
    """The 7-day total (sum of map values / first seven values)."""
    if kind == "map":
        return F.aggregate(F.map_values(f), F.lit(0.0),
                           lambda acc, x: acc + F.coalesce(x.cast("double"), F.lit(0.0)))
    return array_sum(seven_days(f, kind))


def forecast_map(values: Column) -> Column:
    """``map<string,double>`` with keys ``t+1``…``t+7`` from 7 values."""
    return F.map_from_arrays(F.array(*[F.lit(k) for k in FORECAST_KEYS]), values)
