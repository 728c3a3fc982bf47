"""Schemas and fixed values shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Sales table: one row per (product, store, date).  snake_case inside, the
# CSV headers of the original application map onto it in ``CSV_HEADERS``.
# ---------------------------------------------------------------------------
SALES = T.StructType([
    T.StructField("date", T.DateType(), False),
    T.StructField("product_id", T.StringType(), False),
    T.StructField("store_id", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("region", T.StringType(), True),
    T.StructField("inventory_level", T.DoubleType(), True),
    T.StructField("units_sold", T.DoubleType(), True),
    T.StructField("units_ordered", T.DoubleType(), True),
    T.StructField("price", T.DoubleType(), True),
    T.StructField("discount", T.DoubleType(), True),
    T.StructField("promotion", T.DoubleType(), True),
    T.StructField("competitor_pricing", T.DoubleType(), True),
    T.StructField("epidemic", T.DoubleType(), True),
    T.StructField("demand", T.DoubleType(), True),
])

# CSV header names of the sales file, in schema order.
CSV_HEADERS = {
    "date": "Date",
    "product_id": "Product ID",
    "store_id": "Store ID",
    "category": "Category",
    "region": "Region",
    "inventory_level": "Inventory Level",
    "units_sold": "Units Sold",
    "units_ordered": "Units Ordered",
    "price": "Price",
    "discount": "Discount",
    "promotion": "Promotion",
    "competitor_pricing": "Competitor Pricing",
    "epidemic": "Epidemic",
    "demand": "Demand",
}

# Feature recipe (lags, rolling windows, horizons).
LAGS = (1, 2, 3, 4, 5, 6, 7, 14, 21, 28, 30)
ROLLING_MEAN_WINDOWS = (3, 7, 14, 21, 30)
ROLLING_STD_WINDOWS = (7, 14, 30)
HORIZONS = 7
MAX_LOOKBACK = max(max(LAGS), max(ROLLING_MEAN_WINDOWS), max(ROLLING_STD_WINDOWS))

# Numeric pass-through columns of the serving row (order as in the recipe).
PASS_THROUGH = ("inventory_level", "units_ordered", "price", "discount",
                "promotion", "competitor_pricing", "epidemic")

# The 29-name model manifest, in model-input order.
FEATURES_V1 = (
    "inventory_level", "units_sold", "units_ordered", "price", "discount",
    "promotion", "competitor_pricing", "epidemic", "demand",
    "lag_1", "lag_2", "lag_3", "lag_4", "lag_5", "lag_6", "lag_7",
    "lag_14", "lag_21", "lag_28", "lag_30",
    "rolling_mean_3", "rolling_mean_7", "rolling_mean_14", "rolling_mean_21",
    "rolling_mean_30", "rolling_std_7", "rolling_std_14", "rolling_std_30",
    "is_weekend",
)
CALENDAR = ("day_of_week", "week_of_year", "month", "is_weekend")


def feature_manifest(include_calendar: bool = False) -> tuple[str, ...]:
    """P5: the model's features; ``include_calendar`` adds the calendar columns that the default list lacks."""
    return FEATURES_V1 + (tuple(c for c in CALENDAR if c not in FEATURES_V1) if include_calendar else ())


TARGETS = tuple(f"demand_t{i}" for i in range(1, HORIZONS + 1))
FORECAST_KEYS = tuple(f"t+{i}" for i in range(1, HORIZONS + 1))

DEFAULT_LEAD_TIME = 3
DEFAULT_INVENTORY = 100.0

# Per-SKU context document (nullable where the sample omits fields).
CONTEXT = T.StructType([
    T.StructField("sku", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("current_inventory", T.DoubleType()),
    T.StructField("current_price", T.DoubleType()),
    T.StructField("forecast", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("days_to_stockout", T.IntegerType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("reorder_needed", T.BooleanType()),
    T.StructField("recommended_reorder_quantity", T.DoubleType()),
    T.StructField("daily_sales_history", T.ArrayType(T.DoubleType())),
    T.StructField("metadata", T.StructType([
        T.StructField("lead_time_days", T.IntegerType()),
        T.StructField("safety_stock", T.DoubleType()),
        T.StructField("reorder_point", T.DoubleType()),
        T.StructField("lead_time_demand", T.DoubleType()),
        T.StructField("inventory_coverage_days", T.DoubleType()),
        T.StructField("average_price", T.DoubleType()),
    ])),
])
