"""Per-product snapshots: latest row (W6), recent sales (W7), product info (A5).

All are partial aggregates or top-k filters, so no task ever holds a whole
product's history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.features import tail_rows
from shelfcast.sources.sales import order_columns


def ord_struct(df: DataFrame) -> Column:
    return F.struct(*[F.col(c) for c in order_columns(df)])


def latest_row(sales: DataFrame) -> DataFrame:
    """The last row of every product (``max_by`` → partial aggregation)."""
    cols = [c for c in sales.columns if c != "product_id"]
    g = sales.groupBy("product_id").agg(
        F.max_by(F.struct(*[F.col(c) for c in cols]), ord_struct(sales)).alias("_r"))
    return g.select("product_id", *[F.col(f"_r.{c}").alias(c) for c in cols])


def recent_sales(sales: DataFrame, n: int = 14) -> DataFrame:
    """The last ``n`` units-sold values per product, oldest first."""
    tail = tail_rows(sales, n)
    g = tail.groupBy("product_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("rd"), F.col("units_sold"))), asc=False)
        .alias("_t"))
    return g.select("product_id",
                    F.transform("_t", lambda s: s["units_sold"]).alias("daily_sales_history"))


def product_info(sales: DataFrame) -> DataFrame:
    """First row's category/region/store, average price, display name.

    ``min_by`` over the total order picks the first row; ``avg`` skips NULL
    prices like the pandas mean.  A NULL category prints as "Unknown".
    """
    g = sales.groupBy("product_id").agg(
        F.min_by(F.struct("category", "region", "store_id"), ord_struct(sales)).alias("_f"),
        F.avg("price").alias("average_price"))
    return g.select(
        F.col("product_id").alias("sku"),
        F.col("_f.category").alias("category"),
        F.col("_f.region").alias("region"),
        F.concat_ws(" - ", F.coalesce(F.col("_f.category"), F.lit("Unknown")),
                    F.col("product_id")).alias("product_name"),
        F.col("_f.store_id").alias("store_id"),
        F.col("average_price"),
    )

