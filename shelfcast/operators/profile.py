"""Data profiling and catalog operators.

All are single-pass partial aggregates; none keeps rows of a product together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.schema import HORIZONS, TARGETS


def zero_profile(sales: DataFrame) -> DataFrame:
    """A1: total rows, rows with zero sales, their share and the rest."""
    g = sales.agg(F.count(F.lit(1)).alias("total_rows"),
                  F.count_if(F.col("units_sold") == 0).alias("zero_rows"))
    pct = F.try_divide(F.col("zero_rows").cast("double"), F.col("total_rows").cast("double")) * 100
    return g.select("total_rows", "zero_rows", pct.alias("zero_pct"),
                    (F.col("total_rows") - F.col("zero_rows")).alias("nonzero_rows"),
                    (F.lit(100.0) - pct).alias("nonzero_pct"))


def zero_by_product(sales: DataFrame) -> DataFrame:
    """A2: zero-sales rows per product (NULL keys dropped, as a pandas groupby)."""
    return (sales.where(F.col("product_id").isNotNull()).groupBy("product_id")
            .agg(F.count_if(F.col("units_sold") == 0).alias("zero_count")))


def zero_targets(frame: DataFrame) -> DataFrame:
    """A3: zeros / non-null count / share for each target; empty targets omitted."""
    aggs = []
    for t in TARGETS:
        aggs += [F.count_if(F.col(t) == 0).alias(f"z_{t}"), F.count(t).alias(f"n_{t}")]
    wide = frame.agg(*aggs)
    stack = ", ".join(f"'demand_t+{i}', z_{t}, n_{t}" for i, t in zip(range(1, HORIZONS + 1), TARGETS))
    long = wide.selectExpr(f"stack({HORIZONS}, {stack}) AS (target, zero_count, total_count)")
    return (long.where(F.col("total_count") > 0)
            .withColumn("zero_pct", F.col("zero_count").cast("double")
                        / F.col("total_count").cast("double") * 100))


def sku_list(sales: DataFrame) -> DataFrame:
    """A4: distinct products, sorted."""
    return sales.select("product_id").distinct().orderBy("product_id")


def sku_catalog(info: DataFrame, first: int = 50, shown: int = 20) -> DataFrame:
    """O3: first ``first`` products by id with their info, a display flag for
    the first ``shown`` and how many products are not displayed.

    The limit is the feature (a top-k listing): ``orderBy().limit()`` plans as
    TakeOrderedAndProject, a bounded per-partition top-k.
    """
    total = info.select(F.count(F.lit(1))).scalar()
    top = info.orderBy("sku").limit(first)
    from pyspark.sql import Window
    w = Window.orderBy("sku")
    return (top.withColumn("position", F.row_number().over(w))
            .withColumn("displayed", F.col("position") <= shown)
            .withColumn("more_products", F.greatest(total - F.lit(shown), F.lit(0))))


def sku_filter(sales: DataFrame, requested: DataFrame) -> DataFrame:
    """Rows of the requested products (left-semi join, all products at once)."""
    return sales.join(requested.select("product_id").distinct(), "product_id", "left_semi")


def sku_membership(messages: DataFrame, sales: DataFrame) -> DataFrame:
    """P10: is the requested product known; unknown ones fall back to the first SKU."""
    skus = sales.select("product_id").distinct().withColumn("known", F.lit(True))
    first = sales.select(F.min("product_id")).scalar()
    m = messages.join(skus, "product_id", "left")
    return m.select("message_id", "product_id",
                    F.coalesce(F.col("known"), F.lit(False)).alias("known"),
                    F.when(F.col("known"), F.col("product_id")).otherwise(first).alias("resolved_sku"))
