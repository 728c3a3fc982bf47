"""Skew-safe row positions and row-count windows inside each product.

The reference's features are *row-count* windows over one product's rows
ordered by date (lags 1…30, rolling windows of up to 30 previous rows,
leads 1…7).  The textbook plan, ``Window.partitionBy("product_id")``,
sends every row of a product to one task; with one hot product holding a
third of all rows that task would hold a third of the table.  The plan here
puts a product into one task only where it has no more rows than that task may hold:

0. ``parted``: one count per product lists the *large* products, those with more rows than
   the stated size.  The list is short (rows / size at most) and broadcast.  All other products
   take the textbook plan, one exchange and one sort for positions and windows alike
   (``numbered``); only the large ones go through the steps below.  Where none is large, their
   branch joins an empty list and does nothing.
1. ``with_positions``: rows per (product, day) are counted with a partial
   aggregate.  A day of one product with more than ``day_rows`` rows is cut
   into ranges by keys sampled from it (any type of tie-breaker, skewed or not);
   the rows of each range are counted too.  Running sums over these counts, within
   a day, then over a product's days, give every range its starting offset; rows
   are ranked within their range only, so neither a hot product nor its busiest
   day is ranked in one task (rows equal in every order column share a range).
   Where no day is that large, the ranges cost nothing: the sample is joined
   to an empty list of days.  The day is carried as a
   number with a value for a missing date (which sorts first), so the rows of
   a missing date join their offsets like any other.  The big side is exchanged
   once: the ranking and the join to the offsets share the keys.
2. ``chunked_window``: positions are cut into chunks of ``chunk_rows``.
   Each row is also copied into the next chunk when it is among the last
   ``lookback`` rows of its chunk, and into the previous chunk when it is
   among the first ``lookahead`` rows, so a window over
   (product_id, chunk) ordered by ``pos`` sees every neighbour a lag, a
   trailing frame or a lead can reach.  Only each chunk's own rows are kept:
   the result is exact for any frame within [-lookback, +lookahead].
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.sources.sales import order_columns

DEFAULT_CHUNK_ROWS = 1_000_000


DAY_ROWS = 1_000_000    # rows of one product's day that are ranked together
RANGES_PER_DAY_ROWS = 16    # sampled keys per ``DAY_ROWS`` rows of a larger day
SEARCH_STEPS = 31       # halvings, enough for any array


def _range_of(cuts: Column, key: Column) -> Column:
    """How many of the sorted ``cuts`` lie below ``key``, by binary search."""
    def halve(at, _):
        mid = F.floor((at["low"] + at["high"]) / 2).cast("int")
        open_ = at["low"] < at["high"]
        under = open_ & (F.get(cuts, mid) < key)
        return F.struct(F.when(under, mid + 1).otherwise(at["low"]).alias("low"),
                        F.when(open_ & ~under, mid).otherwise(at["high"]).alias("high"))

    ends = F.struct(F.lit(0).alias("low"), F.size(cuts).alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(SEARCH_STEPS)), ends, halve, lambda at: at["low"])
    return F.when(cuts.isNull(), F.lit(0)).otherwise(found)


AT_DAY, AT_RANGE = ("product_id", "_day"), ("product_id", "_day", "_range")


def _cuts_of_days(rows: DataFrame, ties: list[str], day_rows: int, number: Column) -> tuple[DataFrame, DataFrame]:
    """(rows and numbered rows per product and day, sorted cuts of the days with over ``day_rows`` rows).

    Each such day has over ``day_rows`` rows, so there are at most (rows / ``day_rows``) of them, with about 16 cuts for
    each ``day_rows`` rows: both lists are broadcast.
    """
    per_day = rows.groupBy(*AT_DAY).agg(F.count(F.lit(1)).alias("_rows"), F.sum(number).alias("_n"))
    hot = F.broadcast(per_day.where(F.col("_rows") > day_rows).select(*AT_DAY))
    sampled = rows.where(F.pmod(F.xxhash64(*ties), F.lit(max(day_rows // RANGES_PER_DAY_ROWS, 1))) == 0)
    cuts = sampled.join(hot, list(AT_DAY), "left_semi").groupBy(*AT_DAY).agg(F.sort_array(F.collect_set(F.struct(*ties))).alias("_cuts"))
    return per_day, F.broadcast(cuts)


def parted(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the products with at most ``limit`` rows, and those of the larger ones; rows without a product are in neither."""
    known = rows.where(F.col("product_id").isNotNull())
    per_product = known.groupBy("product_id").agg(F.count(F.lit(1)).alias("_rows"))
    large = F.broadcast(per_product.where(F.col("_rows") > limit).select("product_id"))
    return known.join(large, "product_id", "left_anti").select(*rows.columns), known.join(large, "product_id", "left_semi").select(*rows.columns)


def numbered(w: Window, counted: Column | None = None) -> list[Column]:
    """``pos`` and ``n_rows`` over a window of whole products (see ``with_positions``)."""
    number = F.lit(1) if counted is None else counted.cast("int")
    rank = F.row_number().over(w) if counted is None else F.sum(number).over(w.rowsBetween(Window.unboundedPreceding, 0))
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return [rank.cast("long").alias("pos"), F.sum(number).over(every).alias("n_rows")]


def with_positions(sales: DataFrame, order: list[str] | None = None, day_rows: int = DAY_ROWS, counted: Column | None = None) -> DataFrame:
    """Add ``pos`` (1-based, by ``order``, missing values first) and ``n_rows`` within each product.

    ``day_rows`` bounds the rows that one task ranks and changes no position.  With ``counted`` only the rows
    where it holds have a number; any other gets that of the last such row before it (0: none).  Rows without a product
    belong to no sequence and are left out.
    """
    order = order or order_columns(sales)
    small, large = parted(sales, day_rows)
    whole = Window.partitionBy("product_id").orderBy(*order)
    return small.select("*", *numbered(whole, counted)).unionByName(ranged_positions(large, order, day_rows, counted))


def ranged_positions(sales: DataFrame, order: list[str] | None = None, day_rows: int = DAY_ROWS, counted: Column | None = None) -> DataFrame:
    """``with_positions`` of products that no task should hold whole: offsets of days and ranges, ranks inside these."""
    order = order or order_columns(sales)
    day, ties = order[0], order[1:]
    rows = sales.where(F.col("product_id").isNotNull()).select(
        "*", F.coalesce(F.datediff(day, F.lit("1970-01-01")), F.lit(-(2**31))).alias("_day"))
    number = F.lit(1) if counted is None else counted.cast("int")
    before = (Window.unboundedPreceding, -1)

    per_day, cuts = _cuts_of_days(rows, ties, day_rows, number)
    ranged = rows.join(cuts, list(AT_DAY), "left").withColumn("_range", _range_of(F.col("_cuts"), F.struct(*ties))).drop("_cuts")
    hot_ranges = (rows.join(cuts, list(AT_DAY)).groupBy(*AT_DAY, _range_of(F.col("_cuts"), F.struct(*ties)).alias("_range"))
                  .agg(F.sum(number).alias("_n")))

    in_day = Window.partitionBy(*AT_DAY).orderBy("_range").rowsBetween(*before)
    ranges = hot_ranges.select(*AT_RANGE, F.coalesce(F.sum("_n").over(in_day), F.lit(0)).alias("_in_day"))
    of_days = Window.partitionBy("product_id").orderBy("_day").rowsBetween(*before)
    days = per_day.select(*AT_DAY, F.coalesce(F.sum("_n").over(of_days), F.lit(0)).alias("_earlier"),
                          F.sum("_n").over(Window.partitionBy("product_id")).alias("n_rows"))
    offsets = days.join(F.broadcast(ranges), list(AT_DAY), "left").select(
        *AT_DAY, "_earlier", "n_rows", F.coalesce("_range", F.lit(0)).alias("_range"), F.coalesce("_in_day", F.lit(0)).alias("_in_day"))
    in_range = Window.partitionBy(*AT_RANGE).orderBy(*(ties or [day]))
    rank = F.row_number().over(in_range) if counted is None else F.sum(number).over(in_range.rowsBetween(Window.unboundedPreceding, 0))
    return (ranged.withColumn("_rank", rank).join(offsets, list(AT_RANGE))
            .select(*sales.columns, (F.col("_earlier") + F.col("_in_day") + F.col("_rank")).cast("long").alias("pos"), "n_rows"))


def chunked_window(positioned: DataFrame, lookback: int, lookahead: int,
                   chunk_rows: int = DEFAULT_CHUNK_ROWS) -> tuple[DataFrame, Window]:
    """Return (halo frame, window spec) to evaluate row-count window columns.

    Use as::

        halo, w = chunked_window(pos_df, lookback=30, lookahead=7)
        out = finish_chunked(halo.select("*", F.lag("x", 3).over(w).alias("l3")))
    """
    if chunk_rows < max(lookback, lookahead, 1):
        raise ValueError("chunk_rows must cover the window reach")
    idx = F.col("pos") - 1
    own = F.floor(idx / F.lit(chunk_rows)).cast("long")
    off = idx - own * F.lit(chunk_rows)
    targets = F.array(
        own,
        F.when(off >= F.lit(chunk_rows - lookback), own + 1),
        F.when((off < F.lit(lookahead)) & (own > 0), own - 1),
    )
    halo = (positioned.withColumn("_own_chunk", own)
            .withColumn("_chunk", F.explode(F.array_compact(targets))))
    w = Window.partitionBy("product_id", "_chunk").orderBy("pos")
    return halo, w


def finish_chunked(df: DataFrame) -> DataFrame:
    """Keep each chunk's own rows only and drop the helper columns."""
    return df.where(F.col("_chunk") == F.col("_own_chunk")).drop("_chunk", "_own_chunk")
