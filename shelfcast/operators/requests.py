"""Features of requested rows as of their date.

A request is a row (product, date, units sold, any pass-through columns) that
need not be in the history: newer than it, older than parts of it, given several
times, or of a product without any history.  Its features come from the rows
of its product before it.

1. Requests are reduced to distinct *points* (product, date, shared
   tie-breakers), since features depend on nothing else of them.
2. Of each product, the last 31 rows before its earliest point (map-side top-k)
   and the rows after it enter; no feature reaches further back.
3. These rows and the points make one sequence per product (``with_positions``),
   in which only history rows are numbered: a point has the number of the last
   row before it.
4. Chunked windows with frames over that number (a range of values, not of
   rows) give the features, so points in between change nothing, and
   the points are joined back to the requests.

A hot product is spread over chunks, and any number of requests for one point
is one point.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.calendar import calendar_columns
from shelfcast.operators.sequence import DEFAULT_CHUNK_ROWS, chunked_window, finish_chunked, with_positions
from shelfcast.schema import LAGS, MAX_LOOKBACK, PASS_THROUGH, ROLLING_MEAN_WINDOWS, ROLLING_STD_WINDOWS
from shelfcast.session import staged
from shelfcast.sources.sales import TIE_BREAKERS, order_columns


def _bounded_history(sales: DataFrame, points: DataFrame, key: list[str], order: list[str], strict: bool) -> DataFrame:
    """The rows of ``sales`` that a point can reach: 31 before the product's first point, and all after it."""
    first = points.groupBy("product_id").agg(F.min(F.struct(*key)).alias("_first"))
    rows = sales.join(first, "product_id")
    at = F.struct(*key)
    early = at < F.col("_first") if strict else at <= F.col("_first")
    latest_first = Window.partitionBy("product_id").orderBy(*[F.col(c).desc() for c in order])
    before = rows.where(early).withColumn("_rd", F.row_number().over(latest_first)).where(F.col("_rd") <= MAX_LOOKBACK + 1).drop("_rd")
    return before.unionByName(rows.where(~early)).drop("_first")


def _point_features(history: DataFrame, points: DataFrame, key: list[str], order: list[str], strict: bool,
                    carried: list[str], chunk_rows: int) -> DataFrame:
    """Per point: ``n`` rows before it (31 stands for more), lag, mean and deviation columns, the oldest units and the last row's ``carried`` columns."""
    rest = [c for c in order if c not in key]
    # at equal keys a row is before the point, unless only strictly earlier rows count
    union = history.withColumn("_kind", F.lit(1 if strict else 0)).unionByName(
        points.withColumn("_kind", F.lit(0 if strict else 1)), allowMissingColumns=True)
    real = F.col("_kind") == (1 if strict else 0)
    placed = with_positions(union, [*key, "_kind", *rest], counted=real)
    halo, w = chunked_window(placed, lookback=MAX_LOOKBACK, lookahead=0, chunk_rows=chunk_rows)
    units = F.when(real, F.col("units_sold"))
    inner = units if strict else F.when(F.col("pos") >= 2, units)     # the original recipe leaves the oldest row out of a short window
    one = lambda k: w.rangeBetween(-(k - 1), -(k - 1))      # noqa: E731  the k-th row before the point
    last = lambda n: w.rangeBetween(-(n - 1), 0)      # noqa: E731
    cols: list[Column] = [F.max(units).over(one(k)).alias(f"lag_{k}") for k in LAGS]
    cols += [F.avg(inner).over(last(n)).alias(f"rolling_mean_{n}") for n in ROLLING_MEAN_WINDOWS]
    cols += [F.stddev_samp(inner).over(last(n)).alias(f"rolling_std_{n}") for n in ROLLING_STD_WINDOWS]
    cols += [F.max(F.when(real, F.col(c))).over(one(1)).alias(f"_last_{c}") for c in carried]
    cols.append(F.max(F.when(F.col("pos") == 1, units)).over(last(MAX_LOOKBACK)).alias("_oldest"))
    found = finish_chunked(halo.select("product_id", *key, "_kind", "pos", "_chunk", "_own_chunk", *cols))
    return found.where(~real).drop("_kind", "_chunk", "_own_chunk").withColumnRenamed("pos", "_n")


def requested_features(requests: DataFrame, sales: DataFrame, mode: str = "reference", keep: list[str] | None = None,
                       chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """One feature row per request (``product_id``, ``date``, ``units_sold``, any pass-through columns).

    ``mode="reference"`` appends the request to the rows at or before it, as the original does: lags fall back to the oldest row,
    means and deviations skip the oldest row of a short history, and without history lags and means are the request's
    own units, deviations 0.0; missing pass-through values are 0.0.  ``mode="aligned"`` is the training recipe over the rows
    strictly before the request, undefined values missing, with ``units_sold`` and ``demand`` passed through.
    A pass-through column that the requests lack takes its value from the last row before the request.  Requests without a
    product or date are answered like any other: no history, or the rows without a date.  ``keep`` lists the request's
    columns to return (default: those that are no feature).
    """
    if mode not in ("reference", "aligned"):
        raise ValueError("mode must be 'reference' or 'aligned'")
    strict = mode == "aligned"
    key = ["date", *[c for c in TIE_BREAKERS if c in requests.columns and c in sales.columns]]
    order = order_columns(sales)
    lacking = [c for c in PASS_THROUGH if c not in requests.columns]
    points = requests.where(F.col("product_id").isNotNull()).select("product_id", *key).distinct()
    narrow = sales.select("product_id", *dict.fromkeys([*order, "units_sold", *lacking]))
    # written once: the sequence reads it several times, the sales only to find it
    history = staged(_bounded_history(narrow, points, key, order, strict), "requested-history")
    found = _point_features(history, points, key, order, strict, lacking, chunk_rows)
    names = [c for c in found.columns if c not in ("product_id", *key)]
    found = found.select(*[F.col(c).alias(f"_p_{c}") for c in ("product_id", *key)], *names)
    same = reduce(lambda a, b: a & b, [F.col(f"_p_{c}").eqNullSafe(requests[c]) for c in ("product_id", *key)])
    rows = requests.join(found, same, "left")

    own, n = requests["units_sold"].cast("double"), F.coalesce(F.col("_n"), F.lit(0))
    features = ("units_sold", "demand", *PASS_THROUGH)
    cols: list[Column] = [requests[c] for c in (keep or [c for c in requests.columns if c not in features])]
    if strict:
        cols += [F.col(c) for c in names if c.startswith(("lag_", "rolling_"))]
    else:
        cols += [F.when(n == 0, own).when(n >= k, F.col(f"lag_{k}")).otherwise(F.col("_oldest")).alias(f"lag_{k}") for k in LAGS]
        cols += [F.when(n <= 1, own).otherwise(F.col(f"rolling_mean_{w}")).alias(f"rolling_mean_{w}") for w in ROLLING_MEAN_WINDOWS]
        cols += [F.coalesce(f"rolling_std_{w}", F.lit(0.0)).alias(f"rolling_std_{w}") for w in ROLLING_STD_WINDOWS]
    cols += calendar_columns(requests["date"])
    for c in PASS_THROUGH:
        value = F.col(f"_last_{c}") if c in lacking else requests[c].cast("double")
        cols.append((value if strict else F.coalesce(value, F.lit(0.0))).alias(c))
    if strict:
        cols += [own.alias("units_sold"), (requests["demand"] if "demand" in requests.columns else F.lit(None)).cast("double").alias("demand")]
    return rows.select(*cols)
