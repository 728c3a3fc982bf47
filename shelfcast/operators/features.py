"""Time-series features: lags, rolling statistics, calendar, lead targets.

Windows are row-count frames inside one product (not calendar ranges),
ordered by a total order (``order_columns``).  Training features (W1-W5)
are one Window node per product, or per (product, chunk) with the halo rows of ``sequence`` where a product is large.
Serving features (W8) only need the last rows of each product and come
from ``product_state``: a top-k filter (planned as a map-side
``WindowGroupLimit``) plus partial and conditional aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.calendar import calendar_columns
from shelfcast.operators.sequence import (DEFAULT_CHUNK_ROWS, chunked_window,
                                          finish_chunked, numbered, parted, ranged_positions)
from shelfcast.schema import (HORIZONS, LAGS, MAX_LOOKBACK, PASS_THROUGH,
                              ROLLING_MEAN_WINDOWS, ROLLING_STD_WINDOWS, TARGETS)
from shelfcast.sources.sales import order_columns

LAG_COLS = tuple(f"lag_{k}" for k in LAGS)
MEAN_COLS = tuple(f"rolling_mean_{n}" for n in ROLLING_MEAN_WINDOWS)
STD_COLS = tuple(f"rolling_std_{n}" for n in ROLLING_STD_WINDOWS)
WINDOW_COLS = LAG_COLS + MEAN_COLS + STD_COLS


def _window_columns(w: Window, lags=True, means=True, stds=True, targets=True) -> list[Column]:
    u = F.col("units_sold")
    cols: list[Column] = []
    if lags:
        cols += [F.lag(u, k).over(w).alias(f"lag_{k}") for k in LAGS]
    if means:
        cols += [F.avg(u).over(w.rowsBetween(-n, -1)).alias(f"rolling_mean_{n}")
                 for n in ROLLING_MEAN_WINDOWS]
    if stds:
        cols += [F.stddev_samp(u).over(w.rowsBetween(-n, -1)).alias(f"rolling_std_{n}")
                 for n in ROLLING_STD_WINDOWS]
    if targets:
        cols += [F.lead(u, i).over(w).alias(TARGETS[i - 1]) for i in range(1, HORIZONS + 1)]
    return cols


def feature_frame(sales: DataFrame, *, lags: bool = True, means: bool = True,
                  stds: bool = True, targets: bool = True, calendar: bool = True,
                  drop_incomplete: bool = False,
                  chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Every sales row with its window features (``prepare_features``).

    ``drop_incomplete=True`` is P2: rows without all seven future targets go.
    The result carries ``pos``/``n_rows`` (row index and count in the product).

    Products of up to ``chunk_rows`` rows: positions and windows in one Window node over
    the product.  Larger ones: row positions, then windows over (product, chunk of
    ``chunk_rows`` positions) with the neighbours a window can reach (``sequence``).
    ``chunk_rows`` bounds a task and changes no row.
    """
    small, large = parted(sales, chunk_rows)
    w = Window.partitionBy("product_id").orderBy(*order_columns(sales))
    near = small.select("*", *numbered(w), *_window_columns(w, lags=lags, means=means, stds=stds, targets=targets))
    halo, _ = chunked_window(ranged_positions(large), lookback=MAX_LOOKBACK, lookahead=HORIZONS if targets else 0, chunk_rows=chunk_rows)
    far = layout_windows(halo, lags=lags, means=means, stds=stds, targets=targets)
    return _finished(near.unionByName(far), targets, calendar, drop_incomplete)


def layout_windows(halo: DataFrame, **kinds: bool) -> DataFrame:
    """The window columns over rows that are cut into chunks already."""
    w = Window.partitionBy("product_id", "_chunk").orderBy("pos")
    return finish_chunked(halo.select("*", *_window_columns(w, **kinds)))


def _finished(out: DataFrame, targets: bool, calendar: bool, drop_incomplete: bool) -> DataFrame:
    if calendar:
        out = out.select("*", *calendar_columns(F.col("date")))
    if drop_incomplete and targets:
        out = out.dropna("any", subset=list(TARGETS))
    return out


def layout_features(halo: DataFrame, *, lags: bool = True, means: bool = True, stds: bool = True, targets: bool = True,
                    calendar: bool = True, drop_incomplete: bool = False) -> DataFrame:
    """The same columns over rows that are cut into chunks already: a stored layout (``sources.layout``) needs no exchange here."""
    return _finished(layout_windows(halo, lags=lags, means=means, stds=stds, targets=targets), targets, calendar, drop_incomplete)


def training_frame(sales: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """W5 + P2: the model's training rows (all features and seven targets)."""
    return feature_frame(sales, drop_incomplete=True, chunk_rows=chunk_rows)


def dropped_rows(sales: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Rows before/after the target drop, in one pass."""
    ff = feature_frame(sales, lags=False, means=False, stds=False, calendar=False,
                       chunk_rows=chunk_rows)
    incomplete = F.lit(False)
    for t in TARGETS:
        incomplete = incomplete | F.col(t).isNull()
    return ff.agg(
        F.count(F.lit(1)).alias("initial_rows"),
        F.count_if(incomplete).alias("dropped_rows"),
        F.count_if(~incomplete).alias("final_rows"),
    )


# ---------------------------------------------------------------------------
# Serving features (W8): the latest row of every product
# ---------------------------------------------------------------------------

def _ord_struct(df: DataFrame) -> Column:
    return F.struct(*[F.col(c) for c in order_columns(df)])


def tail_rows(sales: DataFrame, k: int) -> DataFrame:
    """The last ``k`` rows of every product with ``rd`` = 1 for the latest.

    ``row_number() <= k`` is planned as a partial WindowGroupLimit before the
    shuffle, so at most ``k`` rows per product and map task are exchanged —
    a hot product does not move its whole history.
    """
    desc = [F.col(c).desc() for c in order_columns(sales)]
    w = Window.partitionBy("product_id").orderBy(*desc)
    return (sales.withColumn("rd", F.row_number().over(w))
            .where(F.col("rd") <= k))


RECENT = 14


def product_state(sales: DataFrame, modes=("reference", "aligned"),
                  columns: tuple[str, ...] | None = None, profile: bool = True) -> DataFrame:
    """One row per product with everything the latest-row jobs need.

    One pass over ``sales`` (map-side top-k) keeps the last 31 rows per product
    and folds them into ``n_rows`` (no more than the rows kept: 31 stands for
    more), ``latest`` (the whole latest row), ``recent`` (last 14 units, oldest
    first) and the serving aggregates of the requested recipes (``modes``),
    restricted to ``columns`` (feature names) if given.

    ``profile`` adds ``first`` (units/category/region/store of the first row)
    and ``average_price``, which need every row: a second pass, as a partial
    aggregate.  Jobs that only score or decide leave it out.
    """
    def want(name):
        return columns is None or name in columns

    reach = MAX_LOOKBACK + 1
    if columns is not None and "reference" not in modes:
        # aligned windows reach w + 1 rows back; the recent history needs 14
        need = [int(c.rsplit("_", 1)[1]) + 1 for c in columns if c.rsplit("_", 1)[-1].isdigit()]
        reach = max([RECENT, *need])
    sales = sales.where(F.col("product_id").isNotNull())
    tail = tail_rows(sales, reach)
    # partitioned and sorted as the top-k left it: no exchange, no sort
    t = tail.withColumn("n_rows", F.count(F.lit(1)).over(Window.partitionBy("product_id")))
    u, rd, n = F.col("units_sold"), F.col("rd"), F.col("n_rows")
    fields = [c for c in sales.columns if c != "product_id"]
    aggs: list[Column] = [
        F.min_by(F.struct(*[F.col(c) for c in fields]), rd).alias("latest"),
        F.max("n_rows").alias("n_rows"),
        F.sort_array(F.collect_list(F.when(rd <= RECENT, F.struct(rd.alias("rd"), u.alias("u")))),
                     asc=False).alias("_recent"),
    ]
    ref, al = "reference" in modes, "aligned" in modes
    for k in LAGS:
        if ref and want(f"lag_{k}"):
            aggs.append(F.max(F.when(rd == F.least(F.lit(k), n), u)).alias(f"_ref_lag_{k}"))
        if al and want(f"lag_{k}"):
            aggs.append(F.max(F.when(rd == k + 1, u)).alias(f"_al_lag_{k}"))
    for w in ROLLING_MEAN_WINDOWS:
        if ref and want(f"rolling_mean_{w}"):
            aggs.append(F.avg(F.when(rd <= F.least(F.lit(w), n - 1), u)).alias(f"_ref_mean_{w}"))
        if al and want(f"rolling_mean_{w}"):
            aggs.append(F.avg(F.when((rd >= 2) & (rd <= w + 1), u)).alias(f"_al_mean_{w}"))
    for w in ROLLING_STD_WINDOWS:
        if ref and want(f"rolling_std_{w}"):
            aggs.append(F.stddev_samp(F.when(rd <= F.least(F.lit(w), n - 1), u)).alias(f"_ref_std_{w}"))
        if al and want(f"rolling_std_{w}"):
            aggs.append(F.stddev_samp(F.when((rd >= 2) & (rd <= w + 1), u)).alias(f"_al_std_{w}"))
    g = t.groupBy("product_id").agg(*aggs)
    state = g.select("*", F.transform("_recent", lambda x: x["u"]).alias("recent")).drop("_recent")
    if not profile:
        return state
    ext = sales.groupBy("product_id").agg(
        F.min_by(F.struct("units_sold", "category", "region", "store_id"), _ord_struct(sales)).alias("first"),
        F.avg("price").alias("average_price"))
    return state.join(ext, "product_id")


def serving_columns(mode: str = "reference") -> list[Column]:
    """W8 feature columns over a ``product_state`` row.

    ``mode="reference"`` reproduces the original inference recipe, which
    appends the latest row to a history that already contains it: with the
    product's series u1…uN (rd = 1 is uN),

    * ``lag_k`` = u at rd = least(k, N)           (u1 when the history is short)
    * ``rolling_mean_w`` = mean of rd <= least(w, N-1); N = 1 → latest units
    * ``rolling_std_w`` = sample std of the same rows, missing → 0.0
    * no ``units_sold``/``demand`` (the model sees 0.0 for them)
    * pass-through numerics of the latest row, missing → 0.0 (P8)

    ``mode="aligned"`` gives the training recipe's values for the latest row
    (lags from rd = k+1, windows over rd in 2..w+1, NULL where undefined)
    and passes ``units_sold``/``demand`` through.
    """
    if mode not in ("reference", "aligned"):
        raise ValueError("mode must be 'reference' or 'aligned'")
    lu = F.col("latest.units_sold")
    cols: list[Column] = [F.col("latest.date").alias("date")]
    if mode == "reference":
        single = F.col("n_rows") == 1
        cols += [F.when(single, lu).otherwise(F.col(f"_ref_lag_{k}")).alias(f"lag_{k}") for k in LAGS]
        cols += [F.when(single, lu).otherwise(F.col(f"_ref_mean_{w}")).alias(f"rolling_mean_{w}")
                 for w in ROLLING_MEAN_WINDOWS]
        cols += [F.coalesce(F.col(f"_ref_std_{w}"), F.lit(0.0)).alias(f"rolling_std_{w}")
                 for w in ROLLING_STD_WINDOWS]
    else:
        cols += [F.col(f"_al_lag_{k}").alias(f"lag_{k}") for k in LAGS]
        cols += [F.col(f"_al_mean_{w}").alias(f"rolling_mean_{w}") for w in ROLLING_MEAN_WINDOWS]
        cols += [F.col(f"_al_std_{w}").alias(f"rolling_std_{w}") for w in ROLLING_STD_WINDOWS]
    cols += calendar_columns(F.col("latest.date"))
    for c in PASS_THROUGH:
        v = F.col(f"latest.{c}")
        cols.append((F.coalesce(v, F.lit(0.0)) if mode == "reference" else v).alias(c))
    if mode == "aligned":
        cols += [lu.alias("units_sold"), F.col("latest.demand").alias("demand")]
    return cols


def serving_features(sales: DataFrame, mode: str = "reference") -> DataFrame:
    """One feature row per product for its latest row (see ``serving_columns``)."""
    return product_state(sales, modes=(mode,), profile=False).select("product_id", *serving_columns(mode))


def pass_through_features(latest: DataFrame, sales: DataFrame) -> DataFrame:
    """The seven pass-through numerics for given latest rows (``product_id`` and any of them).

    A column that ``latest`` has gives its value, one that it lacks the last value of
    the product's history; a missing value is 0.0.
    """
    lacking = [c for c in PASS_THROUGH if c not in latest.columns]
    out = latest
    if lacking:
        last = sales.groupBy("product_id").agg(F.max_by(F.struct(*lacking), _ord_struct(sales)).alias("_last"))
        out = latest.join(last, "product_id", "left")
    return out.select("product_id", *[
        F.coalesce(F.col(f"_last.{c}") if c in lacking else F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in PASS_THROUGH])


def model_input(df: DataFrame, features) -> list[Column]:
    """Manifest-ordered numeric features, absent → 0.0, NULL → 0.0."""
    have = set(df.columns)
    cols = [(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0))
            .alias(c) for c in features]
    return cols
