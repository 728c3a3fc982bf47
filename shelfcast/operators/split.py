"""Exact time-ordered split and contiguous folds without a global sort.

The original splits a date-sorted frame at ``int(n · (1 - test_size))`` rows.
A global ``row_number()`` would pull every row into one partition, so the
cut is located with counts instead:

1. rows per date (partial aggregate, one row per date) → running total →
   the date holding the cut and how many of its rows fall before it;
2. on that date the key with that rank is found by counting cells: sampled
   keys part the rows, one aggregate counts the rows between two of them and
   those equal to one, and the cell with the cut is parted again until few rows
   are left;
3. where the cut falls between equal rows, these are divided by their number:
   rows that agree in everything cannot be told apart, so as many as needed go
   to each side.

The frame is then classified by one comparison with a literal key.  The order
is total for any table (``order_key``): date, product, then the row's position
in its product, else the tie-breakers, else the other sales columns, and last two
hashes of all that is left.  Missing values come first everywhere.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.schema import SALES
from shelfcast.session import staged
from shelfcast.sources.sales import TIE_BREAKERS

FEW = 10_000      # rows of one cell that may be sorted together
BOUNDS = 64       # sampled keys of one round
COPIES = 1_000_000    # equal rows that one task writes


@dataclass(frozen=True)
class Boundary:
    """A key, how many rows equal to it lie before the cut, and how many there are."""

    key: T.Row
    kind: T.StructType
    before: int
    copies: int

    def literal(self) -> Column:
        return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(self.key, self.kind)])


def order_key(frame: DataFrame) -> Column:
    """The struct that orders the rows of ``frame``; equal structs are equal rows."""
    have = set(frame.columns)
    names = ["date", "product_id"]
    if "pos" in have:       # a row's number in its product
        return F.struct(*names, "pos")
    names += list(TIE_BREAKERS) if have.issuperset(TIE_BREAKERS) else [f.name for f in SALES if f.name in have and f.name not in names]
    if have.issuperset(("_h1", "_h2")):     # an ``order_keys`` table
        return F.struct(*names, "_h1", "_h2")
    rest = [c for c in frame.columns if c not in names]
    hashes = [F.xxhash64(*rest).alias("_h1"), F.xxhash64(F.lit(1), *rest).alias("_h2")] if rest else []
    return F.struct(*names, *hashes)


def order_keys(frame: DataFrame) -> DataFrame:
    """The rows' keys alone, written once: what the look-ups of a derived frame read."""
    key = order_key(frame)
    return staged(frame.select(key.alias("_key")).select("_key.*"), "order-keys")


def _sorted_key(row: tuple) -> tuple:
    """Python order of a key's values as Spark orders them: missing first, NaN last."""
    return tuple((v is not None, isinstance(v, float) and math.isnan(v), 0 if v is None or v != v else v) for v in row)


def _day_cuts(frame: DataFrame, ranks: list[Column]) -> list[tuple]:
    """(date, 0-based rank inside the date, rows of the date) per rank; ``ranks`` are columns over ``total``, those beyond it are left out."""
    per_date = frame.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    running = per_date.select(
        "date", "n", F.sum("n").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)).alias("cum"),
        F.sum("n").over(Window.partitionBy()).alias("total"))
    cuts = running.withColumn("k", F.explode(F.array(*[r.cast("long") for r in ranks])))
    cuts = cuts.where((F.col("k") < F.col("cum")) & (F.col("k") >= F.col("cum") - F.col("n")))
    return [(r.date, r.k - (r.cum - r.n), r.n) for r in cuts.orderBy("k").collect()]     # one row per rank


def _ranked(keys: DataFrame, rank: int, total: int) -> Boundary:
    """The boundary at 0-based ``rank`` among ``total`` keys (column ``_key``); no cell of over ``FEW`` rows is sorted."""
    kind = keys.schema["_key"].dataType
    while total > FEW:
        # the sample only steers the search: any other one ends at the same key
        picked = keys.orderBy(F.rand(total)).limit(BOUNDS).distinct().collect()
        bounds = sorted((r["_key"] for r in picked), key=_sorted_key)
        listed = F.array(*[Boundary(b, kind, 0, 0).literal() for b in bounds])
        below = F.size(F.filter(listed, lambda b: b < F.col("_key")))
        cells = keys.select(F.col("_key"), (below * 2 + F.array_contains(listed, F.col("_key")).cast("int")).alias("_cell"))
        counts = dict(cells.groupBy("_cell").count().collect())     # at most 2 · BOUNDS + 1 rows
        for cell in sorted(counts):
            if rank < counts[cell]:
                break
            rank -= counts[cell]
        if cell % 2:
            return Boundary(bounds[cell // 2], kind, rank, counts[cell])
        keys, total = cells.where(F.col("_cell") == cell).select("_key"), counts[cell]
    found = Boundary(keys.orderBy("_key").offset(rank).limit(1).first()["_key"], kind, 0, 0)
    at = found.literal()
    lower, equal = keys.agg(F.count_if(F.col("_key") < at), F.count_if(F.col("_key") == at)).first()
    return Boundary(found.key, kind, rank - lower, equal)


def _boundaries(rows: DataFrame, ranks: list[Column]) -> list[Boundary]:
    key = order_key(rows).alias("_key")
    return [_ranked(rows.where(F.col("date").eqNullSafe(F.lit(d))).select(key), r, n) for d, r, n in _day_cuts(rows, ranks)]


def split_bounds(rows: DataFrame, test_size: float = 0.2) -> list[Boundary]:
    """Where the first ``int(n · (1 - test_size))`` rows end; ``rows`` is the frame or its ``order_keys``."""
    return _boundaries(rows, [F.floor(F.col("total") * F.lit(1 - test_size))])


def fold_bounds(rows: DataFrame, n_folds: int = 3) -> list[Boundary]:
    """Where the folds but the first begin: ``n // k`` rows each, the first ``n % k`` one more."""
    size, more = F.floor(F.col("total") / n_folds), F.col("total") % n_folds
    return _boundaries(rows, [size * i + F.least(more, F.lit(i)) for i in range(1, n_folds)])


def _reached(key: Column, bound: Boundary) -> Column:
    """Whether a row is the boundary's key or lies behind it; the date is compared on its own, which Parquet can push down."""
    date = bound.key[0]
    inside = key >= bound.literal()
    if date is None:
        return F.col("date").isNotNull() | inside
    return (F.col("date") > F.lit(date)) | ((F.col("date") == F.lit(date)) & inside)


def labelled(frame: DataFrame, bounds: list[Boundary], name: str) -> DataFrame:
    """``frame`` with the number of boundaries that each row has reached; copies of a key are divided as the boundaries say."""
    key, label = order_key(frame), F.lit(0)
    for b in bounds:
        label = label + F.when(_reached(key, b), 1).otherwise(0)
    out = frame.withColumn(name, label.cast("int"))
    for at in {b.key for b in bounds if b.before}:
        here = [b for b in bounds if b.key == at]
        same = key == here[0].literal()
        if here[0].key[0] is not None:
            same = (F.col("date") == F.lit(here[0].key[0])) & same
        earlier = sum(_sorted_key(b.key) < _sorted_key(at) for b in bounds)
        cuts = [0, *[b.before for b in here], here[0].copies]
        sizes = F.array(*[F.struct(F.lit(earlier + i).alias("label"), F.lit(b - a).cast("long").alias("n"))
                          for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])
        parts = (frame.where(same).limit(1).withColumn("_part", F.explode(sizes)).where(F.col("_part.n") > 0)
                 .withColumn("_from", F.explode(F.expr(f"sequence(0, (_part.n - 1) div {COPIES})"))))
        if here[0].copies > COPIES:
            parts = parts.repartition("_from", "_part")
        copies = parts.withColumn("_copy", F.explode(F.expr(f"sequence(1, least({COPIES}, _part.n - _from * {COPIES}))")))
        out = out.where(~F.coalesce(same, F.lit(False))).unionByName(copies.select(*frame.columns, F.col("_part.label").cast("int").alias(name)))
    return out


def time_split(frame: DataFrame, test_size: float = 0.2, keys: DataFrame | None = None) -> DataFrame:
    """``split`` = 'train' for the first ``int(n·(1-test_size))`` rows, else 'val'.

    ``keys`` (``order_keys(frame)``) saves computing a derived frame once per look-up.
    """
    out = labelled(frame, split_bounds(frame if keys is None else keys, test_size), "split")
    return out.withColumn("split", F.when(F.col("split") == 0, "train").otherwise("val"))


def contiguous_folds(train: DataFrame, n_folds: int = 3, keys: DataFrame | None = None) -> DataFrame:
    """M2: ``fold`` 0…n-1 as unshuffled K-fold blocks in time order."""
    return labelled(train, fold_bounds(train if keys is None else keys, n_folds), "fold")
