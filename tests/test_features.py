"""Feature goldens (FIXTURES.md §4), chunked-window exactness, serving recipe."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from shelfcast.operators.features import feature_frame, serving_features
from shelfcast.sources import sales_view
from shelfcast.sources.sales import normalise_sales
from tests.conftest import SF_SMALL

D0 = dt.date(2024, 1, 1)


def _series(spark, rows):
    """rows: (product, units) in order; one row per day."""
    data, day = [], {}
    for p, u in rows:
        k = day.get(p, 0)
        day[p] = k + 1
        data.append((D0 + dt.timedelta(days=k), p, u))
    df = spark.createDataFrame(data, "date date, product_id string, units_sold double")
    return normalise_sales(df)


def test_training_windows_golden(spark):
    s = _series(spark, [("A", v) for v in (1.0, 2.0, None, 4.0, 5.0)])
    ff = feature_frame(s, targets=False).orderBy("date").collect()
    mean3 = [r.rolling_mean_3 for r in ff]
    assert mean3 == [None, 1.0, 1.5, 1.5, 3.0]
    # 7-row std of the previous rows: [], [1], [1,2], [1,2,NULL], [1,2,NULL,4]
    std7 = [None if r.rolling_std_7 is None else round(r.rolling_std_7, 4) for r in ff]
    assert std7 == [None, None, 0.7071, 0.7071, 1.5275]
    assert ff[0].lag_1 is None and ff[1].lag_1 == 1.0 and ff[3].lag_2 == 2.0


def test_serving_lags_golden(spark):
    s = _series(spark, [("A", float(v)) for v in range(1, 6)])
    ref = serving_features(s, "reference").first()
    ali = serving_features(s, "aligned").first()
    assert (ref.lag_1, ref.lag_2, ref.lag_3) == (5.0, 4.0, 3.0)
    assert (ali.lag_1, ali.lag_2, ali.lag_3) == (4.0, 3.0, 2.0)


def test_calendar_golden(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 7),), (dt.date(2024, 12, 30),)], "d date")
    from shelfcast.functions.calendar import calendar_columns
    got = [tuple(r) for r in df.select(*calendar_columns(F.col("d"))).orderBy("day_of_week").collect()]
    assert sorted(got) == sorted([(0, 1, 1, 0), (6, 1, 1, 1), (0, 1, 12, 0)])


def test_chunked_window_equals_single_chunk(spark):
    """Tiny chunks (many halo copies) give exactly the one-chunk result."""
    s = sales_view(spark, SF_SMALL)
    cols = ["product_id", "date", "src_order", "src_line", "lag_1", "lag_30", "rolling_mean_30",
            "rolling_std_14", "demand_t1", "demand_t7", "pos"]
    big = feature_frame(s).select(*cols)
    small = feature_frame(s, chunk_rows=30).select(*cols)
    assert big.exceptAll(small).count() == 0 and small.exceptAll(big).count() == 0
    assert big.count() == s.count()


def test_first_row_has_null_lags(spark):
    s = sales_view(spark, SF_SMALL)
    ff = feature_frame(s)
    firsts = ff.where(F.col("pos") == 1)
    assert firsts.where(F.col("lag_1").isNotNull() | F.col("rolling_mean_3").isNotNull()).count() == 0
    lasts = ff.where(F.col("pos") == F.col("n_rows"))
    assert lasts.where(F.col("demand_t1").isNotNull()).count() == 0


def _reference_recipe(units):
    """Restatement of the original inference recipe for one product."""
    import statistics
    w = list(units) + [units[-1]]
    n = len(w)
    latest = units[-1]
    out = {}
    for k in (1, 2, 3, 4, 5, 6, 7, 14, 21, 28, 30):
        out[f"lag_{k}"] = w[-k - 1] if n > k else (w[0] if n > 1 else latest)
    for win in (3, 7, 14, 21, 30):
        data = w[-min(win + 1, n - 1):-1] if n > 1 else []
        vals = [x for x in data if x is not None]
        if len(data) > 0:
            out[f"rolling_mean_{win}"] = sum(vals) / len(vals) if vals else None
        else:
            out[f"rolling_mean_{win}"] = latest
    for win in (7, 14, 30):
        data = w[-min(win + 1, n - 1):-1] if n > 1 else []
        vals = [x for x in data if x is not None]
        out[f"rolling_std_{win}"] = statistics.stdev(vals) if len(data) > 1 and len(vals) > 1 else 0.0
    return out


def test_serving_reference_matches_recipe(spark):
    rnd = random.Random(3)
    rows, series = [], {}
    for p in range(40):
        length = rnd.choice([1, 2, 3, 5, 8, 20, 31, 32, 45])
        vals = [float(rnd.randint(0, 30)) if rnd.random() > 0.05 else None for _ in range(length)]
        vals[-1] = vals[-1] if vals[-1] is not None else 3.0
        series[f"P{p}"] = vals
        rows += [(f"P{p}", v) for v in vals]
    got = {r.product_id: r.asDict() for r in serving_features(_series(spark, rows), "reference").collect()}
    for p, vals in series.items():
        want = _reference_recipe(vals)
        for k, v in want.items():
            g = got[p][k]
            if v is None or g is None:
                assert v is None and g is None, (p, k, v, g, vals)
            else:
                assert math.isclose(g, v, rel_tol=1e-9, abs_tol=1e-9), (p, k, v, g, vals)


def test_aligned_serving_equals_last_training_style_row(spark):
    s = sales_view(spark, SF_SMALL)
    ff = feature_frame(s, targets=False)
    last = ff.where(F.col("pos") == F.col("n_rows"))
    cols = ["product_id", "lag_1", "lag_7", "lag_30", "rolling_mean_7", "rolling_mean_30"]
    al = serving_features(s, "aligned").select(*cols)
    assert last.select(*cols).exceptAll(al).count() == 0
