"""Requested rows as of their date against a plain restatement; latest rows give the serving features."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from shelfcast.operators.features import serving_features
from shelfcast.operators.requests import requested_features
from shelfcast.operators.snapshot import latest_row
from shelfcast.schema import LAGS, PASS_THROUGH, ROLLING_MEAN_WINDOWS, ROLLING_STD_WINDOWS
from shelfcast.sources import sales_view
from tests.conftest import SF_SMALL

DAY = dt.date(2024, 1, 1)


def approx(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def expected(units, own, mode):
    """Features from the units before the request, oldest first."""
    out, n = {}, len(units)
    real = lambda xs: [x for x in xs if x is not None]
    for k in LAGS:
        out[f"lag_{k}"] = (units[-k] if n >= k else None) if mode == "aligned" else own if n == 0 else units[-k] if n >= k else units[0]
    for w in ROLLING_MEAN_WINDOWS:
        part = real(units[-w:] if mode == "aligned" else units[max(1, n - w):])
        mean = sum(part) / len(part) if part else None
        out[f"rolling_mean_{w}"] = own if mode == "reference" and n <= 1 else mean
    for w in ROLLING_STD_WINDOWS:
        part = real(units[-w:] if mode == "aligned" else units[max(1, n - w):])
        out[f"rolling_std_{w}"] = statistics.stdev(part) if len(part) > 1 else None if mode == "aligned" else 0.0
    return out


@pytest.mark.parametrize("mode", ["reference", "aligned"])
@pytest.mark.parametrize("chunk_rows", [31, 10**6])
def test_old_new_unknown_and_repeated_requests(spark, mode, chunk_rows):
    rnd = random.Random(8)
    rows = [(p, None if rnd.random() < .03 else DAY + dt.timedelta(days=rnd.randint(0, 120)), i, i % 3, None if rnd.random() < .1 else float(rnd.randint(0, 90)), float(i % 7))
            for p, n in (("A", 160), ("B", 25), ("C", 1)) for i in range(n)]
    sales = spark.createDataFrame(rows, "product_id string, date date, src_order long, src_line int, units_sold double, price double")
    sales = sales.select("*", *[F.lit(None).cast("double").alias(c) for c in PASS_THROUGH if c != "price"], F.lit("S").alias("store_id"))
    asked = [(k, p, d, float(k)) for k, (p, d) in enumerate(
        [(p, DAY + dt.timedelta(days=x)) for p in "ABCX" for x in (-5, 0, 7, 60, 61, 119, 120, 400)] + [("A", DAY), ("A", DAY), ("A", None), (None, DAY)])]
    asked += [(500 + i, "B", DAY + dt.timedelta(days=60), 3.0) for i in range(40)]
    requests = spark.createDataFrame(asked, "request_id long, product_id string, date date, units_sold double")
    got = {r.request_id: r for r in requested_features(requests, sales, mode, chunk_rows=chunk_rows).collect()}
    assert len(got) == len(asked)
    for k, p, d, own in asked:
        order = lambda r: (r[1] is not None, r[1] or DAY, r[2], r[3])
        past = sorted((r for r in rows if r[0] == p and (r[1] is None or (d is not None and (r[1] < d or (mode == "reference" and r[1] == d))))
                       and not (mode == "aligned" and d is None)), key=order)
        want = expected([r[4] for r in past], own, mode)
        want["price"] = past[-1][5] if past else None if mode == "aligned" else 0.0
        for name, value in want.items():
            assert approx(got[k][name], value), (k, p, d, name, got[k][name], value)


@pytest.mark.parametrize("mode", ["reference", "aligned"])
def test_latest_rows_give_the_serving_features(spark, mode):
    sales = sales_view(spark, SF_SMALL)
    want = {r.product_id: r for r in serving_features(sales, mode).collect()}
    got = {r.product_id: r for r in requested_features(latest_row(sales), sales, mode).collect()}
    assert set(got) == set(want)
    for p, row in want.items():
        for name, value in row.asDict().items():
            assert approx(got[p][name], value) if isinstance(value, float) else got[p][name] == value, (p, name)


def test_no_history_and_no_requests(spark):
    sales = sales_view(spark, SF_SMALL).where("false")
    one = spark.createDataFrame([("P", DAY, 4.0, 2.5)], "product_id string, date date, units_sold double, price double")
    row = requested_features(one, sales).first()
    assert row.lag_30 == row.rolling_mean_7 == 4.0 and row.rolling_std_7 == 0.0 and row.price == 2.5 and row.discount == 0.0
    assert requested_features(one.where("false"), sales_view(spark, SF_SMALL)).count() == 0
