"""Sales scan (CSV headers, absent columns, NaN) and context JSON round trip."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from shelfcast.schema import CONTEXT
from shelfcast.sources import read_sales


def test_csv_with_original_headers(spark):
    d = tempfile.mkdtemp(prefix="shelfcast-test-")
    p = os.path.join(d, "sales.csv")
    with open(p, "w") as fh:
        fh.write("Date,Product ID,Units Sold,Price,Category\n")
        fh.write("2024-01-02,P1,5,2.5,Toys\n2024-01-01,P1,3,NaN,Toys\n2024-01-01,P2,,1.0,\n")
    df = read_sales(spark, p)
    rows = {(r.product_id, str(r.date)): r for r in df.collect()}
    assert rows[("P1", "2024-01-02")].units_sold == 5.0
    assert rows[("P1", "2024-01-01")].price is None          # NaN → NULL
    assert rows[("P2", "2024-01-01")].units_sold is None
    assert all(r.inventory_level == 100.0 for r in rows.values())  # absent column → default
    assert rows[("P2", "2024-01-01")].region is None


def test_csv_dates_and_bad_values(spark):
    import pytest
    p = os.path.join(tempfile.mkdtemp(prefix="shelfcast-test-"), "sales.csv")
    with open(p, "w") as fh:
        fh.write("Date,Product ID,Units Sold\n1/2/2024,P1,5\n2024-01-03,P1,\n")
    assert [str(r.date) for r in read_sales(spark, p).orderBy("date").collect()] == ["2024-01-02", "2024-01-03"]
    for row in ("someday,P1,5", "2024-01-04,P1,x7"):
        with open(p, "w") as fh:
            fh.write(f"Date,Product ID,Units Sold\n{row}\n")
        with pytest.raises(Exception, match="sales file"):
            read_sales(spark, p).collect()
        assert read_sales(spark, p, bad="null").count() == 1


def test_changed_input_is_seen(spark):
    import shutil
    from shelfcast.sources import sales_view
    from tests.conftest import SF_SMALL
    d = tempfile.mkdtemp(prefix="shelfcast-test-")
    for t in ("part", "supplier", "nation", "region"):
        shutil.copy(f"{SF_SMALL}/{t}.parquet", d)
    rows = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    for n in (200, 50):
        rows.orderBy("l_orderkey", "l_linenumber").limit(n).write.mode("overwrite").parquet(f"{d}/lineitem.parquet")
        assert sales_view(spark, f"file://{d}").count() == n


def test_context_json_round_trip(spark):
    doc = {"sku": "P9", "current_inventory": 12.0,
           "forecast": {f"t+{i}": float(i) for i in range(1, 8)},
           "days_to_stockout": 4, "risk_level": "MEDIUM", "reorder_needed": True,
           "recommended_reorder_quantity": 3.5, "daily_sales_history": [1.0, 2.0],
           "metadata": {"lead_time_days": 3, "safety_stock": 1.2, "reorder_point": 7.2,
                        "lead_time_demand": 6.0, "inventory_coverage_days": 2.1}}
    d = tempfile.mkdtemp(prefix="shelfcast-test-")
    p = os.path.join(d, "ctx.json")
    with open(p, "w") as fh:
        json.dump(doc, fh, indent=2)
    df = spark.read.schema(CONTEXT).option("multiLine", True).json(p)
    r = df.first()
    assert r.sku == "P9" and r.forecast["t+3"] == 3.0 and r.metadata.lead_time_days == 3
    assert r.product_name is None and r.metadata.average_price is None
    back = json.loads(df.select(F.to_json(F.struct(*df.columns))).first()[0])
    assert back["forecast"] == doc["forecast"] and back["metadata"]["reorder_point"] == 7.2


def test_parquet_scan_normalises(spark):
    import datetime as dt
    d = tempfile.mkdtemp(prefix="shelfcast-test-")
    p = os.path.join(d, "sales.parquet")
    df = spark.createDataFrame(
        [(dt.date(2024, 1, 1), "P1", float("nan"), 3.0), (dt.date(2024, 1, 2), "P1", 2.0, None)],
        "date date, product_id string, units_sold double, inventory_level double")
    df.write.parquet(p)
    got = read_sales(spark, p).orderBy("date").collect()
    assert got[0].units_sold is None and got[1].units_sold == 2.0   # NaN → NULL
    assert got[1].inventory_level is None                          # present column: no default
    assert got[0].price is None and got[0].demand is None          # absent columns: typed NULL
