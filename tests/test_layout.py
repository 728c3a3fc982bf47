"""The stored layout: same features, no exchange under their windows, one file a bucket, readable by a session that did not write it."""

import glob
import os

from shelfcast.operators.features import feature_frame, layout_features
from shelfcast.sources import sales_view
from shelfcast.sources.layout import layout_rows, open_sales, store_sales
from tests.conftest import SF_SMALL


def test_layout_windows_are_local(spark, tmp_path):
    sales = sales_view(spark, SF_SMALL)
    path = f"{tmp_path}/layout"
    layout = store_sales(sales, "layout_test", path, buckets=7, chunk_rows=50)
    assert len(glob.glob(os.path.join(path, "*.parquet"))) == 7
    assert layout.where("_chunk > 0").count() > 0      # products of several chunks
    got, want = layout_features(layout), feature_frame(sales)
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan
    assert layout_rows(layout).drop("pos", "n_rows").exceptAll(sales).count() == 0
    again = open_sales(spark, "layout_opened", path, buckets=7)
    assert "Exchange" not in layout_features(again)._jdf.queryExecution().executedPlan().toString()
    assert layout_features(again).exceptAll(want).count() == 0
    for name in ("layout_test", "layout_opened"):
        spark.sql(f"DROP TABLE {name}")
