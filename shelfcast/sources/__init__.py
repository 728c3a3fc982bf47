"""Scans and sinks: sales table (CSV/Parquet), test-table views, context JSON."""

from shelfcast.sources.sales import read_sales, normalise_sales, order_columns  # noqa: F401
from shelfcast.sources.testdata import (gaps_view, load_table, materialize_sales, messages_view, requests_view,  # noqa: F401
                                         sales_view, untied_view)
