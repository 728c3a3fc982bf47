"""A stored layout of the sales that makes feature windows local.

``store_sales`` writes each row with its position in its product, cut into
chunks, with the neighbouring rows that a window can reach, as a Parquet
table bucketed by (product, chunk) and sorted by position; every bucket is one
file.  Windows over (product, chunk) then read it without an exchange, however
often they run; a hot product is spread over as many buckets as it has chunks.
The extra rows are at most 37 of a chunk.

The rows of the sales are those with ``_chunk = _own_chunk`` (``layout_rows``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfcast.operators.sequence import DEFAULT_CHUNK_ROWS, chunked_window, finish_chunked, with_positions
from shelfcast.schema import HORIZONS, MAX_LOOKBACK

KEYS = ("product_id", "_chunk")
SORTED = (*KEYS, "pos")


def store_sales(sales: DataFrame, table: str, path: str, buckets: int, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Write ``sales`` as the external table ``table`` under ``path`` in ``buckets`` files and read it back.

    ``buckets`` should make files of 100 MB to 1 GB; ``table`` and ``path`` must be new.
    """
    rows, _ = chunked_window(with_positions(sales), lookback=MAX_LOOKBACK, lookahead=HORIZONS, chunk_rows=chunk_rows)
    (rows.repartition(buckets, *KEYS).sortWithinPartitions(*SORTED)
     .write.format("parquet").option("path", path).bucketBy(buckets, *KEYS).sortBy(*SORTED).saveAsTable(table))
    return sales.sparkSession.table(table)


def open_sales(spark: SparkSession, table: str, path: str, buckets: int) -> DataFrame:
    """A layout that another session has stored: its table, made known to this session's catalog where it is not."""
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({', '.join(f'`{k}`' for k in KEYS)}) "
                  f"SORTED BY ({', '.join(f'`{k}`' for k in SORTED)}) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def layout_rows(layout: DataFrame) -> DataFrame:
    """The sales rows of a layout, with ``pos`` and ``n_rows``."""
    return finish_chunked(layout)
