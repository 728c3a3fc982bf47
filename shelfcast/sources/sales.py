"""Sales scan: explicit schema, snake_case columns, one rename at the scan.

A missing path raises ``AnalysisException`` from Spark itself.  Rows are not
sorted here: order only matters inside per-product windows, which carry
their own total ordering (``order_columns``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.schema import CSV_HEADERS, DEFAULT_INVENTORY, SALES

# Tie-breakers that make the per-product order total when present.
TIE_BREAKERS = ("src_order", "src_line")


DATE_FORMATS = ("yyyy-MM-dd", "M/d/yyyy")


def _parsed(raw: Column, name: str, kind: str, date_formats: tuple[str, ...], bad: str) -> Column:
    """A text column as ``kind``; blank is NULL, and a value that does not parse fails the job or (``bad="null"``) is NULL."""
    text = F.nullif(F.trim(raw), F.lit(""))
    value = (F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in date_formats]) if kind == "date"
             else text.try_cast(kind))
    if bad == "null":
        return value
    message = F.concat(F.lit(f"sales file: no {kind} in column {name}: "), text)
    return F.when(text.isNull() | value.isNotNull(), value).otherwise(F.raise_error(message).cast(kind))


def read_sales(spark: SparkSession, path: str, fmt: str | None = None, date_formats: tuple[str, ...] = DATE_FORMATS,
               bad: str = "fail") -> DataFrame:
    """Read a sales file: CSV with the original headers, or Parquet/JSON.

    CSV dates take the first of ``date_formats`` that fits.  A value that is there but does not
    parse fails the job, so no row loses its place in a product's order unseen;
    ``bad="null"`` reads it as missing.
    """
    if bad not in ("fail", "null"):
        raise ValueError("bad must be 'fail' or 'null'")
    fmt = fmt or ("csv" if path.lower().endswith(".csv") else "parquet")
    if fmt == "csv":
        # header names only: no inference pass
        raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
        by_header = {v: k for k, v in CSV_HEADERS.items()}
        cols = []
        for c in raw.columns:
            name = by_header.get(c, c if c in CSV_HEADERS else None)
            if name is not None:
                kind = SALES[name].dataType.simpleString()
                cols.append(_parsed(F.col(f"`{c}`"), c, kind, date_formats, bad).alias(name))
        return normalise_sales(raw.select(*cols))
    return normalise_sales(spark.read.format(fmt).load(path))


def normalise_sales(df: DataFrame) -> DataFrame:
    """Cast to ``SALES``; absent optional columns become typed literals.

    * ``inventory_level`` defaults to 100 only when the *column* is absent
      (a missing value stays NULL).
    * float NaN becomes NULL once here, since Spark ``avg`` propagates NaN.
    """
    present = set(df.columns)
    cols = []
    for f in SALES.fields:
        if f.name in present:
            c = F.col(f.name).cast(f.dataType)
            if isinstance(f.dataType, T.DoubleType):
                c = F.when(~F.isnan(c), c)
        elif f.name == "inventory_level":
            c = F.lit(DEFAULT_INVENTORY).cast(f.dataType)
        elif f.nullable:
            c = F.lit(None).cast(f.dataType)
        else:
            raise ValueError(f"sales data lacks required column {f.name!r}")
        cols.append(c.alias(f.name))
    extra = [F.col(c) for c in TIE_BREAKERS if c in present]
    return df.select(*cols, *extra)


def order_columns(df: DataFrame) -> list[str]:
    """Total order inside one product: date, then the tie-breakers; a table without any is ordered by its other columns,
    store first, so only rows that are equal throughout are left in no order."""
    ties = [c for c in TIE_BREAKERS if c in df.columns]
    if ties:
        return ["date", *ties]
    known = [f.name for f in SALES if f.name in df.columns and f.name not in ("date", "product_id")]
    return ["date", *known, *sorted(c for c in df.columns if c not in SALES.fieldNames())]
