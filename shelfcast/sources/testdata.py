"""Views over the driver's TPC-H-like test tables (see FIXTURES.md §2).

``sales_view`` maps lineitem/part/supplier/nation/region to the sales
schema; columns without a natural source are deterministic stand-ins.
``messages_view`` maps ``events`` to user questions about products.

Join plan (designed for a 100 TB lineitem):

* nation and region are fixed 25- and 5-row tables, so they are broadcast
  explicitly; that bound holds at every scale factor.
* supplier (grows with the data) and part (grows with the data) are joined
  with plain equi-joins: AQE broadcasts them while they are under
  ``spark.sql.autoBroadcastJoinThreshold`` and falls back to a sort-merge
  join (with skew splitting) beyond it.  No unchecked ``broadcast()``.
  supplier is joined by itself and nation_region after it: the estimated size of
  a join is the product of its sides', so supplier joined to nation first would
  never look small enough, and every scan would shuffle lineitem for it.
* lineitem is pruned to the 11 columns used, so the scan reads only them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.sources.sales import normalise_sales


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _padded(prefix: str, k, width: int) -> F.Column:
    """``prefix`` + key zero-padded to ``width`` digits (never truncated).

    ``lpad`` stays in generated code; ``format_string`` would call Java's
    formatter once per row.
    """
    s = k.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0")))


def product_key(k) -> F.Column:
    """``P`` + zero-padded key (at least 6 digits)."""
    return _padded("P", k, 6)


def store_key(k) -> F.Column:
    return _padded("S", k, 4)


def sales_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales table over the test tables: a lazy join, so changed input is seen at once."""
    return build_sales_view(spark, sf_dir)


def materialize_sales(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """Write the joined view to ``path`` (the caller's, shared by the cluster) and read it back.

    For users who run many jobs over one state of the tables; ``read_sales`` takes the path.
    """
    build_sales_view(spark, sf_dir).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def input_stamp(spark: SparkSession, sf_dir: str) -> str:
    """Digest of the sales tables' files (path, size, time), through Spark's file systems."""
    import hashlib

    conf = spark.sparkContext._jsc.hadoopConfiguration()
    stamp = []
    for t in ("lineitem", "part", "supplier", "nation", "region"):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{t}.parquet")
        for f in path.getFileSystem(conf).listStatus(path):
            stamp.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha1("|".join(sorted(stamp)).encode()).hexdigest()[:16]


def build_sales_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
        "l_linestatus", "l_shipdate")
    part = load_table(spark, sf_dir, "part").select(
        "p_partkey", "p_type", "p_size", "p_retailprice")
    nation = load_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = load_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    supplier = load_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")

    nation_region = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    joined = (li.join(part, li.l_partkey == part.p_partkey)
              .join(supplier, li.l_suppkey == supplier.s_suppkey)
              .join(F.broadcast(nation_region), supplier.s_nationkey == nation_region.n_nationkey))

    dbl = lambda v: F.lit(v).cast("double")
    sales = joined.select(
        F.col("l_shipdate").cast("date").alias("date"),
        product_key(F.col("l_partkey")).alias("product_id"),
        store_key(F.col("l_suppkey")).alias("store_id"),
        F.col("p_type").alias("category"),
        F.col("r_name").alias("region"),
        F.when(F.col("p_size") % 10 == 0, dbl(0))
         .otherwise(F.col("p_size").cast("double") * dbl(10)).alias("inventory_level"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), dbl(0))
         .otherwise(F.col("l_quantity")).alias("units_sold"),
        (F.col("l_linenumber").cast("double") * dbl(10)).alias("units_ordered"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_discount").alias("discount"),
        F.when(F.col("l_returnflag") == "A", dbl(1)).otherwise(dbl(0)).alias("promotion"),
        F.col("p_retailprice").alias("competitor_pricing"),
        F.when(F.col("l_linestatus") == "F", dbl(1)).otherwise(dbl(0)).alias("epidemic"),
        (F.col("l_quantity") * (dbl(1) + F.col("l_tax"))).alias("demand"),
        F.col("l_orderkey").alias("src_order"),
        F.col("l_linenumber").alias("src_line"),
    )
    return normalise_sales(sales)


def untied_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales as a plain file gives them: no tie-breakers, dates and products missing in places, many equal rows.

    Ten products, quarters and rounded values make the rows; every 97th order lacks its date, every 89th its product.
    """
    li = load_table(spark, sf_dir, "lineitem")
    order = F.col("l_orderkey")
    return normalise_sales(li.select(
        F.when(order % 97 != 0, F.trunc(F.col("l_shipdate").cast("date"), "quarter")).alias("date"),
        F.when(order % 89 != 0, product_key(F.col("l_partkey") % 10)).alias("product_id"),
        store_key(F.col("l_suppkey") % 3).alias("store_id"),
        F.when(F.col("l_linenumber") > 1, F.floor(F.col("l_quantity") / 10).cast("double")).alias("units_sold")))


def gaps_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales view with a fixed share of missing stock, prices and units."""
    order = F.col("src_order")
    return sales_view(spark, sf_dir).withColumns({
        "inventory_level": F.when(order % 5 != 0, F.col("inventory_level")),
        "price": F.when(order % 7 != 0, F.col("price")),
        "units_sold": F.when(order % 3 != 0, F.col("units_sold"))})


def requests_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested rows over the events: older than the history, inside it, newer, for unknown products, and repeated."""
    ev = load_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    inside = F.date_add(F.lit("1995-01-02").cast("date"), (F.col("user_id") * 17 % 2500).cast("int"))
    date = (F.when(F.col("event_type") == "purchase", inside).when(F.col("event_type") == "view", F.date_add(inside, 400))
            .when(F.col("event_type") == "click", F.lit("2001-12-01").cast("date"))
            .when(F.col("event_type") == "error", F.lit("1994-01-01").cast("date")).otherwise(F.lit("1998-06-15").cast("date")))
    return ev.select(F.col("event_id").alias("request_id"), product_key(F.col("user_id") * 15).alias("product_id"), date.alias("date"),
                     F.floor("value").cast("double").alias("units_sold"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("price"))


# Question text per event type of the messages view.
MESSAGE_TEXT = {
    "purchase": "Do I need to reorder? How much?",
    "error": "What is the current risk level and why?",
    "view": "What is the forecast for next week?",
    "click": "Give me a summary",
}
MESSAGE_DEFAULT = "hello there"


def messages_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    text = F.lit(MESSAGE_DEFAULT)
    for kind, q in reversed(list(MESSAGE_TEXT.items())):
        text = F.when(F.col("event_type") == kind, F.lit(q)).otherwise(text)
    return ev.select(
        F.col("event_id").alias("message_id"),
        product_key(F.col("user_id")).alias("product_id"),
        text.alias("query"),
    )
