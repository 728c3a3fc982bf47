"""One product holding a third of all rows: the chunked path is exact."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfcast.operators.features import feature_frame
from shelfcast.sources import sales_view
from tests.conftest import SF_SMALL

COLS = ["product_id", "date", "src_order", "src_line", "pos", "n_rows", "lag_1", "lag_30",
        "rolling_mean_30", "rolling_std_14", "demand_t1", "demand_t7"]


def test_hot_product_chunked_equals_direct(spark):
    s = sales_view(spark, SF_SMALL)
    n = s.count()
    ids = [r.product_id for r in s.select("product_id").distinct().orderBy("product_id").collect()]
    cut = ids[len(ids) // 3]
    # relabel the first third of the products as one hot product; keep the
    # order total by folding the old key into the line tie-breaker
    hot = s.withColumn("src_line", (F.col("src_line").cast("long") * 1000000
                                    + F.substring("product_id", 2, 6).cast("long")).cast("long")) \
           .withColumn("product_id", F.when(F.col("product_id") < cut, F.lit("HOT"))
                       .otherwise(F.col("product_id")))
    hot_rows = hot.where(F.col("product_id") == "HOT").count()
    assert hot_rows > n // 4
    chunked = feature_frame(hot, chunk_rows=97).select(*COLS)      # HOT spans many chunks
    direct = feature_frame(hot, chunk_rows=10 ** 9).select(*COLS)  # one window per product
    assert chunked.count() == n
    assert chunked.exceptAll(direct).count() == 0 and direct.exceptAll(chunked).count() == 0
    plan = chunked._jdf.queryExecution().executedPlan().toString()
    assert "_chunk" in plan


def test_missing_dates_units_and_a_hot_day(spark):
    """No chunk size loses or moves a row: missing dates, missing units, one day with most rows."""
    import datetime as dt
    import random
    rnd = random.Random(2)
    rows = [(None if rnd.random() < .05 else dt.date(2024, 1, 1) + dt.timedelta(days=5 if rnd.random() < .4 else rnd.randint(0, 90)),
             p, "s", None if rnd.random() < .1 else float(rnd.randint(0, 50)), rnd.randint(0, 10**6) if rnd.random() < .95 else None, i)
            for p in ("A", "B") for i in range(300)]
    df = spark.createDataFrame(rows, "date date, product_id string, store_id string, units_sold double, src_order long, src_line int")
    out = [sorted(map(str, feature_frame(df, chunk_rows=c, calendar=False).collect())) for c in (40, 97, 10**9)]
    assert len(out[0]) == 600 and out[0] == out[1] == out[2]
    plain = Window.partitionBy("product_id").orderBy("date", "src_order", "src_line")
    cols = ["date", "product_id", "src_line", "pos", "lag_7"]
    want = df.select("*", F.row_number().over(plain).cast("long").alias("pos"), F.lag("units_sold", 7).over(plain).alias("lag_7"))
    got = feature_frame(df, chunk_rows=97, calendar=False)
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_a_busy_day_is_cut_by_sampled_keys(spark):
    """Any splitter count gives the same rows, and no range of a day with most rows is over the stated size, for string and skewed keys."""
    import datetime as dt
    import random
    from shelfcast.operators import sequence
    rnd = random.Random(5)
    day = dt.date(2024, 5, 1)
    rows = [(day if rnd.random() < .8 else day + dt.timedelta(days=rnd.randint(1, 9)), rnd.choice(["A"] * 5 + ["B"]),
             f"S{int(rnd.expovariate(0.004)):06d}", float(rnd.randint(0, 10**6))) for _ in range(6000)]
    df = spark.createDataFrame(rows, "date date, product_id string, store_id string, units_sold double")
    plain = Window.partitionBy("product_id").orderBy("date", "store_id", "units_sold")
    want = sorted(map(str, df.withColumn("pos", F.row_number().over(plain).cast("long")).collect()))
    for day_rows in (10**6, 2000, 300, 40):
        got = sequence.with_positions(df, day_rows=day_rows)
        assert sorted(map(str, got.drop("n_rows").collect())) == want
        marked = df.withColumn("_day", F.datediff("date", F.lit("1970-01-01")))
        ties = ["store_id", "units_sold"]
        _, cuts = sequence._cuts_of_days(marked, ties, day_rows, F.lit(1))
        ranges = marked.join(cuts, list(sequence.AT_DAY), "left").groupBy(*sequence.AT_DAY, sequence._range_of(F.col("_cuts"), F.struct(*ties)).alias("r"))
        sizes = sorted(r["count"] for r in ranges.count().collect())
        assert sizes[-1] <= day_rows and (day_rows > 4000 or len(sizes) > 4000 // day_rows)


def test_rows_without_a_number_take_the_one_before(spark):
    import datetime as dt
    from shelfcast.operators.sequence import with_positions
    rows = [("A", dt.date(2024, 1, d), k, bool(c)) for d, k, c in [(1, 0, 0), (1, 1, 1), (2, 0, 1), (2, 1, 0), (2, 2, 0), (3, 0, 1), (4, 0, 0)]]
    df = spark.createDataFrame(rows, "product_id string, date date, src_order int, real boolean")
    for day_rows in (10**6, 1):
        got = with_positions(df, ["date", "src_order"], day_rows, F.col("real")).orderBy("date", "src_order").collect()
        assert [r.pos for r in got] == [0, 1, 2, 2, 2, 3, 3] and {r.n_rows for r in got} == {3}
