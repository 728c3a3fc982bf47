"""Intent goldens (FIXTURES.md §5)."""

from pyspark.sql import functions as F

from shelfcast.functions.text import detect_intent

GOLDEN = [
    ("What is the current risk level and why?", "risk"),
    ("Do I need to reorder? How much?", "reorder"),
    ("What's the forecast for next week?", "forecast"),
    ("Is a stockout a risk?", "risk"),
    ("Predict demand and tell me the risk", "forecast"),
    ("Who is at the border?", "reorder"),
    ("Give me a summary", "summary"),
    ("Analyze the sales trend", "summary"),
]


def test_intent_goldens(spark):
    df = spark.createDataFrame(GOLDEN, "query string, want string")
    got = df.select("want", detect_intent(F.col("query")).alias("got")).collect()
    assert all(r.want == r.got for r in got), got
