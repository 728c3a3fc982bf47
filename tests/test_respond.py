"""Routing of messages: intents pick the parts; unknown products get the
missing-data texts (the test tables only ask about known products)."""

from pyspark.sql import functions as F

from shelfcast.catalog import _context
from shelfcast.operators.context import respond
from tests.conftest import SF_SMALL


def test_respond_parts_and_unknown_products(spark):
    ctx = _context(spark, SF_SMALL)
    known = ctx.select("sku").orderBy("sku").first().sku
    msgs = spark.createDataFrame([
        (1, known, "What is the forecast for next week?"),
        (2, known, "Do I need to reorder?"),
        (3, known, "Any risk?"),
        (4, known, "hello"),
        (5, "NOPE", "What is the forecast?"),
        (6, "NOPE", "Should I restock?"),
        (7, "NOPE", "Is it critical?"),
        (8, "NOPE", "status please"),
    ], "message_id long, product_id string, query string")
    got = {r.message_id: r for r in respond(msgs, ctx).collect()}
    assert got[1].intent == "forecast" and got[1].forecast is not None and got[1].inventory is None
    assert got[1].response_text.startswith("7-day demand forecast generated.")
    assert got[2].intent == "reorder" and got[2].inventory is not None and got[2].alerts is None
    assert got[3].intent == "risk" and got[3].alerts is not None and got[3].forecast is None
    assert got[4].intent == "summary" and got[4].response_text.startswith("OPERATIONAL SUMMARY\nForecast: ")
    assert got[5].response_text == "Cannot generate forecast without latest data."
    assert got[6].response_text == ("Cannot generate inventory recommendation without forecast "
                                    "and inventory data.")
    assert got[7].response_text == got[6].response_text
    assert got[8].response_text == "Unable to generate summary without forecast."
    assert all(got[i].forecast is None and got[i].inventory is None for i in (5, 6, 7, 8))


def test_missing_stock_gives_error_not_health(spark):
    from shelfcast.operators.context import prompt_context
    ctx = _context(spark, SF_SMALL)
    sku = ctx.select("sku").orderBy("sku").first().sku
    gone = ctx.where(F.col("sku") == sku)
    for c in ("current_inventory", "_inv_rounded"):
        gone = gone.withColumn(c, F.lit(None).cast("double"))
    msgs = spark.createDataFrame([(1, sku, "forecast?"), (2, sku, "reorder?"), (3, sku, "risk?"), (4, sku, "summary")],
                                 "message_id long, product_id string, query string")
    got = {r.message_id: r for r in respond(msgs, gone).collect()}
    assert got[1].error is None and got[1].forecast is not None
    for i in (2, 3, 4):
        assert got[i].error and got[i].inventory is None and got[i].alerts is None
        assert got[i].response_text.startswith("Cannot generate inventory recommendation")
    assert "Current Inventory: unknown" in prompt_context(gone).first().prompt
