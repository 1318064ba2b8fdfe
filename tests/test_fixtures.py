"""Landed texts keep a bounded size however many rows there are."""

from pyspark.sql import functions as F

from ledgerloom.sources import fixtures, landed

DATA = "/root/testdata/sf0.001"


def test_lists_are_bounded(spark):
    rows = spark.range(40_000).select(F.col("id").alias("num"), F.col("id").cast("string").alias("token"))
    texts = fixtures.list_texts(rows, {"TokenID": "token"})
    sizes = [r.n for r in texts.select(F.size(F.from_json("value", "Result array<struct<TokenID: string>>")["Result"]).alias("n")).collect()]
    assert max(sizes) <= 1000 and sum(sizes) == 40_001
    assert landed.list_items(texts, "RBT").select("TokenID").distinct().count() == 40_000


def test_chains_in_parts(spark):
    """Parts of 50 numbers give the same chains as one part."""
    texts = fixtures.chain_texts(spark, DATA, 50)
    blocks = landed.explode_chains(texts).persist()
    assert texts.count() > texts.select("token_id").distinct().count()
    whole = landed.explode_chains(fixtures.chain_texts(spark, DATA, 1 << 40))
    assert blocks.count() > 0 and blocks.exceptAll(whole).count() == whole.exceptAll(blocks).count() == 0
    part = landed.explode_chains(texts.select("token_id", "first", "value")).groupBy("token_id").agg(F.max("pos").alias("last"), F.countDistinct("pos").alias("n"))
    assert part.where("last <> n - 1").count() == 0
    held = F.from_json("value", "TokenChainData array<string>, blocks array<string>")
    assert texts.agg(F.max(F.size(F.coalesce(held["TokenChainData"], held["blocks"])))).first()[0] <= 50


def test_few_parts(spark):
    """A token's blocks are cut where they are too many, not where their numbers are far apart: at this size one part holds a token's chain."""
    texts = fixtures.chain_texts(spark, DATA)
    assert texts.count() == texts.select("token_id").distinct().count() and texts.agg(F.max("first")).first()[0] == 0


def test_chains_are_shuffled_without_texts(spark):
    """Orders go to their spans once for each token, and become texts there: no text is made below that shuffle."""
    plan = fixtures.chain_texts(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    before, _, after = plan.partition("Exchange hashpartitioning(token_id")
    assert "structstojson" in before.lower() and "structstojson" not in after.lower()
