"""What is parsed is parsed once: plans hold one parser for each text that they read."""

from pyspark.sql import functions as F

from ledgerloom.operators import blocks as B
from ledgerloom.sources import landed


def parsers(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("from_json(")


def test_an_amount_is_parsed_once(spark):
    told = spark.createDataFrame([('{"status":true,"result":{"TransactionID":"t1","TransactionValue":2.5}}', 0), ('{"status":true,"result":{"TransactionID":"t1","TransactionValue":1.5}}', 1), ('{"status":false,"result":{"TransactionID":"t1","TransactionValue":9}}', 2), ('{"status":true,"result":{"TransactionID":null,"TransactionValue":9}}', 2), ("no", 3), (None, 3)], "value string, arrival int")
    rows = landed.read_amounts(told)
    assert parsers(rows) == 1
    assert [tuple(r) for r in rows.collect()] == [("t1", 1.5)]


def test_contract_blocks_are_parsed_once(spark):
    text = '{"2":"%s","98":"%s","epoch":60,"5":{"8":"d","9":"e","6":{"QmS1":{"4":"7","5":"p"}}}}'
    texts = spark.createDataFrame([(text % x,) for x in (("09", "b1"), ("10", "b2"), ("02", "b3"))] + [(None,)], "value string")
    rows = B.contract_blocks(B.route(B.decode(texts)))
    assert parsers(rows) == 1
    got = rows.withColumn("epoch", F.unix_timestamp("epoch")).orderBy("block_id").collect()
    assert [(r.block_id, r.contract_id, r.block_height, r.executor_did, r.owner_did) for r in got] == [("b1", "QmS1", 7, None, "d"), ("b2", "QmS1", 7, "e", "")]
