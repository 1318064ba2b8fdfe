"""Scalar functions on hand-written rows."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from ledgerloom.functions import codes
from ledgerloom.functions import scalars as S
from ledgerloom.operators import blocks as B
from ledgerloom.plans import ledger_queries
from ledgerloom.operators.reads import bounds


def apply(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", make(F.col("v")).alias("x")).orderBy("i").collect()
    return [r.x for r in rows]


def test_labels(spark):
    assert apply(spark, ["02", "2", "08", "8", "13", "09", "9", "10", "05", "5", "zz", None], S.block_type) == ["transfer", "transfer", "burnt", "unknown", "burnt_for_ft", "deploy", "deploy", "execute", "mint", "mint", "unknown", "unknown"]
    assert apply(spark, ["02", "2", "13", None], S.transaction_name) == ["Transfer", None, "BurntForFT", None]
    assert apply(spark, ["13", "08", "8", None], S.burn_label) == ["Burnt for FT", "Burnt", "Unknown", "Unknown"]
    assert apply(spark, ["transfer", "mint", "unknown", None], S.block_type_number) == [1, 6, 0, 0]


def test_lenient_numbers(spark):
    assert apply(spark, ["1.5", " 7x", "-2e2", "x", "", None, ".5"], S.lenient_double) == [1.5, 7.0, -200.0, 0.0, 0.0, None, 0.5]
    assert apply(spark, ["15", "7.9", "-3z", "x", None, "1.7E3"], S.lenient_long) == [15, 7, -3, 0, None, 1700]


def test_times(spark):
    ingest = F.timestamp_seconds(F.lit(99))
    assert apply(spark, ["1760004074", "2025-10-09T10:01:14Z", "soon", None], lambda c: F.unix_timestamp(S.block_time(c, ingest))) == [1760004074, 1760004074, 99, 99]
    assert apply(spark, ["1760004074", "2025-10-09T10:01:14Z", None], S.contract_time) == [datetime(2025, 10, 9, 10, 1, 14), None, None]
    assert apply(spark, ["Token burnt at : 2025-10-09 15:31:14", "2025-13-09 15:31:14", "none", None], S.burn_epoch) == [1760004074, None, None, None]


def test_maps(spark):
    assert apply(spark, [{"b": 1, "a": 2}, {}, None], S.json_map, "map<string,int>") == ['{"a":2,"b":1}', "{}", "null"]
    assert apply(spark, [{"b": 1, "a": 2}, {}, None], S.first_key, "map<string,int>") == ["a", None, None]


def test_ids_and_rounding(spark):
    assert apply(spark, ["Qmx", "bafyx", "tx", ""], S.id_kind) == ["token", "did", "transaction", "transaction"]
    assert apply(spark, [1.2345, -1.2345, 2.0], S.round3, "double") == [1.235, -1.235, 2.0]


def test_bounds():
    assert bounds(0, 0) == (0, 10) and bounds(3, 5) == (10, 5) and bounds(-1, -2) == (0, 10)


def test_whole_block_decoding(spark):
    block = {"2": "02", "5": {"1": "s", "6": {"QmX": {"4": "7", "deep": {"5": "p"}}}, "10": [{"4": "1"}]}, "98": "h", "epoch": 5, "4": {"2": {"1": 3}}, "free": 1}
    got = json.loads(apply(spark, [json.dumps(block), "{bad", None], B.decode_text)[0])
    assert got == {"TCTransTypeKey": "02", "TCTransInfoKey": {"TISenderDIDKey": "s", "TITokensKey": {"QmX": {"TTBlockNumberKey": "7", "deep": {"TTPreviousBlockIDKey": "p"}}}, "TICommitedTokensKey": [{"TTBlockNumberKey": "1"}]}, "TCBlockHashKey": "h", "TCEpoch": 5, "TCGenesisBlockKey": {"GBInfoKey": {"GITokenLevelKey": 3}}, "free": 1}
    assert apply(spark, ["{bad", None], B.decode_text) == [None, None]


def test_decode_known_fields(spark):
    texts = ['{"2":2,"98":"h","10":"5.5x","epoch":"77","5":{"4":"t","6":{"QmA":{"4":"3","5":"p"}}}}', '{"TCTransTypeKey":"10","TCTransInfoKey":{"TITIDKey":"t2"}}', "{bad", None]
    rows = B.decode(spark.createDataFrame([(t,) for t in texts], "value string")).collect()
    assert (rows[0].block_hash, rows[0].type_code, rows[0].amount_text, rows[0].txn_id, rows[0].tokens["QmA"].previous) == ("h", "2", "5.5x", "t", "p")
    assert (rows[1].block_hash, rows[1].type_code, rows[1].txn_id) == (None, "10", "t2")
    assert rows[2].block_hash is None and rows[3].block_hash is None
    kept, rejected = B.keyed(B.decode(spark.createDataFrame([(t,) for t in texts], "value string")))
    assert kept.count() == 1 and rejected.count() == 3


def test_key_dictionary():
    assert len(codes.BLOCK_KEYS) == 47 and codes.BLOCK_KEYS["5-10-4"] == codes.BLOCK_KEYS["5-6-4"]


def test_blocks_are_made_and_parsed_once(spark):
    """The second notification of a block is no second pass over all of them."""
    plan = ledger_queries.all_blocks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("l_orderkey#") and plan.count("from_json(") == 1
