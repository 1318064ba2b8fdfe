"""Jobs parse and move what they ask for only, with the same results on odd texts."""

import os

from pyspark.sql import functions as F

import __spark_entry__
from ledgerloom.operators import blocks as B
from ledgerloom.operators import owners as O
from ledgerloom.operators import reads as R
from ledgerloom.streaming import streams

ODD = ['{"2":"08","98":"h","epoch":1,"5":{"4":"t","6":{"Q":{"4":"1","5":"p"}}}}', '{"2":13,"98":"h"}', '{"98":"h","2" :\t13}', "{'2':'08','98':'h'}", '{"2":"\\u0030\\u0038"}', '{"\\u0032":"13"}', '{"TCTransTypeKey" :\n"08"}', '{"2":"08","98":"h","5":"none"}', '{"2":"08","5":{"6":[1],"4":"t"}}', '{"2":"08","98":"h" broken', '{"2":"08","98":"h"} tail', '[{"2":"08"}]', '{"2":["08"]}', '{"2":13.0}', '{"2":null,"TCTransTypeKey":"08"}', '{"2":2,"98":"h"}', '{"2":"9"}', '{"2":10,"10":{"2":"08"}}', '{"5":{"2":"08"}}', '{"2":"08","2":"02"}', '{"2":"02","2":"08"}', "no", "", None]


def rows(df, columns):
    return [tuple(map(str, r)) for r in df.orderBy("i").select("i", *columns).collect()]


def odd(spark):
    return spark.createDataFrame(list(enumerate(ODD)), "i int, value string")


def test_other_routes_are_left_unparsed(spark):
    whole = B.route(B.decode(odd(spark)))
    columns = [c for c in whole.columns if c not in ("i", "value")]
    for route, n in (("transfer", 1), ("burnt", 9), ("deploy", 1), ("execute", 1)):
        got, due = rows(B.with_routes(odd(spark), route), columns), rows(whole.where(F.col("route") == route), columns)
        assert got == due and len(got) >= n, route
    plain = spark.createDataFrame([(0, '{"2":"02","98":"08"}'), (1, '{"2":"08","98":"h"}')], "i int, value string")
    plan = B.with_routes(plain, "burnt")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("from_json") < plan.index("08|13")  # the filter is below the parser


def test_only_asked_fields_are_parsed(spark):
    whole = B.decode(odd(spark))
    for only in (B.ALL_FIELDS, B.BURN_FIELDS, ("type_code",), ("tokens",), ("prev_block_id", "pledges")):
        few = B.decode(odd(spark), only=only)
        assert sorted(few.columns) == sorted(["i", "value", *only])
        assert rows(few, only) == rows(whole, only)
    assert "TCPledgeDetailsKey" not in B.decode(odd(spark), only=B.ALL_FIELDS)._jdf.queryExecution().optimizedPlan().toString()


def test_analytics_in_one_pass(spark):
    types = spark.createDataFrame([("a", "RBT"), ("b", "FT"), ("c", "RBT")], "token_id string, token_type string")
    told = [("h1", 3600, 1.5, ["a", "c"]), ("h2", 3700, 2.0, ["a", "b"]), ("h3", 3700, None, ["x"]), ("h4", 9000, 4.0, None), ("h5", 9000, 5.0, []), ("h6", 0, 1.0, ["a"]), ("h7", None, 1.0, ["a"]), ("h8", 9000, 1.0, ["x", None, "a"]), (None, 9000, 7.0, ["a"]), (None, 9000, 7.0, ["b"])]
    blocks = spark.createDataFrame(told, "block_hash string, epoch bigint, amount double, token_ids array<string>")
    due = R.analytics(blocks.drop("token_ids"), blocks.select("block_hash", F.explode("token_ids").alias("token_id")), types)
    got = R.analytics_in_one_pass(blocks, types)
    assert got.schema == due.schema
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, due.collect()))


def test_counts_write_no_table(spark):
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(base))
    assert __spark_entry__.queries()["ledger_counts"](spark, "/root/testdata/sf0.001").count() == 1
    assert set(os.listdir(base)) == before


def test_totals_need_few_columns(spark):
    row = spark.createDataFrame([("QmR1", "d", "b", "1", 2.5, 0)], "rbt_id string, owner_did string, block_id string, block_height string, token_value double, token_status int")
    assert O.counted(row, "rbt_id").columns == ["rbt_id", "owner_did", "token_value", "token_status"]
    assert O.rbt_totals(O.counted(row, "rbt_id")).collect() == O.rbt_totals(row).collect()


def test_lines_are_numbered_after_decoding(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(['{"2":"02","98":"h","5":{"4":"t1"}}', "", "bad", '{"2":"02","98":"h","5":{"4":"t2"}}', '{"2":"13","98":"g","5":{"4":"t3"}}']))
    source = str(tmp_path / "in")
    assert streams.texts(spark, source, only=B.ALL_FIELDS).columns == [*(c for c in B.decode(odd(spark)).columns if c in B.ALL_FIELDS), "arrival"]
    got = streams.first_blocks(spark, source, f"file://{tmp_path}/out", F.timestamp_seconds(F.lit(0)))
    assert sorted((r.block_hash, r.txn_id) for r in got.collect()) == [("g", "t3"), ("h", "t1")]
