"""The full sync into keyed tables: what it rewrites, keeps and rejects, a merge that was cut off, and what lookups read."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import sync
from ledgerloom.plans.ledger_queries import load_time
from ledgerloom.sources import keyed, landed

SCHEMA = "id string, value string"


def files(folder):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def block(name, code, txn, token, **more):
    return {"2": code, "5": {"1": "s", "2": "r", "4": txn, "6": {token: {"4": "1", "5": "p"}}, "8": "d", "9": "e"}, "10": 1.5, "epoch": 1_700_000_000, **({"98": name} if name else {}), **more}


def chain(spark, **chains):
    return spark.createDataFrame([(t, json.dumps({"status": True, "blocks": b})) for t, b in chains.items()], "token_id string, value string")


def table(spark, folder, name, *columns):
    return sorted(tuple(r) for r in sync.synced(spark, folder, name).select(*columns).collect())


def test_sync_merges_routes_and_rejects(spark, tmp_path):
    folder = str(tmp_path / "out")
    types = spark.createDataFrame([("Qa", "RBT"), ("Qb", "RBT"), ("Qs", "SC")], "token_id string, token_type string")
    first = chain(spark, Qa=[block("t1", "02", "x1", "Qa"), block("b1", "08", "x2", "Qa"), block(None, "02", "lost", "Qa"), block("c1", "09", "x3", "Qa")], Qs=[block("c2", "10", "x4", "Qs"), block("t2", "02", "x5", "Qs")])
    done = sync.sync_chains(first, types, folder, load_time(), buckets=4)
    assert all(done.values()) and list(done) == ["AllBlocks", "TransferBlocks", "BurntBlocks", "SC_Blocks", "Rejects"]
    assert table(spark, folder, "AllBlocks", "block_hash", "txn_id") == [("b1", "x2"), ("c1", "x3"), ("c2", "x4"), ("t1", "x1"), ("t2", "x5")]
    assert table(spark, folder, "TransferBlocks", "block_hash", "txn_id") == [("t1", "x1")]  # t2 stands in a contract's chain only
    assert table(spark, folder, "BurntBlocks", "block_hash") == [("b1",)] and table(spark, folder, "SC_Blocks", "block_id", "executor_did") == [("c2", "e")]
    assert table(spark, folder, "Rejects", "reject_id", "pos") == [("Qa:2", 2)]
    before = files(folder)
    assert set(sync.sync_chains(first, types, folder, load_time(), buckets=4).values()) == {0} and files(folder) == before  # a second load rewrites nothing
    # one block in two chains, and again in one of them: the last place of the last token counts, AllBlocks keeps its row
    second = chain(spark, Qa=[block("t1", "02", "y1", "Qa"), block("t3", "02", "y3", "Qa"), block("t3", "02", "y4", "Qa")], Qb=[block("t1", "02", "y2", "Qb")])
    done = sync.sync_chains(second, types, folder, load_time(), buckets=4)
    assert done["BurntBlocks"] == done["SC_Blocks"] == done["Rejects"] == 0 and 1 <= done["TransferBlocks"] <= 2 and done["AllBlocks"] == 1
    assert table(spark, folder, "TransferBlocks", "block_hash", "txn_id") == [("t1", "y2"), ("t3", "y4")]
    assert table(spark, folder, "AllBlocks", "block_hash", "txn_id") == [("b1", "x2"), ("c1", "x3"), ("c2", "x4"), ("t1", "x1"), ("t2", "x5"), ("t3", "y3")]


def test_merge_against_plain_dictionaries(spark, tmp_path):
    rng, held = random.Random(1), {"first": {}, "last": {}}
    for _ in range(4):
        rows = {f"k{rng.randrange(60)}": rng.choice(["a", "b", None]) for _ in range(rng.choice([0, 3, 40]))}
        df = spark.createDataFrame([*rows.items(), (None, "x")], SCHEMA)
        for keep, mine in held.items():
            folder = str(tmp_path / keep)
            n = keyed.merge(df, folder, SCHEMA, "id", keep, buckets=8)
            news = {k: v for k, v in rows.items() if (k not in mine if keep == "first" else k not in mine or mine[k] != v)}
            assert (n == 0) == (not news) and n <= min(8, len(news))
            mine.update(news)
            assert {r.id: r.value for r in keyed.read(spark, folder, SCHEMA).collect()} == mine


def test_merge_that_was_cut_off(spark, tmp_path, monkeypatch):
    """The driver is lost after the new partitions are prepared and their old files are gone: the next merge finishes it first."""
    folder = str(tmp_path / "t")
    keyed.merge(spark.range(100).selectExpr("cast(id AS string) AS id", "'old' AS value"), folder, SCHEMA, "id", "last", buckets=4)
    with monkeypatch.context() as m:
        real, calls = keyed.finish, []
        m.setattr(keyed, "finish", lambda *a: real(*a) if not calls.append(1) and len(calls) == 1 else None)
        keyed.merge(spark.range(50, 150).selectExpr("cast(id AS string) AS id", "'new' AS value"), folder, SCHEMA, "id", "last", buckets=4)
    for f in files(f"{folder}/bucket=1"):
        os.remove(f)
    assert keyed.merge(spark.createDataFrame([("7", "newest")], SCHEMA), folder, SCHEMA, "id", "last", buckets=4) == 1
    wanted = {str(k): "old" if k < 50 else "new" for k in range(150)} | {"7": "newest"}
    assert {r.id: r.value for r in keyed.read(spark, folder, SCHEMA).collect()} == wanted


def scanned(df):
    """Files and rows that the scans of a query read."""
    df = df.select("*")  # a plan of its own: metrics count once
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan
    leaves, n, rows = plan.collectLeaves(), 0, 0
    for k in range(leaves.size()):
        metrics = leaves.apply(k).metrics()
        if metrics.contains("numFiles"):
            n, rows = n + metrics.apply("numFiles").value(), rows + metrics.apply("numOutputRows").value()
    return n, rows


@pytest.mark.parametrize("few", [1000, 1])
def test_lookup_reads_its_partitions(spark, tmp_path, few):
    folder = str(tmp_path / "t")
    keyed.merge(spark.range(20_000).selectExpr("cast(id AS string) AS id", "concat('v', id) AS value"), folder, SCHEMA, "id", "last", buckets=16)
    ids = spark.createDataFrame([("5",), ("77",), ("77",), ("none",), (None,)], "id string")
    got = keyed.lookup(spark, folder, SCHEMA, "id", ids, 16, few)
    assert got.columns == ["id", "value"] and sorted(map(tuple, got.collect())) == [("5", "v5"), ("77", "v77")]
    if few == 1000:
        n, rows = scanned(got)
        assert 1 <= n <= 3 and rows <= 3 * 20_000 / 16 * 1.3
    assert keyed.lookup(spark, folder, SCHEMA, "id", ids.limit(0), 16, few).count() == 0


def test_repeated_answers_multiply_no_transfer(spark):
    from ledgerloom.operators import reads as R
    from ledgerloom.sources import landed

    answer = lambda txn, v, ok=True: json.dumps({"status": ok, "result": {"TransactionID": txn, "TransactionValue": v}})
    texts = spark.createDataFrame([(answer("a", 5.0), 1), (answer("a", 7.0), 3), (answer("a", 6.0), 2), (answer("a", 9.0, False), 4), (answer("b", None), 5)], "value string, arrival int")
    amounts = landed.read_amounts(texts)
    assert [tuple(r) for r in amounts.collect()] == [("a", 7.0)]
    transfers = spark.createDataFrame([("h1", "a", None, 10), ("h2", "a", 3.0, 11), ("h3", "", None, 12)], "block_hash string, txn_id string, amount double, epoch long").withColumns({c: F.lit(None).cast("string") for c in ("sender_did", "receiver_did", "txn_type")})
    many = amounts.unionAll(amounts.withColumn("txn_value", F.lit(6.5)))  # a table that holds a transaction twice
    for known in (amounts, many):
        assert sorted((r.block_hash, r.amount) for r in R.backfill(transfers, known).collect()) == [("h1", 7.0), ("h2", 7.0), ("h3", None)]
        assert sorted((r.block_hash, r.amount, r["count"]) for r in R.transfer_page(transfers, known, 1, 10).collect()) == [("h1", 7.0, 3), ("h2", 3.0, 3), ("h3", 0.0, 3)]


def test_a_sync_leaves_only_its_tables(spark, tmp_path, monkeypatch):
    """What a sync writes on the way is deleted, for one table (which needs no copy of the blocks) and for all."""
    types = spark.createDataFrame([("Qa", "RBT"), ("Qs", "sc")], "token_id string, token_type string")
    chains = chain(spark, Qa=[block("t1", "02", "x1", "Qa"), block("c1", "09", "x3", "Qa")], Qs=[block("c2", "10", "x4", "Qs"), block("t2", "02", "x5", "Qs")])
    made = []
    for module in (landed, keyed):
        monkeypatch.setattr(module, "new_folder", lambda spark, name: made.append(f"{tmp_path}/way/{name}-{len(made)}") or made[-1])
    for sinks in (("TransferBlocks",), ("SC_Blocks",), (*sync.SINKS, "Rejects")):
        sync.sync_chains(chains, types, str(tmp_path / "out"), load_time(), sinks, buckets=4)
    assert table(spark, str(tmp_path / "out"), "TransferBlocks", "block_hash") == [("t1",)] and table(spark, str(tmp_path / "out"), "SC_Blocks", "block_id") == [("c2",)]
    assert made and files(tmp_path / "way") == [] and sum("sync-blocks" in m for m in made) == 1


def test_routed_sinks_parse_their_own_texts(spark, tmp_path, monkeypatch):
    """A load of routed tables alone parses no text that can't have one of their codes, and only the fields that they need."""
    seen, decode = [], sync.B.decode

    def noted(blocks, text, only):
        seen.append((blocks.count(), set(only)))
        return decode(blocks, text, only)

    monkeypatch.setattr(sync.B, "decode", noted)
    types = spark.createDataFrame([("Qa", "RBT")], "token_id string, token_type string")
    rows = chain(spark, Qa=[block("t1", "02", "x1", "Qa"), block("b1", "08", "x2", "Qa"), block("b2", 13, "x3", "Qa"), block("c1", "09", "x4", "Qa")])
    sync.sync_chains(rows, types, str(tmp_path / "out"), load_time(), ("BurntBlocks",), buckets=4)
    assert seen == [(2, {"block_hash", *sync.NEEDS["BurntBlocks"]})]
    assert table(spark, str(tmp_path / "out"), "BurntBlocks", "block_hash") == [("b1",), ("b2",)]
    sync.sync_chains(rows, types, str(tmp_path / "all"), load_time(), buckets=4)
    assert seen[1][0] == 4 and table(spark, str(tmp_path / "all"), "AllBlocks", "block_hash") == [("b1",), ("b2",), ("c1",), ("t1",)]
