"""Live jobs: order of arrival, cost of a batch, folders that logs keep, and state against the batch replay."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import blocks as B
from ledgerloom.operators import changes as C
from ledgerloom.operators import reads as R
from ledgerloom.plans.ledger_queries import load_time
from ledgerloom.streaming import logs, streams
from tests.test_streams import block, land


@pytest.mark.parametrize("together", [1, 50])
def test_lines_arrive_as_they_stand(spark, tmp_path, together):
    """Two lines of one hash in one file, in both orders, and a line in a later file of the same batch: AllBlocks keeps the first, TransferBlocks the last."""
    files = [[block("a", 1, "z"), block("a", 1, "b"), block("b", 1, "b"), block("b", 1, "z")], *[[block(f"x{k}", 1, "t")] for k in range(9)], [block("c", 1, "z")], [block("c", 1, "b")]]
    out = str(tmp_path / "out")
    streams.route_blocks(spark, land(tmp_path / "in", *files), out, load_time(), together)
    first = {r.block_hash: r.txn_id for r in streams.block_table(spark, out, "AllBlocks").collect()}
    last = {r.block_hash: r.txn_id for r in streams.block_table(spark, out, "TransferBlocks").collect()}
    assert (first["a"], first["b"], first["c"]) == ("z", "b", "z") and (last["a"], last["b"], last["c"]) == ("b", "z", "b")
    assert len(first) == len(last) == 12
    index = {(r.sink, r.block_hash): r.txn_id for r in logs.table(spark, f"{out}/Index", streams.INDEX, ["sink", "block_hash"]).collect()}
    assert index["transfer", "a"] == "b" and index["transfer", "b"] == "z"


def test_many_batches_cost_the_same(spark, tmp_path, monkeypatch):
    """65 batches of 20 new hashes and 20 known ones: bytes read by a batch stay level, old folders go, nothing is lost or doubled."""
    blocks = lambda k: [block(f"h{k}-{i}", 5, f"t{k}") for i in range(20)] + [block(f"h{random.Random(k * 20 + i).randrange(max(k, 1))}-{i}", 5, "late") for i in range(20)]
    source, out = land(tmp_path / "in", *[blocks(k) for k in range(65)]), str(tmp_path / "out")
    statistics = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics()
    read, real = [], logs.append

    def append(rows, folder, number):
        real(rows, folder, number)
        read.append(sum(s.getBytesRead() for s in statistics))

    monkeypatch.setattr(logs, "append", append)
    got = streams.first_blocks(spark, source, out, load_time())
    each = [b - a for a, b in zip(read, read[1:])]
    plain = [x for k, x in enumerate(each) if k % logs.COMPACT not in (logs.COMPACT - 1, 0)]
    early, late = sorted(plain[5:18]), sorted(plain[-13:])
    assert late[6] < 1.5 * early[6] + 20_000
    rows = got.collect()
    assert len(rows) == len({r.block_hash for r in rows}) == 65 * 20 and all(r.txn_id == f"t{r.block_hash[1:].split('-')[0]}" for r in rows)
    kept = [len(list((tmp_path / "out" / "AllBlocks" / part).iterdir())) for part in ("part=base", "part=delta")]
    assert kept[0] <= 2 and kept[1] <= 2 * logs.COMPACT


def test_token_state_equals_the_replay(spark, tmp_path):
    """Random changes in nine batches, lines of a batch in any order: totals, tokens and registry are those of one replay over all."""
    rng, changes = random.Random(4), []
    for seq in range(600):
        kind = rng.choice(["FullnodeRBTtable", "FullnodeFTtable", "FullnodeNFTtable", "FullnodeSCtable", "Other"])
        token, op = f"{kind[8:10]}{rng.randrange(12)}", rng.choice(["CREATE", "UPDATE", "UPDATE", "DELETE"])
        data = {"smart_contract_hash" if kind == "FullnodeSCtable" else "TokenID": token}
        if op != "DELETE":
            data |= {"deployer" if kind == "FullnodeSCtable" else "OwnerDID": rng.choice(["", "a", "b", "c", "d"]), "TokenValue": rng.choice([0.0, 0.0005, 1.2345, 7.0]), "TokenStatus": rng.choice([0, 0, 1])}
        changes.append({"table": kind, "operation": op, "seq": seq, "data": data})
    parts = [changes[k : k + 70] for k in range(0, 600, 70)]
    for p in parts:
        rng.shuffle(p)
    out = str(tmp_path / "out")
    totals = streams.token_totals(spark, land(tmp_path / "in", *parts), out, load_time())
    whole = C.parsed(spark.createDataFrame([(json.dumps(c),) for c in changes], "value string"))
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(totals.select("did", "RBT", "FT", "NFT", "SC")) == plain(C.did_totals(whole)) and totals.count() >= 4
    columns = ["kind", "token_id", "owner_did", "token_value", "token_status"]
    assert plain(streams.token_table(spark, out).select(columns)) == plain(C.token_state(whole).select(columns))
    assert plain(streams.registry_table(spark, out)) == plain(C.registry_after(whole, load_time()))


def test_analytics_take_unknown_back(spark, tmp_path):
    """Blocks before, between and after their tokens' registration, without tokens, without a time, repeated with other tokens; two types in one block."""
    tokens = lambda *ids: {"5": {"4": "t", "6": {i: {"4": "1"} for i in ids}}}
    steps = [
        ([block("a", 100, **tokens("q1", "q2")), block("b", 100, **tokens("q3")), block("c", 100), block("d", **tokens("q1")), block("e", 4000, **tokens("none")) | {"10": 2.5}], []),
        ([block("a", 100, **tokens("q3"))], [("q2", "FT"), ("q4", "RBT")]),
        ([block("f", 3599, **tokens("q2", "q4")), block("g", 3600, **tokens("q5"))], [("q1", "FT"), ("q3", "NFT"), ("q2", "SC")]),
        ([], [("q5", "SC"), ("", "FT"), ("q6", "")]),
    ]
    out, source = str(tmp_path / "out"), tmp_path / "in"
    source.mkdir()
    schema = "token_id string, token_type string"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "types"))
    seen = []
    for blocks, types in steps:
        land(source, *([blocks] if blocks else []))
        spark.createDataFrame(types, schema).write.mode("append").parquet(str(tmp_path / "types"))
        got = streams.live_txn_analytics(spark, str(source), spark.readStream.schema(schema).parquet(str(tmp_path / "types")), out, files_per_batch=10)
        seen.append(sorted((r.s, r.token_type, r.txn_count, r.total_value) for r in got.withColumn("s", F.unix_timestamp("interval_start")).collect()))
    assert seen[0] == [(0, "UNKNOWN", 3, 0.0), (3600, "UNKNOWN", 1, 2.5)]
    assert seen[1] == [(0, "FT", 1, 0.0), (0, "UNKNOWN", 2, 0.0), (3600, "UNKNOWN", 1, 2.5)]
    assert seen[3] == [(0, "FT", 2, 0.0), (0, "NFT", 1, 0.0), (0, "RBT", 1, 0.0), (0, "UNKNOWN", 1, 0.0), (3600, "SC", 1, 0.0), (3600, "UNKNOWN", 1, 2.5)]
    every = [b for blocks, _ in steps for b in blocks if b["98"] != "a" or "q1" in b["5"]["6"]]
    d = B.decode(spark.createDataFrame([(json.dumps(b),) for b in every], "value string"))
    rows = d.select("block_hash", B.S.lenient_double(F.col("amount_text")).alias("amount"), B.S.lenient_long(F.col("epoch_text")).alias("epoch"))
    types = spark.createDataFrame([("q1", "FT"), ("q2", "FT"), ("q3", "NFT"), ("q4", "RBT"), ("q5", "SC")], schema)
    whole = R.analytics(rows, B.token_links(d), types)
    assert seen[3] == sorted((r.s, r.token_type, r.txn_count, r.total_value) for r in whole.withColumn("s", F.unix_timestamp("interval_start")).collect())


def test_analytics_call_no_python_for_a_key(spark, tmp_path, monkeypatch):
    """State of blocks, tokens and types is native: a batch of many keys makes no call to Python for each of them. A type with two tokens in one block, and one token in many blocks, count once for a block."""
    plans, real = [], streams.run_now
    monkeypatch.setattr(streams, "run_now", lambda stream, *a: plans.append(stream._jdf.queryExecution().analyzed().toString()) or real(stream, *a))
    blocks = [block(f"b{k}", 100 + 3600 * (k % 3), **{"5": {"4": "t", "6": {f"q{k % 50}": {"4": "1"}, f"q{(k + 2) % 50}": {"4": "1"}}}, "10": 1.5}) for k in range(600)]
    source, schema = land(tmp_path / "in", blocks), "token_id string, token_type string"
    spark.createDataFrame([(f"q{k}", "FT" if k % 2 else "RBT") for k in range(40)], schema).write.parquet(str(tmp_path / "types"))
    got = streams.live_txn_analytics(spark, source, spark.readStream.schema(schema).parquet(str(tmp_path / "types")), str(tmp_path / "out"))
    kinds = [{"FT" if q % 2 else "RBT" for q in (k % 50, (k + 2) % 50) if q < 40} or {"UNKNOWN"} for k in range(600)]
    wanted = {(3600 * i, t): len([k for k in range(600) if k % 3 == i and t in kinds[k]]) for i in range(3) for t in ("FT", "RBT", "UNKNOWN")}
    rows = got.withColumn("s", F.unix_timestamp("interval_start")).collect()
    assert {(r.s, r.token_type): r.txn_count for r in rows} == wanted and all(r.total_value == 1.5 * r.txn_count for r in rows)
    assert plans and not any("TransformWithState" in p for p in plans)
