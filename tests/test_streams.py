"""The streaming jobs on notifications that repeat, come late or carry odd epochs."""

import json

from pyspark.sql import functions as F

from ledgerloom.operators import blocks as B
from ledgerloom.plans.ledger_queries import load_time
from ledgerloom.streaming import streams


def land(folder, *files):
    """One file, and so one batch, for each list of blocks."""
    import os
    import time

    folder.mkdir(exist_ok=True)
    at = len(list(folder.iterdir()))
    for k, blocks in enumerate(files):
        path = folder / f"{at + k:03d}.json"
        path.write_text("".join(json.dumps(b) + "\n" for b in blocks))
        os.utime(path, (time.time() - 1000 + at + k,) * 2)
    return str(folder)


def block(name, epoch=None, txn="t", code="02", **more):
    return {"2": code, "98": name, "5": {"4": txn}, **({} if epoch is None else {"epoch": epoch}), **more}


def test_old_blocks_after_a_future_one_stay(spark, tmp_path):
    source = land(tmp_path / "in", [block("ahead", 4_000_000_000)], [block("millis", 1_700_000_000_000)], [block("none")], [block("old", 700_000_000), block("ahead", 5, "late")], [block("zero", 0), block("old", 9, "late")])
    out = str(tmp_path / "out")
    got = streams.first_blocks(spark, source, out, load_time())
    assert sorted((r.block_hash, r.txn_id) for r in got.select("block_hash", "txn_id").collect()) == [(n, "t") for n in ("ahead", "millis", "none", "old", "zero")]
    assert {r.block_hash: r.e for r in got.select("block_hash", F.unix_timestamp("epoch").alias("e")).collect()}["old"] == 700_000_000
    land(tmp_path / "in", [block("new", 1), block("millis", 2, "late")])
    for _ in range(2):  # the second run finds nothing new
        got = streams.first_blocks(spark, source, out, load_time())
        assert sorted((r.block_hash, r.txn_id) for r in got.select("block_hash", "txn_id").collect()) == [(n, "t") for n in ("ahead", "millis", "new", "none", "old", "zero")]


def test_first_blocks_of_an_empty_folder(spark, tmp_path):
    assert streams.first_blocks(spark, land(tmp_path / "in"), str(tmp_path / "out"), load_time()).count() == 0


def test_routed_tables_hold_whole_rows(spark, tmp_path):
    """Every column of each table equals the batch projection of the notification that wins."""
    full = lambda name, code, n: block(name, 1_700_000_000 + n, f"t{n}", code, **{"3": f"o{n}", "8": {f"p{n}": n}, "10": n + 0.5, "11": [f"c{n}"]}) | {"5": {"1": f"s{n}", "2": f"r{n}", "3": f"Token burnt at : 2024-01-02 03:04:{n:02d}", "4": f"t{n}", "8": f"d{n}", "9": f"e{n}", "6": {f"Qm{n}": {"4": str(n), "5": f"prev{n}"}}}}
    bare = {"2": "02", "5": {"4": "t"}}
    first = [bare, full("a", "02", 1), full("b", "08", 2), full("c", "09", 3), full("d", "10", 4), full("e", "02", 5), full("f", "99", 6)]
    second = [full("a", "02", 11), full("b", "13", 12), full("c", "10", 13), full("g", "02", 17)]
    out = str(tmp_path / "out")
    streams.route_blocks(spark, land(tmp_path / "in", first, second, []), out, load_time())
    of = lambda blocks: B.route(B.decode(spark.createDataFrame([(json.dumps(b),) for b in blocks], "value string")))
    first = first[1:]
    assert [r.value for r in streams.rejected_blocks(spark, out).collect()] == [json.dumps(bare)]
    last = of(second + [b for b in first if b["98"] in "def"])
    wanted = {"AllBlocks": B.all_blocks(of(first + second[3:]), load_time()), "TransferBlocks": B.transfers(last.where("route = 'transfer'")), "BurntBlocks": B.burns(last.where("route = 'burnt'")), "SC_Blocks": B.contract_blocks(last)}
    for name, rows in wanted.items():
        got = streams.block_table(spark, out, name)
        assert sorted(got.columns) == sorted(rows.columns) and rows.count() > 0
        assert sorted(map(str, got.select(*rows.columns).collect())) == sorted(map(str, rows.collect())), name


def test_registry_follows_changes(spark, tmp_path):
    """A row comes with a token's first upsert, keeps its time under later ones, goes with the deletion and comes back anew."""
    change = lambda seq, op, token: {"table": "FullnodeRBTtable", "operation": op, "seq": seq, "data": {"token_id" if op == "DELETE" else "TokenID": token, "OwnerDID": "o", "TokenValue": 1.0, "TokenStatus": 0}}
    source = land(tmp_path / "in", [change(1, "CREATE", "a"), change(2, "CREATE", "b"), change(3, "DELETE", "none")], [change(4, "UPDATE", "a"), change(5, "DELETE", "b")], [change(6, "CREATE", "b"), change(7, "CREATE", "c"), change(8, "DELETE", "c")])
    out = str(tmp_path / "out")
    totals = {r.did: r.RBT for r in streams.token_totals(spark, source, out, load_time()).collect()}
    assert totals == {"o": 2000}
    assert {(r.token_id, r.token_type) for r in streams.registry_table(spark, out).collect()} == {("a", "RBT"), ("b", "RBT")}


def test_a_file_is_read_in_splits_and_its_lines_keep_their_order(spark, tmp_path):
    """One file of many splits, each hash in it thrice: the first and the last line of a hash count, and no task reads the file as a whole."""
    source = land(tmp_path / "in", [block(f"h{k % 700}", 5, f"t{k:05d}") for k in range(2100)])
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "16384")
        out, sizes = str(tmp_path / "out"), []
        streams.route_blocks(spark, source, out, load_time())
        first = {r.block_hash: r.txn_id for r in streams.block_table(spark, out, "AllBlocks").collect()}
        last = {r.block_hash: r.txn_id for r in streams.block_table(spark, out, "TransferBlocks").collect()}
        read = streams.texts(spark, source).writeStream.foreachBatch(lambda rows, n: sizes.extend(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()))
        read.option("checkpointLocation", str(tmp_path / "sizes")).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert first == {f"h{k}": f"t{k:05d}" for k in range(700)} and last == {f"h{k}": f"t{k + 1400:05d}" for k in range(700)}
    assert sum(sizes) == 2100 and len(sizes) > 4 and max(sizes) < 700
