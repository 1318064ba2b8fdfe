"""Writing the ledger tables, and the logs that streams keep."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import tables
from ledgerloom.sources.schemas import COLUMNS, TABLES
from ledgerloom.streaming import logs


def test_written_tables_come_back(spark, tmp_path):
    day = 86_400
    rows = [("a", "o", None, "x", 5 * day, "{}"), ("b", "o", "t", "x", None, "{}"), ("c", "o", "t", "x", 900 * day, "{}")]
    burnt = spark.createDataFrame(rows, "block_hash string, owner_did string, txn_type string, child_tokens string, epoch bigint, tokens string")
    for days in (None, 1, 365):
        tables.write_table(burnt, "BurntBlocks", str(tmp_path), days)
        back = tables.read_table(spark, "BurntBlocks", str(tmp_path))
        assert back.columns == COLUMNS["BurntBlocks"] and sorted(map(str, back.select(*burnt.columns).collect())) == sorted(map(str, burnt.collect()))
    assert len([p for p in (tmp_path / "BurntBlocks").iterdir() if p.name.startswith("period=")]) == 3
    for name, schema in TABLES.items():
        assert tables.stored(spark.createDataFrame([], schema), name, str(tmp_path)).count() == 0


def test_other_columns_and_types_are_refused(spark, tmp_path):
    good = spark.createDataFrame([("t", "RBT", None)], TABLES["TokenType"])
    with pytest.raises(ValueError, match="columns"):
        tables.write_table(good.withColumn("more", F.lit(1)), "TokenType", str(tmp_path))
    with pytest.raises(ValueError, match="columns"):
        tables.write_table(good.drop("token_type"), "TokenType", str(tmp_path))
    with pytest.raises(TypeError, match="token_id"):
        tables.write_table(good.withColumn("token_id", F.lit(1)), "TokenType", str(tmp_path))


def test_logs(spark, tmp_path, monkeypatch):
    """The last batch of a key counts, a batch may run again, compaction changes nothing, and what the base before the last holds is deleted."""
    monkeypatch.setattr(logs, "COMPACT", 3)
    folder, schema = str(tmp_path / "log"), "k string, v int"
    assert logs.table(spark, folder, schema, ["k"]).count() == 0
    wanted, at = {}, {}
    for n in range(8):
        for again in range(2):
            rows = [(f"k{(n + i) % 5}", 10 * n + i) for i in range(2)]
            logs.append(spark.createDataFrame(rows, schema), folder, n)
            logs.compact(spark, folder, schema, lambda df: logs.last_of(df, ["k"]), n)
        wanted |= dict(rows)
        at[n] = dict(wanted)
        assert {r.k: r.v for r in logs.table(spark, folder, schema, ["k"]).collect()} == wanted
    assert {r.k: r.v for r in logs.last_of(logs.rows_of(spark, folder, schema, 4), ["k"]).collect()} == at[4]
    kept = {part: sorted(p.name for p in (tmp_path / "log" / part).iterdir() if p.name.startswith("batch=")) for part in ("part=base", "part=delta")}
    assert kept == {"part=base": ["batch=2", "batch=5"], "part=delta": [f"batch={n}" for n in range(3, 8)]}
