"""Pages of tables that are partitioned by periods."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import reads as R
from ledgerloom.sources import tables
from tests.test_sync import scanned


@pytest.mark.parametrize("page,limit", [(1, 7), (2, 7), (5, 40), (3, 100), (9, 100), (500, 10), (0, 0)])
def test_a_page_reads_its_periods(spark, tmp_path, page, limit):
    """Rows and totals are those of the whole table; at most the periods that hold the page are read; ties, null epochs and a page past the end."""
    rng = random.Random(1)
    rows = [(f"h{k:04d}", rng.choice([None, *[d * 86_400 + rng.randrange(3) for d in range(60)]])) for k in range(700)]
    df = spark.createDataFrame(rows, "block_hash string, epoch long").select("block_hash", F.lit("[]").alias("child_tokens"), F.lit("Burnt").alias("txn_type"), F.lit("o").alias("owner_did"), "epoch", F.lit("null").alias("tokens"))
    tables.write_table(df, "BurntBlocks", str(tmp_path), days=10)
    read = lambda periods: tables.read_periods(spark, "BurntBlocks", str(tmp_path), periods)
    counts = R.period_counts(read(None))
    shown, total = R.period_page(read, counts, page, limit)
    skip, most = R.bounds(page, limit)
    wanted = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))[skip : skip + most]
    assert total == 700 and [(r.block_hash, r.epoch) for r in shown.collect()] == wanted
    sizes = {r.period: r.n for r in counts.collect()}
    touched = {None if e is None else e // 864_000 for _, e in wanted}
    assert scanned(shown)[1] == sum(sizes[p] for p in touched)


def test_holdings_pass_on_a_page_of_each_owner(spark):
    """A hot owner: ranks are cut before the shuffle, the page and the count are whole."""
    rbt = spark.range(0, 30_000, numPartitions=6).selectExpr("CASE WHEN id % 10 < 9 THEN 'hot' ELSE concat('o', id % 70) END AS owner_did", "format_string('t%06d', id) AS rbt_id", "1.0D AS token_value", "cast(id % 11 = 5 AS int) AS token_status")
    dids = spark.createDataFrame([("hot",), ("o9",), ("none",)], "did string")
    got = R.holdings(rbt, dids, 2, 5)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("WindowGroupLimit") >= 1
    free = [(r.owner_did, r.rbt_id) for r in rbt.where("token_status = 0 AND owner_did IN ('hot', 'o9')").orderBy("rbt_id").collect()]
    for owner in ("hot", "o9"):
        mine = [t for o, t in free if o == owner]
        assert [(r.rbt_id, r.rn, r["count"]) for r in got.where(F.col("owner_did") == owner).orderBy("rn").collect()] == [(t, k + 6, len(mine)) for k, t in enumerate(mine[5:10])]
