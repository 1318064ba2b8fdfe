"""Replay of ordered token changes with windows: token rows, and owner totals that never fall below 0.

A change is (seq, kind, op, token_id, owner_did, token_value, token_status); op DELETE deletes, any other creates or patches. In a patch
an empty owner, a value of 0 and a status of 0 keep what is stored. seq gives the one order in which changes apply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.scalars import look_up, milli
from ..sources import schemas

CHANGE_COLUMNS = ["seq", "kind", "op", "token_id", "owner_did", "token_value", "token_status"]
BEFORE = (Window.unboundedPreceding, -1)
#: Sequence numbers whose changes one task may hold for an owner.
SPAN = 100_000


def parsed(text: DataFrame) -> DataFrame:
    """Changes from JSON text {table, data, operation, seq}; unknown tables are dropped."""
    c = text.select(F.from_json("value", schemas.CHANGE).alias("c")).select("c.*")
    d = c.withColumn("d", F.from_json("data", schemas.CHANGE_DATA)).withColumn("kind", look_up(codes.CHANGE_TABLES, F.col("table"))).where("kind IS NOT NULL")
    return d.select(
        "seq",
        "kind",
        F.when(F.col("operation") == "DELETE", "DELETE").otherwise("UPSERT").alias("op"),
        F.coalesce(F.when(F.col("kind") == "SC", F.col("d.smart_contract_hash")), F.col("d.token_id"), F.col("d.TokenID")).alias("token_id"),
        F.coalesce(F.when(F.col("kind") == "SC", F.col("d.deployer")), F.col("d.OwnerDID"), F.lit("")).alias("owner_did"),
        F.coalesce("d.token_value", "d.TokenValue", F.lit(0.0)).alias("token_value"),
        F.coalesce("d.TokenStatus", F.lit(0)).alias("token_status"),
    )


def token_state(changes: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """(kind, token_id, owner_did, token_value, token_status) of the tokens that exist after all changes.

    `tokens` is the state before. Two grouped aggregates, no sort: the last deletion, then the last value of each field after it."""
    rows = changes.select(*CHANGE_COLUMNS)
    if tokens is not None:
        rows = rows.unionByName(tokens.select(F.lit(-1).cast("bigint").alias("seq"), "kind", F.lit("UPSERT").alias("op"), "token_id", "owner_did", "token_value", "token_status"))
    key = ["kind", "token_id"]
    gone = rows.where("op = 'DELETE'").groupBy(*key).agg(F.max("seq").alias("gone"))
    alive = rows.where("op <> 'DELETE'").join(gone, key, "left").where("gone IS NULL OR seq > gone")
    last = lambda c, empty: F.coalesce(F.max_by(c, F.when(F.col(c) != empty, F.col("seq"))), F.lit(empty)).alias(c)
    return alive.groupBy(*key).agg(last("owner_did", ""), last("token_value", 0.0), last("token_status", 0))


def effects(changes: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """One row per change that may touch an owner: (seq, did, kind, creates, new, amount); amount is in thousandths for base tokens, else 1, negative for deletions."""
    rows = changes.select(*CHANGE_COLUMNS, F.lit(False).alias("seed"))
    if tokens is not None:
        rows = rows.unionByName(tokens.select(F.lit(-1).cast("bigint").alias("seq"), "kind", F.lit("UPSERT").alias("op"), "token_id", "owner_did", "token_value", "token_status", F.lit(True).alias("seed")))
    upsert = F.col("op") != "DELETE"
    token = Window.partitionBy("kind", "token_id").orderBy("seq")
    life = Window.partitionBy("kind", "token_id", "life").orderBy("seq").rowsBetween(*BEFORE)
    rows = rows.withColumn("life", F.coalesce(F.sum(F.when(~upsert, 1)).over(token.rowsBetween(*BEFORE)), F.lit(0)))
    rows = rows.withColumns({
        "existed": F.coalesce(F.max(F.when(upsert, True)).over(life), F.lit(False)),
        "stored_owner": F.coalesce(F.last(F.nullif("owner_did", F.lit("")), True).over(life), F.lit("")),
        "stored_value": F.coalesce(F.last(F.nullif("token_value", F.lit(0.0)), True).over(life), F.lit(0.0)),
    })
    size = lambda value: F.when(F.col("kind") == "RBT", milli(value)).otherwise(F.lit(1).cast("bigint"))
    counts = (F.col("token_status") == 0) | F.col("kind").isin("NFT", "SC")
    own = rows.where(~F.col("seed") & F.when(upsert, counts).otherwise(F.col("existed")))
    return own.select("seq", F.when(upsert, F.col("owner_did")).otherwise(F.col("stored_owner")).alias("did"), "kind", upsert.alias("creates"), (~F.col("existed")).alias("new"), F.when(upsert, size(F.col("token_value"))).otherwise(-size(F.col("stored_value"))).alias("amount"))


def did_totals(changes: DataFrame, tokens: DataFrame | None = None, dids: DataFrame | None = None, span: int = SPAN) -> DataFrame:
    """(did, RBT, FT, NFT, SC): totals of every owner after all changes, RBT in thousandths.

    `tokens` and `dids` are the states before. An owner is created by its first counting upsert, even of a known token. A total is floored at 0
    after each deletion, which equals the last prefix sum less the lowest one below 0. Prefix sums are taken within spans of `span` sequence numbers, each
    of which leaves its sum and its lowest prefix, and the spans are then added up in order: an owner of very many changes is no single task."""
    rows = effects(changes, tokens).withColumn("seed", F.lit(False))
    if dids is not None:
        old = dids.select("did", F.expr("stack(4, 'RBT', RBT, 'FT', FT, 'NFT', NFT, 'SC', SC) AS (kind, amount)"))
        rows = rows.unionByName(old.select(F.lit(-1).cast("bigint").alias("seq"), "did", "kind", F.lit(True).alias("creates"), F.lit(True).alias("new"), "amount", F.lit(True).alias("seed")))
    order = F.struct("seq", "kind")
    made = rows.where("creates").groupBy("did").agg(F.min(order).alias("made"))
    rows = rows.join(made, "did")  # owners that nothing creates have no row
    known = order > F.col("made")
    part = F.when(F.col("seed"), F.col("amount")).when(F.col("creates"), F.when(~known | F.col("new"), F.col("amount")).otherwise(0)).otherwise(F.when(known, F.col("amount")).otherwise(0))
    rows = rows.select("did", "kind", F.floor(F.col("seq") / span).alias("span"), "seq", part.alias("part"))
    running = Window.partitionBy("did", "kind", "span").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    spans = rows.withColumn("low", F.sum("part").over(running)).groupBy("did", "kind", "span").agg(F.sum("part").alias("sum"), F.min("low").alias("low"))
    zero = F.lit(0).cast("bigint")
    step = lambda x, c: F.struct((x["sum"] + c["sum"]).alias("sum"), F.least(x["low"], x["sum"] + c["low"]).alias("low"))
    parts = F.array_sort(F.collect_list(F.struct("span", "sum", "low")))  # a row for each span
    per = spans.groupBy("did", "kind").agg(F.aggregate(parts, F.struct(zero.alias("sum"), zero.alias("low")), step, lambda x: x["sum"] - x["low"]).alias("total"))
    total = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("total"))), F.lit(0)).cast("bigint").alias(k)
    return per.groupBy("did").agg(*[total(k) for k in ("RBT", "FT", "NFT", "SC")])


def as_did_rows(totals: DataFrame) -> DataFrame:
    """Totals with the names of the DIDs table."""
    return totals.select("did", (F.col("RBT") / 1000).alias("total_rbts"), F.col("FT").cast("double").alias("total_fts"), F.col("NFT").alias("total_nfts"), F.col("SC").alias("total_sc"))


def registry_after(changes: DataFrame, ingest: Column, registry: DataFrame | None = None) -> DataFrame:
    """TokenType after all changes: a row comes with a token's first upsert and goes with its deletion; a later upsert makes a new one. Known rows keep their time.

    Of kinds that share an id the first counts. Grouped aggregates only."""
    rows = changes.select("seq", "kind", "op", "token_id", ingest.alias("last_updated"))
    if registry is not None:
        rows = rows.unionByName(registry.select(F.lit(-1).cast("bigint").alias("seq"), F.col("token_type").alias("kind"), F.lit("UPSERT").alias("op"), "token_id", "last_updated"))
    gone = rows.where("op = 'DELETE'").groupBy("kind", "token_id").agg(F.max("seq").alias("gone"))
    alive = rows.where("op <> 'DELETE'").join(gone, ["kind", "token_id"], "left").where("gone IS NULL OR seq > gone")
    first = alive.groupBy("token_id").agg(F.min_by(F.struct("kind", "last_updated"), "seq").alias("x"))
    return first.select("token_id", F.col("x.kind").alias("token_type"), F.col("x.last_updated").alias("last_updated"))
