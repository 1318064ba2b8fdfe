"""Asset tables: from list items to rows, insert-if-absent, the token registry and chain requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = {"RBT": "rbt_id", "FT": "ft_id", "NFT": "nft_id", "SC": "contract_id"}


def rows_of(items: DataFrame, kind: str) -> DataFrame:
    """Table rows of list items; other columns of items (such as arrival) are kept at the end."""
    known = {
        "RBT": [("TokenID", "rbt_id"), ("OwnerDID", "owner_did"), ("BlockHash", "block_id"), (F.col("BlockHeight").cast("string"), "block_height"), ("TokenValue", "token_value"), ("TokenStatus", "token_status")],
        "FT": [("TokenID", "ft_id"), ("TokenValue", "token_value"), ("FTName", "ft_name"), ("OwnerDID", "owner_did"), ("CreatorDID", "creator_did"), ("BlockHeight", "block_height"), ("BlockHash", "block_id"), ("TransactionID", "txn_id"), ("TokenStatus", "token_status")],
        "NFT": [("token_id", "nft_id"), (F.format_string("%f", F.col("token_value")), "token_value"), ("OwnerDID", "owner_did"), ("BlockHash", "block_hash"), ("TransactionID", "txn_id"), ("BlockHeight", "block_height"), ("TokenStatus", "token_status")],
        "SC": [("smart_contract_hash", "contract_id"), ("BlockHash", "block_hash"), ("deployer", "deployer_did"), ("TransactionID", "txn_id"), ("BlockHeight", "block_height"), ("TokenStatus", "token_status")],
    }[kind]
    more = [c for c in items.columns if c == "arrival"]
    return items.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in known], *more)


def first_of_each(rows: DataFrame, key: str, arrival: str = "arrival") -> DataFrame:
    others = [c for c in rows.columns if c not in (key, arrival)]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), arrival).alias("_x")).select(key, *[F.col(f"_x.`{c}`").alias(c) for c in others])


def new_rows(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows (with arrival) whose key the table lacks; of a repeated key the first arrival counts."""
    return first_of_each(incoming, key).join(existing.select(key), key, "left_anti")


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The table after the load: existing rows are untouched."""
    return existing.unionByName(new_rows(existing, incoming, key).select(existing.columns))


def registry(existing: DataFrame, loads: dict[str, DataFrame], ingest: Column) -> DataFrame:
    """TokenType after loading lists: every listed token once, the first kind (in the order of `loads`) that lists it."""
    told = None
    for k, (kind, rows) in enumerate(loads.items()):
        one = rows.select(F.col(KEYS[kind]).alias("token_id"), F.lit(kind).alias("token_type"), F.lit(k).alias("arrival"))
        told = one if told is None else told.unionAll(one)
    return insert_if_absent(existing, told.withColumn("last_updated", ingest), "token_id")


def chain_requests(token_type: DataFrame, rbt: DataFrame) -> DataFrame:
    """(token_id, token_type) to ask chains for; a base token of a value below 1 is asked for as PART."""
    both = token_type.select("token_id", "token_type").join(rbt.select(F.col("rbt_id").alias("token_id"), "token_value"), "token_id", "left")
    part = (F.upper("token_type") == "RBT") & (F.col("token_value") < 1.0)
    return both.select("token_id", F.when(part, "PART").otherwise(F.col("token_type")).alias("token_type"))
