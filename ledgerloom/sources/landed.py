"""Readers of landed JSON and the folders that jobs write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset and there is one machine only (tests), below a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(spark, "_ledger_folder", None) or tempfile.mkdtemp(prefix="spark-ledger-")
        spark._ledger_folder = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def kept(rows: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The rows, written once and read back, for queries that use them several times; path: where, for one who deletes them afterwards."""
    path = path or new_folder(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def list_items(text: DataFrame, kind: str) -> DataFrame:
    """Items of asset lists of one kind (RBT, FT, NFT, SC) from a column `value` of JSON text; lists whose status is not true are rejected."""
    item = f"array<struct<{schemas.ITEMS[kind]}>>"
    wrap = text.select(F.from_json("value", f"Status boolean, Result {item}").alias("a"), F.from_json("value", f"status boolean, result {item}").alias("b"))
    ok = F.coalesce(F.col("a.Status"), F.col("b.status"), F.lit(False))
    return wrap.where(ok).select(F.explode(F.coalesce("a.Result", "b.result")).alias("item")).where("item IS NOT NULL").select("item.*")


def read_items(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Asset list items from a folder of JSON lines, one list in a line."""
    return list_items(spark.read.text(path), kind)


def explode_chains(chains: DataFrame, *more: str) -> DataFrame:
    """(token_id, *more, pos, block) from chain texts (token_id, value, *more): blocks stand under TokenChainData, else under blocks. A long chain comes in parts, with
    the place of each part's first block in a column `first`.

    Chains whose status is false, and those without blocks, are skipped, and so are items that are no objects; pos keeps the place in the chain. A chain's text is parsed once: the explode of one
    element keeps the optimizer from repeating the parser for each field and filter.
    """
    first = F.col("first") if "first" in chains.columns else F.lit(0)
    parsed = F.from_json("value", "status boolean, TokenChainData array<string>, blocks array<string>")
    told = chains.select("token_id", *more, first.alias("first"), F.explode(F.array(parsed)).alias("c")).where(F.coalesce(F.col("c.status"), F.lit(True)))
    parts = told.select("token_id", *more, "first", F.posexplode(F.coalesce("c.TokenChainData", "c.blocks")).alias("at", "block"))
    blocks = parts.select("token_id", *more, (F.col("first") + F.col("at")).alias("pos"), "block")
    return blocks.where(F.ltrim("block").startswith("{"))


def cut_chains(chains: DataFrame, *more: str) -> DataFrame:
    """(token_id, *more, first, n, blocks) from chain texts, a row for each part that has blocks: these as an array of (pos, block), told as explode_chains tells them, and how many they are.

    Written in place of the texts, it gives directories and pages that parse no chain again."""
    first = F.coalesce("first", F.lit(0)) if "first" in chains.columns else F.lit(0)
    parsed = F.from_json("value", "status boolean, TokenChainData array<string>, blocks array<string>")
    told = chains.select("token_id", *more, first.alias("first"), F.explode(F.array(parsed)).alias("c")).where(F.coalesce(F.col("c.status"), F.lit(True)))
    each = F.transform(F.coalesce("c.TokenChainData", "c.blocks"), lambda x, i: F.struct((F.col("first") + i).alias("pos"), x.alias("block")))
    parts = told.select("token_id", *more, "first", F.explode(F.array(F.filter(each, lambda x: F.ltrim(x["block"]).startswith("{")))).alias("blocks"))
    return parts.select("token_id", *more, "first", F.size("blocks").cast("bigint").alias("n"), "blocks").where("n > 0")


def read_amounts(text: DataFrame) -> DataFrame:
    """(txn_id, txn_value), once for each transaction: of the landed answers (value, perhaps arrival) the one that arrived last. Without arrivals the largest value counts.

    Answers whose status is not true, and those without an id or a value, are left out. An answer is parsed once: the explode of one element keeps the optimizer from repeating the parser for each field and filter."""
    arrival = F.col("arrival") if "arrival" in text.columns else F.lit(0)
    told = text.select(F.explode(F.array(F.from_json("value", schemas.AMOUNT))).alias("a"), arrival.alias("arrival")).where("a.status")
    rows = told.selectExpr("a.result.TransactionID AS txn_id", "a.result.TransactionValue AS txn_value", "arrival").where("txn_id IS NOT NULL AND txn_value IS NOT NULL")
    return rows.groupBy("txn_id").agg(F.max_by("txn_value", F.struct("arrival", "txn_value")).alias("txn_value"))
