"""Totals per owner, recomputed from tables. Values are summed in whole thousandths, so that sums are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import milli


def counted(rows: DataFrame, key: str) -> DataFrame:
    """An asset table's key and what totals are made of: what a load shuffles to tell new rows is no wider."""
    return rows.select(key, *[c for c in ("owner_did", "deployer_did", "token_value", "token_status") if c in rows.columns])


def rbt_totals(rbt: DataFrame) -> DataFrame:
    free = rbt.where("token_status = 0")
    return free.groupBy(F.col("owner_did").alias("did")).agg((F.sum(milli(F.col("token_value"))) / 1000).alias("total_rbts"))


def ft_totals(ft: DataFrame) -> DataFrame:
    return ft.where("token_status = 0").groupBy(F.col("owner_did").alias("did")).agg(F.count(F.lit(1)).alias("total_fts"))


def nft_totals(nft: DataFrame) -> DataFrame:
    return nft.groupBy(F.col("owner_did").alias("did")).agg(F.count(F.lit(1)).alias("total_nfts"))


def sc_totals(sc: DataFrame) -> DataFrame:
    return sc.groupBy(F.col("deployer_did").alias("did")).agg(F.count(F.lit(1)).alias("total_sc"))


def did_totals(rbt: DataFrame, ft: DataFrame, nft: DataFrame, sc: DataFrame, ingest: Column, existing: DataFrame | None = None) -> DataFrame:
    """The DIDs table: the four kinds and the existing totals in long form, one shuffle by did.

    A did gets a row when one of its newly loaded tokens counts (base and fungible ones only when free)."""
    none = F.lit(0).cast("bigint")
    part = lambda rows, did, **own: rows.select(F.col(did).alias("did"), F.lit(None).cast("timestamp").alias("created_at"), *[own.get(c, none).alias(c) for c in ("r", "f", "n", "s")])
    one = F.lit(1).cast("bigint")
    rows = part(rbt.where("token_status = 0"), "owner_did", r=milli(F.col("token_value"))).unionAll(part(ft.where("token_status = 0"), "owner_did", f=one)).unionAll(part(nft, "owner_did", n=one)).unionAll(part(sc, "deployer_did", s=one))
    if existing is not None:
        rows = rows.unionAll(existing.select("did", "created_at", milli(F.col("total_rbts")), F.col("total_fts").cast("bigint"), "total_nfts", "total_sc"))
    sums = rows.groupBy("did").agg(F.min("created_at").alias("created_at"), *[F.sum(c).alias(c) for c in ("r", "f", "n", "s")])
    return sums.select("did", F.coalesce("created_at", ingest).alias("created_at"), (F.col("r") / 1000).alias("total_rbts"), F.col("f").cast("double").alias("total_fts"), F.col("n").alias("total_nfts"), F.col("s").alias("total_sc"))
