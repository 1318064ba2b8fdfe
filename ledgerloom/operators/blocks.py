"""Decoding, routing and projecting blocks, and merging them into tables. Built-in expressions throughout."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions import scalars as S
from ..sources import schemas

NUMBER = re.compile(r"-?[0-9]+\Z")
CODES = {"transfer": codes.TRANSFER_CODES, "burnt": codes.BURN_CODES, "deploy": codes.DEPLOY_CODES, "execute": codes.EXECUTE_CODES}


def decode(blocks: DataFrame, text: str = "value", only: tuple[str, ...] = ()) -> DataFrame:
    """blocks with the known fields of their JSON text (or those of `only`, which is shorter: others are skipped in the text), whether keys are numeric or named; every scalar is text.

    Unreadable texts give null fields. tokens maps a token id to (number, previous), or is null. A text is parsed once, however many fields are used:
    the explode of one element keeps the optimizer from repeating the parser in each of them and in filters.
    """
    rows = blocks.withColumn("_b", F.explode(F.array(F.from_json(F.col(text), schemas.block(*only)))))
    either = lambda base, number, name: F.coalesce(F.col(f"{base}.`{number}`"), F.col(f"{base}.{name}"))
    link = lambda k, v: F.struct(F.coalesce(v["4"], v["TTBlockNumberKey"]).alias("number"), F.coalesce(v["5"], v["TTPreviousBlockIDKey"]).alias("previous"))
    fields = {name: lambda keys=keys: either("_b", *keys) for name, keys in schemas.BLOCK_FIELDS.items()}
    inner = {name: lambda keys=keys: either("_i", *keys) for name, keys in schemas.INFO_FIELDS.items()}
    inner["prev_block_id"] = lambda: F.col("_i.TTPreviousBlockIDKey")
    inner["tokens"] = lambda: F.transform_values(either("_i", "6", "TITokensKey"), link)
    if not only or set(only) & set(inner):
        rows = rows.withColumn("_i", either("_b", "5", "TCTransInfoKey"))
    return rows.withColumns({name: made() for name, made in (fields | inner).items() if not only or name in only}).drop("_b", "_i")


def _renamed(value, path: str):
    if isinstance(value, dict):
        out = {}
        for key, inner in value.items():
            own = f"{path}-{key}" if path and NUMBER.match(key) else key
            out[codes.BLOCK_KEYS.get(own, own)] = _renamed(inner, own if NUMBER.match(key) else path)
        return out
    if isinstance(value, list):
        return [_renamed(x, path) for x in value]
    return value


def decode_text(text: Column) -> Column:
    """A whole block's JSON text with all numeric keys, at any depth, renamed by their paths; keys in order. Unreadable text gives null."""

    @F.pandas_udf("string")
    def rename(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else json.dumps(_renamed(json.loads(t), ""), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                return None

        return texts.map(one)

    return rename(text)


#: Fields that all_blocks and burns are made of.
ALL_FIELDS = ("block_hash", "type_code", "epoch_text", "txn_id")
BURN_FIELDS = ("block_hash", "type_code", "owner_did", "comment", "tokens", "children")


def keyed(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks that have a hash, and the rejected rest."""
    return decoded.where("block_hash IS NOT NULL"), decoded.where("block_hash IS NULL")


def _links_json(tokens: Column) -> Column:
    return S.json_map(F.transform_values(tokens, lambda k, v: F.struct(v["number"].alias("TTBlockNumberKey"), v["previous"].alias("TTPreviousBlockIDKey"))))


def route(decoded: DataFrame) -> DataFrame:
    """decoded with route: transfer, burnt, deploy, execute or null."""
    code = F.col("type_code")
    return decoded.withColumn("route", F.when(code.isin(codes.TRANSFER_CODES), "transfer").when(code.isin(codes.BURN_CODES), "burnt").when(code.isin(codes.DEPLOY_CODES), "deploy").when(code.isin(codes.EXECUTE_CODES), "execute"))


def may_have(text: str, *routes: str) -> Column:
    """Whether a block's text can have a code of these routes: the code's key is followed by it, as text or as a number, or a part of either is escaped."""
    own = "|".join(c for r in routes for c in CODES[r])
    return F.col(text).rlike(rf"""["'](?:2|TCTransTypeKey)["']\s*:\s*["']?(?:{own})["'\s,}}]|\\u""")


def with_routes(blocks: DataFrame, *routes: str, text: str = "value", only: tuple[str, ...] = ()) -> DataFrame:
    """decoded blocks of these routes (with the fields of `only`, the type code among them). Texts that can't have one of their codes are left out unparsed."""
    return route(decode(blocks.where(may_have(text, *routes)), text, only)).where(F.col("route").isin(*routes))


def route_in_bulk(decoded: DataFrame, asset_type: str = "asset_type") -> DataFrame:
    """The same for blocks read from chains: contract tokens take only deploys and executions, others only transfers and burns."""
    contract = F.coalesce(F.upper(asset_type) == "SC", F.lit(False))
    own = F.col("route").isin("deploy", "execute")
    return route(decoded).withColumn("route", F.when(contract == own, F.col("route")))


def all_blocks(decoded: DataFrame, ingest: Column, *more: str) -> DataFrame:
    return decoded.select("block_hash", S.block_type(F.col("type_code")).alias("block_type"), S.block_time(F.col("epoch_text"), ingest).alias("epoch"), "txn_id", *more)


def transfers(decoded: DataFrame) -> DataFrame:
    return decoded.select("block_hash", "prev_block_id", "sender_did", "receiver_did", F.col("type_code").alias("txn_type"), S.lenient_double(F.col("amount_text")).alias("amount"), S.lenient_long(F.col("epoch_text")).alias("epoch"), _links_json(F.col("tokens")).alias("tokens"), F.coalesce("pledges", F.lit("null")).alias("validator_pledge_map"), "txn_id")


def burns(decoded: DataFrame) -> DataFrame:
    return decoded.select("block_hash", F.coalesce("children", F.lit("null")).alias("child_tokens"), S.burn_label(F.col("type_code")).alias("txn_type"), "owner_did", S.burn_epoch(F.col("comment")).alias("epoch"), _links_json(F.col("tokens")).alias("tokens"))


def contract_blocks(routed: DataFrame) -> DataFrame:
    """Deploys (owner: the deployer) and executions (owner '', executor set) in one table, by one pass over the blocks."""
    first, runs = S.first_key(F.col("tokens")), F.col("route") == "execute"
    height = F.coalesce(F.try_element_at("tokens", first)["number"].try_cast("bigint"), F.lit(0).cast("bigint"))
    own = routed.where(F.col("route").isin("deploy", "execute"))
    return own.select(F.col("block_hash").alias("block_id"), first.alias("contract_id"), height.alias("block_height"), S.contract_time(F.col("epoch_text")).alias("epoch"), F.when(runs, F.col("executor_did")).alias("executor_did"), F.when(runs, F.lit("")).otherwise(F.col("deployer_did")).alias("owner_did"))


def token_links(decoded: DataFrame) -> DataFrame:
    """(block_hash, token_id, block_number, prev_block_id): one row for each token of each block."""
    return decoded.select("block_hash", F.explode("tokens").alias("token_id", "x")).select("block_hash", "token_id", F.col("x.number").try_cast("bigint").alias("block_number"), F.col("x.previous").alias("prev_block_id"))


def _one_per_key(rows: DataFrame, key: str, arrival: str, last: bool) -> DataFrame:
    others = [c for c in rows.columns if c not in (key, arrival)]
    pick = (F.max_by if last else F.min_by)(F.struct(*others), arrival)
    return rows.groupBy(key).agg(pick.alias("_x")).select(key, *[F.col(f"_x.`{c}`").alias(c) for c in others])


def last_wins(rows: DataFrame, key: str, arrival: str = "arrival") -> DataFrame:
    """One row per key, the one that arrived last, whole; partial aggregates keep hot keys small before the shuffle."""
    return _one_per_key(rows, key, arrival, True)


def first_wins(rows: DataFrame, key: str, arrival: str = "arrival") -> DataFrame:
    return _one_per_key(rows, key, arrival, False)


def chain_blocks(exploded: DataFrame, *more: str) -> DataFrame:
    """(token_id, pos, block_hash, owner_did, epoch, transaction_type, transaction_id) of each block of a chain."""
    d = decode(exploded, "block")
    return d.select("token_id", "pos", "block_hash", "owner_did", F.col("epoch_text").alias("epoch"), S.transaction_name(F.col("type_code")).alias("transaction_type"), F.col("txn_id").alias("transaction_id"), *more)
