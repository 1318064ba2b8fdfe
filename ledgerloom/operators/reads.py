"""Explorer reads: counts, pages, lookups and search over the tables. Pages are top-k: no full sort for small offsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.landed import kept


def bounds(page: int, limit: int) -> tuple[int, int]:
    """(offset, limit); a page below 1 is 1, a limit below 1 is 10."""
    page, limit = max(page, 1), limit if limit >= 1 else 10
    return (page - 1) * limit, limit


def page_of(rows: DataFrame, order: list, page: int, limit: int) -> DataFrame:
    skip, most = bounds(page, limit)
    return rows.orderBy(*order).offset(skip).limit(most)


def total_pages(total: Column, limit: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / (limit if limit >= 1 else 10))).cast("bigint")


def counts(**tables: DataFrame) -> DataFrame:
    """One row with the exact number of rows of each table."""
    out = None
    for name, t in tables.items():
        one = t.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def usable(transfers: DataFrame) -> DataFrame:
    return transfers.where("epoch IS NOT NULL AND epoch <> 0")


def missing_amount(transfers: DataFrame) -> Column:
    return F.col("amount").isNull() | (F.col("amount") == 0)


def transfer_page(transfers: DataFrame, amounts: DataFrame, page: int, limit: int) -> DataFrame:
    """Latest transfers; a missing amount is filled for the rows of the page only. With the count of listed transfers."""
    rows = usable(transfers)
    shown = page_of(rows, [F.desc("epoch"), "block_hash"], page, limit)
    return transfer_rows(with_total(filled(shown, amounts, limit), rows))


def transfer_rows(page: DataFrame) -> DataFrame:
    """A page's transfers as they are shown: no nulls but in the epoch."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return page.select("block_hash", text("sender_did"), text("receiver_did"), text("txn_type"), text("txn_id"), F.coalesce("amount", F.lit(0.0)).alias("amount"), "epoch", "count")


def backfill(transfers: DataFrame, amounts: DataFrame) -> DataFrame:
    """Transfers with the known value written to all rows of every transaction that has a row without an amount. Null and empty ids don't join; amounts has a transaction once
    (landed.read_amounts), and a repeated one gives its largest value, so that no transfer is multiplied."""
    named = transfers.where("txn_id IS NOT NULL AND txn_id <> ''")
    wanted = named.where(missing_amount(named)).select("txn_id").distinct().join(amounts, "txn_id").groupBy("txn_id").agg(F.max("txn_value").alias("txn_value"))
    return transfers.join(wanted, "txn_id", "left").withColumn("amount", F.coalesce("txn_value", "amount")).select(transfers.columns)


def period_counts(rows: DataFrame) -> DataFrame:
    """(period, n): rows of each period of a table (tables.read_periods). Store it beside the table, and count again the periods that a load has touched."""
    return rows.groupBy("period").agg(F.count(F.lit(1)).alias("n"))


def period_page(read: Callable[[list], DataFrame], counts: DataFrame, page: int, limit: int, order: str = "block_hash") -> tuple[DataFrame, int]:
    """(page, total) of a table's rows, latest first and null epochs before all, then by `order`: running sums over the counts tell which periods hold the page, and read(periods) reads these alone.

    counts has a row for each period, so that it is small however large the table is. A page beyond the end reads nothing."""
    skip, most = bounds(page, limit)
    sizes = sorted(((r["period"], r["n"]) for r in counts.collect()), key=lambda x: (x[0] is not None, -(x[0] or 0)))
    chosen, before, offset = [], 0, 0
    for period, n in sizes:
        if before < skip + most and before + n > skip:
            offset = offset if chosen else skip - before
            chosen.append(period)
        before += n
    return read(chosen).orderBy(F.desc_nulls_first("epoch"), order).offset(offset).limit(most), before


def with_total(shown: DataFrame, rows: DataFrame) -> DataFrame:
    """A page with the count of all rows beside each of its rows."""
    return shown.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("count"))))  # one row


def page_json(shown: DataFrame, name: str, order: str | list[Column], fields: dict[str, str] | None = None) -> DataFrame:
    """One row, json: a page (with_total's columns) as the object that an endpoint answers with, {name: [rows by `order`], "count": total}; nulls are written. An empty page has no rows and counts 0.

    fields: the columns by the names that the answer gives them, in order; else all under their own."""
    fields = fields or {c: c for c in shown.columns if c != "count"}
    keys = F.struct(*[x.alias(f"k{i}") for i, x in enumerate([F.col(order)] if isinstance(order, str) else order)])
    each = F.struct(keys.alias("key"), F.struct(*[F.col(c).alias(k) for k, c in fields.items()]).alias("row"))
    rows = F.transform(F.array_sort(F.collect_list(each)), lambda x: x["row"])  # a page's rows
    return shown.agg(F.to_json(F.struct(rows.alias(name), F.coalesce(F.max("count"), F.lit(0)).alias("count")), {"ignoreNullFields": "false"}).alias("json"))


#: Ids that are sent to every task to read amounts against; more are joined by a shuffle.
MOST_IDS = 10_000


def filled(transfers: DataFrame, amounts: DataFrame, most: int | None = None) -> DataFrame:
    """Transfers (a page, looked-up rows) with missing amounts filled from known values other than 0; amounts are read once, against their ids.

    most: how many rows transfers has at most, where that is known (a page's limit); else its ids are counted, up to MOST_IDS."""
    ids = transfers.where(missing_amount(transfers) & F.col("txn_id").isNotNull() & (F.col("txn_id") != "")).select("txn_id").distinct()
    if (ids.limit(MOST_IDS + 1).count() if most is None else most) <= MOST_IDS:
        ids = F.broadcast(ids)
    known = amounts.join(ids, "txn_id", "left_semi").where("txn_value <> 0").groupBy("txn_id").agg(F.max("txn_value").alias("txn_value"))
    amount = F.when(missing_amount(transfers), F.coalesce("txn_value", "amount")).otherwise(F.col("amount"))
    return transfers.join(known, "txn_id", "left").withColumn("amount", amount).select(transfers.columns)


def burnt_page(burnt: DataFrame, page: int, limit: int) -> DataFrame:
    """Burns, latest first, with the count of all."""
    return with_total(page_of(burnt, [F.desc_nulls_first("epoch"), "block_hash"], page, limit), burnt)


def top_holders(dids: DataFrame, page: int, limit: int) -> DataFrame:
    """Holders by base-token total, with the count of all owners, unfiltered."""
    shown = page_of(dids.where("did IS NOT NULL AND did <> '0'"), [F.desc_nulls_first("total_rbts"), "did"], page, limit)
    return with_total(shown, dids)


def holdings(rbt: DataFrame, dids: DataFrame, page: int, limit: int) -> DataFrame:
    """A page of free base tokens for each of the owners, with how many each has.

    The count is a grouped sum, and ranks stand alone in their window, so that each task passes on no more than a page's end of an owner's rows (up to rank 1,000): an owner of very many tokens is no single task."""
    skip, most = bounds(page, limit)
    free = rbt.where("token_status = 0").join(dids.select(F.col("did").alias("owner_did")), "owner_did", "left_semi")
    ranked = free.withColumn("rn", F.row_number().over(Window.partitionBy("owner_did").orderBy("rbt_id"))).where((F.col("rn") <= skip + most) & (F.col("rn") > skip))
    return ranked.join(free.groupBy("owner_did").agg(F.count(F.lit(1)).alias("count")), "owner_did").select("owner_did", "rbt_id", "token_value", "rn", "count")


def did_detail(dids: DataFrame, rbt: DataFrame, page: int, limit: int) -> DataFrame:
    """Totals of owners with a page of their free tokens as an array, and the count."""
    shown = holdings(rbt, dids, page, limit).groupBy(F.col("owner_did").alias("did")).agg(F.array_sort(F.collect_list("rbt_id")).alias("rbts"), F.max("count").alias("count"))  # at most `limit` each
    return dids.join(shown, "did", "left").select(dids.columns + [F.coalesce("rbts", F.array().cast("array<string>")).alias("rbts"), F.coalesce("count", F.lit(0)).alias("count")])


def first_transfer(transfers: DataFrame, txn_ids: DataFrame) -> DataFrame:
    """For each transaction id the transfer of the smallest block hash."""
    others = [c for c in transfers.columns if c not in ("txn_id", "block_hash")]
    rows = transfers.join(txn_ids.select("txn_id"), "txn_id", "left_semi")
    return rows.groupBy("txn_id").agg(F.min("block_hash").alias("block_hash"), F.min_by(F.struct(*others), "block_hash").alias("_x")).select("txn_id", "block_hash", "_x.*")


def by_key(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The whole rows whose key is among `ids` (one column, id); unknown ids are left out."""
    return rows.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_semi")


def lookup(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> DataFrame:
    """(id, kind, data) of the rows that the ids (kind, id) name; kind names the table. data is JSON text."""
    out = None
    for kind, (rows, key) in tables.items():
        one = rows.join(ids.where(F.col("kind") == kind).select(F.col("id").alias(key)), key).select(F.col(key).alias("id"), F.lit(kind).alias("kind"), F.to_json(F.struct(*sorted(rows.columns))).alias("data"))
        out = one if out is None else out.unionAll(one)
    return out


def asset_types(token_type: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, asset_type); unknown ids and empty types give null."""
    return ids.join(token_type.select(F.col("token_id").alias("id"), "token_type"), "id", "left").select("id", F.nullif("token_type", F.lit("")).alias("asset_type"))


def resolve(ids: DataFrame, token_type: DataFrame, tables: dict[str, tuple[DataFrame, str]], transfers: DataFrame, amounts: DataFrame | None = None) -> DataFrame:
    """(id, type, data) for a list of ids of any kind: tokens by their registered type, owners, else transactions, whose missing amounts are filled from `amounts`. Unknown ids are left out."""
    kinds = ids.select("id", S.id_kind(F.col("id")).alias("is"))
    tokens = asset_types(token_type, kinds.where("is = 'token'").select("id")).select("id", F.col("asset_type").alias("kind"))
    named = tokens.unionAll(kinds.where("is = 'did'").select("id", F.lit("DID").alias("kind")))
    found = lookup(tables, named).select("id", F.col("kind").alias("type"), "data")
    txns = first_transfer(transfers, kinds.where("is = 'transaction'").select(F.col("id").alias("txn_id")))
    if amounts is not None:
        txns = filled(kept(txns, "found"), amounts)
    return found.unionAll(txns.select(F.col("txn_id").alias("id"), F.lit("TransferBlock").alias("type"), F.to_json(F.struct(*sorted(txns.columns))).alias("data")))


def chain_page(chain: DataFrame, page: int, limit: int) -> DataFrame:
    """A page of every token's chain in order, with the token's total and number of pages."""
    skip, most = bounds(page, limit)
    total = chain.groupBy("token_id").agg(F.count(F.lit(1)).alias("total"))
    rows = chain.withColumn("rn", F.row_number().over(Window.partitionBy("token_id").orderBy("pos")))
    return rows.where((F.col("rn") > skip) & (F.col("rn") <= skip + most)).join(total, "token_id").withColumn("total_pages", total_pages(F.col("total"), limit)).drop("rn")


def _rolled_up(each: DataFrame, interval: str) -> DataFrame:
    """Sums of (ts, txns, cents, token_type) for each interval and type."""
    sums = each.groupBy(F.window("ts", interval).alias("w"), "token_type").agg(F.sum("txns").alias("txn_count"), F.sum("cents").alias("cents"))
    return sums.select(F.col("w.start").alias("interval_start"), F.col("w.end").alias("interval_end"), "txn_count", (F.col("cents") / 100).alias("total_value"), "token_type")


def _cents(amount: str) -> Column:
    return F.round(F.coalesce(amount, F.lit(0.0)) * 100).cast("bigint").alias("cents")


def _told(kinds: str) -> Column:
    """The types of a block, each once; UNKNOWN where it has none."""
    return F.when(F.size(F.coalesce(kinds, F.array().cast("array<string>"))) > 0, F.col(kinds)).otherwise(F.array(F.lit("UNKNOWN")))


def analytics(blocks: DataFrame, links: DataFrame, token_type: DataFrame, interval: str = "1 hour") -> DataFrame:
    """TxnAnalytics: transactions and value per interval and token type.

    blocks: (block_hash, epoch seconds, amount). A block counts once for each different type among its tokens, and so does its amount; without
    a registered type it counts as UNKNOWN. Blocks without a usable epoch are left out. Values are summed in hundredths."""
    types = links.select("block_hash", "token_id").join(token_type.select("token_id", "token_type"), "token_id", "left")
    kinds = types.groupBy("block_hash").agg(F.collect_set("token_type").alias("kinds"))  # at most one entry per type
    rows = blocks.where("epoch IS NOT NULL AND epoch <> 0").join(kinds, "block_hash", "left")
    return _rolled_up(rows.select(F.timestamp_seconds("epoch").alias("ts"), F.lit(1).alias("txns"), _cents("amount"), F.explode(_told("kinds")).alias("token_type")), interval)


def analytics_in_one_pass(blocks: DataFrame, token_type: DataFrame, interval: str = "1 hour") -> DataFrame:
    """The same for blocks that carry their token ids: (block_hash, epoch seconds, amount, token_ids), each once.

    Blocks are read once, and their times and amounts go along with the links, of which a block's first one (or the row that stands for none) holds the amount. Blocks of one hash and
    time count as so many, under the types of all their tokens; those without a hash have no types."""
    usable = blocks.where("epoch IS NOT NULL AND epoch <> 0").select("block_hash", "epoch", _cents("amount"), F.when(F.col("block_hash").isNotNull(), F.col("token_ids")).alias("ids"))
    links = usable.select("block_hash", "epoch", "cents", F.posexplode_outer("ids").alias("at", "token_id")).withColumn("first", F.coalesce("at", F.lit(0)) == 0)
    own = links.select("block_hash", "epoch", F.when(F.col("first"), 1).alias("txns"), F.when(F.col("first"), F.col("cents")).alias("cents"), "token_id")
    typed = own.join(token_type.select("token_id", "token_type"), "token_id", "left")
    kinds = typed.groupBy("block_hash", "epoch").agg(F.sum("txns").alias("txns"), F.sum("cents").alias("cents"), F.collect_set("token_type").alias("kinds"))  # at most one entry per type
    return _rolled_up(kinds.select(F.timestamp_seconds("epoch").alias("ts"), "txns", "cents", F.explode(_told("kinds")).alias("token_type")), interval)
