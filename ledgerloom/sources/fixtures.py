"""Ledger rows derived from the test tables, in Spark and as SQL for the oracle, and the JSON payloads built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOKEN_OF_LINE = "case l_linenumber % 4 when 0 then concat('QmF', l_partkey) when 1 then concat('QmR', l_partkey) when 2 then concat('QmN', l_suppkey) else concat('QmS', l_suppkey % 25) end"

VIEWS = {
    "fx_rbt": """select concat('QmR', o_orderkey) as rbt_id, case when o_custkey % 150 = 0 then '0' else concat('bafy', o_custkey % 150) end as owner_did,
        concat('bh', o_orderkey) as block_id, o_orderkey % 1000 as block_height, cast(floor(o_totalprice) as bigint) % 4000 / 1000 as token_value,
        case o_orderstatus when 'O' then 0 when 'P' then 1 else 2 end as token_status, o_orderkey as num from {orders}""",
    "fx_ft": """select concat('QmF', p_partkey) as ft_id, p_retailprice as token_value, p_brand as ft_name, concat('bafy', p_partkey % 150) as owner_did,
        concat('bafy', p_size) as creator_did, p_partkey % 50 as block_height, concat('bh', p_partkey) as block_id, concat('tx', p_partkey) as txn_id,
        p_size % 3 as token_status, p_partkey as num from {part}""",
    "fx_nft": """select concat('QmN', s_suppkey) as nft_id, s_acctbal as token_value, concat('bafy', s_suppkey % 40) as owner_did, concat('bh', s_suppkey) as block_hash,
        concat('tx', s_suppkey) as txn_id, s_suppkey % 9 as block_height, s_suppkey % 2 as token_status, s_suppkey as num from {supplier}""",
    "fx_sc": """select concat('QmS', n_nationkey) as contract_id, concat('bh', n_nationkey) as block_hash, concat('bafy', n_regionkey) as deployer_did,
        concat('tx', n_nationkey) as txn_id, n_nationkey % 4 as block_height, n_nationkey % 2 as token_status, n_nationkey as num from {nation}""",
    "fx_block": """select concat('bh', o_orderkey) as block_hash, concat('tx', cast(floor(o_orderkey / 2) as bigint)) as txn_id,
        case substr(o_orderpriority, 1, 1) when '1' then '02' when '2' then '08' when '3' then '09' when '4' then '13' else '10' end as trans_code,
        concat('bafy', o_custkey % 150) as sender_did, concat('bafy', (o_custkey * 7 + 1) % 150) as receiver_did,
        case when o_orderkey % 5 = 0 then null when o_orderkey % 11 = 0 then cast(0 as double) else o_totalprice end as amount,
        case when o_orderkey % 17 = 0 then null when o_orderkey % 19 = 0 then cast(0 as bigint) else EPOCH_OF(o_orderdate) + o_orderkey % 86400 end as epoch,
        concat('Token burnt at : ', TEXT_OF(o_orderdate)) as comment, o_orderkey as num from {orders}""",
    "fx_block_token": f"""select concat('bh', l_orderkey) as block_hash, {TOKEN_OF_LINE} as token_id, cast(min(cast(l_quantity as bigint)) as bigint) as block_number,
        concat('bh', l_orderkey - 1) as prev_block_id from {{lineitem}} group by l_orderkey, {TOKEN_OF_LINE}""",
    "fx_txn_amount": "select concat('tx', o_orderkey) as txn_id, o_totalprice as txn_value from {orders} where o_orderkey % 3 <> 0",
    "fx_change": """select event_id as seq, case event_id % 4 when 0 then 'FullnodeRBTtable' when 1 then 'FullnodeFTtable' when 2 then 'FullnodeNFTtable' else 'FullnodeSCtable' end as table_name,
        case event_type when 'error' then 'DELETE' when 'signup' then 'CREATE' else 'UPDATE' end as operation,
        concat('Qm', event_id % 4, '-', cast(floor(event_id / 4) as bigint) * 7 % 97) as token_id,
        case when event_type = 'purchase' and event_id % 3 = 0 then '' else concat('bafy', user_id % 150) end as owner_did,
        case when event_type = 'view' and event_id % 5 = 0 then cast(0 as double) else cast(floor(value * 10) as bigint) / 1000 end as token_value,
        case when user_id % 7 = 0 then 1 else 0 end as token_status, ts from {events}""",
}
NAMES = ("orders", "part", "supplier", "nation", "lineitem", "events")


def view(spark: SparkSession, sf_dir: str, name: str, *more: str, **given: DataFrame) -> DataFrame:
    """Rows of a view over the test tables, or over those `given` in their place, of which columns `more` come along."""
    text = VIEWS[name].replace("EPOCH_OF(o_orderdate)", "unix_timestamp(o_orderdate)").replace("TEXT_OF(o_orderdate)", "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')")
    text = text.replace(" from {", f", {', '.join(more)} from {{", 1) if more else text
    used = {n: given.get(n) or spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in NAMES if f"{{{n}}}" in text}
    return spark.sql(text, **used)


def sql_views(*names: str) -> str:
    """A WITH clause that gives the named views to the oracle."""
    told = []
    for n in names:
        text = VIEWS[n].replace("EPOCH_OF(o_orderdate)", "cast(epoch(o_orderdate) as bigint)").replace("TEXT_OF(o_orderdate)", "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')")
        for t in NAMES:
            text = text.replace(f"{{{t}}}", t)
        told.append(f"{n} AS ({text})")
    return "WITH " + ",\n".join(told)


def tokens_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, token_id, n): one row for each token of each order, n as text. Lines are shuffled by their order's number, as they stand in the table."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity").repartition("l_orderkey")
    return lines.groupBy("l_orderkey", F.expr(TOKEN_OF_LINE).alias("token_id")).agg(F.min(F.col("l_quantity").cast("bigint")).cast("string").alias("n"))


def linked_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders that blocks are made of, with links, an array of (token_id, n) (null where there is none)."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority").repartition("o_orderkey")
    links = tokens_of_lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("token_id", "n")).alias("links"))
    return orders.join(links, "o_orderkey", "left")


def block_text() -> Column:
    """The JSON text of a row of fx_block with its links: under numeric keys, of each tenth under named ones."""

    def made(named: bool):
        k = lambda number, name: name if named else number
        before = F.concat(F.lit("bh"), F.col("num") - 1).alias(k("5", "TTPreviousBlockIDKey"))
        link = lambda x: F.struct(x["token_id"], F.struct(x["n"].alias(k("4", "TTBlockNumberKey")), before))
        tokens = F.when(F.col("links").isNotNull(), F.map_from_entries(F.transform("links", link)))
        info = F.struct(F.col("sender_did").alias(k("1", "TISenderDIDKey")), F.col("receiver_did").alias(k("2", "TIReceiverDIDKey")), F.col("comment").alias(k("3", "TICommentKey")), F.col("txn_id").alias(k("4", "TITIDKey")), tokens.alias(k("6", "TITokensKey")), F.col("sender_did").alias(k("8", "TIDeployerDIDKey")), F.col("receiver_did").alias(k("9", "TIExecutorDIDKey")))
        return F.to_json(F.struct(F.col("trans_code").alias(k("2", "TCTransTypeKey")), F.col("sender_did").alias(k("3", "TCTokenOwnerKey")), info.alias(k("5", "TCTransInfoKey")), F.create_map("receiver_did", "txn_id").alias(k("8", "TCPledgeDetailsKey")), F.col("amount").alias(k("10", "TCTokenValueKey")), F.array(F.concat("block_hash", F.lit("-c"))).alias(k("11", "TCChildTokensKey")), F.col("block_hash").alias(k("98", "TCBlockHashKey")), F.col("epoch").alias(k("epoch", "TCEpoch"))))

    return F.when(F.col("num") % 10 == 0, made(True)).otherwise(made(False))


def block_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(num, block_hash, value): every block as JSON text."""
    return view(spark, sf_dir, "fx_block", "links", orders=linked_orders(spark, sf_dir)).select("num", "block_hash", block_text().alias("value"))


#: Items of a list, and blocks of a part of a chain, at most.
PART = 1000
#: Numbers whose blocks one task may put in order for a token, before they are cut into parts.
SPAN = 1 << 16


def chain_texts(spark: SparkSession, sf_dir: str, most: int = PART, only: DataFrame | None = None) -> DataFrame:
    """(token_id, first, value): the chain of every token, or of those in `only` (token_id), in parts of at most `most` blocks, oldest block first, under TokenChainData or (even length of the id) blocks.

    A token's blocks are put in order within a span of numbers and cut there into parts; first is the place of a part's first block in the chain. Orders are shuffled to their spans, once for each token, and become texts
    there: these are several times as large. The places come to them as rows of the same grouping."""
    span, most = F.floor(F.col("o_orderkey") / SPAN).alias("span"), min(most, SPAN)
    wanted = (lambda df: df.join(only, "token_id", "left_semi")) if only is not None else lambda df: df
    numbers = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").repartition("o_orderkey")
    sizes = wanted(tokens_of_lines(spark, sf_dir).withColumnRenamed("l_orderkey", "o_orderkey").join(numbers, "o_orderkey").select("token_id", span)).groupBy("token_id", "span").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("token_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("token_id", "span", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("int").alias("first"))
    blocks = wanted(linked_orders(spark, sf_dir).select("*", span, F.explode("links.token_id").alias("token_id")))
    own = Window.partitionBy("token_id", "span").orderBy(F.col("o_orderkey").asc_nulls_first())  # a span's place comes first
    placed = blocks.unionByName(firsts, allowMissingColumns=True).withColumn("at", F.row_number().over(own) - 2).withColumn("first", F.max("first").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.where("o_orderkey IS NOT NULL").withColumn("part", F.floor(F.col("at") / most).cast("int"))
    texts = view(spark, sf_dir, "fx_block", "links", "token_id", "span", "part", "at", "first", orders=placed).select("token_id", "span", "part", "first", F.struct("at", block_text().alias("value")).alias("one"))
    parts = texts.groupBy("token_id", "span", "part").agg(F.array_sort(F.collect_list("one")).alias("all"), F.max("first").alias("first"))  # at most `most` each
    body = F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["value"]), ","), F.lit("]"))
    name = F.when(F.length("token_id") % 2 == 0, "blocks").otherwise("TokenChainData")
    return parts.select("token_id", (F.col("first") + F.col("part") * most).cast("int").alias("first"), F.concat(F.lit('{"status":true,"'), name, F.lit('":'), body, F.lit("}")).alias("value"))


def list_texts(rows: DataFrame, item: dict, lower: bool = False) -> DataFrame:
    """value: asset lists of 1,000 items at most as JSON text, one for each range of numbers, and one list that reports failure."""
    status, result = ("status", "result") if lower else ("Status", "Result")
    one = rows.select(F.floor(F.col("num") / PART).alias("g"), F.struct(*[F.col(c).alias(k) if isinstance(c, str) else c.alias(k) for k, c in item.items()]).alias("x"))
    lists = one.groupBy("g").agg(F.collect_list("x").alias("x")).select(F.to_json(F.struct(F.lit(True).alias(status), F.col("x").alias(result))).alias("value"))
    failed = one.limit(1).select(F.to_json(F.struct(F.lit(False).alias(status), F.array("x").alias(result))).alias("value"))
    return lists.unionAll(failed)
