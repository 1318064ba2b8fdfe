"""Structured Streaming jobs. What later batches must know is keyed state in RocksDB, so that a batch costs what it changes; what they find is appended to logs of Parquet folders."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import blocks as B
from ..operators import changes as C
from ..sources import schemas
from . import logs, state

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every partition's store reserves megabytes of disk
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",  # all stores of an executor share one budget
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "500",
}


def lines(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Landed JSON lines as a stream (value), for jobs that need no order of arrival."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path).where("value <> ''")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = 0
    for b in batches:
        yield b.append_column("line", pa.array(range(n, n + b.num_rows), pa.int64()))
        n += b.num_rows


def texts(spark: SparkSession, path: str, files_per_batch: int = 1, only: tuple[str, ...] = ()) -> DataFrame:
    """Landed JSON lines as a stream (value, arrival): lines arrive in the order of their files' times, then names, then as they stand in the file. With `only`, these fields of the blocks come in place of the texts.

    A file is read in splits, in each of which a task numbers the lines as it reads them, so that neither a file nor a split is held as a whole, whatever its size. Fields are decoded before, so that no text goes there and back."""
    files = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    placed = files.select("value", F.unix_micros("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).where("value <> ''")
    if only:
        placed = B.decode(placed, only=only).drop("value")
    told = placed.mapInArrow(_numbered, StructType([*(StructField(f.name, f.dataType) for f in placed.schema.fields), StructField("line", LongType())]))
    return told.withColumn("arrival", F.struct("at", "file", "start", "line")).drop("at", "file", "start", "line")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_now(stream: DataFrame, write: Callable, checkpoint: str, mode: str = "append") -> None:
    with rocksdb(stream.sparkSession):
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: Tables that live blocks are merged into: key, routes, projection. The last notification of a key replaces its row.
ROUTED = {"TransferBlocks": ("block_hash", ("transfer",), B.transfers), "BurntBlocks": ("block_hash", ("burnt",), B.burns), "SC_Blocks": ("block_id", ("deploy", "execute"), B.contract_blocks)}
INDEX = "sink string, block_hash string, txn_id string, label string"
REJECTS = "value string"


def block_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """AllBlocks, TransferBlocks, BurntBlocks or SC_Blocks as route_blocks left it."""
    return logs.table(spark, f"{folder}/{name}", schemas.TABLES[name], [ROUTED[name][0] if name in ROUTED else "block_hash"])


def rejected_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """(value, batch): texts of blocks without a hash, as they came."""
    return logs.rows_of(spark, f"{folder}/Rejects", REJECTS)


def route_blocks(spark: SparkSession, source: str, folder: str, ingest: Column | None = None, files_per_batch: int = 1) -> DataFrame:
    """Live blocks, merged as whole rows into AllBlocks (the first notification of a hash stays) and the routed tables (the last one stays); block_table reads them.
    Blocks without a hash go to the rejects.

    Returns their index: (sink, block_hash, txn_id, label). Two queries over one source: first_blocks knows the hashes before; the routed rows need nothing from earlier batches."""

    def write(batch: DataFrame, number: int) -> None:
        good, bad = B.keyed(B.decode(batch))
        logs.append(bad.select("value"), f"{folder}/Rejects", number)
        routed = B.route(good).where("route IS NOT NULL").drop("value").persist()
        label = B.S.block_type(F.col("type_code"))
        index = routed.groupBy(F.col("route").alias("sink"), "block_hash").agg(F.max_by(F.struct("txn_id", label.alias("label")), "arrival").alias("x")).select("sink", "block_hash", "x.*")
        for name, schema, key, rows in [("Index", INDEX, ["sink", "block_hash"], index), *[(n, schemas.TABLES[n], [key], project(B.last_wins(routed.where(F.col("route").isin(*routes)), "block_hash")).select(*schemas.COLUMNS[n])) for n, (key, routes, project) in ROUTED.items()]]:
            logs.append(rows, f"{folder}/{name}", number)
            logs.compact(spark, f"{folder}/{name}", schema, lambda df, key=key: logs.last_of(df, key), number)
        routed.unpersist()

    run_now(texts(spark, source, files_per_batch), write, f"{folder}/checkpoint")
    every = first_blocks(spark, source, folder, ingest, files_per_batch)
    return every.select(F.lit("all").alias("sink"), "block_hash", "txn_id", F.col("block_type").alias("label")).unionByName(logs.table(spark, f"{folder}/Index", INDEX, ["sink", "block_hash"]))


def first_blocks(spark: SparkSession, source: str, folder: str, ingest: Column | None = None, files_per_batch: int = 1) -> DataFrame:
    """AllBlocks: one row per hash under repeated notification, the first to arrive, whatever its epoch.

    The state holds each hash with its row and the times of the first and the last batch that named it; where these are one, the hash is new and its row is appended. No
    earlier row is read."""
    decoded = B.keyed(texts(spark, source, files_per_batch, B.ALL_FIELDS))[0].withColumn("now", F.current_timestamp())
    rows = B.all_blocks(decoded, F.col("now") if ingest is None else ingest, "arrival", "now")
    columns = schemas.COLUMNS["AllBlocks"]
    kept = rows.select("block_hash", "arrival", "now", F.struct(*[c for c in columns if c != "block_hash"]).alias("row"))
    known = kept.groupBy("block_hash").agg(F.min_by("row", "arrival").alias("row"), F.min("now").alias("born"), F.max("now").alias("named"))
    at = f"{folder}/AllBlocks"

    def write(batch: DataFrame, number: int) -> None:
        logs.append(batch.where("born = named").select("block_hash", "row.*").select(columns), at, number)
        logs.compact(spark, at, schemas.TABLES["AllBlocks"], lambda df: logs.last_of(df, ["block_hash"]), number)

    run_now(known, write, f"{folder}/checkpoint-first", "update")
    return logs.rows_of(spark, at, schemas.TABLES["AllBlocks"]).drop("batch")


TOKENS = "kind string, token_id string, owner_did string, token_value double, token_status int, first_seq bigint, made bigint, gone boolean"
OWNERS = "did string, RBT bigint, FT bigint, NFT bigint, SC bigint"
#: Changes without a number come before all others.
NO_SEQ = -(1 << 63)


def token_table(spark: SparkSession, folder: str) -> DataFrame:
    """The tokens that exist, as token_totals left them."""
    return logs.table(spark, f"{folder}/tokens", TOKENS, ["kind", "token_id"]).where("NOT gone").drop("gone")


def registry_table(spark: SparkSession, folder: str) -> DataFrame:
    """TokenType as token_totals left it; of kinds that share an id the one that came first."""
    first = F.min_by(F.struct("kind", "made"), "first_seq").alias("x")
    return token_table(spark, folder).groupBy("token_id").agg(first).select("token_id", F.col("x.kind").alias("token_type"), F.timestamp_micros("x.made").alias("last_updated"))


def token_totals(spark: SparkSession, source: str, folder: str, ingest: Column | None = None, files_per_batch: int = 1) -> DataFrame:
    """Live token changes: owner totals after all of them (did, RBT, FT, NFT, SC; RBT in thousandths); token_table and registry_table read what is kept beside them.

    Changes go to the state of their token, which knows the stored owner and value, and from there as effects to the state of their owner. A batch appends the rows of the tokens and owners that it touched."""
    changes = C.parsed(lines(spark, source, files_per_batch)).withColumn("ingest", F.unix_micros(F.current_timestamp() if ingest is None else ingest)).withColumn("seq", F.coalesce("seq", F.lit(NO_SEQ)))
    effects = changes.where("token_id IS NOT NULL").groupBy("kind", "token_id").transformWithStateInPandas(state.Tokens(), state.EFFECTS, "Append", "None")
    told = effects.groupBy("did").transformWithStateInPandas(state.Owners(), state.TOTALS, "Append", "None").withColumn("first_seq", F.nullif("first_seq", F.lit(NO_SEQ)))

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, out, schema, key in (("tokens", "token", TOKENS, ["kind", "token_id"]), ("dids", "owner", OWNERS, ["did"])):
            logs.append(batch.where(F.col("out") == out).select(*[c.split()[0] for c in schema.split(", ")]), f"{folder}/{name}", number)
            logs.compact(spark, f"{folder}/{name}", schema, lambda df, key=key: logs.last_of(df, key), number)
        batch.unpersist()

    run_now(told, write, f"{folder}/checkpoint")
    return logs.table(spark, f"{folder}/dids", OWNERS, ["did"])


def _handed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What one query of a job has handed to the next as a stream: a folder for each batch, which the query before writes whole before this one starts.

    Texts and numbers are never null, and are told so: else a batch in which one of two sources is empty gives the state another schema."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/start")
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 10_000).parquet(folder)
    none = {"string": "", "bigint": 0}
    return rows.select(*[F.coalesce(c, F.lit(none[kind]).cast(kind)).alias(c) if kind in none else F.col(c) for c, kind in rows.dtypes])


def _hand_first(stream: DataFrame, key: str, row: Column, order: Column, folder: str, name: str, only: str = "true") -> None:
    """Hand on one row for each new key of a stream, its first, where that fulfils `only`; the state holds each key with the times of the first and the last batch that named it."""
    kept = stream.select(key, order.alias("order"), row.alias("row")).withColumn("now", F.current_timestamp())
    known = kept.groupBy(key).agg(F.min_by("row", "order").alias("row"), F.min("now").alias("born"), F.max("now").alias("named"))
    run_now(known, lambda batch, number: batch.where("born = named").select(key, "row.*").where(only).write.mode("overwrite").parquet(f"{folder}/{name}/{number}"), f"{folder}/checkpoint-{name}", "update")


NEW_BLOCKS = "block_hash string, token_ids array<string>, cents bigint, interval_start bigint"
NEW_TYPES = "token_id string, token_type string"
TYPED = "block_hash string, cents bigint, interval_start bigint, token_type string"
DELTAS = "interval_start bigint, interval_end bigint, token_type string, txn_count bigint, cents bigint"
UNKNOWN = "UNKNOWN"


def live_txn_analytics(spark: SparkSession, source: str, registry: DataFrame, folder: str, interval: str = "1 hour", files_per_batch: int = 1) -> DataFrame:
    """TxnAnalytics by token type under live blocks and a growing registry, a stream of (token_id, token_type). No row is late, so open intervals show too.

    A block counts once, when it is first notified: once for each type among its tokens, as UNKNOWN while none has one. When a token gets its type, its blocks so far count under it, and those that were
    UNKNOWN are taken back. A batch appends the signed sums of what it changes. A token's first type stays; of two in one batch the smaller name counts.

    Four queries over native state hand rows on: new blocks, new types, blocks joined to types by token (whichever comes first waits for the other), and what a block's types add to the sums."""
    decoded = B.keyed(B.decode(texts(spark, source, files_per_batch), only=("block_hash", "amount_text", "epoch_text", "tokens")))[0]
    epoch = B.S.lenient_long(F.col("epoch_text"))
    length = F.lit(_seconds(interval))
    begin = (F.floor(F.when(epoch != 0, epoch) / length) * length).cast("bigint")
    block = F.struct(F.map_keys("tokens").alias("token_ids"), F.round(F.coalesce(B.S.lenient_double(F.col("amount_text")), F.lit(0.0)) * 100).cast("bigint").alias("cents"), begin.alias("interval_start"))
    _hand_first(decoded, "block_hash", block, F.col("arrival"), folder, "blocks", "interval_start IS NOT NULL")  # a block without a usable time counts nowhere
    told = registry.where("token_id IS NOT NULL AND token_type <> ''")
    _hand_first(told, "token_id", F.struct("token_type"), F.col("token_type"), folder, "types")

    blocks = lambda: _handed(spark, f"{folder}/blocks", NEW_BLOCKS)
    links = blocks().select("block_hash", "cents", "interval_start", F.explode(F.array_distinct("token_ids")).alias("token_id")).withColumn("token_id", F.coalesce("token_id", F.lit("")))
    typed = links.join(_handed(spark, f"{folder}/types", NEW_TYPES), "token_id").select("block_hash", "cents", "interval_start", "token_type")
    run_now(typed, lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/typed/{number}"), f"{folder}/checkpoint-typed")

    # each block under '' with the times when it came and when it was first typed, and under each of its types
    bare = blocks().select("block_hash", "cents", "interval_start", F.lit("").alias("token_type"), F.lit(False).alias("typed"))
    pairs = _handed(spark, f"{folder}/typed", TYPED).select("block_hash", "cents", "interval_start", F.explode(F.array(F.lit(""), "token_type")).alias("token_type"), F.lit(True).alias("typed"))
    rows = bare.unionByName(pairs).withColumn("now", F.current_timestamp())
    times = [F.min(F.when(~F.col("typed"), F.col("now"))).alias("came"), F.min(F.when(F.col("typed"), F.col("now"))).alias("first_typed"), F.max("now").alias("named")]
    state = rows.groupBy("block_hash", "token_type").agg(F.max("cents").alias("cents"), F.max("interval_start").alias("interval_start"), *times)
    newly = F.col("first_typed") == F.col("named")
    sign = F.when(F.col("token_type") != "", F.when(newly, 1))  # a type that the block has now for the first time
    sign = F.coalesce(sign, F.when(F.col("token_type") == "", F.when(F.col("first_typed").isNull(), F.when(F.col("came") == F.col("named"), 1)).when(newly & (F.col("came") < F.col("first_typed")), -1)))
    added = lambda df: df.groupBy("interval_start", "interval_end", "token_type").agg(F.sum("txn_count").alias("txn_count"), F.sum("cents").alias("cents")).where("txn_count <> 0 OR cents <> 0")

    def write(batch: DataFrame, number: int) -> None:
        kind = F.when(F.col("token_type") == "", UNKNOWN).otherwise(F.col("token_type")).alias("token_type")
        deltas = batch.withColumn("txn_count", sign.cast("bigint")).where("txn_count IS NOT NULL").select("interval_start", (F.col("interval_start") + length).alias("interval_end"), kind, "txn_count", (F.col("txn_count") * F.col("cents")).alias("cents"))
        logs.append(added(deltas), f"{folder}/sums", number)
        logs.compact(spark, f"{folder}/sums", DELTAS, added, number)

    run_now(state, write, f"{folder}/checkpoint-sums", "update")
    return added(logs.rows_of(spark, f"{folder}/sums", DELTAS)).where("txn_count <> 0").select(F.timestamp_seconds("interval_start").alias("interval_start"), F.timestamp_seconds("interval_end").alias("interval_end"), "txn_count", (F.col("cents") / 100).alias("total_value"), "token_type")


def _seconds(interval: str) -> int:
    """Seconds of an interval such as '1 hour' or '15 minutes'."""
    number, unit = interval.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit.rstrip("s")]


def live_analytics(spark: SparkSession, source: str, folder: str, interval: str = "1 hour", delay: str = "1 hour", files_per_batch: int = 1) -> DataFrame:
    """Transactions and value per closed interval and block type, in append mode under a watermark.

    An interval is written once the watermark has passed its end, so the newest intervals stay open. Landed files must come in the order of time to within
    `delay`; later rows are dropped by the watermark."""
    decoded = B.decode(lines(spark, source, files_per_batch), only=("block_hash", "type_code", "amount_text", "epoch_text")).where("block_hash IS NOT NULL")
    epoch = F.col("seconds")
    rows = decoded.withColumn("seconds", F.explode(F.array(B.S.lenient_long(F.col("epoch_text"))))).select(F.timestamp_seconds(epoch).alias("ts"), B.S.block_type(F.col("type_code")).alias("block_type"), F.round(F.coalesce(B.S.lenient_double(F.col("amount_text")), F.lit(0.0)) * 100).cast("bigint").alias("cents")).where(epoch > 0)
    sums = rows.withWatermark("ts", delay).groupBy(F.window("ts", interval).alias("w"), "block_type").agg(F.count(F.lit(1)).alias("txn_count"), F.sum("cents").alias("cents"))
    out = sums.select(F.unix_timestamp("w.start").alias("interval_start"), "block_type", "txn_count", "cents")
    with rocksdb(spark):
        out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")
