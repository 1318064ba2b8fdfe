"""Exact deduplication with stateful streaming.

The documents are read as a stream. Its state, kept on disk by the RocksDB state store and never expired, holds for
each digest of a normalised text the stable identifier of the row that stays, the locator of its content (file and row
number) and the number of rows. Rows whose digest other rows share are hits; the full bytes of hits are compared, and
the rare digest that covers different texts is split by the texts themselves.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_broadcast, new_folder, saved, widened

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every partition's store reserves megabytes of disk
}


def normalised(text_col: str):
    """The text without any character of [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", "")


def digest_of(text):
    return F.sha2(text.cast("binary"), 256)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(digest, mark): mark orders rows for staying: most code points of the original text, smallest id, then the locator."""
    length = F.coalesce(F.length(text_col), F.lit(0))
    return docs.select(
        digest_of(normalised(text_col)).alias("digest"),
        F.struct((-length).cast("bigint").alias("shorter"), F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("mark"),
    )


def stream_state(spark: SparkSession, stream: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, keeper, rows): what the state holds once all that the stream offers now has been read.

    Each micro-batch writes the digests that it touched to its own folder in the shared directory, and of a digest the last
    batch counts; a batch that runs again after a failure overwrites its folder. There is no watermark: nothing expires.
    """
    at = new_folder(spark, "exact-dedup")
    totals = keyed(stream, id_col, text_col).groupBy("digest").agg(F.min("mark").alias("keeper"), F.count(F.lit(1)).alias("rows"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/touched/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        query = totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not any(p.numInputRows for p in query.recentProgress):
        return spark.createDataFrame([], totals.schema)
    touched = spark.read.schema(widened(totals.schema, "batch bigint")).parquet(f"{at}/touched")
    last = touched.groupBy("digest").agg(F.max_by(F.struct("keeper", "rows"), "batch").alias("last"))
    return last.select("digest", "last.keeper", "last.rows")


def literal(path: str) -> str:
    """The path with no slash at its end, its marks of patterns escaped."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path.rstrip("/") or "/")


def pattern(path: str) -> str:
    """A pattern that only this (escaped) path meets: a stream reads patterns of files as well as of folders. Its last letter or digit becomes a class of one."""
    head, slash, name = path.rpartition("/")
    return head + slash + re.sub(r"([0-9A-Za-z])([^0-9A-Za-z]*)\Z", r"[\1]\2", name)


def deduplicate(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int = 1000) -> DataFrame:
    """Every row of the Parquet table at `path`: id_col, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; empty texts equal each other. Among rows that tie in length and id (repeated rows) the
    first by file and row number stays, so exactly one row of a group has kept = true. A null id loses against any other.
    Only the two named columns are read. An empty table gives an empty result.
    """
    path = literal(path)
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern(path))
    state = saved(stream_state(spark, stream, id_col, text_col), "exact-dedup-state")

    # full bytes of all hits: equal texts are combined before the shuffle
    shared = checked_broadcast(state.where("rows > 1").select("digest"))
    texts = table.select(normalised(text_col).alias("bytes")).withColumn("digest", digest_of(F.col("bytes"))).join(shared, "digest", "left_semi")
    differ = saved(texts.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), "exact-dedup-differ")

    rows = keyed(table, id_col, text_col)
    plain = rows.join(state.withColumnRenamed("digest", "of"), F.col("digest") == F.col("of"))
    if not differ.isEmpty():
        plain = plain.join(checked_broadcast(differ), "digest", "left_anti")
    out = plain.select("digest", "mark", "keeper", "rows")
    if not differ.isEmpty():
        own = keyed(table, id_col, text_col).select("digest", "mark").join(checked_broadcast(differ), "digest", "left_semi")
        text = table.select(normalised(text_col).alias("bytes"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        own = own.join(text, (F.col("mark.file") == text["file"]) & (F.col("mark.row") == text["row"]))
        groups = own.groupBy("digest", "bytes").agg(F.min("mark").alias("keeper"), F.count(F.lit(1)).alias("rows"))
        out = out.unionByName(own.join(groups, ["digest", "bytes"]).select("digest", "mark", "keeper", "rows"))
    return out.select(
        F.col("mark.id").alias(id_col),
        F.col("keeper.id").alias("keep_id"),
        F.col("rows").alias("group_size"),
        ((F.col("mark.file") == F.col("keeper.file")) & (F.col("mark.row") == F.col("keeper.row"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each document."""
    return deduplicate(spark, f"{sf_dir}/documents.parquet")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents
), r AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS k, count(*) OVER (PARTITION BY t) AS group_size,
         first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id FROM d
)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(t) AS text_sha256 FROM r
"""
