"""Tables of one row per key, in partitions by a hash of the key: a merge rewrites the partitions that it changes, a lookup reads those that it asks for.

Files are sorted by the key and carry Bloom filters on it, so that a pushed list of keys skips row groups within a partition too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .landed import kept, new_folder

#: Partitions of a table; choose it so that a partition has about a gigabyte.
BUCKETS = 64
#: Keys that are pushed to the scan as a list; more are joined.
FEW = 1000


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def read(spark: SparkSession, folder: str, schema: str, only: list[int] | None = None) -> DataFrame:
    """The table's rows with their bucket; with `only`, those partitions alone are listed and read."""
    rows = spark.read.schema(f"{schema}, bucket int").parquet(folder)
    return rows if only is None else rows.where(F.col("bucket").isin(only))


def _buckets(rows: DataFrame) -> list[int]:
    return sorted(r[0] for r in rows.select("bucket").distinct().collect())  # at most one for each partition of the table


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def deleted(spark: SparkSession, path: str) -> None:
    at, files = _path(spark, path)
    files.delete(at, True)


def start(spark: SparkSession, folder: str, schema: str) -> None:
    """An empty table, where there is none."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/bucket=-1")


def finish(spark: SparkSession, folder: str, schema: str, key: str) -> None:
    """Replace the partitions that a merge has prepared. A merge that was cut off here is finished by the next one, so that no partition is lost."""
    pending = f"{folder}.pending"
    at, files = _path(spark, f"{pending}/_SUCCESS")
    if not files.exists(at):
        return
    rows = spark.read.schema(f"{schema}, bucket int").parquet(pending).hint("rebalance", "bucket").sortWithinPartitions("bucket", key)
    bloom = {f"parquet.bloom.filter.enabled#{key}": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
    rows.write.options(**bloom).option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").mode("overwrite").parquet(folder)
    deleted(spark, pending)


def merge(rows: DataFrame, folder: str, schema: str, key: str, keep: str, buckets: int = BUCKETS) -> int:
    """Merge rows (one for each key; null keys are left out) into the table at `folder`; gives the number of partitions that it rewrote.

    keep 'first': stored rows stay, only new keys come in. keep 'last': a row replaces the stored one as a whole, where they differ. Partitions without
    a change are not written; with none, nothing is. All loads of a table must use one number of partitions. What it writes on the way is deleted at the end."""
    spark, columns = rows.sparkSession, names(schema)
    places = [new_folder(spark, name) for name in ("merge-new", "merge-changed")]
    others = [c for c in columns if c != key]
    start(spark, folder, schema)
    finish(spark, folder, schema, key)
    new = kept(rows.where(F.col(key).isNotNull()).select(*columns, bucket_of(F.col(key), buckets).alias("bucket")), "merge-new", places[0])
    held = read(spark, folder, schema, _buckets(new)).select(key, "bucket", F.struct(*others).alias("_held"))
    both = new.join(held, [key, "bucket"], "left")
    differs = F.col("_held").isNull() if keep == "first" else ~F.struct(*others).eqNullSafe(F.col("_held"))
    changed = kept(both.where(differs).select(*columns, "bucket"), "merge-changed", places[1])
    touched = _buckets(changed)
    if touched:
        rest = read(spark, folder, schema, touched).join(changed.select(key, "bucket"), [key, "bucket"], "left_anti")
        rest.unionByName(changed).write.option("compression", "zstd").mode("overwrite").parquet(f"{folder}.pending")
        finish(spark, folder, schema, key)
    for place in places:
        deleted(spark, place)
    return len(touched)


def lookup(spark: SparkSession, folder: str, schema: str, key: str, ids: DataFrame, buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """The whole rows whose key is among `ids` (one column, id). Up to `few` ids are pushed to the scan of their partitions; more are joined, partition by partition."""
    asked = ids.select(F.col("id").alias(key)).where("id IS NOT NULL").distinct().withColumn("bucket", bucket_of(F.col(key), buckets))
    some = asked.limit(few + 1).collect()  # at most few + 1
    columns = names(schema)
    if len(some) <= few:
        rows = read(spark, folder, schema, sorted({r["bucket"] for r in some}))
        return rows.where(F.col(key).isin([r[key] for r in some])).select(*columns)
    return read(spark, folder, schema).join(asked, [key, "bucket"], "left_semi").select(*columns)
