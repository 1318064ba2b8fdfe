"""Writing and reading the eleven ledger tables as Parquet folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .schemas import COLUMNS, TABLES

#: Tables with a time to partition by; a null epoch has a partition of its own.
TIMED = ("TransferBlocks", "AllBlocks", "SC_Blocks", "BurntBlocks")


def conformed(rows: DataFrame, name: str) -> DataFrame:
    """The rows with the table's columns, in its order and types. Missing and unknown columns are errors; so are types that don't fit without loss."""
    if sorted(rows.columns) != sorted(COLUMNS[name]):
        raise ValueError(f"{name} has the columns {COLUMNS[name]}, not {rows.columns}")
    wanted = StructType.fromDDL(TABLES[name])
    widens = {("int", "bigint"), ("int", "double"), ("bigint", "double"), ("float", "double"), ("void", "string")}
    for f in wanted:
        has, due = rows.schema[f.name].dataType.simpleString(), f.dataType.simpleString()
        if has != due and (has, due) not in widens and not (has.startswith("decimal") and due == "double"):
            raise TypeError(f"{name}.{f.name} is {due}, not {has}")
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])


def period(epoch: Column, kind: str, days: int) -> Column:
    seconds = F.unix_timestamp(epoch) if kind == "timestamp" else epoch
    return F.floor(seconds / (86_400 * days)).cast("bigint")


def write_table(rows: DataFrame, name: str, folder: str, days: int | None = None) -> str:
    """Write a table below `folder`, replacing it; with days, the block tables are partitioned by periods of so many days of their epoch.

    Partitions are rebalanced before the write, so that a hot period is split and a thin one makes one file."""
    rows, path = conformed(rows, name), f"{folder}/{name}"
    if days and name in TIMED:
        kind = rows.schema["epoch"].dataType.simpleString()
        rows.withColumn("period", period(F.col("epoch"), kind, days)).hint("rebalance", "period").write.partitionBy("period").mode("overwrite").parquet(path)
    else:
        rows.write.mode("overwrite").parquet(path)
    return path


def read_table(spark: SparkSession, name: str, folder: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}").select(*COLUMNS[name])


def read_periods(spark: SparkSession, name: str, folder: str, periods: list[int | None] | None = None) -> DataFrame:
    """A table that is partitioned by periods, with its column period; with `periods`, only these partitions are read (None: rows without an epoch)."""
    rows = spark.read.schema(f"{TABLES[name]}, period bigint").parquet(f"{folder}/{name}")
    if periods is None:
        return rows
    known = [p for p in periods if p is not None]
    return rows.where(F.col("period").isin(known) | F.col("period").isNull() if None in periods else F.col("period").isin(known))


def stored(rows: DataFrame, name: str, folder: str) -> DataFrame:
    """The table, written once and read back: what reads it parses no JSON again."""
    write_table(rows, name, folder)
    return read_table(rows.sparkSession, name, folder)
