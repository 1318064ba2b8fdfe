"""Helpers that the operators share: written intermediate tables, token batches, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BATCH_BYTES, SLICE_BYTES = 4 << 20, 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where it is unset and there is one machine only (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_own_checkpoint_dir", None)
    if not path:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(path)
        spark._own_checkpoint_dir = path
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def freed(*tables: DataFrame) -> None:
    """Delete the files of saved tables that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(df._saved_at)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def given_back() -> None:
    """Free memory goes back to the system: a Python worker lives on between tasks, beside the JVM of its executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def in_arrow(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """df.mapInArrow with batches bounded in bytes as well as in rows: both sides of the pipe hold a batch or two. What a task held is given back at its end."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?[0-9]+)([a-z]?)b?", conf.get(key).strip().lower()).groups()
    if not 0 < int(number) << 10 * " kmgtp".index(unit if unit and unit != "b" else " ") <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            given_back()

    return df.mapInArrow(work, schema)


def widened(schema: StructType, more: str) -> StructType:
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])


def checked_broadcast(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """The table with a broadcast hint if it has at most `most_rows` rows; else as it is, for a shuffled join.

    For narrow tables that were written before (counting them is cheap)."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def crc_mod(col: str, m: int):
    """crc32 of the id as text, modulo m; null ids count as 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % m, F.lit(0).cast("bigint"))


def text_names(text: Column) -> dict[str, Column]:
    """t and u: 128 bits of the text's sha256, as two numbers; null for a null text."""
    told = F.sha2(text.cast("binary"), 256)
    return {c: F.conv(F.substring(told, at, 16), 16, -10).cast("bigint") for c, at in (("t", 1), ("u", 17))}


def bounded_slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have at most about max_bytes together; one longer text is a part of its own."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + max_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def split_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """ASCII white-space tokens of each text: code of each token, start of each text's codes (one more than texts), distinct tokens.

    Null and blank texts have no tokens.
    """
    filled = pc.fill_null(texts, "").cast(pa.large_string())
    lists = pc.ascii_split_whitespace(filled)
    words = lists.flatten()
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(full)])[bounds]
    coded = words.filter(pa.array(full)).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds, coded.dictionary


def per_text_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values between consecutive bounds; empty ranges give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def string_bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all strings in one array, and where each begins (one more than strings)."""
    strings = strings.cast(pa.large_string())
    offsets = np.frombuffer(strings.buffers()[1], dtype=np.int64, count=len(strings) + 1 + strings.offset)[strings.offset :]
    data = strings.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary_parts(column: pa.Array, kind=np.uint8) -> list[np.ndarray]:
    """A binary column without nulls as one array for each row, without copies."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return [raw[a:b].view(kind) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def binary_array(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array of the bytes between 0 and the first end, the first and the second, and so on."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... (size of them) of each pair, one after the other."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(size) else np.zeros(0, dtype=np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges (a, b); nodes without edges are absent.

    Alternates the large-star and small-star steps, each one grouped minimum and one equi-join, so that no
    task holds the neighbours of a node; a hub's edges are a skewed join side, which adaptive execution splits.
    Every round is written to the shared folder, and the round before is deleted then. It ends when a round changes nothing.
    """
    spark = edges.sparkSession
    now = saved(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), name)
    mark = None
    while True:
        both = now.select("a", "b").unionAll(now.selectExpr("b AS a", "a AS b"))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # large star: each larger neighbour is linked to the smallest of the neighbourhood
        large = both.where("b > a").join(low, "a").where("b <> m").selectExpr("b AS a", "m AS b").distinct()
        large = saved(large, name)
        # small star: each smaller neighbour, and the node, is linked to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").selectExpr("explode(array(struct(a AS a, m AS b), struct(b AS a, m AS b))) AS e").select("e.*")
        before, now = now, saved(small.where("a <> b").distinct(), name)
        freed(before, large)
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    label = now.groupBy("a").agg(F.min("b").alias("component"))
    roots = label.select(F.col("component").alias("a")).distinct().selectExpr("a", "a AS component")
    return label.unionAll(roots).withColumnRenamed("a", "node")
