"""Nearest vectors: a hierarchical navigable small-world graph for each shard, kept as flat neighbour arrays; shard results are merged.

Equal vectors are one node with their smallest ids, so a vector that very many rows share neither fills a shard nor cuts its graph.
Nodes are dealt to shards of bounded size by a hash. Graphs are built and searched for many vectors at once: a beam holds the best
nodes of each query, and every step looks at the neighbours of some of them. Each block of queries meets every shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from .common import binary_parts, checked_broadcast, in_arrow, saved

#: Neighbours of a node on upper levels (twice as many on level 0), beam of the construction, beam of a search, nodes inserted at once.
LINKS, BUILD_BEAM, SEARCH_BEAM, BATCH = 16, 64, 128, 256
#: Nodes of a shard, bytes of its vectors, queries of a block.
NODES, SHARD_BYTES, QUERIES = 8192, 32 << 20, 1024
STEP = 4  # nodes of a beam that are looked at together


def distances(x: np.ndarray, norm: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances, up to each query's own norm, of q's rows to the nodes of the rows of ids."""
    return norm[ids] - 2 * np.matmul(x[ids], q[:, :, None])[:, :, 0]


def beam(x: np.ndarray, norm: np.ndarray, links: np.ndarray, q: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the `width` best nodes found for each query from its starts (-1: none), best first; -1 where there are fewer."""
    rows = np.arange(len(q))[:, None]
    ids = np.full((len(q), width), -1, dtype=np.int64)
    far = np.full((len(q), width), np.inf, dtype=x.dtype)
    open_ = np.zeros((len(q), width), dtype=bool)
    seen = np.zeros((len(q), len(norm) + 1), dtype=bool)  # the last column stands for -1
    n = min(width, starts.shape[1])
    ids[:, :n] = starts[:, :n]
    far[:, :n] = np.where(ids[:, :n] >= 0, distances(x, norm, q, ids[:, :n]), np.inf)
    open_[:, :n] = ids[:, :n] >= 0
    seen[rows, ids], seen[:, -1] = True, True
    while True:
        on = np.flatnonzero(open_.any(axis=1))
        if not len(on):
            break
        some = min(STEP, width)
        at = np.argpartition(np.where(open_[on], far[on], np.inf), some - 1, axis=1)[:, :some]
        node = np.where(open_[on[:, None], at], ids[on[:, None], at], -1)
        open_[on[:, None], at] = False
        near = np.where(node[:, :, None] >= 0, links[node], -1).reshape(len(on), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[on[:, None], near]] = -1
        new = np.flatnonzero((near >= 0).any(axis=1))
        on, near = on[new], near[new]
        if not len(on):
            continue
        near = -np.sort(-near, axis=1)[:, : int((near >= 0).sum(axis=1).max())]
        seen[on[:, None], near] = True
        found = np.where(near >= 0, distances(x, norm, q[on], near), np.inf)
        all_ids, all_far = np.concatenate([ids[on], near], axis=1), np.concatenate([far[on], found], axis=1)
        all_open = np.concatenate([open_[on], near >= 0], axis=1)
        best = np.argpartition(all_far, width - 1, axis=1)[:, :width]
        take = np.arange(len(on))[:, None]
        ids[on], far[on], open_[on] = all_ids[take, best], all_far[take, best], all_open[take, best]
    order = np.argsort(far, axis=1, kind="stable")
    ids, far = ids[rows, order], far[rows, order]
    return np.where(np.isfinite(far), ids, -1), far


def chosen(x: np.ndarray, norm: np.ndarray, ids: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` of the candidates (sorted by distance, -1: none) of each row: those nearer to the row's vector than to any chosen before, then the nearest others."""
    if ids.shape[1] <= most:
        return ids
    held = x[ids]
    apart = norm[ids][:, :, None] + norm[ids][:, None, :] - 2 * np.matmul(held, held.transpose(0, 2, 1))
    kept = np.zeros(ids.shape, dtype=bool)
    for t in range(ids.shape[1]):
        kept[:, t] = (ids[:, t] >= 0) & (kept.sum(axis=1) < most) & (~kept | (apart[:, t] > far[:, t, None])).all(axis=1)
    order = np.argsort(np.where(ids < 0, 2, ~kept), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, order, axis=1)


def own_distances(x: np.ndarray, norm: np.ndarray, nodes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.where(ids >= 0, np.maximum(distances(x, norm, x[nodes], ids) + norm[nodes][:, None], 0), np.inf)


def linked_back(x: np.ndarray, norm: np.ndarray, links: np.ndarray, nodes: np.ndarray, ids: np.ndarray) -> None:
    """The links from nodes to ids, the other way round; full lists keep the best."""
    to, source = ids[ids >= 0], np.repeat(nodes, (ids >= 0).sum(axis=1))
    far = own_distances(x, norm, to, source[:, None])[:, 0]
    order = np.lexsort([source, far, to])
    to, source = to[order], source[order]
    first = np.searchsorted(to, to)
    rank, most = np.arange(len(to)) - first, links.shape[1]
    to, source, rank = to[rank < most], source[rank < most], rank[rank < most]
    owners, row = np.unique(to, return_inverse=True)
    for low in range(0, len(owners), BATCH):
        part = owners[low : low + BATCH]
        all_ids = np.concatenate([links[part], np.full((len(part), most), -1, dtype=np.int64)], axis=1)
        mine = (row >= low) & (row < low + BATCH)
        all_ids[row[mine] - low, most + rank[mine]] = source[mine]
        far = own_distances(x, norm, part, all_ids)
        order = np.argsort(far, axis=1, kind="stable")
        links[part] = chosen(x, norm, np.take_along_axis(all_ids, order, axis=1), np.take_along_axis(far, order, axis=1), most)


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """Vectors over their largest component, in single precision where their lengths allow it, and that component."""
    top = float(np.abs(vectors).max())
    x = vectors.astype(np.float64) / top
    lengths = np.abs(x).max(axis=1)
    return (x.astype(np.float32) if lengths.min() > 1e-4 else x), top


def graph(vectors: np.ndarray, seed: int = 1) -> tuple[np.ndarray, list[np.ndarray]]:
    """(order, links): nodes with the highest level first, and for each level the neighbours (-1: none) of the nodes that have it."""
    draws = np.random.default_rng(seed).random(len(vectors))
    level = (-np.log(1 - draws) / np.log(LINKS)).astype(np.int64)
    order = np.argsort(-level, kind="stable")
    level, (x, _) = level[order], scaled(vectors[order])
    norm = (x * x).sum(axis=1)
    links = [np.full((int((level >= k).sum()), LINKS if k else 2 * LINKS), -1, dtype=np.int64) for k in range(level[0] + 1)]
    done = 1
    while done < len(x):
        stop = min(len(x), done + min(done, BATCH))
        new = np.arange(done, stop)
        starts = np.zeros((len(new), 1), dtype=np.int64)
        for k in range(len(links) - 1, -1, -1):
            mine = int((level[new] >= k).sum())  # of the first ones
            found, far = beam(x, norm, links[k], x[new], starts, BUILD_BEAM if mine else STEP)
            starts = found[:, :STEP]
            if not mine:
                continue
            nodes = new[:mine]
            between = np.broadcast_to(nodes, (mine, mine)).copy()
            np.fill_diagonal(between, -1)
            ids = np.concatenate([found[:mine], between], axis=1)
            far = np.concatenate([np.where(found[:mine] >= 0, far[:mine] + norm[nodes][:, None], np.inf), np.where(between >= 0, norm[nodes][:, None] + norm[nodes][None, :] - 2 * x[nodes] @ x[nodes].T, np.inf)], axis=1)
            best = np.argsort(far, axis=1, kind="stable")[:, :BUILD_BEAM]
            ids = chosen(x, norm, np.take_along_axis(ids, best, axis=1), np.take_along_axis(far, best, axis=1), LINKS)
            links[k][nodes, : ids.shape[1]] = ids
            linked_back(x, norm, links[k], nodes, ids)
        done = stop
    return order, links


def search(vectors: np.ndarray, links: list[np.ndarray], queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, distances) of the `most` nearest nodes found, nearest first; Euclidean distances of the vectors themselves in double precision; -1 where there are fewer."""
    x, top = scaled(vectors)
    norm = (x * x).sum(axis=1)
    with np.errstate(over="ignore"):
        q = np.clip(queries.astype(np.float64) / top, -1e18, 1e18).astype(x.dtype)
    starts = np.zeros((len(q), 1), dtype=np.int64)
    for k in range(len(links) - 1, 0, -1):
        starts = beam(x, norm, links[k], q, starts, 4 * STEP)[0]
    ids = beam(x, norm, links[0], q, starts, max(SEARCH_BEAM, most))[0]
    exact = np.full(ids.shape, np.inf)
    with np.errstate(over="ignore"):
        for i in range(len(q)):  # of a beam each
            own = ids[i][ids[i] >= 0]
            exact[i, : len(own)] = np.sqrt(((vectors[own].astype(np.float64) - queries[i].astype(np.float64)) ** 2).sum(axis=1))
            ids[i, : len(own)], ids[i, len(own) :] = own, -1
    order = np.lexsort([ids, exact, ids < 0], axis=1)[:, :most] if len(q) else np.zeros((0, most), dtype=np.int64)
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(exact, order, axis=1)


def usable(batch: pa.RecordBatch, kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, matrix) of the vectors that take part; negative zeros become zeros."""
    lists, ids = batch.column("embedding"), batch.column("vec_id")
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    for dim in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero((size == dim) & known)
        some = lists.take(pa.array(at)).flatten()
        whole = some.is_valid().to_numpy(zero_copy_only=False).reshape(-1, dim).all(axis=1)
        x = pc.fill_null(some, 0).to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim) + np.dtype(kind).type(0)
        ok = whole & np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        yield dim, ids.take(pa.array(at[ok])).to_numpy(zero_copy_only=False), np.ascontiguousarray(x[ok])


def cells(x: np.ndarray) -> pa.Array:
    width = x.shape[1] * x.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(x)]).cast(pa.binary())


def distinct_vectors(rows: DataFrame, kind: str, most: int) -> DataFrame:
    """(dim, vec, ids): each vector once, as bytes, with its `most` smallest ids in order. Ids are cut to that in each batch, then by groups of tasks, before a vector's ids meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, x in usable(batch, kind):
                if not len(x):
                    continue
                _, same = np.unique(x.view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_inverse=True)
                order = np.lexsort([ids, same])
                same, ids = same[order], ids[order]
                fresh = np.concatenate([[True], (same[1:] != same[:-1]) | (ids[1:] != ids[:-1])])
                same, ids, order = same[fresh], ids[fresh], order[fresh]
                first = np.searchsorted(same, same)
                near = np.arange(len(same)) - first < most
                begins = np.flatnonzero(first[near] == np.arange(len(same))[near])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([begins, [near.sum()]]).astype(np.int32)), pa.array(ids[near]))
                yield pa.RecordBatch.from_arrays([pa.array([dim] * len(begins), pa.int32()), cells(x[order[near][begins]]), lists], ["dim", "vec", "ids"])

    told = in_arrow(rows, run, "dim int, vec binary, ids array<bigint>").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(1000)))
    least = lambda: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids")
    return told.groupBy("dim", "vec", "salt").agg(least()).groupBy("dim", "vec").agg(least())


def nearest(vectors: DataFrame, every: int = 100, most: int = 10, nodes: int = NODES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors (vec_id, embedding) whose vec_id `every` divides its `most` nearest other rows found (all, if fewer), nearest first, ties to the smaller vec_id.

    score is the Euclidean distance in double precision. Vectors null, empty, zero, or with null or non-finite components take no part, nor do rows without a vec_id.
    Vectors of different dimensions don't meet. Rows that repeat an id and a vector count once; of an id with different vectors each is a row, none of which is near to another. Other columns don't matter.
    `nodes` bounds a shard; distances are exact, and so is the result while a shard has few nodes; else the neighbours are those that the graphs lead to."""
    element = vectors.schema["embedding"].dataType
    if not isinstance(element, ArrayType) or not isinstance(element.elementType, FloatType | DoubleType):
        raise TypeError("embedding must be an array of floats or doubles")
    kind = "<f4" if isinstance(element.elementType, FloatType) else "<f8"
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    classes = saved(distinct_vectors(rows, kind, most + 1), "vectors")
    room = F.least(F.lit(nodes), F.greatest(F.lit(256), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim")))))
    shards = saved(classes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / room).cast("int").alias("shards")), "vector-shards")

    def build(key: tuple, table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table.column("vec")))  # a task that runs again builds the same graph
        dim, shard = (k.as_py() for k in key)
        x = np.frombuffer(b"".join(table.column("vec").to_pylist()), dtype=kind).reshape(-1, dim)
        order, links = graph(x)
        ids = table.column("ids").combine_chunks().take(pa.array(order))
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "vecs": pa.array([x[order].tobytes()], pa.binary()), "ids": pa.array([ids.to_pylist()], pa.list_(pa.list_(pa.int64()))), "links": pa.array([[a.astype("<i4").tobytes() for a in links]], pa.list_(pa.binary()))})

    dealt = classes.join(checked_broadcast(shards), "dim").withColumn("shard", F.pmod(F.xxhash64("vec"), F.col("shards")).cast("int"))
    graphs = saved(dealt.select("dim", "shard", "vec", "ids").groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, vecs binary, ids array<array<bigint>>, links array<binary>"), "vector-graphs")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, x in usable(batch, kind):
                yield pa.RecordBatch.from_arrays([pa.array([dim] * len(ids), pa.int32()), pa.array(ids, pa.int64()), cells(x)], ["dim", "query_id", "vec"])

    queries = saved(in_arrow(rows.where(F.col("vec_id") % every == 0), asked, "dim int, query_id bigint, vec binary").distinct(), "vector-queries")
    blocks = queries.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks")).join(shards, "dim")
    block = F.pmod(F.xxhash64("query_id", "vec"), F.col("blocks"))
    asks = queries.join(checked_broadcast(saved(blocks, "vector-blocks")), "dim").groupBy("dim", block.alias("block"), "shards").agg(F.collect_list("query_id").alias("query_ids"), F.collect_list("vec").alias("asks"))  # about QUERIES of them
    meet = asks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).join(graphs, ["dim", "shard"]).select("dim", "query_ids", "asks", "vecs", "ids", "links")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                own = {c: batch.column(c)[r] for c in batch.schema.names}
                dim, ids, ask = own["dim"].as_py(), own["query_ids"].as_py(), own["asks"].as_py()
                x = np.frombuffer(own["vecs"].as_buffer(), dtype=kind).reshape(-1, dim)
                links = [np.frombuffer(b, dtype="<i4").astype(np.int64).reshape(-1, 2 * LINKS if k == 0 else LINKS) for k, b in enumerate(own["links"].as_py())]
                q = np.frombuffer(b"".join(ask), dtype=kind).reshape(-1, dim)
                found, far = search(x, links, q, most + 1)
                members = own["ids"].values
                out = ([], [], [], [])
                for i, (query, text) in enumerate(zip(ids, ask, strict=True)):
                    near = [(d, v) for c, d in zip(found[i].tolist(), far[i].tolist(), strict=True) if c >= 0 for v in members[c].as_py() if v != query]
                    for d, v in sorted(near)[:most]:
                        for column, value in zip(out, (query, text, v, d), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.float64())], ["query_id", "vec", "vec_id", "score"])

    found = in_arrow(meet, look, "query_id bigint, vec binary, vec_id bigint, score double").withColumn("vec", F.xxhash64("vec"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "vec").orderBy("score", "vec_id"))).where(F.col("rank") <= most)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op12_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id and score: the ten nearest of every hundredth embedding."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
