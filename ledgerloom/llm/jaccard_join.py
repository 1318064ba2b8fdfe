"""N-gram Jaccard join with signature trees; links become components.

Equal sets are one class. Classes whose sets may be similar share one of the tokens that come first in a common order (the prefix;
tokens of passages that stand in many texts come last, as far as they were noticed, before them those of frequent hash slots), so the classes of each such token form a block: the root of a signature tree.
Blocks with the same members are one. In every block a dual traversal over OR-combined bitmaps and size ranges prunes all pairs that
can't overlap enough; what remains connects classes to candidate groups, and each class's whole set goes to its one
group, where the same traversal runs with exact verification of each pair that is not connected yet.

Groups with more tokens than a task may hold are dealt in chunks: each chunk is joined within itself and with one leader, and the classes that
the leader's component has not reached are then joined with every chunk. No link between different components is lost.
Tokens are named by 64-bit hashes. So are classes; a second hash tells names that different sets share, and then names those sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_parts, bounded_slices, checked_broadcast, components, freed, in_arrow, saved
from .shingles import shingle_sets
from .signature_tree import Links, bitmap, candidates, width_of

SLOT_BITS, SLICE = 17, 1 << 20
#: Tokens that a task counts at once, how often one must be among these to be noticed, and how many of the most frequent ones come last in the order.
NOTED, NOTICED, FREQUENT = 1 << 22, 3, 1 << 17
NAMES = ["sid", "other"]


def names_of(tokens: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit names of a set."""
    told = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(told[:8], "little", signed=True), int.from_bytes(told[8:], "little", signed=True)


def class_of(tokens: np.ndarray, shared: frozenset) -> int:
    """The first name of a set, or the second where different sets share the first."""
    name, other = names_of(tokens)
    return other if name in shared else name


def slot(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def over_sets(rows: DataFrame, size: int, schema: str, make: Callable) -> DataFrame:
    """make(batch, sets) for batches of (doc_id, text) with the sets of the texts; about a megabyte of texts (or one text) at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for whole in batches:
            for batch in bounded_slices(whole, "text", SLICE):
                yield from make(state, batch, shingle_sets(batch.column("text"), size))
        yield from make(state, None, None)

    return in_arrow(rows, run, schema)


def grouped(rows: DataFrame, key: str, work: Callable, aside: list[str]) -> DataFrame:
    """(a, b) edges from work(batch), called with the rows of each key, which stand together after a shuffle; one group at a time is in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, edges = None, []

        def told() -> None:
            if held:
                whole = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                edges.extend(work(whole))

        for batch in batches:
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]).tolist() if len(keys) else [0]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if held and keys[a] != now:
                    told()
                    held = []
                now = keys[a]
                held.append(batch.slice(a, b - a))
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in edges], pa.int64()), pa.array([y for _, y in edges], pa.int64())], ["a", "b"])
                edges.clear()
        told()
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in edges], pa.int64()), pa.array([y for _, y in edges], pa.int64())], ["a", "b"])

    return in_arrow(rows.repartition(F.col(key)).sortWithinPartitions(key, *aside), run, "a bigint, b bigint")


class Order(NamedTuple):
    """The common order of tokens: those of `often` (sorted) last, by the classes in `times`; before them those of the slots with the larger classes in `common`."""

    common: np.ndarray
    often: np.ndarray
    times: np.ndarray

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """Numbers that sort as the tokens do."""
        out = (self.common[slot(tokens)].astype(np.uint64) << np.uint64(53)) | (tokens >> np.uint64(11))
        if len(self.often):
            at = np.minimum(np.searchsorted(self.often, tokens), len(self.often) - 1)
            out |= np.where(self.often[at] == tokens, self.times[at], 0).astype(np.uint64) << np.uint64(58)
        return out


def doublings(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(counts, 1))).astype(np.uint8)


def measured(docs: DataFrame, size: int) -> tuple[DataFrame, Order, frozenset]:
    """(doc_id, n, sid) of each row (sid null: empty set), the order of the tokens, and the first names that different sets share.

    A task tells how often each hash slot is met, and of so many tokens at a time those that it met several times: what is rarer than that is not worth a place of its own in the order."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "n", *NAMES, "slot", "token", "count"]

    def aside(state, key, name, counts):
        none = pa.nulls(len(key), pa.int64())
        given = {"slot": none, "token": none, name: pa.array(key)}
        return pa.RecordBatch.from_arrays([pa.nulls(len(key), state["id"]), none, none, none, given["slot"], given["token"], pa.array(counts)], columns)

    def noticed(state):
        tokens, counts = np.unique(np.concatenate(state["held"]), return_counts=True)
        state["held"], state["n"] = [], 0
        often = counts >= NOTICED
        return aside(state, tokens[often].view(np.int64), "token", counts[often])

    def make(state, batch, sets):
        counts = state.setdefault("counts", np.zeros(1 << SLOT_BITS, dtype=np.int64))
        if batch is not None:
            state["id"] = batch.schema.field("doc_id").type
            for s in sets:
                if len(s):
                    state.setdefault("held", []).append(s)
                    state["n"] = state.get("n", 0) + len(s)
                    if state["n"] >= NOTED:
                        yield noticed(state)
            if full := [s for s in sets if len(s)]:
                counts += np.bincount(slot(np.concatenate(full)), minlength=len(counts))
            names = [names_of(s) if len(s) else (None, None) for s in sets]
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *[pa.array([x[k] for x in names], pa.int64()) for k in (0, 1)], none, none, none], columns)
        elif "id" in state:
            if state.get("held"):
                yield noticed(state)
            at = np.flatnonzero(counts)
            yield aside(state, at, "slot", counts[at])

    both = saved(over_sets(docs, size, f"doc_id {id_type}, n bigint, sid bigint, other bigint, slot bigint, token bigint, count bigint", make), "jaccard-rows")
    counts = np.zeros(1 << SLOT_BITS)
    told = both.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("count").alias("n")).toArrow()  # at most 2**SLOT_BITS rows
    counts[told.column("slot").to_numpy()] = told.column("n").to_numpy()
    often = both.where("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    tokens, times = often.column("token").to_numpy().view(np.uint64), often.column("n").to_numpy()
    usual, own = counts.sum() / len(counts), np.argsort(tokens)
    order = Order(np.minimum(doublings(counts / max(usual, 1e-9)), 31), tokens[own], doublings(times[own]))
    rows = both.where("slot IS NULL AND token IS NULL")
    # of n sets about n * n / 2**65 pairs share a name by chance: a handful among 10**10
    shared = frozenset(r["sid"] for r in rows.where("sid IS NOT NULL").groupBy("sid").agg(F.min("other").alias("a"), F.max("other").alias("b")).where("a <> b").select("sid").collect())
    if shared:
        rows = rows.withColumn("sid", F.when(F.col("sid").isin(*shared), F.col("other")).otherwise(F.col("sid")))
    return rows.select("doc_id", "n", "sid"), order, shared


def prefixed(docs: DataFrame, size: int, num: int, den: int, order: Order, shared: frozenset) -> DataFrame:
    """(sid, n, keys, bits): each class once per task, with its prefix tokens and bitmap."""
    held = docs.sparkSession.sparkContext.broadcast(order)  # 2**SLOT_BITS + 9 * FREQUENT bytes

    def make(state, batch, sets):
        if batch is None:
            return
        seen, out = state.setdefault("seen", set()), ([], [], [], [])
        for s in sets:
            if not len(s) or (sid := class_of(s, shared)) in seen:
                continue
            seen.add(sid)  # copies within a task go no further; a task's rows bound this set
            n = len(s)
            p = n - -(-num * n // den) + 1
            keys = s[np.argpartition(held.value.of(s), p - 1)[:p]] if p < n else s
            for column, x in zip(out, (sid, n, keys.view(np.int64), bitmap(s, width_of(n)).tobytes()), strict=True):
                column.append(x)
        ends = np.cumsum([0, *map(len, out[2])]).astype(np.int32)
        keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *out[2]])))
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), keys, pa.array(out[3], pa.binary())], ["sid", "n", "keys", "bits"])

    return saved(over_sets(docs, size, "sid bigint, n bigint, keys array<bigint>, bits binary", make), "jaccard-prefixes")


def candidate_edges(prefixes: DataFrame, num: int, den: int, most: int) -> DataFrame:
    """Edges (a, b) between classes: their components hold every pair that may be similar. Blocks over `most` classes are connected whole."""
    tokens = prefixes.select(F.explode("keys").alias("key"), "sid", "n").repartition("key")
    member = tokens.groupBy("key", "sid").agg(F.first("n").alias("n"))
    name = F.xxhash64("sid")
    blocks = member.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.sum(F.shiftright(name, 20)).alias("x"), F.bit_xor(F.xxhash64("sid", F.lit(7))).alias("y"), F.min("sid").alias("first"), F.min("n").alias("low"), F.max("n").alias("high"))
    blocks = blocks.where(f"k > 1 AND NOT (k = 2 AND {den} * low < {num} * high)")
    blocks = saved(blocks.groupBy("k", "x", "y").agg(F.min("key").alias("key"), F.min("first").alias("first")).select("key", "k", "first"), "jaccard-blocks")
    member = saved(prefixes.select(F.explode("keys").alias("key"), "sid").join(checked_broadcast(blocks), "key").select("key", "sid", "k", "first"), "jaccard-members")
    large = member.where(F.col("k") > most).where("sid <> first").selectExpr("first AS a", "sid AS b")
    signed = member.where(F.col("k") <= most).select("key", "sid").distinct().join(prefixes.groupBy("sid").agg(F.first("n").alias("n"), F.first("bits").alias("bits")), "sid")

    def work(rows: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        if rows.num_rows < 2:
            return
        sids = rows.column("sid").to_pylist()
        links = Links(sids)
        for i, j in candidates(rows.column("n").to_numpy(), binary_parts(rows.column("bits"), np.uint64), num, den, links):
            links.join(i, j)
            yield sids[i], sids[j]

    edges = saved(large.unionAll(grouped(signed, "key", work, ["sid"])), "jaccard-edges")
    freed(blocks, member)
    return edges


def verified(rows: pa.RecordBatch, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Links that connect what is not connected by the labels; each is verified exactly."""
    sids = rows.column("sid").to_numpy()
    rows = rows.take(pa.array(np.unique(sids, return_index=True)[1]))
    sids, sets = rows.column("sid").to_pylist(), binary_parts(rows.column("tokens"), np.uint64)
    sizes = np.array([len(s) for s in sets])
    links = Links(rows.column("label").to_pylist())
    for i, j in candidates(sizes, [bitmap(s, width_of(len(s))) for s in sets], num, den, links):
        small, large = (i, j) if sizes[i] <= sizes[j] else (j, i)
        at = np.searchsorted(sets[large], sets[small])
        same = int((sets[large][np.minimum(at, sizes[large] - 1)] == sets[small]).sum())
        if den * same >= num * (sizes[i] + sizes[j] - same):
            links.join(i, j)
            yield sids[i], sids[j]


def links_of(sets: DataFrame, num: int, den: int, most_tokens: int) -> DataFrame:
    """Exact links (a, b) that span the components. sets: (grp, sid, n, tokens); a class may stand there more than once."""
    work = lambda rows: verified(rows, num, den)
    groups = saved(sets.select("grp", "sid", "n").distinct().groupBy("grp").agg(F.sum("n").alias("all"), F.min("sid").alias("leader")).withColumn("chunks", F.ceil(F.col("all") / most_tokens).cast("bigint")), "jaccard-groups")
    dealt = sets.join(groups.select("grp", "chunks", "leader"), "grp").withColumn("label", F.col("sid"))
    if groups.where("chunks > 1").isEmpty():
        return saved(grouped(dealt.withColumn("task", F.col("grp")).select("task", "sid", "label", "tokens"), "task", work, ["sid"]), "jaccard-links")
    chunk = F.pmod(F.xxhash64("sid"), F.col("chunks"))
    leads = F.when((F.col("sid") == F.col("leader")) & (F.col("chunks") > 1), F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).otherwise(F.array(chunk))
    first = dealt.withColumn("task", F.explode(leads)).select(F.xxhash64("grp", "task").alias("task"), "sid", "label", "tokens")
    links = saved(grouped(first, "task", work, ["sid"]), "jaccard-links")
    labels = components(links, "jaccard-labels")
    big = dealt.where("chunks > 1").drop("label").join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("component", "sid")).drop("component")
    big = saved(big, "jaccard-big")
    lead = big.where("sid = leader").select("grp", F.col("label").alias("main"))
    rest = big.join(lead, "grp").where("label <> main").drop("main")
    parts = saved(rest.groupBy("grp").agg(F.ceil(F.sum("n") / most_tokens).cast("bigint").alias("parts")), "jaccard-rest")
    all_rows = big.join(parts, "grp").withColumn("x", F.pmod(F.xxhash64("sid"), F.col("chunks"))).withColumn("y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    rest = rest.join(parts, "grp").withColumn("y", F.pmod(F.xxhash64("sid", F.lit(1)), F.col("parts"))).withColumn("x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    second = all_rows.unionByName(rest).select(F.xxhash64("grp", "x", "y").alias("task"), "sid", "label", "tokens")
    return links.unionAll(saved(grouped(second, "task", work, ["sid"]), "jaccard-links"))


def jaccard_components(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100, most_block: int = 2048, most_tokens: int = 2_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text); other columns don't matter.

    Sets hold the distinct runs of `size` words; shorter texts are one run; null, empty and wordless texts have no set and are linked with nothing, their
    component is their own doc_id. Two rows link when den * overlap >= num * union. component_id is the smallest doc_id reachable by links
    (null ids count as larger than any; null if all are null). Repeated rows each give a row. `most_block` classes and `most_tokens`
    tokens bound what one task holds; results don't depend on them.
    """
    docs = docs.select("doc_id", "text")
    rows, order, shared = measured(docs, size)
    prefixes = prefixed(docs, size, num, den, order, shared)
    edges = candidate_edges(prefixes, num, den, most_block)
    freed(prefixes)
    groups = components(edges, "jaccard-candidates").select(F.col("node").alias("sid"), F.col("component").alias("grp"))
    groups = saved(groups, "jaccard-grouped")
    freed(edges)
    classes = saved(rows.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("least")), "jaccard-classes")
    wanted = saved(groups.join(classes, "sid").select(F.col("least").alias("doc_id")).where("doc_id IS NOT NULL").distinct(), "jaccard-wanted")
    texts = docs.join(checked_broadcast(wanted), "doc_id", "left_semi").unionAll(docs.where("doc_id IS NULL"))

    def make(state, batch, sets):
        if batch is not None:
            sets = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s, shared) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["sid", "n", "tokens"])

    whole = over_sets(texts, size, "sid bigint, n bigint, tokens binary", make)
    whole = saved(whole.join(checked_broadcast(groups), "sid").select("grp", "sid", "n", "tokens"), "jaccard-sets")
    links = links_of(whole, num, den, most_tokens)
    freed(whole)
    labels = components(links, "jaccard-components")
    by_class = classes.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = by_class.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = saved(by_class.join(least, "component").select("sid", "component_id"), "jaccard-result")
    out = rows.join(by_class, "sid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of each document: runs of four words, similarity of 0.85 or more."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
