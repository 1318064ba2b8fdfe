"""Suffix-array deduplication: repeated byte strings are found by blockwise suffix sorting with a difference cover.

Suffixes are dealt into buckets by content: of the hashes of the short grams inside the `length` bytes at a start, the smallest names the start's
bucket, so that equal strings meet in one bucket and nothing else about their texts matters. Starts that follow each other into one bucket are a run, and
the bytes that a run covers are its context. Buckets of one run alone go no further, unless it may repeat itself. Spark shuffles the contexts of the other buckets; a task sorts a
block of buckets at a time. Of equal contexts all but the earliest are removed whole. The suffixes of different contexts in one bucket are sorted by
their first 32 bytes, and longer ties by the ranks of a difference-cover sample of the block, computed before by doubling. Two suffixes find a common
distance to sampled positions in a small table. Neighbours that share `length` bytes are equal; all but the earliest are removed.

Memory is bounded by the block: texts are read in pieces, a context covers at most RUN starts, and buckets of more bytes than `most_bytes` are
handled by grouped minima over their contexts and strings, combined before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_slices, checked_broadcast, in_arrow, mixed, ranges, saved, string_bytes, text_names
from .shingles import DOWN, PIECE, STEP, UP

GRAM, RUN, BLOCK_BYTES = 32, 1024, 2 << 20
#: A difference cover: every difference modulo COVER_MOD is that of two of its members.
COVER_MOD, COVER = 31, (1, 5, 11, 24, 25, 27)
IN_COVER = np.isin(np.arange(COVER_MOD), COVER)
#: The least distance at which both residues reach the cover.
DISTANCE = np.array([[next(d for d in range(COVER_MOD) if IN_COVER[(a + d) % COVER_MOD] and IN_COVER[(b + d) % COVER_MOD]) for b in range(COVER_MOD)] for a in range(COVER_MOD)])
STEPS = DISTANCE.tolist()
BYTE = mixed(np.arange(1000, 1256, dtype=np.uint64))
#: The low bits of a gram hash that give way to its place in a piece.
PLACE = np.uint64(PIECE - 1)
#: Keys of so many texts are broadcast to leave other texts out before a shuffle.
FEW = 200_000
#: Two 64-bit hashes of a text, together its identity.
TEXT = ("t", "u")


def anchored(raw: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, name, first, count, more) of runs of starts with one bucket: the smallest gram hash, the run's first start in its text and its starts, and
    whether the gram's first place changes within the run. Only then may two of the run's strings be equal. At most a piece of bytes."""
    n, window = len(raw), length - GRAM + 1
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none, none, none, none, none.astype(bool)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE[raw] * UP[:n], out=sums[1:])
    grams = (sums[GRAM:] - sums[:-GRAM]) * DOWN[: n - GRAM + 1]
    grams ^= grams >> np.uint64(32)
    grams *= STEP
    low, wide = grams & ~PLACE, 1  # by the high bits, then by place
    low |= np.arange(len(grams), dtype=np.uint64)
    while wide * 2 <= window:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    rest, m = window - wide, n - length + 1
    low = np.minimum(low[:m], low[rest : rest + m])
    full, new = np.ones(m, dtype=bool), np.ones(m, dtype=bool)
    new[1:] = low[1:] != low[:-1]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):  # a string ends in its own text
        end = max(a, b - length + 1)
        full[end:b] = False
        new[a : a + 1] = new[end : end + 1] = True
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, m))
    begin, count = begin[full[begin]], count[full[begin]]
    if not len(begin):
        return none, none, none, none, none.astype(bool)
    # starts with one place, joined where they follow each other into one bucket
    name = grams[(low[begin] & PLACE).astype(np.int64)].view(np.int64)
    owner = np.searchsorted(at, begin, side="right") - 1
    head = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])]))
    more = np.diff(np.append(head, len(begin))) > 1
    count, begin, name, owner = np.add.reduceat(count, head), begin[head], name[head], owner[head]
    if (count > RUN).any():
        parts = -(-count // RUN)
        nth = ranges(np.zeros(len(parts), dtype=np.int64), parts)
        begin, count, name, owner, more = (np.repeat(x, parts) for x in (begin, count, name, owner, more))
        begin, count = begin + nth * RUN, np.minimum(RUN, count - nth * RUN)
    return owner, name, begin - at[owner], count, more


def text_runs(texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """What anchored() gives for whole texts. A text over a piece is cut into overlapping pieces, at places that depend on that text alone."""
    raw, at = string_bytes(texts)
    if len(raw) <= PIECE:
        yield anchored(raw, at, length)
        return
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        for low in range(a, max(b - length + 1, a), PIECE - length + 1):
            own, name, first, count, more = anchored(raw[low : min(b, low + PIECE)], np.array([0, min(b, low + PIECE) - low]), length)
            yield own + i, name, first + (low - a), count, more


def words_at(text: np.ndarray, at: np.ndarray, count: int) -> list[np.ndarray]:
    """`count` big-endian 64-bit words from each position; text must be padded."""
    views = np.lib.stride_tricks.sliding_window_view(text, 8)
    return [np.ascontiguousarray(views[at + 8 * k]).view(">u8").ravel().astype(np.uint64) for k in range(count)]


def dense(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) by keys, the first most significant; equal keys have equal ranks."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


def cover_ranks(text: np.ndarray, length: int) -> np.ndarray:
    """At sampled positions the rank of their suffix to at least `length` bytes, elsewhere -1."""
    n = len(text) - 64
    at = np.flatnonzero(IN_COVER[np.arange(n) % COVER_MOD])
    rank = np.full(n + COVER_MOD * 8, -1, dtype=np.int64)
    rank[at] = dense(words_at(text, at, 4))[1]
    depth = 32
    step = COVER_MOD  # a multiple of the modulus leads from sample to sample
    while depth < length:
        rank[at] = dense([rank[at] << 32 | rank[np.minimum(at + step, len(rank) - 1)] + 1])[1]
        depth, step = step + depth, 2 * step
    return rank


def sorted_suffixes(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): starts by their suffix, and whether each has its first `length` bytes in common with the one before.

    text ends in 64 zeros; every start has `length` bytes before them. Order is that of the suffixes to `length` bytes at least."""
    ranks = cover_ranks(text, length)
    ranks_at = ranks.item
    order, prefix = dense(words_at(text, starts, 4))
    residue = starts % COVER_MOD
    own = ranks[starts + DISTANCE[residue, residue]]  # comparable among equal residues
    order, exact = dense([(prefix * COVER_MOD + residue) << 32 | own])
    # ties of 32 bytes between different residues: their classes are compared at the distance that suits both
    head = np.concatenate([[True], exact[order[1:]] != exact[order[:-1]]])
    heads = order[head]
    tie = np.concatenate([[0], np.cumsum(prefix[heads[1:]] != prefix[heads[:-1]])])
    sizes = np.bincount(tie)
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(heads))
    first_residue = residue[heads]
    mixed_up = np.zeros(len(sizes), dtype=bool)
    mixed_up[tie[1:][(tie[1:] == tie[:-1]) & (first_residue[1:] != first_residue[:-1])]] = True
    for g in np.flatnonzero(mixed_up):
        a, b = begin[g], begin[g] + sizes[g]
        at, of = starts[heads[a:b]].tolist(), first_residue[a:b].tolist()

        def compare(x: int, y: int) -> int:
            d = STEPS[of[x]][of[y]]
            return ranks_at(at[x] + d) - ranks_at(at[y] + d)

        place[a:b] = [a + k for k in sorted(range(b - a), key=cmp_to_key(compare))]
    if (place != np.arange(len(heads))).any():
        new_rank = np.empty(len(heads), dtype=np.int64)
        new_rank[place] = np.arange(len(heads))
        order = np.argsort(new_rank[exact], kind="stable")
    first, second = starts[order[1:]], starts[order[:-1]]
    same = np.zeros(len(order), dtype=bool)
    near = np.flatnonzero(prefix[order[1:]] == prefix[order[:-1]])
    equal = np.ones(len(near), dtype=bool)
    whole, rest = divmod(length, 8)
    for offset in [*range(32, 8 * whole, 8), *([length - 8] if rest else [])]:
        left = np.flatnonzero(equal)
        if not len(left):
            break
        x, y = words_at(text, first[near[left]] + offset, 1)[0], words_at(text, second[near[left]] + offset, 1)[0]
        equal[left] = x == y
    same[near + 1] = equal
    return order, same


def within(data: bytes, starts: int, length: int) -> bool:
    """Whether two of the run's strings may be equal. All of them hold the bytes from the last start to the first end, so equal ones hold these twice."""
    return starts > length - GRAM + 1 or data.find(data[starts - 1 : length], starts) >= 0


def block_marks(name: np.ndarray, place: np.ndarray, first: np.ndarray, data: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ord, begin, end) spans to remove. Contexts of whole buckets, those of a bucket in the order of their texts (`place`) and starts."""
    sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
    known: dict[bytes, int] = {}
    origin = np.fromiter(map(known.setdefault, data, range(len(data))), dtype=np.int64, count=len(data))
    copy = np.flatnonzero(origin != np.arange(len(data)))  # the same context came earlier: all of its strings did
    out = [(place[copy], first[copy], first[copy] + sizes[copy])]
    kept = np.flatnonzero(origin == np.arange(len(data)))
    other = np.concatenate([[True], name[kept[1:]] != name[kept[:-1]], [True]])
    alone = other[:-1] & other[1:]  # the only one of its bucket
    kept = kept[[not x or within(data[i], sizes[i] - length + 1, length) for x, i in zip(alone.tolist(), kept.tolist(), strict=True)]]
    if len(kept):
        sizes = sizes[kept]
        text = np.concatenate([np.frombuffer(b"".join([data[i] for i in kept.tolist()]), dtype=np.uint8), np.zeros(64, dtype=np.uint8)])
        begin = np.cumsum(sizes) - sizes
        count = sizes - length + 1
        context = np.repeat(np.arange(len(kept)), count)
        starts = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        order, same = sorted_suffixes(text, starts, length)
        group = np.cumsum(~same)
        least = np.full(group[-1] + 1, len(starts), dtype=np.int64)
        np.minimum.at(least, group, order)  # places are in the order of texts and starts
        later = np.zeros(len(starts), dtype=bool)
        later[order] = order != least[group]
        edge = np.concatenate([[True], context[1:] != context[:-1]])
        run = np.flatnonzero(later & (np.concatenate([[True], ~later[:-1]]) | edge))
        stop = np.flatnonzero(later & (np.concatenate([~later[1:], [True]]) | np.concatenate([edge[1:], [True]])))
        own = kept[context[run]]
        base = first[own] - begin[context[run]]
        out.append((place[own], starts[run] + base, starts[stop] + base + length))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def anchor_rows(docs: DataFrame, length: int, often: int = 4) -> DataFrame:
    """(deal, name, t, u, first, count) of every text, a text once per task. Rows with one `deal` are to meet.

    deal is the name, but for names that some texts at hand hold more than `often` times: such a name is repeated for sure, so that its further
    rows are spread instead of meeting in one task. They have a negative count, as have runs that may repeat themselves: no other row is needed."""
    columns = ["deal", "name", *TEXT, "first", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()  # bounded by the rows of a task
        for whole in batches:
            for batch in bounded_slices(whole, "text", PIECE):
                keys = list(zip(*(batch.column(c).to_pylist() for c in TEXT), strict=True))
                new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
                if not new:
                    continue
                batch = batch.take(pa.array(new))
                t, u = (batch.column(c).to_numpy() for c in TEXT)
                for owner, name, first, count, more in text_runs(batch.column("text"), length):
                    order = np.argsort(name, kind="stable")
                    begin = np.concatenate([[True], name[order[1:]] != name[order[:-1]]]) if len(order) else np.zeros(0, dtype=bool)
                    nth = np.arange(len(order)) - np.maximum.accumulate(np.where(begin, np.arange(len(order)), 0))
                    sure = np.zeros(len(order), dtype=bool)
                    sure[order] = nth >= often
                    deal = np.where(sure, mixed((name ^ t[owner]).view(np.uint64) + first.astype(np.uint64)).view(np.int64), name)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (deal, name, t[owner], u[owner], first.astype(np.int32), np.where(sure | more, -count, count).astype(np.int32))], columns)

    return in_arrow(docs, run, "deal bigint, name bigint, t bigint, u bigint, first int, count int")


def context_rows(joined: DataFrame, length: int) -> DataFrame:
    """(name, ord, first, data): the bytes that each run of starts covers. joined: (text, ord, runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded_slices(whole, "text"):
                raw, at = string_bytes(batch.column("text"))
                raw, lists = raw.tobytes(), batch.column("runs")
                owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                runs = lists.flatten()
                name, first, count = (runs.field(c).to_numpy() for c in ("name", "first", "count"))
                place, start = batch.column("ord").to_numpy()[owner], at[owner] + first
                size = count.astype(np.int64) + length - 1
                bounds = np.searchsorted(np.cumsum(size), np.arange(0, size.sum(), 1 << 20), side="left").tolist() + [len(size)]  # a megabyte at a time
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    data = [raw[x:y] for x, y in zip(start[a:b].tolist(), (start[a:b] + size[a:b]).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(name[a:b]), pa.array(place[a:b]), pa.array(first[a:b]), pa.array(data, pa.binary())], ["name", "ord", "first", "data"])

    return in_arrow(joined.select("text", "ord", "runs"), run, "name bigint, ord bigint, first int, data binary")


def marked(contexts: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """(ord, begin, end) spans to remove, from contexts that a shuffle brings together by name."""

    def told(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        name, place, first = (rows.column(c).to_numpy() for c in ("name", "ord", "first"))
        data = rows.column("data").to_pylist()
        again = np.concatenate([[False], (name[1:] == name[:-1]) & (place[1:] == place[:-1]) & (first[1:] == first[:-1])])  # one run of one text, from repeated rows
        if again.any():
            data = [x for x, y in zip(data, again.tolist(), strict=True) if not y]
            name, place, first = name[~again], place[~again], first[~again]
        spans = block_marks(name, place, first, data, length)
        return pa.RecordBatch.from_arrays([pa.array(spans[0]), pa.array(spans[1].astype(np.int32)), pa.array(spans[2].astype(np.int32))], ["ord", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("name").to_numpy()
            ends = np.flatnonzero(names[1:] != names[:-1]) + 1
            if held and names[0] != last:
                ends = np.concatenate([[0], ends])
            upto = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column("data")).to_numpy())])
            at = 0
            while (k := int(np.searchsorted(upto[ends], upto[at] + block_bytes - size))) < len(ends):  # whole buckets
                held.append(batch.slice(at, ends[k] - at))
                yield told(held)
                held, size, at, ends = [], 0, int(ends[k]), ends[k + 1 :]
            held.append(batch.slice(at))
            size, last = size + int(upto[-1] - upto[at]), names[-1]
        if held:
            yield told(held)

    return in_arrow(contexts.repartition("name").sortWithinPartitions("name", "ord", "first"), run, "ord bigint, begin int, end int")


def hot_marked(contexts: DataFrame, length: int) -> DataFrame:
    """The same for buckets of very many bytes: a grouped minimum over their contexts, then over the strings of the different ones, both combined before the shuffle."""
    contexts = contexts.select("data", F.struct("ord", "first").alias("place"))
    different = saved(contexts.groupBy("data").agg(F.min("place").alias("least")), "suffix-hot-contexts")
    whole = contexts.join(different, "data").where("place <> least").select("place.ord", F.col("place.first").alias("begin"), (F.col("place.first") + F.octet_length("data")).alias("end"))
    each = different.select("least", "data", F.explode(F.sequence(F.lit(0), F.octet_length("data") - length)).alias("k"))
    each = each.select(F.substring("data", F.col("k") + 1, F.lit(length)).alias("s"), F.struct(F.col("least.ord").alias("ord"), (F.col("least.first") + F.col("k")).alias("at")).alias("place"))
    least = each.groupBy("s").agg(F.min("place").alias("earliest"))
    return whole.unionAll(each.join(least, "s").where("place <> earliest").select("place.ord", F.col("place.at").alias("begin"), (F.col("place.at") + length).alias("end")))


def kept_bytes(joined: DataFrame) -> DataFrame:
    """(ord, removed, spans, kept) of texts with their spans (begin, end), which may overlap and are sorted: bytes removed, maximal runs of them, digest of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded_slices(whole, "text"):
                raw, at = string_bytes(batch.column("text"))
                raw, lists = raw.tobytes(), batch.column("cuts")
                owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                begin, end = (lists.flatten().field(c).to_numpy() + at[owner] for c in ("begin", "end"))
                reach = np.maximum.accumulate(end)  # a text's spans end before the next text's begin
                head = np.concatenate([[True], (begin[1:] > reach[:-1]) | (owner[1:] != owner[:-1])])
                begin, owner = begin[head], owner[head]
                end = reach[np.append(np.flatnonzero(head)[1:], len(reach)) - 1]
                n = np.bincount(owner, minlength=batch.num_rows)
                removed = np.bincount(owner, weights=end - begin, minlength=batch.num_rows).astype(np.int64)
                bounds, digests = np.concatenate([[0], np.cumsum(n)]).tolist(), []
                begin, end, at = begin.tolist(), end.tolist(), at.tolist()
                for i in range(batch.num_rows):
                    a, b = bounds[i], bounds[i + 1]
                    digests.append(hashlib.sha256(b"".join([raw[x:y] for x, y in zip([at[i], *end[a:b]], [*begin[a:b], at[i + 1]], strict=True)])).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("ord"), pa.array(removed), pa.array(n.astype(np.int64)), pa.array(digests, pa.string())], ["ord", "removed", "spans", "kept"])

    return in_arrow(joined.select("ord", "text", "cuts"), run, "ord bigint, removed bigint, spans bigint, kept string")


def deduplicate_spans(docs: DataFrame, length: int = 100, most_bytes: int = 4 << 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row of docs (doc_id, text) with n_bytes, n_removed, n_spans, kept_sha256; other columns don't matter.

    A byte is removed if a string of `length` bytes covers it that also starts earlier: in a text of a smaller doc_id, or earlier in the same one. Texts
    are UTF-8; null counts as empty, texts under `length` bytes lose nothing, and matches never cross texts. Null ids come last; different texts under one id are
    ordered by a hash, equal ones by row. `most_bytes` and `block_bytes` bound what a task holds; results don't depend on them.
    """
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns(text_names(F.col("text")))
    table = plain.select("doc_id", *TEXT, F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.monotonically_increasing_id().alias("row"))
    table = saved(table, "suffix-rows")
    first = table.groupBy(*TEXT).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "row")).alias("f")).select(*TEXT, "f.*")
    # one number for each text, in the order in which texts count as earlier
    first = saved(first.orderBy("no_id", "id", *TEXT).select(*TEXT, "id", F.col("row").alias("first_row"), F.monotonically_increasing_id().alias("ord")), "suffix-first")

    long = plain.where(F.octet_length("text") >= length)
    dealt = anchor_rows(long.select(*TEXT, "text"), length).repartition("deal")
    row = F.xxhash64("name", *TEXT, "first", "count")  # of all columns, so that both sides of the join share one shuffle
    repeated = dealt.groupBy("deal").agg(F.min(row).alias("a"), F.max(row).alias("b"), F.min("count").alias("c")).where("a <> b OR c < 0").select("deal")
    runs = saved(dealt.join(repeated, "deal").select(*TEXT, "name", "first", F.abs("count").alias("count")), "suffix-runs")
    hot = saved(runs.groupBy("name").agg(F.sum(F.col("count") + (length - 1)).alias("n")).where(F.col("n") > most_bytes).select("name", F.lit(True).alias("hot")), "suffix-hot-names")
    any_hot = not hot.isEmpty()
    runs = runs.join(checked_broadcast(hot), "name", "left").withColumn("hot", F.coalesce("hot", F.lit(False))) if any_hot else runs.withColumn("hot", F.lit(False))
    per_text = runs.select(*TEXT, F.struct("name", "first", "count", "hot").alias("r")).groupBy(*TEXT).agg(F.collect_set("r").alias("runs"))  # a text's own runs
    per_text = saved(per_text.join(first, [*TEXT]).select(*TEXT, "id", "ord", "runs"), "suffix-texts")

    def with_texts(told: DataFrame) -> DataFrame:
        """told's rows with their texts, each read from a row of the text's first id."""
        texts = long
        if told.limit(FEW + 1).count() <= FEW:  # else the join below shuffles all texts, once
            texts = texts.join(F.broadcast(told.select(*TEXT)), [*TEXT], "left_semi")
        texts = texts.withColumnsRenamed({"t": "_t", "u": "_u"})
        return texts.join(told, (F.col("_t") == F.col("t")) & (F.col("_u") == F.col("u")) & F.col("doc_id").eqNullSafe(F.col("id")))

    one = with_texts(per_text)
    cold = one.withColumn("runs", F.filter("runs", lambda r: ~r["hot"])) if any_hot else one
    spans = marked(context_rows(cold, length), length, block_bytes)
    if any_hot:
        spans = spans.unionAll(hot_marked(saved(context_rows(one.withColumn("runs", F.filter("runs", lambda r: r["hot"])), length).distinct(), "suffix-hot"), length))
    spans = saved(spans, "suffix-spans")
    cuts = spans.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("cuts"))  # a text's own spans
    cuts = saved(cuts.join(first, "ord").select(*TEXT, "id", "ord", "cuts"), "suffix-cuts")
    told = saved(kept_bytes(with_texts(cuts)).dropDuplicates(["ord"]), "suffix-kept")
    rows = table.join(first.join(told, "ord", "left").select(*TEXT, "first_row", "removed", "spans", "kept"), [*TEXT])
    original = F.col("row") == F.col("first_row")
    gone = ~original & (F.col("n_bytes") >= length)
    value = lambda copy, own, none: F.when(gone, copy).when(original, F.coalesce(own, none)).otherwise(none)
    zero = F.lit(0).cast("bigint")
    return rows.select("doc_id", "n_bytes", value(F.col("n_bytes"), F.col("removed"), zero).alias("n_removed"), value(F.lit(1).cast("bigint"), F.col("spans"), zero).alias("n_spans"), value(F.sha2(F.lit("").cast("binary"), 256), F.col("kept"), F.col("sha")).alias("kept_sha256"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document, for repeated strings of 100 bytes."""
    return deduplicate_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
