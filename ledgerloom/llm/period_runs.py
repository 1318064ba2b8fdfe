"""Periodic runs of words, by maximal pairs.

A run of smallest period q and length l starts at i exactly if the suffixes at i and i + q agree in l - q words, no more, and different words stand before them: a
maximal pair. Suffixes are sorted by doubling, their common lengths give the LCP intervals, and these are walked bottom up. A node has its positions in order, classed by
the word to their left; where two children meet, neighbouring positions of different classes are the pairs that may be close enough. Two occurrences
closer than a third of their common length have no other class between them, so that farther positions need no look; pairs of a multiple of the
smallest period name the same stretch and the least of them stays.

Only texts in which five words repeat often enough within a short distance are sorted at all, and only intervals of such five words are walked: a run
has 3 * q - 4 starts in a row whose five words come again at q or before.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_slices, in_arrow, mixed, ranges, split_tokens

#: Least length of a run and least number of its periods.
LEAST, TIMES = 6, 4
GRAM = 5  # the shortest common length of a maximal pair that is a run
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: The two ends of a maximal pair that is a run share at least so many times their distance.
CLOSE = TIMES - 1


def repeated_parts(codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, starts): texts that may hold runs, and the starts in them whose five words may stand in a run or its repetition."""
    none = np.zeros(0, dtype=np.int64)
    if len(codes) < GRAM + 1:
        return none, none
    word = mixed(codes.astype(np.uint64) + np.uint64(1))
    key = mixed(doc[: len(codes) - GRAM + 1].astype(np.uint64) + np.uint64(1 << 40))
    for k in range(GRAM):
        key = key * FACTOR + word[k : k + len(key)]
    at = np.flatnonzero(doc[GRAM - 1 :] == doc[: len(key)])
    order = at[np.argsort(key[at], kind="stable")]
    again = np.flatnonzero(key[order[1:]] == key[order[:-1]]) if len(order) else none
    start, gap = order[again], order[again + 1] - order[again]
    by = np.argsort(start)
    start, gap = start[by], gap[by]
    while len(start):
        new = np.concatenate([[True], (start[1:] != start[:-1] + 1) | (doc[start[1:]] != doc[start[:-1]])])
        number = np.cumsum(new) - 1
        fits = CLOSE * gap - (GRAM - 1) <= np.bincount(number)[number]
        if fits.all():
            break
        start, gap = start[fits], gap[fits]
    if not len(start):
        return none, none
    marked = np.unique(key[start])
    place = np.minimum(np.searchsorted(marked, key[at]), len(marked) - 1)
    return np.unique(doc[start]), at[marked[place] == key[at]]


def sorted_suffixes(codes: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the suffixes of texts that stand one after the other (end: where each position's text ends), those with equal first words together, and how many
    words each shares with the one before it, 0 where these are fewer than five. Texts must not share codes of words."""
    n = len(codes)
    place = np.arange(n)
    columns = [np.where(place + k < end, codes[np.minimum(place + k, n - 1)], -1) for k in range(GRAM)]
    order = np.lexsort(columns[::-1])
    differs = np.zeros(n, dtype=bool)
    differs[:1] = True
    for c in columns:
        differs[1:] |= c[order[1:]] != c[order[:-1]]
    first = np.flatnonzero(differs)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(first, np.diff(np.concatenate([first, [n]])))
    levels, size = [rank.astype(np.int32)], GRAM
    sizes = np.diff(np.concatenate([first, [n]]))
    open_ = ranges(first[sizes > 1], sizes[sizes > 1])  # places in the order whose rank is shared
    while len(open_):
        at = order[open_]
        follows = np.where(at + size < end[at], rank[np.minimum(at + size, n - 1)], -1)
        by = np.lexsort([follows, rank[at]])
        at, follows = at[by], follows[by]
        order[open_] = at
        new = np.concatenate([[True], (rank[at[1:]] != rank[at[:-1]]) | (follows[1:] != follows[:-1])])
        first = np.flatnonzero(new)
        sizes = np.diff(np.concatenate([first, [len(at)]]))
        rank[at] = np.repeat(open_[first], sizes)
        size *= 2
        open_ = open_[np.repeat(sizes > 1, sizes)]
        levels.append(rank.astype(np.int32))
    common = np.zeros(n, dtype=np.int64)
    pair = np.flatnonzero(~differs)
    a, b = order[pair - 1], order[pair]
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common[pair], b + common[pair]
        inside = (x < end[a]) & (y < end[b])
        same = np.zeros(len(pair), dtype=bool)
        same[inside] = levels[k][x[inside]] == levels[k][y[inside]]
        common[pair[same]] += GRAM << k
    on = pair
    for _ in range(GRAM - 1):
        x, y = order[on - 1] + common[on], order[on] + common[on]
        inside = (x < end[order[on - 1]]) & (y < end[order[on]])
        on, x, y = on[inside], x[inside], y[inside]
        on = on[codes[x] == codes[y]]
        common[on] += 1
    return order, common


def joined(one: list[int], other: list[int], size: int, left: list[int], runs: dict) -> list[int]:
    """The positions of two children whose suffixes share `size` words; maximal pairs that are runs go to runs, {(start, length): period}."""
    if len(one) < len(other):
        one, other = other, one
    for x in other:
        k = bisect_left(one, x)
        for a, b in [(y, x) for y in one[max(k - 1, 0) : k]] + [(x, y) for y in one[k : k + 1]]:
            q = b - a
            if CLOSE * q <= size and q + size >= LEAST and left[a] != left[b]:
                runs[a, q + size] = min(q, runs.get((a, q + size), q))
    for x in other:
        if x > one[-1]:
            one.append(x)
        else:
            one.insert(bisect_left(one, x), x)
    return one


def maximal_pairs(order: list[int], common: list[int], left: list[int]) -> dict:
    """Runs among sorted suffixes: the LCP-interval tree from the bottom up. A common length of 0 parts trees."""
    runs: dict = {}
    stack: list[tuple[int, list[int]]] = []
    child: list[int] = []
    for place, size in zip([*order, -1], [*common, 0], strict=True):
        while stack and stack[-1][0] > size:
            deep, held = stack.pop()
            child = joined(held, child, deep, left, runs)
        if size:
            if stack and stack[-1][0] == size:
                child = joined(stack.pop()[1], child, size, left, runs)
            stack.append((size, child))
        child = [place]
    return runs


def runs_of(codes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of texts whose words' codes stand between bounds, in order; starts are places in codes."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    texts, starts = repeated_parts(codes, doc)
    if not len(texts):
        return []
    size = bounds[texts + 1] - bounds[texts]
    place = ranges(bounds[texts], size)
    begin = np.concatenate([[0], np.cumsum(size)])
    own = np.repeat(np.arange(len(texts)), size)
    _, plain = np.unique(codes[place], return_inverse=True)
    order, common = sorted_suffixes(own * (int(plain.max()) + 1) + plain, begin[own + 1])
    wanted = np.zeros(len(codes), dtype=bool)
    wanted[starts] = True
    keep = wanted[place[order]]
    left = np.concatenate([[-1], plain[:-1]])
    left[begin[:-1]] = -1 - np.arange(len(texts))
    found = maximal_pairs(order[keep].tolist(), common[keep].tolist(), left.tolist())
    return sorted((int(place[a]), length, q) for (a, length), q in found.items())


def looped(bounds: np.ndarray, ids: list) -> np.ndarray:
    """Which original word stands at each place: of texts whose crc32 of the id ends in 0, words from some place on repeat. A null id changes nothing."""
    out = np.arange(bounds[-1])
    for k, i in enumerate(ids):
        n, b = int(bounds[k + 1] - bounds[k]), int(bounds[k])
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            out[b + a : b + n] = b + a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return out


SCHEMA = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def run_columns(ids: list, texts: pa.Array) -> list[pa.Array]:
    codes, bounds, words = split_tokens(texts)
    codes = codes[looped(bounds, ids)]
    runs = runs_of(codes, bounds)
    drop = np.zeros(len(codes) + 1, dtype=np.int64)
    for s, length, q in runs:
        drop[s + q] += 1
        drop[s + length] -= 1
    kept = np.cumsum(drop[:-1]) == 0
    at = np.concatenate([[0], np.cumsum(kept)])[bounds]
    lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), words.cast(pa.string()).take(pa.array(codes[kept])))
    collapsed = [hashlib.sha256(x.as_buffer()).hexdigest() for x in pc.binary_join(lists, " ")]
    own: list[list] = [[] for _ in ids]
    for (s, length, q), k in zip(runs, (np.searchsorted(bounds, [r[0] for r in runs], side="right") - 1).tolist(), strict=True):
        own[k].append((s - int(bounds[k]), length, q))
    best = [min(r, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if r else (None, None, None) for r in own]
    digest = [hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in sorted(r, key=lambda x: (x[0], x[2]))).encode()).hexdigest() for r in own]
    milli = [None if s is None else 1000 * n // q for s, n, q in best]
    longs = [[len(r) for r in own], *[[b[c] for b in best] for c in range(3)], milli]
    return [*[pa.array(x, pa.int64()) for x in longs], pa.array(digest, pa.string()), pa.array(collapsed, pa.string())]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256 and collapsed_sha256 of each row of docs (doc_id, text).

    Null, empty and wordless texts have no runs, and the sha256 of nothing. A null doc_id leaves the words as they are. Repeated rows each give a row; ties of the greatest
    length over period go to the smallest start, then period; other columns don't matter. A text is one task's work, its length is the only bound on memory."""
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *[f.split()[0] for f in SCHEMA.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded_slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *run_columns(batch.column("doc_id").to_pylist(), batch.column("text"))], names)

    return in_arrow(docs, run, f"doc_id {id_type}, {SCHEMA}")


def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document."""
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
