"""Spelling variants: words one edit apart, found by dense prefix-suffix tiles, and the frequent form that each leads to.

An edit of the longer word, of L code points, lies in one of three segments of its positions, so both words agree before and after that segment:
words meet in blocks of (L, segment, text before, text after). A block is a padded code-point matrix, once aligned left and once right; its pairs are
compared in tiles, and a common prefix plus a common suffix of at least L - 1 tells a single edit. The edit stands where the common prefix ends,
so that each pair counts in one segment only. Blocks of more than `most` words are cut into segments of one position, which hold
one word for each letter of the alphabet and the shorter word at most.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_slices, in_arrow, ranges, saved, split_tokens, string_bytes

#: Bytes of A-Z and a-z; 0xC3 begins U+00C0 to U+00FF and nothing else.
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Cells (pairs times code points) of a tile.
CELLS = 1 << 21
SEGMENTS = 3


def _crc_tables(n: int = 32) -> np.ndarray:
    """n times four tables: what 2**k zero bytes after a text make of each byte of its crc32."""
    byte = np.arange(256, dtype=np.uint32)
    one = byte.copy()
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    step = lambda c: one[c & 255] ^ (c >> 8)
    out = np.empty((n, 4, 256), dtype=np.uint32)
    out[0] = [step(byte << np.uint32(8 * i)) for i in range(4)]
    for k in range(1, n):
        out[k] = [shifted(out[k - 1], part) for part in out[k - 1]]
    return out


def shifted(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & 255] ^ table[1][(c >> 8) & 255] ^ table[2][(c >> 16) & 255] ^ table[3][c >> 24]


ZEROS = _crc_tables()


def joined_crc(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of two texts one after the other, from their own and the bytes of the second."""
    out = first.astype(np.uint32)
    for k in range(int(size.max(initial=0)).bit_length()):
        at = np.flatnonzero((size >> k) & 1)
        out[at] = shifted(ZEROS[k], out[at])
    return out ^ second.astype(np.uint32)


def letter_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Runs of letters (A-Z, a-z, U+00C0 to U+00FF; A-Z lower-cased) of each text, as split_tokens gives tokens."""
    raw, at = string_bytes(pc.fill_null(texts, ""))
    own = LETTER[raw]
    own[1:] |= raw[:-1] == 0xC3
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at), pa.py_buffer(np.where(own, LOWER[raw], np.uint8(32))))
    return split_tokens(plain)


def slice_counts(ids: list, texts: pa.Array, every: int, least: int) -> Counter | dict:
    """Occurrences of each word of at least `least` code points, after runs whose crc32 (with the row's id) `every` divides have lost one code point."""
    codes, bounds, words = letter_runs(texts)
    if not len(codes):
        return {}
    head = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], dtype=np.uint32)
    data, at = string_bytes(words)
    own = np.array([zlib.crc32(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], dtype=np.uint32)
    h = joined_crc(np.repeat(head, np.diff(bounds)), own[codes], np.diff(at)[codes])
    hit = np.flatnonzero(h % np.uint32(every) == 0)
    counts = np.bincount(codes, minlength=len(words))
    np.subtract.at(counts, codes[hit], 1)
    long = np.flatnonzero((pc.utf8_length(words).to_numpy(zero_copy_only=False) >= least) & (counts > 0))
    out = Counter(dict(zip(words.take(pa.array(long)).to_pylist(), counts[long].tolist(), strict=True)))
    for word, x in zip(words.take(pa.array(codes[hit])).to_pylist(), h[hit].tolist(), strict=True):
        if len(word) > least:
            out[word[: x % len(word)] + word[x % len(word) + 1 :]] += 1
    return out


def word_counts(docs: DataFrame, every: int = 97, least: int = 5) -> DataFrame:
    """(word, n) over whole texts of docs (doc_id, text); null texts have no words, a null doc_id counts as an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded_slices(whole, "text"):
                told = slice_counts(batch.column("doc_id").to_pylist(), batch.column("text"), every, least)
                yield pa.RecordBatch.from_arrays([pa.array(list(told), pa.string()), pa.array(list(told.values()), pa.int64())], ["word", "n"])

    return in_arrow(docs.select("doc_id", "text"), run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


BLOCK = ["key", "size", "low", "high"]


def in_blocks(rows: DataFrame) -> DataFrame:
    """Rows (word, n, size, low, high) with the key of their block: what stands before `low` and, in a word of `size` code points, from `high` on."""
    return rows.withColumn("key", F.xxhash64("size", "low", F.expr("left(word, low)"), F.expr("right(word, size - high)")))


def compared(words: list[str], n: np.ndarray, group: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (places) one edit apart; rows of a group stand together. Tiles of at most CELLS cells (or one pair)."""
    length = np.array([len(w) for w in words])
    ends = np.searchsorted(group, group, side="right")
    for width in np.unique(size):
        at = np.flatnonzero(size == width)
        left = np.array([words[i] for i in at], dtype=f"U{width}").view(np.uint32).reshape(len(at), width)
        right, short = left.copy(), length[at] < width
        right[short, 1:], right[short, 0] = left[short, :-1], 0
        more = np.searchsorted(at, ends[at]) - np.arange(len(at)) - 1
        begin, done = 0, np.concatenate([[0], np.cumsum(more)])
        while begin < len(at):
            stop = max(begin + 1, int(np.searchsorted(done, done[begin] + max(1, CELLS // width), side="right")) - 1)
            a = np.repeat(np.arange(begin, stop), more[begin:stop])
            b = ranges(np.arange(begin, stop) + 1, more[begin:stop])
            some = ~(short[a] & short[b])
            a, b = a[some], b[some]
            same = left[a] == left[b]
            prefix = np.where(same.all(axis=1), width, same.argmin(axis=1))
            same = (right[a] == right[b])[:, ::-1]
            suffix = np.where(same.all(axis=1), width, same.argmin(axis=1))
            near = (prefix + suffix >= width - 1) & (prefix < width) & (prefix >= low[at[a]]) & (prefix < high[at[a]])
            if near.any():
                yield at[a[near]], at[b[near]]
            begin = stop


def tile(rows: pa.Table) -> pa.RecordBatch:
    """(word, n_near, form, form_n): near words in these blocks, and the most frequent of them."""
    words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
    size, low, high, key = (rows.column(c).to_numpy() for c in ("size", "low", "high", "key"))
    new = np.concatenate([[False], (key[1:] != key[:-1]) | (size[1:] != size[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]) if len(key) else np.zeros(0, dtype=bool)
    found = [np.stack(p) for p in compared(words, n, np.cumsum(new), size, low, high)]
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)
    own, other = np.concatenate([pairs[0], pairs[1]]), np.concatenate([pairs[1], pairs[0]])
    rank = np.empty(len(words), dtype=np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort([rank[other], -n[other], own])
    own, other = own[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, dtype=np.int64)
    near = np.diff(np.concatenate([first, [len(own)]]))
    take = lambda places: pa.array([words[i] for i in places], pa.string())
    return pa.RecordBatch.from_arrays([take(own[first]), pa.array(near, pa.int64()), take(other[first]), pa.array(n[other[first]], pa.int64())], ["word", "n_near", "form", "form_n"])


def tiles(rows: DataFrame) -> DataFrame:
    """tile() over blocks that stand together after a shuffle; some blocks at a time, none of them cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
            if last or (held and held[-1].column("key")[-1].as_py() != key[-1]):
                yield tile(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield tile(pa.Table.from_batches(held))

    return in_arrow(rows.repartition("key").sortWithinPartitions(*BLOCK), run, "word string, n_near bigint, form string, form_n bigint")


def near_words(words: DataFrame, most: int = 512) -> DataFrame:
    """(word, n_near, form, form_n) of each word (word, n; each once) that has near words: their number, and the most frequent (ties: the smallest in code-point order) with its n."""
    parts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), lambda j: F.struct(F.floor(F.col("size") * j / SEGMENTS).cast("int").alias("low"), F.floor(F.col("size") * (j + 1) / SEGMENTS).cast("int").alias("high")))).alias("p")
    roles = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("size"))
    rows = in_blocks(roles.select("*", parts).select("word", "n", "size", "p.*"))
    blocks = rows.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("k"), F.max(F.length("word") == F.col("size")).alias("whole")).where("k > 1 AND whole")
    rows = saved(rows.join(blocks.drop("whole"), BLOCK), "spelling-blocks")
    single = F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("low")
    cut = in_blocks(rows.where(F.col("k") > most).select("word", "n", "size", single).withColumn("high", F.col("low") + 1))
    columns = ["word", "n", *BLOCK]
    found = tiles(rows.where(F.col("k") <= most).select(columns).unionByName(cut.select(columns)))
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("x")).select("word", "n_near", "x.form", (-F.col("x.n")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last by pointer doubling; n at least doubles at each step, so chains are short and have no rings."""
    now = saved(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        told = saved(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        now = told.select("word", "root")
        if told.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, every: int = 97, least: int = 5, least_n: int = 3, times: int = 2, most: int = 512) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of docs (doc_id, text) with at least `least` code points and `least_n` occurrences.

    form is the near word of largest n if that is at least `times` the word's own. Without texts or words there are no rows; repeated rows count again; ties go to the
    smaller word; other columns don't matter. `most` words bound a block, results don't depend on it."""
    words = saved(word_counts(docs, every, least).where(F.col("n") >= least_n), "spelling-words")
    told = words.join(near_words(words, most), "word", "left")
    fits = F.col("form_n") >= times * F.col("n")
    told = saved(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")), "spelling-forms")
    out = told.join(roots(told.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of all documents."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    """crc32 by bytes with its table of 256 numbers, words by list functions, near words by the texts that are left without one position."""
    table = [x for x in range(256)]
    for _ in range(8):
        table = [(x >> 1) ^ 0xEDB88320 if x & 1 else x >> 1 for x in table]
    lower = "translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    utf8 = "flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::UBIGINT] ELSE [195::UBIGINT, (unicode(c) - 64)::UBIGINT] END))"
    return f"""WITH RECURSIVE runs AS (SELECT doc_id, {lower} AS w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS x FROM documents WHERE text IS NOT NULL)),
pairs AS (SELECT doc_id, w, count(*) AS k, {utf8} AS b FROM runs GROUP BY doc_id, w),
hashed AS (SELECT w, k, xor(list_reduce(list_prepend(4294967295::UBIGINT, b), lambda c, x: xor(({table}::UBIGINT[])[(xor(c, x) % 256)::BIGINT + 1], c // 256)), 4294967295::UBIGINT)::BIGINT AS h FROM pairs),
counted AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM counted WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS (SELECT word, n, i, length(word) AS size, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
one AS (SELECT x.word, y.word AS near, y.n FROM cut x JOIN cut y ON x.i = y.i AND x.size = y.size AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cut x JOIN words y ON x.a || x.b = y.word UNION SELECT y.word, x.word, x.n FROM cut x JOIN words y ON x.a || x.b = y.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n FROM one GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM forms UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n FROM forms f JOIN walk ON walk.word = f.word JOIN forms r ON r.word = walk.root AND r.form IS NULL"""


OP11_SQL = _oracle()
