"""Benchmark decontamination: a prefix-filtered set join on word shingles, in DataFrame operations only.

An item's windows are its runs of `window` words (an item of fewer words is one window). A document holds a window only
if it holds all of the window's shingles of `shingle` words, so one necessary shingle is enough to find candidates: the
prefix of a window is its rarest shingle, with rarity counted over all documents. One pass over the texts finds every place of the
items' shingles; rows there are a text's hash, a place and a key, never its words, so that the work is linear in a text's length.
Candidates are bounded by position (the shingle's place in the window must fit its place in the document) and by the document's length.
Texts with candidates are read again and verified word by word over the item-sized windows, once for each text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, saved, text_names

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words counted in the text as it is.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ADDED = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words_of(text):
    """Lower-cased (A-Z only) words: runs of digits, ASCII letters and characters beyond ASCII; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), APART), lambda w: w != "")


def shingle_keys(words, n, size: int):
    """A 64-bit key for each run of `size` words, in order; none where there are fewer words."""
    cut = lambda i: F.xxhash64(F.lit(size), *[F.get(words, i + k) for k in range(size)])
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), cut)).otherwise(F.array().cast("array<bigint>"))


def windows_of(benchmark: DataFrame, window: int) -> DataFrame:
    """(win: the words, len, items: sorted distinct item ids as text): each different window once. Null ids are left out."""
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    cut = items.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, F.lit(window)))).alias("win"))
    return cut.groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("len", F.size("win"))


def shingles_of(wins: DataFrame, shingle: int, sizes: list[int]) -> DataFrame:
    """(win, len, items, offset, key) for each shingle of each window."""
    parts = [wins.where(F.least("len", F.lit(shingle)) == s).select("*", F.posexplode(shingle_keys(F.col("win"), F.col("len"), s)).alias("offset", "key")) for s in sizes]
    return saved(reduce(DataFrame.unionAll, parts), "decontaminate-shingles")


def prefixes(needed: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, offset, win, len, items): each window's rarest shingle. A window with a shingle that no document holds is left out."""
    ranked = needed.join(counts, "key", "left").withColumn("missing", F.max(F.col("df").isNull()).over(Window.partitionBy("win")))
    order = Window.partitionBy("win").orderBy("df", "key", "offset")
    return ranked.where("NOT missing").withColumn("k", F.row_number().over(order)).where("k = 1").select("key", "offset", "win", "len", "items")


def covered(found):
    """Words inside the runs (at, len) of an array that is sorted by at."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    step = lambda x, c: F.struct((x["n"] + F.greatest(F.lit(0), c["at"] + c["len"] - F.greatest(c["at"], x["reach"]))).alias("n"), F.greatest(x["reach"], c["at"] + c["len"]).alias("reach"))
    return F.aggregate(found, start, step, lambda x: x["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, most_windows: int = 100_000) -> DataFrame:
    """docs' rows without text, with n_words, n_hit, n_items, items_sha256 and contaminated added.

    n_hit counts the words inside any occurrence of a window; n_items the items with an occurring window; items_sha256 is the
    digest of their ids, sorted as strings and comma-joined. Null or wordless texts have 0 words and no hits; null or
    wordless items have no windows, and items without an id are left out. Every row, repeated ones too, gives a row; equal texts are verified
    once. Columns of the added names are replaced; others, whatever their names, stay. Empty tables work. Texts are told apart by two 64-bit hashes.
    Up to `most_windows` different windows, keys are broadcast; beyond that they are joined by a shuffle. The result is the same.
    """
    docs = docs.drop(*ADDED)
    row = F.struct(*[c for c in docs.columns if c != "text"]).alias("row")
    texts = docs.select(row, F.coalesce("text", F.lit("")).alias("text")).withColumns(text_names(F.col("text")))
    wins = saved(windows_of(benchmark, window), "decontaminate-windows")
    small = F.broadcast if wins.limit(most_windows + 1).count() <= most_windows else lambda df: df
    sizes = [r["s"] for r in wins.select(F.least("len", F.lit(shingle)).alias("s")).distinct().orderBy("s").collect()] or [shingle]  # at most `shingle` values
    needed = shingles_of(wins, shingle, sizes)
    keys = small(needed.select("key").distinct())
    words = texts.select("t", "u", words_of(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    places = [words.select("t", "u", "n", F.posexplode(shingle_keys(F.col("w"), F.col("n"), s)).alias("pos", "key")).join(keys, "key", "left_semi") for s in sizes]
    places = saved(reduce(DataFrame.unionAll, places), "decontaminate-places")
    prefix = saved(prefixes(needed, places.groupBy("key").agg(F.count(F.lit(1)).alias("df"))), "decontaminate-prefix")

    fits = places.join(small(prefix), "key").where("pos >= offset AND pos - offset + len <= n")
    fits = fits.select("t", "u", (F.col("pos") - F.col("offset")).alias("at"), "len", "win", "items").distinct()  # equal texts have equal candidates
    fits = saved(fits.groupBy("t", "u").agg(F.sort_array(F.collect_list(F.struct("at", "len", "win", "items"))).alias("fits")), "decontaminate-candidates")
    # never broadcast for its size on disk: the windows' words repeat in it, so that it takes some seventy times as much in memory
    read = texts.select("t", "u", "text").join(checked_broadcast(fits.select("t", "u")), ["t", "u"], "left_semi").join(fits.hint("merge"), ["t", "u"])
    read = read.select("t", "u", "fits", F.explode(F.array(words_of(F.col("text")))).alias("w"))  # split once, not for each candidate
    found = read.select("t", "u", F.filter("fits", lambda c: F.slice(F.col("w"), c["at"] + 1, c["len"]) == c["win"]).alias("found")).where("size(found) > 0")
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda c: c["items"]))))
    told = found.select("t", "u", covered(F.col("found")).cast("bigint").alias("n_hit"), items.alias("items")).dropDuplicates(["t", "u"])
    told = saved(told.select("t", "u", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "decontaminate-found")

    rows = texts.select("row", "t", "u", F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("n_words")).join(checked_broadcast(told), ["t", "u"], "left")
    hits = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return rows.select("row.*", "n_words", hits.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (hits > 0).alias("contaminated"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document, for windows of ten words of the benchmark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT cast(item_id AS varchar) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), wins AS (
  SELECT item, array_to_string(list_slice(w, s, s + 9), ' ') AS t, least(len(w), 10) AS n
  FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(s) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM wins
), grams AS (
  SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS t FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(s)
), hits AS (SELECT DISTINCT g.doc_id, g.s, g.n, i.item FROM grams g JOIN wins i ON g.t = i.t AND g.n = i.n
), words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(s, s + n)) AS u(p) GROUP BY doc_id
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, cast(len(d.w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
