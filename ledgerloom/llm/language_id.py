"""Language identification: word-first backoff.

A word that the training rows hold is scored by its log frequency in each language; an unseen word falls back to
its longest character n-grams that are known (5, 4, 3, 2, then 1 characters, with a mark at each end of the word).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_slices, crc_mod, in_arrow, per_text_sum, split_tokens, widened

#: Letters as Spark's side takes them.
LETTERS = regex.compile(r"\p{L}+")
LONGEST_GRAM = 5


def fit(labelled: DataFrame, rows_per_lang: int = 1500, max_words: int = 120_000, max_grams: int = 120_000, smoothing: float = 0.5) -> dict:
    """Learn from (text, lang) rows of `labelled` (also doc_id, which only draws the sample).

    About `rows_per_lang` rows of each language are drawn by a hash of doc_id and text; this bounds the sample.
    Rows with a null text or lang are not used. Spark counts the words and n-grams; the driver gets the `max_words` and `max_grams` most frequent ones
    with their counts (those seen once too, while there is room; ties by name). A word beyond these counts as unseen. An empty training set gives a model without languages.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {"langs": [], "known": {}, "scores": np.zeros((0, 0))}
    langs = sorted(sizes)
    rate = F.element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, rows_per_lang / sizes[lang]))]), F.col("lang"))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.length("text")), F.lit(1 << 30)) / float(1 << 30)
    words = rows.where(draw < rate).select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("gram")).where("gram <> ''")
    words = words.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")).persist()
    marked = F.concat(F.lit("<"), F.col("gram"), F.lit(">"))
    cut = [F.when(F.length(marked) >= k, F.transform(F.sequence(F.lit(1), F.length(marked) - (k - 1)), lambda i, k=k: F.substring(marked, i, F.lit(k)))) for k in range(1, LONGEST_GRAM + 1)]
    pieces = F.explode(F.flatten(F.filter(F.array(*cut), lambda x: x.isNotNull())))
    grams = words.select("lang", "n", pieces.alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    def top(counts: DataFrame, limit: int):
        each = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(langs)]
        return counts.groupBy("gram").agg(F.sum("n").alias("total"), *each).orderBy(F.desc("total"), "gram").limit(limit).drop("total").toArrow()

    known, table = {}, []
    for kind, found in (("w", top(words, max_words)), ("g", top(grams, max_grams))):
        names = found.column("gram").to_pylist()
        counts = np.stack([found.column(f"n{i}").to_numpy() for i in range(len(langs))], axis=1).astype(np.float64)
        width = np.array([1 if kind == "w" else len(x) for x in names])
        logs = np.zeros_like(counts)
        for k in np.unique(width):  # each length is a distribution of its own
            own = width == k
            logs[own] = np.log((counts[own] + smoothing) / (counts[own].sum(axis=0) + smoothing * own.sum()))
        known |= {kind + x: sum(map(len, table)) + i for i, x in enumerate(names)}
        table.append(logs)
    words.unpersist()
    return {"langs": langs, "known": known, "scores": np.concatenate(table).astype(np.float32)}


def words_in(token: str) -> list[str]:
    """Lower-case runs of letters."""
    low = token.lower()
    return [low] if low.isalpha() else LETTERS.findall(low)


class WordScores(dict):
    """Word (lower-case letters) → row of `rows`: its score by language, 1, and 1 if it or one of its n-grams is known. Row 0 is no word."""

    def __init__(self, model: dict, limit: int = 150_000):
        self.model, self.limit = model, limit
        self.rows = np.zeros((1024, len(model["langs"]) + 2), dtype=np.float32)
        self.used = 1

    def __missing__(self, word: str) -> int:
        if self.used == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        told = self.score(word)
        self.rows[self.used, :-2], self.rows[self.used, -2:] = (0, (1, 0)) if told is None else (told, (1, 1))
        self.used += 1
        self[word] = self.used - 1
        return self.used - 1

    def score(self, word: str) -> np.ndarray | None:
        known, scores = self.model["known"], self.model["scores"]
        if (at := known.get("w" + word)) is not None:
            return scores[at]
        for k in range(min(LONGEST_GRAM, len(word) + 2), 0, -1):
            marked = f"<{word}>" if k > 1 else word  # a mark alone says nothing
            found = [at for i in range(len(marked) - k + 1) if (at := known.get("g" + marked[i : i + k])) is not None]
            if found:
                return scores[found].mean(axis=0)
        return None

    def table(self, tokens: list[str]) -> np.ndarray:
        """For each token the sum of its words' rows. Most tokens are one word with marks around it; the others are summed one by one."""
        if len(self) > self.limit:  # bounds a worker's memory
            self.clear()
            self.used = 1
        at, more = np.zeros(len(tokens), dtype=np.int64), []
        for i, token in enumerate(tokens):
            words = words_in(token)
            if len(words) == 1:
                at[i] = self[words[0]]
            elif words:
                more.append((i, [self[w] for w in words]))
        out = self.rows[at].astype(np.float64)
        for i, rows in more:
            out[i] = self.rows[rows].sum(axis=0, dtype=np.float64)
        return out


def predict(docs: DataFrame, model: dict, undecided: str = "und") -> DataFrame:
    """docs with lang_pred, score and evidence added (columns of these names are replaced).

    score is the posterior of the predicted language under equal priors, evidence the share of words that are known or hold a known n-gram. Null texts, texts
    without a letter, and any text when the model knows no language give `undecided`, 0 and 0. Ties go to the language that sorts first. Whole texts count.
    """
    kept = docs.drop("lang_pred", "score", "evidence")
    schema = widened(kept.schema, "lang_pred string, score double, evidence double")
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_words and max_grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordScores(held.value)
        langs = held.value["langs"]
        for whole in batches:
            for batch in bounded_slices(whole, "text"):
                codes, bounds, tokens = split_tokens(batch.column("text"))
                sums = per_text_sum(cache.table(tokens.to_pylist())[codes] if len(codes) else np.zeros((0, len(langs) + 2)), bounds)
                words, seen, logs = np.rint(sums[:, -2]), np.rint(sums[:, -1]), sums[:, :-2]
                ok = (words > 0) & bool(langs)
                best = logs.argmax(axis=1) if langs else np.zeros(len(sums), dtype=int)
                share = np.exp(logs - logs.max(axis=1, keepdims=True)) if langs else np.ones((len(sums), 1))
                score = np.where(ok, 1 / share.sum(axis=1), 0.0)
                evidence = np.where(ok, seen / np.maximum(words, 1), 0.0)
                names = np.array([*langs, undecided], dtype=object)[np.where(ok, best, len(langs))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score), pa.array(evidence)], schema.names)

    return in_arrow(kept, run, schema)


def held_out(doc_id: str = "doc_id"):
    return crc_mod(doc_id, 5) == 0


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages learned from the rows that are not held out, predicted for every row; one row per row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
