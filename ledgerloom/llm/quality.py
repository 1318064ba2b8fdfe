"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed features: words, character n-grams of each word (with a mark at
each end) and one feature for a word that repeats the one before it. A softmax layer over the average gives the score. Vectors
and layer are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_slices, crc_mod, in_arrow, mixed, per_text_sum, split_tokens, string_bytes, widened

BUCKETS, GRAMS = 1 << 16, (2, 3, 4)
REPEATED = BUCKETS  # the feature of a repeated word
BEGIN, END = 2, 3


def characters(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all strings, each as the number that its UTF-8 bytes make, and where each string's begin (one more than strings)."""
    raw, at = string_bytes(tokens)
    start = np.flatnonzero((raw & 0xC0) != 0x80)
    size = np.diff(np.append(start, len(raw)))
    out = raw[start].astype(np.uint64)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        out[more] |= raw[start[more] + k].astype(np.uint64) << np.uint64(8 * k)
    return out, np.searchsorted(start, at)


def token_features(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of every token: buckets, and where each token's features begin (one more than tokens)."""
    chars, at = characters(tokens)
    n = len(tokens)
    length = np.diff(at) + 2
    begin = np.concatenate([[0], np.cumsum(length)])
    data = np.empty(begin[-1], dtype=np.uint64)
    inner = np.ones(begin[-1], dtype=bool)
    inner[begin[:-1]] = inner[begin[1:] - 1] = False
    data[begin[:-1]], data[begin[1:] - 1] = BEGIN, END
    data[inner] = chars
    data = mixed(data + np.uint64(1))
    owner = np.repeat(np.arange(n), length)
    left = np.repeat(begin[1:], length) - np.arange(begin[-1])  # characters from here to the token's end
    # the whole word: a sum over its characters by place
    power = np.uint64(0x9E3779B97F4A7C15)
    place = (np.arange(begin[-1]) - np.repeat(begin[:-1], length)).astype(np.uint64)
    whole = np.add.reduceat(data * mixed(place + power), begin[:-1]) if n else np.zeros(0, dtype=np.uint64)
    owners, buckets = [np.arange(n)], [mixed(whole)]
    key = np.zeros(begin[-1], dtype=np.uint64)
    for k in range(1, max(GRAMS) + 1):
        step = np.zeros_like(key)
        if len(data) >= k:
            step[: len(data) - k + 1] = data[k - 1 :]
        key = (key + step) * power
        if k in GRAMS:
            ok = left >= k
            owners.append(owner[ok])
            buckets.append(mixed(key[ok] + np.uint64(k)))
    owner, bucket = np.concatenate(owners), (np.concatenate(buckets) % np.uint64(BUCKETS)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def document_bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, shares) of each text; shares sum to 1, or both are empty."""
    codes, bounds, tokens = split_tokens(texts)
    bucket, begin = token_features(tokens)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own, times = np.unique(codes[a:b], return_counts=True)
        size = begin[own + 1] - begin[own]
        at = np.repeat(begin[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        counts = np.bincount(bucket[at], weights=np.repeat(times, size), minlength=BUCKETS + 1) if len(own) else np.zeros(BUCKETS + 1)
        counts[REPEATED] = (codes[a + 1 : b] == codes[a : b - 1]).sum() * 4
        found = np.flatnonzero(counts)
        out.append((found, (counts[found] / counts.sum()).astype(np.float32) if len(found) else np.zeros(0, np.float32)))
    return out


def train(texts: list[str | None], labels: list[int], dim: int = 12, epochs: int = 12, rate: float = 1.0, seed: int = 1) -> dict:
    """Vectors (one per bucket) and a two-class softmax layer, by SGD with a falling rate, one document a step.

    Without both labels present, the model scores every text by the share of label 1 (0.5 if there is none)."""
    y = np.asarray(labels, dtype=np.int64)
    prior = float(y.mean()) if len(y) else 0.5
    if len(set(labels)) < 2:
        return {"effect": np.zeros(BUCKETS + 1), "bias": float(np.log((prior + 1e-3) / (1 - prior + 1e-3)))}
    bags = [bag for i in range(0, len(texts), 256) for bag in document_bags(pa.array(texts[i : i + 256], pa.string()))]
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS + 1, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, 2), dtype=np.float32), np.log(np.array([1 - prior, prior], dtype=np.float32))
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            at, share = bags[i]
            step = np.float32(rate * (1 - done / steps))
            done += 1
            own = vectors[at]
            mean = share @ own
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1  # gradient of the logits
            back = layer @ p
            layer -= step * np.outer(mean, p) * 0.5
            bias -= step * 0.01 * p
            vectors[at] = own - step * share[:, None] * back[None, :] * 10
    # a document's logit difference is linear in its average, so that each bucket has one effect
    return {"effect": (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float64), "bias": float(bias[1] - bias[0])}


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 6000, most_chars: int = 200_000, **settings) -> dict:
    """Train on at most `most_rows` labelled rows, the first in the order of a hash of doc_id; null labels, ids and texts and texts of over `most_chars` characters are left out.

    Of repeated labels of a doc_id the lowest counts, of its texts the first in order. Only the sample's texts come to the driver."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)  # bounded by the parameter
    fitting = docs.where(F.length("text") <= most_chars).select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    rows = fitting.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return train([r["text"] for r in rows], [int(r["quality"] > 0) for r in rows], **settings)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with a score column (0 to 1, higher: label 1 is likelier), from the whole text alone; null, empty and blank texts get the model's prior."""
    kept = docs.drop("score")
    schema = widened(kept.schema, "score double")
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        effect, bias = held.value["effect"], held.value["bias"]
        for whole in batches:
            for batch in bounded_slices(whole, "text"):
                codes, bounds, tokens = split_tokens(batch.column("text"))
                bucket, begin = token_features(tokens)
                each = np.stack([per_text_sum(effect[bucket], begin), np.diff(begin).astype(float)], axis=1)
                sums = per_text_sum(each[codes] if len(codes) else np.zeros((0, 2)), bounds)
                same = np.zeros(len(codes) + 1)
                np.cumsum(codes[1:] == codes[:-1], out=same[2:]) if len(codes) > 1 else None
                first = np.minimum(bounds[:-1] + 1, bounds[1:])  # a text's first word repeats none
                repeats = np.where(bounds[1:] > bounds[:-1], same[bounds[1:]] - same[first], 0) * 4
                total, n = sums[:, 0] + repeats * effect[REPEATED], sums[:, 1] + repeats
                logit = bias + np.divide(total, n, out=np.zeros_like(total), where=n > 0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(logit, -50, 50))))], [*batch.schema.names, "score"])

    return in_arrow(kept, run, schema)


def held_out():
    return crc_mod("doc_id", 4) == 2


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of each document; labels of held-out rows are not learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()))
    scored = score(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))
