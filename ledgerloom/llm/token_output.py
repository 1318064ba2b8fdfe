"""Token-ID output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A folder holds two tables. `ranks` lists the ids by falling frequency over the whole corpus. `blocks` holds the
documents in ascending doc_id order, one row per run of whole documents: the coder replaces an id by its rank and writes the
rank's 1 to 4 low bytes into `data`; two bits of `control` for each id say how many. Decoding looks lengths up in a table of
256 control bytes and ids in the table of ranks, in numpy.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from .common import binary_array, bounded_slices, in_arrow, new_folder, ranges, saved, split_tokens, string_bytes

END_ID, BLOCK_IDS = 1, 1 << 18
#: Byte lengths of the four ids that a control byte describes.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.int64)


#: A run of letters (ASCII and Latin-1), or of ASCII punctuation without the apostrophe: the tokenizer parts the two and lower-cases the first.
PLAIN = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+|[!-&(-/:-@\[-`{-~]+")
#: Byte → the character that stands for it in a byte-level vocabulary.
BYTE_CHARS = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
BYTE_CHARS |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in BYTE_CHARS)}
AS_CHARS = {chr(c): "".join(BYTE_CHARS[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
#: Bytes of letters, and of punctuation that is parted from a letter before it: no apostrophe (contractions), no bar (it ends special tokens).
LETTER = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", dtype=np.uint8))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PART = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{}~", dtype=np.uint8))


def lower_cased_words(tokenizer_json: str) -> bool:
    """Whether the tokenizer is of the kind that PLAIN describes: lower-cased, byte-level, letters apart from other characters."""
    told = json.loads(tokenizer_json)
    norm, pre = told.get("normalizer") or {}, told.get("pre_tokenizer") or {}
    return {"type": "Lowercase"} in norm.get("normalizers", []) and [x["type"] for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"] and r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in str(pre["pretokenizers"][0]["pattern"].get("Regex"))


def spaced(texts: pa.Array) -> pa.Array:
    """The texts with a blank between a letter and punctuation, where such a tokenizer parts them anyway, so that there are fewer different words.

    They are lower-cased too (A-Z), unless a text at hand may hold a special token, which is told by its case."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    raw, at = string_bytes(texts)
    if not len(raw):
        return texts
    if not pc.any(pc.match_substring(texts, "<|")).as_py():
        raw = LOWER[raw]
    after = LETTER[raw[:-1]]
    after[1:] |= (raw[:-2] == 0xC3) & (raw[1:-1] != 0x97) & (raw[1:-1] != 0xB7)  # Latin-1 letters
    cut = np.flatnonzero(after & PART[raw[1:]]) + 1
    cut = cut[at[np.searchsorted(at, cut)] != cut]  # not between two texts
    data, at = np.insert(raw, cut, 32), at + np.searchsorted(cut, at)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data))


class WordIds:
    """Ids of words, for tokenizers of the plain kind: white space always parts their words, so each is encoded once. Entry 0 is the end id's.

    Ids of word k are flat[start[k] : start[k] + size[k]]. Beyond `limit` words the older half is forgotten."""

    def __init__(self, tokenizer_json: str, limit: int = 400_000):
        self.tokenizer, self.limit, self.plain = Tokenizer.from_str(tokenizer_json), limit, lower_cased_words(tokenizer_json)
        self.words = pa.array([""], pa.large_string())
        self.flat, self.start, self.size = np.array([END_ID], dtype=np.uint32), np.zeros(1, dtype=np.int64), np.ones(1, dtype=np.int64)

    def forget(self) -> None:
        kept = np.concatenate([[0], np.arange(len(self.words) // 2, len(self.words))])
        self.words = self.words.take(pa.array(kept))
        self.flat = self.flat[ranges(self.start[kept], self.size[kept])]
        self.size = self.size[kept]
        self.start = np.cumsum(self.size) - self.size

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has): runs of letters or punctuation by the tokenizer's model alone, other words by the whole tokenizer."""
        found: list = [None] * len(words)
        odd, model, match = [], self.tokenizer.model.tokenize, PLAIN.fullmatch
        for i, word in enumerate(words):
            if match(word):
                found[i] = [t.id for t in model(word.lower() if word.isascii() else "".join([AS_CHARS.get(ch, ch) for ch in word.lower()]))]
            else:
                odd.append(i)
        for k in range(0, len(odd), 4096):
            part = odd[k : k + 4096]
            for i, got in zip(part, self.tokenizer.encode_batch_fast([words[i] for i in part], add_special_tokens=False), strict=True):
                found[i] = got.ids
        return np.fromiter(chain.from_iterable(found), dtype=np.uint32), np.fromiter(map(len, found), dtype=np.int64, count=len(found))

    def places(self, words: pa.Array) -> np.ndarray:
        """The entry of each of some different words."""
        if len(self.words) > self.limit:
            self.forget()
        at = pc.index_in(words, value_set=self.words)
        fresh = words.filter(pc.is_null(at))
        at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        for k in range(0, len(fresh), 20_000):
            part = fresh.slice(k, 20_000)
            ids, size = self.encoded(part.to_pylist())
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, ids])
        at[at < 0] = len(self.words) + np.arange(len(fresh))
        self.words = pa.concat_arrays([self.words, fresh])
        return at

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all whole texts, each with the end id; where each text's ids end)."""
        codes, bounds, words = split_tokens(spaced(texts))
        entry = np.insert(self.places(words)[codes], bounds[1:], 0)
        size = self.size[entry]
        return self.flat[ranges(self.start[entry], size)], np.concatenate([[0], np.cumsum(size)])[bounds[1:] + np.arange(1, len(bounds))]


_WORDS: dict[str, WordIds] = {}  # kept by a worker from task to task


def tokenized(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """(id_col, ids, id, n): little-endian ids of the whole text and the end id, 2 bytes each (4 where the vocabulary is larger: the second result).

    Rows without ids say how often (n) the texts of a task have an id."""
    wide = Tokenizer.from_str(tokenizer_json).get_vocab_size() > 1 << 16
    held = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    kept = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    schema = StructType([kept.schema[0], *StructType.fromDDL("ids binary, id bigint, n bigint").fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if held.value not in _WORDS:
            _WORDS.clear()
            _WORDS[held.value] = WordIds(held.value)
        words, kind, key_type = _WORDS[held.value], np.uint32 if wide else np.uint16, None
        total = np.zeros(1 << 16, dtype=np.int64)
        for whole in batches:
            key_type = whole.schema.field(0).type
            for batch in bounded_slices(whole, "text"):
                if words.plain:
                    ids, ends = words.of_texts(batch.column("text"))
                else:  # white space may belong to this tokenizer's tokens: encode whole texts
                    got = words.tokenizer.encode_batch_fast([t or "" for t in batch.column("text").to_pylist()], add_special_tokens=False)
                    ids = np.array([i for x in got for i in (*x.ids, END_ID)], dtype=np.uint32)
                    ends = np.cumsum([len(x.ids) + 1 for x in got])
                found = np.bincount(ids, minlength=len(total))
                total = found + np.pad(total, (0, len(found) - len(total)))
                ids = ids.astype(kind)
                none = pa.nulls(batch.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), binary_array(ids.view(np.uint8), ends * ids.itemsize), none, none], names)
        if key_type is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), key_type), pa.nulls(len(at), pa.binary()), pa.array(at), pa.array(total[at])], names)

    return in_arrow(kept, run, schema), wide


def rank_table(counts: DataFrame) -> DataFrame:
    """(id, n, rank) from (id, n): how often the corpus holds each id; ties by id. At most one row per id of the vocabulary."""
    rows = sorted(((r["id"], r["n"]) for r in counts.groupBy("id").agg(F.sum("n").alias("n")).collect()), key=lambda r: (-r[1], r[0]))  # bounded by the vocabulary
    return counts.sparkSession.createDataFrame([(i, n, k) for k, (i, n) in enumerate(rows)], "id bigint, n bigint, rank bigint").coalesce(1)


def coded(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of an array of ranks below 2**32."""
    v = ranks.astype(np.uint32)
    size = 1 + (v >= 1 << 8).astype(np.int64) + (v >= 1 << 16) + (v >= 1 << 24)
    padded = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    padded[: len(v)] = size - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = np.zeros(size.sum(), dtype=np.uint8)
    at = np.cumsum(size) - size
    for k in range(4):
        own = size > k
        data[at[own] + k] = (v[own] >> np.uint32(8 * k)).astype(np.uint8)
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decoded(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks that coded() wrote."""
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    raw = np.frombuffer(data, dtype=np.uint8)
    at = np.cumsum(size) - size
    v = raw[at].astype(np.uint32)
    for k in range(1, 4):
        own = np.flatnonzero(size > k)
        if not len(own):
            break
        v[own] |= raw[at[own] + k].astype(np.uint32) << np.uint32(8 * k)
    return v


def write_tokens(docs: DataFrame, tokenizer_json: str, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text (null: empty) with the end id and write the two tables under `folder`.

    Rows with equal ids are each written, in the order of their tokens; null ids come first. An empty table writes no blocks.
    """
    both, wide = tokenized(docs, tokenizer_json, id_col, text_col)
    both = saved(both, "tokens")
    tokens = both.where("ids IS NOT NULL").select(id_col, "ids")
    ranks = rank_table(both.where("ids IS NULL").select("id", "n"))
    ranks.write.parquet(f"{folder}/ranks")
    pairs = ranks.collect()
    rank_of = np.zeros(max((r["id"] for r in pairs), default=0) + 1, dtype=np.uint32)
    for r in pairs:
        rank_of[r["id"]] = r["rank"]
    held = docs.sparkSession.sparkContext.broadcast(rank_of)  # one number per id of the vocabulary
    kind = tokens.schema[id_col]
    schema = StructType([*StructType.fromDDL("part int, first bigint, n bigint").fields, *StructType.fromDDL(f"ids array<{kind.dataType.simpleString()}>, sizes array<bigint>, control binary, data binary").fields])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, keys, sizes, held_ids, most = TaskContext.get().partitionId(), 0, [], [], [], 0

        def block() -> pa.RecordBatch:
            control, data = coded(held.value[np.concatenate(held_ids)])
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first]), pa.array([most]), pa.array([keys], pa.list_(key_type)), pa.array([sizes], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())], schema.names)

        for batch in batches:
            key_type = batch.schema.field(0).type
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(raw, dtype=np.uint32 if wide else np.uint16)
                if most and most + len(ids) > BLOCK_IDS:
                    yield block()
                    first, keys, sizes, held_ids, most = first + most, [], [], [], 0
                keys.append(key)
                sizes.append(len(ids))
                held_ids.append(ids)
                most += len(ids)
        if most:
            yield block()

    ordered = tokens.repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col, "ids")
    in_arrow(ordered, encode, schema).write.option("compression", "none").parquet(f"{folder}/blocks")


def read_tokens(spark: SparkSession, folder: str, id_type: str = "bigint", digest: bool = False, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids) of each document, read back from the files; with digest, ids_crc32 in place of ids."""
    ranks = spark.read.parquet(f"{folder}/ranks").select("id", "rank").collect()  # bounded by the vocabulary
    id_of = np.zeros(len(ranks), dtype=np.uint32)
    for r in ranks:
        id_of[r["rank"]] = r["id"]
    held = spark.sparkContext.broadcast(id_of)
    blocks = spark.read.schema(f"part int, first bigint, n bigint, ids array<{id_type}>, sizes array<bigint>, control binary, data binary").parquet(f"{folder}/blocks")
    last = ("ids_crc32", "bigint") if digest else ("ids", "array<int>")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                sizes = np.asarray(row["sizes"].as_py(), dtype=np.int64)
                ids = held.value[decoded(row["control"].as_buffer(), row["data"].as_buffer(), int(sizes.sum()))]
                ends = np.cumsum(sizes)
                cut = [ids[e - s : e] for s, e in zip(sizes, ends, strict=True)]
                what = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in cut], pa.int64()) if digest else pa.array([x.astype(np.int32) for x in cut], pa.list_(pa.int32()))
                part = np.full(len(sizes), row["part"].as_py(), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), row["ids"].values, pa.array(row["first"].as_py() + ends - sizes), pa.array(sizes), what], ["part", id_col, "at", "n_tokens", last[0]])

    rows = in_arrow(blocks.select("part", "first", "ids", "sizes", "control", "data"), decode, f"part int, {id_col} {id_type}, at bigint, n_tokens bigint, {last[0]} {last[1]}")
    sums = blocks.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one number per written partition
    before, starts = 0, []
    for r in sums:
        starts.append((r["part"], before))
        before += r["n"]
    base = spark.createDataFrame(starts, "part int, base bigint")
    return rows.join(F.broadcast(base), "part").select(id_col, (F.col("base") + F.col("at")).alias("start"), "n_tokens", last[0])


def encode_and_read(docs: DataFrame, tokenizer_path: str, digest: bool = True) -> DataFrame:
    spark = docs.sparkSession
    folder = new_folder(spark, "token-files")
    with open(tokenizer_path, encoding="utf-8") as f:  # on the driver; executors get the content
        write_tokens(docs, f.read(), folder)
    return read_tokens(spark, folder, docs.schema["doc_id"].dataType.simpleString(), digest)


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from the written files."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_and_read(docs, public_tokenizers.path("word_bpe_49k.json"))
