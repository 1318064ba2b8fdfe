"""op5 and op7 and the pipeline against brute force and exact round trips."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import public_tokenizers
from tokenizers import Tokenizer

from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import suffix_dedup as S
from ledgerloom.llm import token_output as T
from ledgerloom.llm.common import new_folder

PATH = public_tokenizers.path("word_bpe_49k.json")
DATA = "/root/testdata/sf0.001"


def plain_spans(rows, length=100):
    """(doc_id, bytes, removed, spans, digest) for rows in their order."""
    seen, out = set(), []
    for doc, text in rows:
        b = (text or "").encode()
        cover = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                cover[s : s + length] = b"\1" * length
            seen.add(b[s : s + length])
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out.append((doc, len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest()))
    return out


def repeats(rng):
    words = lambda n: " ".join(rng.choice(["thé", "on", "er", "ing", "and", "w%d" % rng.randrange(500)]) for _ in range(n))
    passages = [words(30) for _ in range(4)]
    rows = []
    for i in range(40):
        parts = [words(rng.randrange(20)) for _ in range(3)]
        rows.append((i, "".join(x + rng.choice([" ", "\n", rng.choice(passages), rng.choice(passages)[:110]]) for x in parts)))
    rows += [(40, "ab" * 200), (41, "a" * 100), (42, "a" * 99), (43, "a" * 350), (44, rows[3][1] * 3), (45, rows[3][1]), (46, None), (47, ""), (48, "é" * 50), (49, "é" * 51), (50, "x" * 60_000)]
    return rows


@pytest.mark.parametrize(("most", "block"), [(4 << 20, S.BLOCK_BYTES), (400, 2000)])
def test_suffix_dedup(spark, most, block):
    """The second case takes the way for hot buckets, and many small blocks."""
    rows = repeats(random.Random(1))
    shuffled = list(rows)
    random.Random(2).shuffle(shuffled)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in shuffled], "doc_id bigint, text string, tid string, n_bytes int").repartition(3)
    got = sorted(map(tuple, S.deduplicate_spans(docs, most_bytes=most, block_bytes=block).collect()))
    assert got == plain_spans(rows)


def test_suffix_dedup_of_periodic_texts(spark):
    """A megabyte of one character, and of ruled lines (their period is over a window): no more runs than ordinary text has, and nothing but the first strings stays."""
    texts = ["x" * 1_000_000, ("-" * 79 + "\n") * 12_000, "y" * 150 + "x" * 400]
    runs = [sum(len(r[0]) for r in S.text_runs(pa.array([t]), 100)) for t in texts]
    assert runs[0] < 1000 and runs[1] < len(texts[1]) / 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in S.deduplicate_spans(docs).collect()}
    assert got == {0: (999_999, 1), 1: (960_000 - 80, 1), 2: (549, 1)}


def test_suffix_dedup_of_repeated_rows_and_null_ids(spark):
    text = "some long text " * 10
    docs = spark.createDataFrame([(1, text), (1, text), (None, text + "z"), (2, "short")], "doc_id bigint, text string")
    got = sorted(map(tuple, S.deduplicate_spans(docs).collect()), key=str)
    wanted = plain_spans([(1, text), (1, text), (2, "short"), (None, text + "z")])
    assert got == sorted(wanted, key=str)
    assert S.deduplicate_spans(docs.limit(0)).count() == 0


def test_suffix_order():
    """Sorted suffixes against Python's order of the same bytes, with long ties."""
    rng = np.random.default_rng(3)
    for _ in range(10):
        body = np.concatenate([np.tile(rng.integers(97, 99, rng.integers(1, 40)), 20) for _ in range(6)] + [rng.integers(97, 123, 300)]).astype(np.uint8)
        text = np.concatenate([body, np.zeros(64, dtype=np.uint8)])
        starts = np.arange(len(body) - 100 + 1)
        order, same = S.sorted_suffixes(text, starts, 100)
        raw = body.tobytes()
        cut = [raw[s : s + 100] for s in starts[order]]
        assert cut == sorted(cut) and sorted(order) == list(range(len(starts)))
        assert same.tolist() == [False] + [a == b for a, b in zip(cut, cut[1:], strict=False)]


def test_difference_cover():
    assert {(a - b) % S.COVER_MOD for a in S.COVER for b in S.COVER} == set(range(S.COVER_MOD))


def test_variable_length_coding():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = T.coded(ranks)
        assert len(control) == -(-n // 4) and (T.decoded(control, data, n) == ranks).all()


def test_words_equal_whole_texts():
    js = open(PATH, encoding="utf-8").read()
    words, plain, rng = T.WordIds(js), Tokenizer.from_str(js), random.Random(1)
    letters = "abcXYZéÉßÿÞñöÜ.,!*&%$#|-_'’09 \t\n\x0b\x0c\x85 ́<|>endoftext"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 15))) for _ in range(3000)] + ["of<|endoftext|>.", "<|ENDOFTEXT|> A,b", "a.Σ", "e\u0301.", "x=\u0338"]
    for at in range(0, len(texts), 5):
        part = texts[at : at + 5]
        ids, ends = words.of_texts(pa.array([*part, None, ""]))
        got = [x.tolist() for x in np.split(ids, ends)[:-1]]
        assert got == [[*plain.encode(t, add_special_tokens=False).ids, 1] for t in part] + [[1], [1]], part


def test_words_are_forgotten_and_found_again():
    words, plain = T.WordIds(open(PATH, encoding="utf-8").read(), limit=20), Tokenizer.from_file(PATH)
    for k in range(0, 200, 7):
        text = " ".join(f"word{chr(97 + (k + i) % 26)}{chr(97 + i)}" for i in range(15))
        assert words.of_texts(pa.array([text]))[0].tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1]
        assert len(words.words) < 60


EDGES = [(7, None), (3, ""), (9, "the of <|endoftext|>"), (4, "Été, DU ***"), (4, "Été, DU ***"), (1, "x" * 50_000), (2, "a " * 300_000), (None, "b")]


@pytest.mark.parametrize("digest", [True, False])
def test_round_trip(spark, digest):
    docs = spark.createDataFrame([(d, t, 1) for d, t in EDGES], "doc_id bigint, text string, ids int")
    got = T.encode_and_read(docs, PATH, digest).collect()
    plain, at = Tokenizer.from_file(PATH), 0
    for (doc, text), row in zip(sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0)), sorted(got, key=lambda r: r.start), strict=True):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        assert (row.doc_id, row.start, row.n_tokens) == (doc, at, len(ids))
        assert row[3] == (zlib.crc32(np.array(ids, dtype="<u4").tobytes()) if digest else ids)
        at += len(ids)


def test_a_tokenizer_that_keeps_white_space(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "Two  words \n here"), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in T.encode_and_read(docs, path, False).collect()}
    assert got == {1: [*Tokenizer.from_file(path).encode("Two  words \n here", add_special_tokens=False).ids, 1], 2: [1]}


def test_files_of_an_empty_table(spark):
    folder = new_folder(spark, "test-tokens")
    T.write_tokens(spark.createDataFrame([], "doc_id bigint, text string"), open(PATH, encoding="utf-8").read(), folder)
    assert T.read_tokens(spark, folder).count() == 0


def test_pipeline_stages(spark):
    """Each stage's decisions, on the rows that the one before kept."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "token_output"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, columns = docs, docs.columns
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns, name
        docs = docs.persist()
        kept = {r.doc_id for r in docs.collect()}
        gone = {r.doc_id: r.text for r in before.collect() if r.doc_id not in kept}
        if name == "language_id":
            assert all(not re.search(r"[^\W\d_]", t or "") for t in gone.values())
        if name == "decontamination":
            from tests.llm.test_native import plain_hits

            items = list(enumerate(bench))
            assert all(plain_hits(t, items)[4] for t in gone.values())
            assert not any(plain_hits(r.text, items)[4] for r in docs.collect())
        if name == "near_duplicates":
            from tests.llm.test_jaccard import plain_components

            told = plain_components([(r.doc_id, r.text) for r in before.collect()], 5, 80, 100)
            assert kept == {d for d, _, c in told if d == c}
            assert docs.count() == len(kept)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert len(last) > 0
    plain = Tokenizer.from_file(PATH)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in last} == set(text) and len(clean) > len(last) > 0
    assert all(r.ids == [*plain.encode(text[r.doc_id], add_special_tokens=False).ids, 1] for r in last)


def test_pipeline_on_edge_rows(spark, tmp_path):
    rows = [(1, "the of and", "en", "s", 3), (2, None, None, None, None), (2, "", "en", "s", 0), (None, "das ist und der", None, "t", 1), (3, "the of and", "en", "s", 3), (3, "the of and", "en", "s", 3)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None), (None, "x")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "start", "n_tokens", "ids"]
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (2, "other words of an equal id"), (2, "other words of an equal id"), (None, "no id here at all then"), (None, "no id and another text now"), (None, "a b c d e f")], "doc_id bigint, text string")
    kept = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    assert kept == [(1, "a b c d e f"), (2, "other words of an equal id"), (None, "no id and another text now"), (None, "no id here at all then")]
    train = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate([("the of and to", "en"), ("der die und das", "de")] * 9)] + [(50, "щфы жзц юэя", None), (51, "the of", None)], "doc_id bigint, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, train, "").collect()} == set(range(18)) | {51}
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_keep_clashing_columns(spark):
    """Columns that operators use for their own results come through every stage as they were, and in their order."""
    names = ["score", "lang_pred", "evidence", "topic", "n_tokens", "probability", "kept", "row", "_row", "t", "u", "_key", "component_id", "contaminated"]
    text = F.concat_ws(" ", F.col("text"), F.lit("and"), F.col("doc_id"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("text", text).select(*[F.concat(F.lit(f"{n}-"), F.col("doc_id")).alias(n) for n in names[:7]], "*", *[F.concat(F.lit(f"{n}-"), F.col("doc_id")).alias(n) for n in names[7:]])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert len(rows) > 50 and all(r[n] == f"{n}-{r.doc_id}" for r in rows for n in names), name
