"""Spelling variants against plain Python; the SQL on a small table is in test_oracle."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from ledgerloom.llm import spelling as S

DATA = "/root/testdata/sf0.001"


def plain_counts(rows, every):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w if h % every else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, every=97):
    n, out = plain_counts(rows, every), {}
    for w in n:
        others = sorted((-n[x], x) for x in n if near(w, x))
        form = others[0][1] if others and -others[0][0] >= 2 * n[w] else None
        out[w] = [form, None, n[w], len(others), n[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return sorted((w, *x) for w, x in out.items())


def told(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("most", [1, 3, 512])
def test_made_texts(spark, most):
    """Blocks of any size give the same; every seventh run loses a letter; letters beyond ASCII; null, empty and repeated rows; clashing columns."""
    rng, rows = random.Random(3), [(None, "Große GROSSE große"), (1, None), (2, ""), (3, " 12 ×÷ \n")]
    base = ["grüßen", "aaaaa", "aaaaaa", "banane", "straßen", "naïveté", "Šašek", "abcabcabc", "ÀÉÎÕÜà"]
    for i in range(4, 60):
        words = []
        for _ in range(40):
            w = list(rng.choice(base))
            if rng.random() < 0.3:
                w[rng.randrange(len(w))] = rng.choice("abnÿ")
            words.append("".join(w) * rng.choice([1, 1, 1, 2]))
        rows.append((i, rng.choice([" ", "-", "1", "ł"]).join(words)))
    rows += rows[-3:]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    wanted = plain(rows, 7)
    assert told(S.variants(df, every=7, most=most)) == wanted and sum(w[1] is not None for w in wanted) > 20 and any(w[1] != w[2] for w in wanted if w[1])


def test_long_words_and_empty_table(spark):
    word = "ab" * 30_000
    rows = [(k, f"{word} {word[:-1]} {word}x") for k in range(1, 7)] + [(k, word) for k in range(7, 20)]
    assert told(S.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)
    assert told(S.variants(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_joined_crc():
    rng = random.Random(1)
    pairs = [(rng.randbytes(rng.randint(0, 9)), rng.randbytes(rng.randint(0, 300))) for _ in range(200)]
    got = S.joined_crc(np.array([zlib.crc32(a) for a, _ in pairs], dtype=np.uint32), np.array([zlib.crc32(b) for _, b in pairs], dtype=np.uint32), np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_oracle(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    wanted = sorted(con.sql(f"SELECT word, form, root, n, n_near, form_n FROM ({S.OP11_SQL})").fetchall())
    assert told(S.op11_spelling_variants(spark, DATA)) == wanted and len(wanted) > 1000
