"""Periodic runs against a plain search for every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ledgerloom.llm.period_runs import op13_period_runs, periodic_runs, runs_of

DATA = "/root/testdata/sf0.001"


def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)  # smaller periods come first
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = (None,) * 3
    for s, m, q in sorted(runs, key=lambda r: (r[0], r[2])):
        if best[0] is None or m * best[2] > best[1] * q:
            best = (s, m, q)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    told = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha(told), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_many_small_texts():
    rng = random.Random(5)
    for _ in range(3000):
        texts = []
        for _ in range(rng.randint(1, 4)):
            unit = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 9))]
            words = [rng.choice("abc") for _ in range(rng.randint(0, 12))] + unit * rng.randint(0, 9) + unit[: rng.randint(0, 5)] + [rng.choice("abc") for _ in range(rng.randint(0, 12))]
            texts.append(words * rng.randint(1, 5) if rng.random() < 0.2 else words)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        codes = np.array([ord(w) for t in texts for w in t], dtype=np.int64)
        wanted = [(int(b) + s, m, q) for b, t in zip(bounds, texts) for s, m, q in plain_runs(t)]
        assert sorted(runs_of(codes, bounds)) == wanted


@pytest.mark.parametrize("n", [1, 2, 7, 5000])
def test_one_word_over_and_over(n):
    found = runs_of(np.zeros(n, dtype=np.int64), np.array([0, n]))
    assert found == ([(0, n, 1)] if n >= 6 else [])


def test_edges(spark):
    """Null, empty and blank texts, null and repeated ids, ties, extra columns, a long text."""
    long = " ".join(f"w{i % 3000}" for i in range(14_000)) + " tail"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b a b a b a b"), (4, "a b a b a b a b"), (None, "x x x x x x y y y y y y"), (None, None), (7, long), (8, "a b " * 6), (9, "one two")]
    docs = spark.createDataFrame([(*r, 5, "z") for r in rows], "doc_id long, text string, n_runs int, words string")
    got = sorted(map(repr, map(tuple, periodic_runs(docs).collect())))
    assert got == sorted(repr(plain_row(*r)) for r in rows)


def test_empty_table(spark):
    assert periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in op13_period_runs(spark, DATA).collect()}
    some = [r for r in docs if len(r.text or "") < 6000]
    assert len(got) == len(docs) and len(some) > 150
    wanted = {r.doc_id: plain_row(*r) for r in some}
    assert {k: got[k] for k in wanted} == wanted and sum(w[1] > 0 for w in wanted.values()) > 5
