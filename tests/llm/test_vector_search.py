"""Nearest vectors against brute force."""

import math

import numpy as np
import pytest

from ledgerloom.llm.vector_search import nearest, op12_nearest_vectors

DATA = "/root/testdata/sf0.1"


def plain(rows, every, most):
    """{query id: [(vec_id, distance)]} of all candidates in order."""
    seen = []
    for i, v in rows:
        ok = i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        if ok and (i, tuple(v)) not in seen:
            seen.append((i, tuple(v)))
    out = {}
    for i, v in seen:
        if i % every == 0:
            near = [(float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in seen if j != i and len(w) == len(v)]
            out.setdefault(i, []).append([(j, d) for d, j in sorted(near)[:most]])
    return out


def told(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def test_recall_and_distances(spark):
    """At least nine tenths of the true neighbours; distances are exact, ranks run from 1, order and ties are kept."""
    rows = [(r.vec_id, np.array(r.embedding, dtype=np.float64)) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    at, x = {i: k for k, (i, _) in enumerate(rows)}, np.stack([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    for got in (told(op12_nearest_vectors(spark, DATA)), told(nearest(spark.read.parquet(f"{DATA}/embeddings.parquet"), nodes=300))):
        assert sorted(got) == sorted(i for i in at if i % 100 == 0)
        hits = 0
        for q, near in got.items():
            far = np.sqrt(((x - x[at[q]]) ** 2).sum(axis=1))
            order = [i for i in ids[np.lexsort([ids, far])] if i != q][:10]
            hits += len(set(order) & {v for _, v, _ in near})
            assert [r for r, _, _ in near] == list(range(1, 11))
            assert [d for _, _, d in near] == pytest.approx([far[at[v]] for _, v, _ in near], rel=1e-14)
            assert [(d, v) for _, v, d in near] == sorted((d, v) for _, v, d in near)
        assert hits >= 0.95 * 10 * len(got)


def test_edges(spark):
    """Nulls, zeros, odd components, repeated rows and ids, ties, two dimensions, a vector of very many rows, clashing extra columns."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (100, [1.0, 2.0]), (100, [4.0, 6.0]), (200, None), (300, []), (400, [0.0, 0.0]), (500, [nan, 1.0]), (600, [1.0, None]), (None, [1.0, 1.0]), (700, [inf, 1.0]), (800, [-0.0, 5.0]), (801, [0.0, 5.0])]
    rows += [(900, [1.0, 2.0, 3.0]), (901, [3.0, 2.0, 1.0]), (902, [1e200, 0.0, 0.0])] + [(1000 + k, [2.0, 2.0]) for k in range(150)]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, embedding array<double>, score string, rank int").repartition(5)
    wanted, got = plain(rows, 100, 10), told(nearest(df))
    assert sorted(got) == sorted(k for k, v in wanted.items() if any(v))
    for q, lists in wanted.items():
        near = sorted((v, d) for _, v, d in got.get(q, []))
        assert near == sorted(x for one in lists for x in one), q


def test_empty_and_lone(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest(spark.createDataFrame([], schema)).count() == 0
    assert nearest(spark.createDataFrame([(0, [1.0, 1.0])], schema)).count() == 0
    assert [tuple(r) for r in nearest(spark.createDataFrame([(0, [1.0, 1.0]), (5, [1.0, 1.0])], schema)).collect()] == [(0, 1, 5, 0.0)]
