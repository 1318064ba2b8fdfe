"""op1 and its parts against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import jaccard_join as J
from ledgerloom.llm.common import components
from ledgerloom.llm.shingles import shingle_sets
from ledgerloom.llm.signature_tree import Links, SignatureTree, bitmap, candidates, folded, width_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, size):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def plain_components(rows, size, num, den):
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = [plain_set(t, size) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for k, (d, _) in enumerate(rows) if find(k) == find(i) and d is not None]
        out.append((doc, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc))
    return sorted(out, key=str)


def corpus(rng, groups, copies, words=60):
    rows, doc = [], 0
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, words))]
        for _ in range(rng.randrange(1, copies)):
            text = list(base)
            for _ in range(rng.randrange(3)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(1000)}"
            rows.append((doc, "  ".join(text)))
            doc += 1
    rng.shuffle(rows)
    return rows


EDGES = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One two"), (1004, "one  TWO"), (1005, "É é"), (1006, "é É"), (None, "one two"), (None, None), (1003, "One two"), (1007, "a b c d"), (1008, "a b c d e " * 3000), (1009, "a b c d e " * 2999)]


@pytest.mark.parametrize(("size", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_components(spark, size, num, den):
    rows = corpus(random.Random(size), 40, 7) + EDGES
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, n string, sid int")
    got = sorted(map(tuple, J.jaccard_components(docs, size, num, den).collect()), key=str)
    assert got == plain_components(rows, size, num, den)


def test_small_limits_change_nothing(spark):
    """Blocks and groups over the limits take the ways for hot ones."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(w if rng.random() > 0.01 else f"y{rng.randrange(10**6)}" for w in base)) for i in range(60)] + [(100 + d, t) for d, t in corpus(rng, 10, 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(tuple, J.jaccard_components(docs, 4, 85, 100, most_block=4, most_tokens=500).collect()), key=str)
    assert got == plain_components(rows, 4, 85, 100)


def test_sets_that_share_a_name(spark, monkeypatch):
    """Half of the sets get one first name: the second tells them apart."""
    whole = J.names_of
    monkeypatch.setattr(J, "names_of", lambda tokens: (7 if len(tokens) % 2 else whole(tokens)[0], whole(tokens)[1]))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c d e f g")], "doc_id bigint, text string")
    rows, _, shared = J.measured(docs, 4)
    assert shared in (frozenset(), frozenset({7}))  # workers that import the module anew see no clash
    got = {r.doc_id: r.sid for r in rows.collect()}
    assert got[1] == got[3] and len({got[1], got[2], got[4]}) == 3


def test_long_words_and_pieces():
    import ledgerloom.llm.shingles as N

    text = "x" * (3 * N.PIECE) + " y " + "z" * N.PIECE + " w"
    start, stop = N.word_bounds(*N.string_bytes(pa.array([text])))
    assert (stop - start).tolist() == [3 * N.PIECE, 1, N.PIECE, 1]
    one, other = N.word_hashes(pa.array([text]))[0], N.word_hashes(pa.array(["a", "x" * (3 * N.PIECE), "y"]))[0]
    assert one[0] == other[1] and one[1] == other[2] and len(set(one.tolist())) == 4


@pytest.mark.parametrize("n", [64, 1024, 4096])
def test_words_of_two_letters_get_their_own_names(n):
    """Words whose letters follow the parity of bits have equal sums modulo 2**64 for every factor; capitals make no other word."""
    import ledgerloom.llm.shingles as N

    one = "".join("ab"[i.bit_count() % 2] for i in range(n))
    texts = [f"one two {w} four five" for w in (one, one.translate(str.maketrans("ab", "ba")), one.upper())]
    sets = [s.tolist() for s in shingle_sets(pa.array(texts), 4)]
    assert not set(sets[0]) & set(sets[1]) and sets[0] == sets[2] and len(set(N.word_hashes(pa.array(texts))[0].tolist())) == 6


def test_empty_table(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_traversal_loses_no_pair():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 1 << 63, rng.integers(5, 200)).astype(np.uint64)
        sets += [np.unique(np.concatenate([base[rng.random(len(base)) > 0.05], rng.integers(0, 1 << 63, 3).astype(np.uint64)])) for _ in range(4)]
    sizes = np.array([len(s) for s in sets])
    links, found = Links(list(range(len(sets)))), set()
    for i, j in candidates(sizes, [bitmap(s, width_of(len(s))) for s in sets], 85, 100, links):
        found.add((min(i, j), max(i, j)))
    for i in range(len(sets)):
        for j in range(i):
            same = len(np.intersect1d(sets[i], sets[j]))
            if 100 * same >= 85 * (sizes[i] + sizes[j] - same):
                assert (j, i) in found
    assert len(found) < len(sets) * (len(sets) - 1) / 4
    wide = bitmap(sets[0], 4096)
    assert (folded(wide, 256) == bitmap(sets[0], 256)).all()
    assert len(SignatureTree(np.zeros(0, dtype=np.int64), np.zeros((0, 1), dtype=np.uint64)).order) == 0


def test_sets_equal_plain_words():
    texts = ["", None, "a", "A b", "a b c d", "É é x\x0by z q  r", "one\ntwo three four five one two three four"]
    for size in (4, 5):
        assert [len(s) for s in shingle_sets(pa.array(texts), size)] == [len(plain_set(t, size)) for t in texts]


def test_components_of_edges(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(400, i) for i in range(401, 460)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "test").collect()}
    assert got == {x: find(x) for x in up}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "test").count() == 0


def test_passages_of_many_texts_connect_nothing(spark):
    """A passage that stands in more texts than a block may hold comes last in the order of their tokens: texts that share it alone are no candidates, and those that are near are found.

    Slots are told as equally common, as they are where a large corpus fills them."""
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join(f"w{i}-{j}" for j in range(60)) + " " + passage) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " more") for i in range(0, 60, 20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    _, order, shared = J.measured(docs, 4)
    order = order._replace(common=np.zeros_like(order.common))
    edges = J.candidate_edges(J.prefixed(docs, 4, 85, 100, order, shared), 85, 100, 8)
    assert edges.distinct().count() == 3
    got = {r.doc_id: r.component_id for r in J.jaccard_components(docs, most_block=8, most_tokens=500).collect()}
    assert {i: c for i, c in got.items() if i != c} == {100: 0, 120: 20, 140: 40}
