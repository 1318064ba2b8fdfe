"""op2, op3, op6 and op10: edge rows against plain Python; the queries against their SQL."""

import hashlib
import os
import random
import re

import duckdb
import pytest

from ledgerloom.llm import decontaminate as D
from ledgerloom.llm import exact_dedup as E
from ledgerloom.llm import mixing as M
from ledgerloom.llm import url_filter as U
from ledgerloom.llm.queries import ORACLES, QUERIES
from tests.test_oracles import rows_of

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DATA}/{t}'")
    got, wanted = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns) and rows_of(got) == rows_of(wanted)


def plain_hits(text, items):
    low = str.maketrans(D.UPPER, D.LOWER)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        if item is None or not v:
            continue
        for s in range(max(1, len(v) - 9)):
            win = v[s : s + 10]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("most_windows", [100_000, 0])
def test_decontamination_edges(spark, most_windows):
    rng = random.Random(1)
    some = lambda n: " ".join(f"w{rng.randrange(30)}" for _ in range(n))
    items = [(i, some(rng.choice([1, 2, 3, 5, 9, 10, 11, 25]))) for i in range(12)] + [(50, None), (51, "..."), (None, "w1 w2"), (52, "É"), (53, "only here once at all")]
    texts = [some(rng.randrange(0, 80)) for _ in range(25)] + [items[7][1] + " x " + items[7][1].upper(), None, "", " . ", "é É", some(3000)]
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)] + [(0, texts[0], "own"), (None, texts[1], None)], "doc_id bigint, text string, n_hit string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.decontaminate(docs, bench, most_windows=most_windows).collect()), key=str)
    wanted = sorted([(i, *plain_hits(t, items)) for i, t in enumerate(texts)] + [(0, *plain_hits(texts[0], items)), (None, *plain_hits(texts[1], items))], key=str)
    assert got == wanted


def test_decontamination_is_linear_in_a_text(spark):
    """Half a million words in one text, in seconds; a row of words for each place took minutes."""
    import time

    rng = random.Random(2)
    words = [f"w{rng.randrange(300)}" for _ in range(500_000)]
    items = [(1, " ".join(words[777:797])), (2, "w1 w2 w3")]
    docs, bench = spark.createDataFrame([(1, " ".join(words), {"t": 1})], "doc_id bigint, text string, row map<string,int>"), spark.createDataFrame(items, "item_id bigint, text string")
    began = time.time()
    got = D.decontaminate(docs, bench).collect()
    assert time.time() - began < 60
    text = " ".join(words) + " "
    runs = re.findall("(?=w1 w2 w3 )", text)
    assert (got[0].n_words, got[0].n_items, got[0].contaminated, got[0].row) == (500_000, 1 + (len(runs) > 0), True, {"t": 1})
    assert got[0].n_hit == 20 + 3 * len(runs)


def test_decontamination_of_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert D.decontaminate(docs.limit(0), bench).count() == 0
    row = D.decontaminate(docs, bench.limit(0)).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (2, 0, 0, False)


def test_urls(spark):
    urls = ["http://A.Example.NET/en/x?q#f", "https://example.net", "https://example.net?x/en/", "no scheme", None, "://", "http://x.org/fr/1", "http://x.example.com/de/1", "http://notexample.com/de/", "ftp://b.net#/en/", "http://a.example.net/en/://b"]
    pages = spark.createDataFrame([(i, u, "<p>", "z") for i, u in enumerate(urls)] + [(0, urls[0], None, "z")], "page_id bigint, url string, html string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(pages).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1] == ("example.net", "", None, "allow") and got[2] == ("example.net", "", None, "allow")
    assert got[3] == got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "allow")
    assert got[6][2:] == ("org/fr/", "allow") and got[7][2:] == ("example.com/de/", "block") and got[8][2:] == (None, "allow")
    assert got[9] == ("b.net", "", None, "allow") and got[10] == ("a.example.net", "/en/://b", "example.net/en/", "allow")
    assert U.filter_urls(pages).count() == len(urls) + 1 and U.filter_urls(pages.limit(0)).count() == 0


def test_pages_with_clashing_columns_and_long_html(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", "<p>" + "x" * 300_000 + '<a href="http://b.de/">', 1, 2, 3), (1, "http://a.net/", None, 4, 5, 6)], "page_id bigint, url string, html string, by_host int, row int, by_rule int")
    got = U.filter_urls(pages)
    assert got.columns == ["page_id", "url", "by_host", "row", "by_rule", "host", "path", "rule", "verdict"]
    assert sorted((r.by_host, r.row, r.by_rule, r.verdict) for r in got.collect()) == [(1, 2, 3, "block"), (4, 5, 6, "block")]


def test_distrust_flows_against_links(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    pages = [(1, "http://farm.de/", link("bad.net", "bad2.net")), (2, "http://bad.net/", ""), (3, "http://bad2.net/", ""), (4, "http://fine.de/", link("good.org")), (5, "http://good.org/fr/", link("other.de")), (6, "http://other.de/", "")]
    got = {r.page_id: r.verdict for r in U.filter_urls(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow"}
    edges = {(r.a, r.b) for r in U.host_edges(U.judged(spark.createDataFrame(pages + [(7, "http://m.good.org/", "<a href='//FARM.de/x'>")], "page_id bigint, url string, html string"))).collect()}
    assert ("m.good.org", "good.org") in edges and ("m.good.org", "farm.de") in edges and ("farm.de", "bad.net") in edges


def test_propagation_equals_a_plain_loop(spark):
    rng = random.Random(4)
    edges = sorted({(f"h{rng.randrange(12)}", f"h{rng.randrange(12)}") for _ in range(40)} - {(f"h{i}", f"h{i}") for i in range(12)})
    seeds = [("t", "h1", 1.0), ("t", "h2", 0.5), ("d", "h3", 1.0)]
    got = {(r.kind, r.host): r.score for r in U.propagate(spark.createDataFrame(edges, "a string, b string"), spark.createDataFrame(seeds, "kind string, host string, seed double"), 0.85, 6).collect()}
    for kind in "td":
        arcs = edges if kind == "t" else [(b, a) for a, b in edges]
        base = {h: 0.15 * s for k, h, s in seeds if k == kind}
        now = dict(base)
        for _ in range(6):
            new = dict(base)
            for a, b in arcs:
                if a in now:
                    new[b] = new.get(b, 0) + 0.85 * now[a] / sum(x == a for x, _ in arcs)
            now = new
        assert {h for k, h in got if k == kind} == set(now)
        assert all(abs(got[kind, h] - s) < 1e-9 for h, s in now.items())


def test_exact_dedup_edges(spark, tmp_path):
    rows = [(5, "a b", "x"), (3, "a  b", "x"), (2, "ab", "x"), (1, "a b", "x"), (7, None, "x"), (6, "", "x"), (8, " \t\n\x0b", "x"), (2, "ab", "x"), (None, "a   b ", "x"), (9, "É" * 50_000, "x"), (10, "É" * 50_000, "x")]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string, digest string").repartition(3).write.parquet(path)
    got = E.deduplicate(spark, path, files_per_batch=1).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((d is None, d or 0) for d, _, _ in rows)
    for text in {norm(t) for _, t, _ in rows}:
        group = [(d, t or "") for d, t, _ in rows if norm(t) == text]
        keep = min(group, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        mine = [r for r in got if r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()]
        assert len(mine) == len(group) and {r.group_size for r in mine} == {len(group)} and {r.keep_id for r in mine} == {keep[0]}
        assert [r.doc_id for r in mine if r.kept] == [keep[0]]


@pytest.mark.parametrize("name", ["plain", "a[1]", "b{x}", "c*d?", "documents.parquet"])
def test_exact_dedup_takes_any_path(spark, tmp_path, name):
    """Marks of patterns in a path, a slash at its end, and a neighbour that the path would meet as a pattern."""
    rows = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], "doc_id long, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    for own, k in ((name, 3), ("a1", 1), ("bx", 1), ("cxdy", 1)):
        (tmp_path / own).mkdir(exist_ok=True)
        rows.limit(k).coalesce(1).write.mode("overwrite").format("parquet").save(str(tmp_path / "one"))
        for f in (tmp_path / "one").glob("part-*"):
            f.rename(tmp_path / own / f.name)
    for path in (f"{tmp_path}/{name}", f"{tmp_path}/{name}/"):
        assert sorted((r.doc_id, r.keep_id) for r in E.deduplicate(spark, path).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_exact_dedup_splits_a_colliding_digest(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a "), (4, "c")], "doc_id bigint, text string").coalesce(1).write.parquet(path)
    from pyspark.sql import functions as F

    monkeypatch.setattr(E, "digest_of", lambda text: F.when(text == "c", "2").otherwise("1"))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in E.deduplicate(spark, path).collect()}
    assert got == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True), 4: (4, 1, True)}


def test_exact_dedup_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(path)
    assert E.deduplicate(spark, path).count() == 0


def test_mixing(spark):
    """Edge rows, repeated rows, null ids, clashing columns, a very long text, an empty table."""
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice(["en", "de", "fr", None]), rng.choice(["plain words here", "x@y mail", "%%% junk", ""]) + " w" * rng.randrange(30), 3, "own", "mine") for i in range(600)]
    rows += [(600, "hot", "en", None, 3, "own", "mine"), (None, "hot", "en", "t t", 3, None, None), (5, *rows[5][1:]), (601, "a", "en", "w " * 200_000, 3, "", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string, kept int, _source string, row string")
    out = M.mix(docs, keep=0.5)
    assert out.columns == ["doc_id", "source", "lang", "text", "_source", "row", "topic", "n_tokens", "probability", "kept"]
    out = out.collect()
    assert len(out) == len(rows) and all(0 <= r.probability <= 1 for r in out)
    total = sum(r.n_tokens for r in out)
    assert sum(r.n_tokens * r.probability for r in out) / total < 0.52
    assert M.mix(docs.limit(0)).count() == 0
    assert [r.probability for r in out if r.doc_id == 600] == [1.0] and [r.n_tokens for r in out if r.doc_id == 601] == [200_000]
    assert {(r._source, r.row) for r in out if r.doc_id == 7} == {("own", "mine")} and len({r.kept for r in out if r.doc_id == 5}) == 1


def test_topics(spark):
    rows = {"plain words": "prose", "licence": "licence", "license x@y x@y": "licence", "x@y " * 3 + "licence": "contact", "a | b | c": "table", "%%% and | x": "symbols", "555 1234 now": "contact", "x@y" + " w" * 5000: "prose", "": "prose"}
    got = M.measured(spark.createDataFrame([(t, None, None) for t in rows], "text string, source string, lang string")).collect()
    assert {r.row.text: r.topic for r in got} == rows


def test_raking_meets_the_marginals(spark):
    rng = random.Random(2)
    cells = [(s, g, t, rng.randrange(1, 1000)) for s in ("a", "b", "c") for g in ("en", "de") for t in ("p", "q")]
    targets = {"lang": {"en": 0.7}, "topic": {"p": 0.2, "q": 0.8}}
    got = M.rake(spark.createDataFrame(cells, "source string, lang string, topic string, tokens bigint"), targets, 12).collect()
    for column, value, goal in (("source", "a", 1 / 3), ("lang", "en", 0.7), ("topic", "p", 0.2)):
        assert abs(sum(r.w for r in got if r[column] == value) - goal) < 1e-3


def test_shares_reach_the_targets(spark):
    """Every marginal of the test table, for the rows that the query keeps in expectation."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    mixed = M.mix(docs, keep_text=False)
    got = {(r.margin, r.value): r for r in M.shares(mixed).collect()}
    cells = M.measured(docs).groupBy(*M.MARGINS).agg(M.F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    for c in M.MARGINS:
        for r in M.target_shares(cells, c, M.TARGETS.get(c)).collect():
            assert abs(got[c, r[0]].expected - r[1]) < 0.01, (c, r[0])
            assert abs(got[c, r[0]].kept - r[1]) < 0.01, (c, r[0])
    assert sum(r.n for r in mixed.where("kept").select(M.F.sum("n_tokens").alias("n")).collect()) > 0.5 * mixed.select(M.F.sum("n_tokens")).first()[0]


@pytest.mark.parametrize("stage", [False, True])
def test_kept_rows_have_the_target_shares(spark, stage):
    """2 % of the rows hold the topic that is to have 10 % of the tokens; a budget of 80 % can't reach that. One lone cell must not shrink the budget."""
    import corpus_pipeline

    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "b"]), rng.choice(["en"] * 6 + ["de", "fr", "es"]), ("%%% " if i % 50 == 0 else "x@y " if i % 25 == 1 else "plain ") + "w " * 9) for i in range(20_000)] + [(20_001, "a", "es", "licence")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string")
    targets = M.TARGETS if stage else {"lang": {"en": 0.6, "de": 0.2}, "topic": {"symbols": 0.1, "contact": 0.1}}
    out = corpus_pipeline.mixing(spark, docs, "").select("doc_id").collect() if stage else M.mix(docs, targets).where("kept").select("doc_id").collect()
    expected = {(r.margin, r.value): r.expected for r in M.shares(M.mix(docs, targets)).collect()}
    cells = M.measured(docs).groupBy("topic").agg(M.F.sum("n_tokens").alias("tokens"))
    goal = {r[0]: r[1] for r in M.target_shares(cells, "topic", targets["topic"]).collect()}["symbols"]
    assert goal > 0.04 and (stage or goal == 0.1)
    assert abs(expected["lang", "en"] - targets["lang"]["en"]) < 0.005 and abs(expected["topic", "symbols"] - goal) < 0.005 and abs(expected["source", "a"] - 0.5) < 0.005
    ids = {r.doc_id for r in out}
    kept = [r for r in rows if r[0] in ids]
    tokens = lambda r: len(r[3].split())
    share = lambda f: sum(tokens(r) for r in kept if f(r)) / sum(map(tokens, kept))
    assert 0.05 < len(kept) / len(rows) < (0.6 if stage else 0.35)
    chance = lambda p: 3 * (p * (1 - p) / len(kept)) ** 0.5  # noqa: E731  three standard deviations of so many rows
    for f, p in ((lambda r: r[2] == "en", targets["lang"]["en"]), (lambda r: "%%%" in r[3], goal), (lambda r: r[1] == "a", 0.5)):
        assert abs(share(f) - p) < chance(p)


def test_candidates_are_not_broadcast(spark, monkeypatch):
    """The candidates' windows compress so well that their size on disk says nothing about the driver's memory: only the texts' names are broadcast, and their number is bounded."""
    plans, write = {}, D.saved

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(D, "saved", noted)
    words = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"a {words} b"), (2, "other words"), (3, words)], "doc_id bigint, text string")
    got = D.decontaminate(docs, spark.createDataFrame([("i", words)], "item_id string, text string")).collect()
    assert {r.doc_id: r.n_hit for r in got} == {1: 30, 2: 0, 3: 30}
    assert plans["decontaminate-found"].count("BroadcastHashJoin") == 1 and "SortMergeJoin" in plans["decontaminate-found"]
