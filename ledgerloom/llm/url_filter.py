"""URL filters: rules first, and for all other pages trust and distrust propagated over host edges.

Trust is a personalised PageRank from hosts that the rules allow; distrust is the same on reversed edges from hosts that
the rules block, so that a host that links to blocked hosts is distrusted. Both run as joins and grouped sums in Spark.
A host is blocked when its distrust reaches the threshold and exceeds its trust.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_broadcast, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""
#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with its path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DAMPING, ROUNDS, THRESHOLD = 0.85, 10, 0.1


def after_scheme(url):
    """What follows the first ://; null where there is none."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url):
    """From the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url):
    """From the end of the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host, path, rules):
    """(rule name, verdict) columns of the longest rule that fits; null where none does."""
    name = verdict = None
    for action, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(F.lit(None).cast("string") if name is None else name)
        verdict = F.when(fits, F.lit(action)).otherwise(F.lit(None).cast("string") if verdict is None else verdict)
    return name, verdict


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """(row: pages' columns without html, html, host, path, rule, by_rule)."""
    row = F.struct(*[c for c in pages.columns if c != "html"]).alias("row")
    plain = pages.select(row, "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return plain.withColumns({"rule": name, "by_rule": verdict})


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (a, b), a <> b: host a's pages link to host b by an absolute link, or b is the domain just above a and has pages.

    The second kind ties subdomains to the domain that grants them; relative links stay on a host and give no edge.
    """
    links = pages.where("host <> ''").select(F.col("host").alias("a"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), 1))).alias("url"))
    absolute = F.when(F.col("url").startswith("//"), F.concat(F.lit("x:"), F.col("url"))).otherwise(F.col("url"))
    linked = links.select("a", host_of(absolute).alias("b"))
    hosts = pages.where("host <> ''").select(F.col("host").alias("a")).distinct()
    above = hosts.select("a", F.regexp_extract("a", r"^[^.]+\.(.+)$", 1).alias("b")).join(hosts.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b")
    return linked.where("b <> ''").unionAll(above).where("a <> b").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(kind, host, score) from seeds (kind, host, seed): 't' flows along edges, 'd' against them; a host splits its score evenly.

    Hosts without seed or incoming score are absent. Each round is one equi-join and one grouped sum.
    """
    out = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    back = edges.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    arcs = edges.join(out, "a").selectExpr("'t' AS kind", "a AS host", "b AS to", "1D / n AS share").unionAll(edges.join(back, "b").selectExpr("'d' AS kind", "b AS host", "a AS to", "1D / n AS share"))
    arcs, base = saved(arcs, "url-arcs"), seeds.selectExpr("kind", "host", f"{1 - damping}D * seed AS score")
    now = base
    for k in range(1, rounds + 1):
        flow = arcs.join(now, ["kind", "host"]).selectExpr("kind", "to AS host", f"{damping}D * score * share AS score")
        now = base.unionAll(flow).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if k % 5 == 0 or k == rounds:
            now = saved(now, "url-scores")
    return now


def filter_urls(pages: DataFrame, rules=RULES, damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of pages without html, with host, path, rule and verdict; columns of these names are replaced, others stay, whatever their names.

    A rule decides where one fits. Otherwise the host's scores do: a host's trust seed is the share of its pages that rules
    allow, its distrust seed the share that they block. Null, empty or unseen hosts are allowed. Empty tables and
    pages without html work; repeated rows each give a row.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    known = judged(pages, rules)
    hosts = known.where("host <> ''").groupBy("host").agg(F.avg(F.when(F.col("by_rule") == "allow", 1.0).otherwise(0.0)).alias("t"), F.avg(F.when(F.col("by_rule") == "block", 1.0).otherwise(0.0)).alias("d"))
    seeds = saved(hosts.selectExpr("stack(2, 't', host, t, 'd', host, d) AS (kind, host, seed)").where("seed > 0"), "url-seeds")
    edges = saved(host_edges(known.select("host", "html")), "url-edges")
    scores = propagate(edges, seeds, damping, rounds).groupBy("host").agg(F.sum(F.when(F.col("kind") == "t", F.col("score")).otherwise(0.0)).alias("t"), F.sum(F.when(F.col("kind") == "d", F.col("score")).otherwise(0.0)).alias("d"))
    blocked = saved(scores.where(f"round(d, 9) >= {threshold}D AND round(d, 9) > round(t, 9)").select("host", F.lit("block").alias("by_host")), "url-blocked")
    out = known.drop("html").join(checked_broadcast(blocked), "host", "left")
    return out.select("row.*", "host", "path", "rule", F.coalesce("by_rule", "by_host", F.lit("allow")).alias("verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of each page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def _rounds_sql() -> str:
    text = ", r0 AS (SELECT * FROM base)"
    for k in range(1, ROUNDS + 1):
        text += f", r{k} AS (SELECT kind, host, sum(score) AS score FROM (SELECT * FROM base UNION ALL SELECT a.kind, a.\"to\", {DAMPING} * r.score * a.share FROM arcs a JOIN r{k - 1} r ON a.kind = r.kind AND a.host = r.host) x GROUP BY kind, host)"
    return text


OP3_SQL = rf"""
WITH u AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS s FROM pages
), p AS (
  SELECT page_id, html, coalesce(translate(regexp_extract(s, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(s, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), j AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p
), v AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS by_rule FROM j
), hosts AS (SELECT host, avg(CASE WHEN by_rule = 'allow' THEN 1.0::double ELSE 0 END) AS t, avg(CASE WHEN by_rule = 'block' THEN 1.0::double ELSE 0 END) AS d FROM v WHERE host <> '' GROUP BY host
), seeds AS (SELECT 't' AS kind, host, t AS seed FROM hosts WHERE t > 0 UNION ALL SELECT 'd', host, d FROM hosts WHERE d > 0
), links AS (
  SELECT DISTINCT host AS a, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]+)', 1)) AS url FROM v WHERE host <> ''
), edges AS (
  SELECT DISTINCT a, b FROM (
    SELECT a, translate(regexp_extract(url, '//([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS b FROM links
    UNION ALL SELECT host, regexp_extract(host, '^[^.]+\.(.+)$', 1) FROM hosts WHERE regexp_extract(host, '^[^.]+\.(.+)$', 1) IN (SELECT host FROM hosts)) x WHERE a <> b AND b <> ''
), arcs AS (
  SELECT 't' AS kind, a AS host, b AS "to", 1.0::double / count(*) OVER (PARTITION BY a) AS share FROM edges
  UNION ALL SELECT 'd', b, a, 1.0::double / count(*) OVER (PARTITION BY b) FROM edges
), base AS (SELECT kind, host, {1 - DAMPING} * seed AS score FROM seeds){_rounds_sql()}
, scores AS (SELECT host, sum(CASE WHEN kind = 't' THEN score ELSE 0 END) AS t, sum(CASE WHEN kind = 'd' THEN score ELSE 0 END) AS d FROM r{ROUNDS} GROUP BY host)
SELECT page_id, v.host, path, rule, coalesce(by_rule, CASE WHEN round(d, 9) >= {THRESHOLD} AND round(d, 9) > round(t, 9) THEN 'block' END, 'allow') AS verdict
FROM v LEFT JOIN scores s ON v.host = s.host
"""
