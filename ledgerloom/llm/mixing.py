"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling.

Tokens are counted per cell (source, language, topic). Each round scales the cells' weights so that first the sources,
then the languages, then the topics have their target shares; the fitted weight over the counted tokens is a cell's ratio. A document
is kept with the probability min(1, scale * ratio).

A cell whose probability is cut at 1 can't rise to its weight, so that a large budget would miss the targets where texts are scarce. The scale is
therefore the largest of a fixed series at which the cut cells lose at most `cut` of all weight: each expected share of the tokens is then within
`cut` of its target, and the budget is what the scarcest texts allow, `keep` of the tokens at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, saved

MARGINS = ("source", "lang", "topic")
#: (topic, weight, pattern): a text's topic is the one with the largest sum of weights over all matches, the first of equal ones, ...
SIGNALS = [
    ("licence", 10, r"[Ll]icen[sc]e|[Cc]opyright|[Pp]ermission|[Ww]arrant(?:y|ies)"),
    ("contact", 5, r"[0-9A-Za-z]@[0-9A-Za-z]"),
    ("contact", 5, r"[0-9]{3}[ -][0-9]{4}"),
    ("table", 1, r" \| "),
    ("symbols", 2, r"%%%|\$\$\$|&&&|###"),
]
#: ... if it has this much for each thousand tokens, else REST.
LEAST, REST = 2, "prose"
TOPICS = list(dict.fromkeys(t for t, _, _ in SIGNALS))
#: Shares of tokens; values that are not named share the rest in proportion to their tokens. Sources: no named value means that all get equal shares.
TARGETS = {"lang": {"en": 0.6, "de": 0.15, "fr": 0.15}, "topic": {"prose": 0.85}}
ROUNDS, KEEP, CUT, SEED = 8, 0.8, 0.005, "mix"
#: Scales fall by this root of 2.
STEPS = 16


def measured(docs: DataFrame, keep_text: bool = True, signals=SIGNALS, least: int = LEAST, rest: str = REST) -> DataFrame:
    """(row: docs' columns, source, lang, topic, n_tokens): null sources and languages as '', tokens are words apart by [\\x20\\x09-\\x0D]; null texts have 0 and the topic `rest`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.struct(*[c for c in docs.columns if keep_text or c != "text"]).alias("row")
    counted = docs.select(row, F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("n_tokens"), *[(F.regexp_count(text, F.lit(p)) * w).cast("bigint").alias(f"s{k}") for k, (_, w, p) in enumerate(signals)])
    topics = list(dict.fromkeys(t for t, _, _ in signals))
    scores = [sum(F.col(f"s{k}") for k, x in enumerate(signals) if x[0] == t) for t in topics]
    best = F.greatest(*scores, F.lit(0))
    topic = F.lit(rest)
    for t, s in reversed(list(zip(topics, scores, strict=True))):
        topic = F.when(s == best, F.lit(t)).otherwise(topic)
    return counted.select("row", "source", "lang", F.when((best > 0) & (best * 1000 >= least * F.col("n_tokens")), topic).otherwise(F.lit(rest)).alias("topic"), "n_tokens")


def target_shares(cells: DataFrame, column: str, named: dict[str, float] | None) -> DataFrame:
    """(column, goal_<column>): the share of each value that has tokens; they sum to 1."""
    sums = cells.groupBy(column).agg(F.sum("tokens").cast("double").alias("own"))
    if not named:
        return sums.select(column, F.lit(1.0 / max(1, sums.count())).alias(f"goal_{column}"))
    marked = sums.withColumn("given", F.try_element_at(F.create_map(*[F.lit(x) for kv in named.items() for x in kv]), F.col(column)))
    other = marked.agg(F.sum(F.when(F.col("given").isNull(), F.col("own")))).first()[0]  # one number
    left = F.lit(max(0.0, 1 - sum(named.values()))) * F.col("own") / F.lit(other)
    raw = marked.select(column, F.coalesce("given", left).alias("goal"))
    total = raw.agg(F.sum("goal")).first()[0]
    return raw.select(column, (F.col("goal") / F.lit(total)).alias(f"goal_{column}"))


def rake(cells: DataFrame, targets=TARGETS, rounds: int = ROUNDS) -> DataFrame:
    """cells (source, lang, topic, tokens > 0) with goals, w (fitted share of the weight) and ratio = w over tokens.

    A round is three grouped sums beside their cells. The table is small: a row for each source, language and topic that meet."""
    now = cells.withColumn("w", F.col("tokens").cast("double"))
    for c in MARGINS:
        now = now.join(checked_broadcast(saved(target_shares(cells, c, targets.get(c)), "mix-goals")), c)
    for k in range(rounds):
        for c in MARGINS:
            now = now.withColumn("w", F.col("w") * F.col(f"goal_{c}") / F.sum("w").over(Window.partitionBy(c)))
        if k % 2 or k == rounds - 1:
            now = saved(now, "mix-weights")
    return now.withColumn("ratio", F.col("w") / F.col("tokens"))


def scale_of(fitted: DataFrame, keep: float = KEEP, cut: float = CUT) -> float:
    """keep * tokens, or the largest 2 ** (-k / STEPS) below that at which cells above probability 1 lose at most `cut` of the weight."""
    total = fitted.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    steps = fitted.groupBy(F.floor(F.log2("ratio") * STEPS).alias("b")).agg(F.sum("w").alias("w"), F.sum("tokens").alias("t")).collect()  # at most STEPS rows for each power of 2
    w, t, scale = 0.0, 0, float(keep * total)
    for r in sorted(steps, key=lambda r: -r["b"]):
        if w - t * 2.0 ** ((r["b"] + 1) / STEPS) > cut:
            break
        step, w, t = r["b"], w + r["w"], t + r["t"]
    return min(scale, 2.0 ** (-(step + 1) / STEPS)) if steps else scale


def draw(id_col, seed: str = SEED):
    """A number in [0, 1) that depends on the id alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def mix(docs: DataFrame, targets=TARGETS, keep: float = KEEP, cut: float = CUT, keep_text: bool = True) -> DataFrame:
    """Every row of docs with topic, n_tokens, probability and kept added (columns of these names are replaced; without keep_text the text goes).

    The expected shares of tokens are within `cut` of the targets, and the budget is as large as this allows, `keep` of the tokens at most.
    Targets that no weights of the cells meet (raking doesn't converge) give the weights of the last round.
    Null sources and languages form a value of their own. Texts are read whole, once. Null, empty and blank texts have no tokens and no weight and are
    kept (probability 1). Repeated rows, and rows with equal ids, share one draw; null ids draw alike. A target value without tokens gives its share to the
    others. Ties between topics go to the first. An empty table gives an empty result; other columns, whatever their names, stay as they are.
    """
    docs = docs.drop("topic", "n_tokens", "probability", "kept")
    rows = saved(measured(docs, keep_text), "mix-rows")
    cells = saved(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "mix-cells")
    fitted = rake(cells, targets)
    table = saved(fitted.select(*MARGINS, F.least(F.lit(1.0), F.lit(scale_of(fitted, keep, cut)) * F.col("ratio")).alias("p")), "mix-probabilities")
    chance = F.coalesce(F.when(F.col("n_tokens") > 0, F.col("p")), F.lit(1.0))
    out = rows.join(checked_broadcast(table), [*MARGINS], "left").select("row", "topic", "n_tokens", chance.alias("probability"))
    return out.withColumn("kept", draw(F.col("row.doc_id")) < F.col("probability")).select("row.*", "topic", "n_tokens", "probability", "kept")


def shares(mixed: DataFrame) -> DataFrame:
    """(margin, value, input, expected, kept): shares of tokens in a result of mix(), to hold against the targets."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("margin"), F.coalesce(c, F.lit("")).alias("value")) for c in MARGINS])).alias("at")
    tokens = {"input": F.col("n_tokens").cast("double"), "expected": F.col("n_tokens") * F.col("probability"), "kept": F.when(F.col("kept"), F.col("n_tokens")).otherwise(0).cast("double")}
    sums = mixed.select(pairs, *[x.alias(k) for k, x in tokens.items()]).groupBy("at").agg(*[F.sum(k).alias(k) for k in tokens])
    own = Window.partitionBy("at.margin")
    return sums.select("at.*", *[(F.col(k) / F.sum(k).over(own)).alias(k) for k in tokens])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability (to six places) and kept of each document."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text"), keep_text=False)
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "kept")


def _oracle() -> str:
    count = lambda p: f"len(regexp_extract_all(coalesce(text, ''), '{p}'))"
    sums = ", ".join("(" + " + ".join(f"{w} * {count(p)}" for t, w, p in SIGNALS if t == topic) + f") AS _{topic}" for topic in TOPICS)
    best = "greatest(" + ", ".join(f"_{t}" for t in TOPICS) + ")"
    topic = f"CASE WHEN {best} = 0 OR {best} * 1000 < {LEAST} * n_tokens THEN '{REST}' " + " ".join(f"WHEN _{t} = {best} THEN '{t}'" for t in TOPICS) + " END"
    sql = rf"""WITH c AS (SELECT doc_id, source, lang, coalesce(source, '') AS _source, coalesce(lang, '') AS _lang, cast({count('[^\x20\x09-\x0D]+')} AS bigint) AS n_tokens, {sums} FROM documents)
, d AS (SELECT doc_id, source, lang, _source, _lang, n_tokens, {topic} AS topic FROM c)
, w0 AS (SELECT _source, _lang, topic, cast(sum(n_tokens) AS bigint) AS tokens, cast(sum(n_tokens) AS double) AS w FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)"""
    for c in MARGINS:
        key = c if c == "topic" else f"_{c}"
        named = TARGETS.get(c)
        if not named:
            sql += f"\n, goal_{c} AS (SELECT {key}, 1.0::double / count(*) OVER () AS goal FROM w0 GROUP BY {key})"
            continue
        given = f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}::double" for k, v in named.items()) + " END"
        sql += f"\n, own_{c} AS (SELECT {key}, sum(w) AS own, {given} AS given FROM w0 GROUP BY {key})"
        sql += f"\n, raw_{c} AS (SELECT {key}, coalesce(given, {max(0.0, 1 - sum(named.values()))}::double * own / sum(CASE WHEN given IS NULL THEN own END) OVER ()) AS goal FROM own_{c})"
        sql += f"\n, goal_{c} AS (SELECT {key}, goal / sum(goal) OVER () AS goal FROM raw_{c})"
    k = 0
    for _ in range(ROUNDS):
        for c in MARGINS:
            key = c if c == "topic" else f"_{c}"
            sql += f"\n, w{k + 1} AS MATERIALIZED (SELECT _source, _lang, topic, tokens, w * goal / sum(w) OVER (PARTITION BY {key}) AS w FROM w{k} JOIN goal_{c} USING ({key}))"
            k += 1
    sql += f"\n, steps AS (SELECT floor(log2(w / tokens) * {STEPS}) AS b, sum(w) AS w, sum(tokens) AS t FROM w{k} GROUP BY 1)"
    sql += "\n, above AS (SELECT b, coalesce(sum(w) OVER a, 0) AS w, coalesce(sum(t) OVER a, 0) AS t FROM steps WINDOW a AS (ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
    sql += f"\n, s AS MATERIALIZED (SELECT least({KEEP} * (SELECT sum(tokens) FROM w0), pow(2.0, -(min(b) + 1) / {STEPS})) AS s FROM above WHERE w - t * pow(2.0, (b + 1) / {STEPS}) <= {CUT})"
    sql += f"\n, p AS (SELECT _source, _lang, topic, least(1.0, s * w / tokens) AS p FROM w{k}, s)"
    return sql + f"""
, j AS (SELECT d.*, coalesce(CASE WHEN n_tokens > 0 THEN p END, 1.0) AS p FROM d LEFT JOIN p USING (_source, _lang, topic))
SELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS probability, cast('0x' || substr(md5('{SEED}' || coalesce(cast(doc_id AS varchar), '')), 1, 8) AS bigint) / 4294967296.0 < p AS kept FROM j"""


OP10_SQL = _oracle()
