"""The corpus pipeline: five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import checked_broadcast, freed, saved, text_names
from ledgerloom.llm.decontaminate import decontaminate
from ledgerloom.llm.jaccard_join import jaccard_components
from ledgerloom.llm.language_id import fit, predict
from ledgerloom.llm.mixing import mix
from ledgerloom.llm.token_output import encode_and_read

TOKENIZER = "word_bpe_49k.json"
#: Share of words that must be known to the language model, or hold an n-gram that is.
LEAST_EVIDENCE = 0.2


def carried(docs: DataFrame) -> Column:
    """All columns but the text as one, so that no name clashes with an operator's own."""
    return F.struct(*[c for c in docs.columns if c != "text"]).alias("_row")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts, no letters, or fewer than LEAST_EVIDENCE of their words known or like known ones. lang becomes the predicted language.

    Repeated rows and rows of one or no id are judged each for itself; languages of equal score: the one that sorts first. Other columns stay as they are, whatever their names."""
    told = predict(docs.select(carried(docs), "text"), fit(docs)).where((F.col("lang_pred") != "und") & (F.col("evidence") >= LEAST_EVIDENCE))
    own = {"text": F.col("text"), "lang": F.col("lang_pred").alias("lang")}
    return told.select(*[own.get(c, F.col(f"_row.`{c}`")) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (runs of five words, similarity 0.8 or more) one row stays: the smallest doc_id, null ids last, then by hashes of the text.

    Rows with one id and different texts count as different documents. Documents without words are near no other, but of rows that are equal in id and text one stays."""
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), *[F.coalesce(x, F.lit(0)).alias(c) for c, x in text_names(F.col("text")).items()])
    told = saved(jaccard_components(docs.select(key.alias("doc_id"), "text"), size=5, num=80, den=100).groupBy("doc_id").agg(F.first("component_id").alias("least"), F.count(F.lit(1)).alias("n")), "pipeline-groups")
    gone = checked_broadcast(saved(told.where("doc_id <> least").select(F.col("doc_id").alias("_key")), "pipeline-gone"))
    again = checked_broadcast(saved(told.where("doc_id = least AND n > 1").select(F.col("doc_id").alias("_key")), "pipeline-again"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("_key")).join(gone, "_key", "left_anti")
    once = rows.join(again, "_key", "left_anti").unionAll(rows.join(again, "_key", "left_semi").dropDuplicates(["_key"]))
    return once.select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, told by hashes of their text; null texts stay."""
    key = {f"_{c}": x for c, x in text_names(F.col("text")).items()}
    told = decontaminate(docs.select("text").withColumns(key), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = checked_broadcast(saved(told.where("contaminated").select("_t", "_u").distinct(), "pipeline-contaminated"))
    return docs.select(F.struct(*docs.columns).alias("row"), *[x.alias(c) for c, x in key.items()]).join(hit, ["_t", "_u"], "left_anti").select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to the target weights, as many as the scarcest texts allow.

    Repeated rows, and rows of one or of no id, share a draw; texts without words stay; ties of topics go to the first. Other columns stay as they are, whatever their names."""
    told = mix(docs.select(carried(docs), "doc_id", "source", "lang", "text")).where("kept")
    return told.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' token ids, written in the file format and read back: doc_id, start, n_tokens, ids.

    Each row gives a row, repeated ones and null texts (the end id alone) too; rows of one id stand together, null ids first; other columns are not read."""
    import public_tokenizers

    return encode_and_read(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER), digest=False)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_output", token_output)]
#: The stages' model, components and byte-pair ids have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        freed(*done)  # the stage before
        done = [docs]
    return docs
