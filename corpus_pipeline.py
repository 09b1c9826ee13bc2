"""A corpus pipeline over ``documents``: each stage works on all that the one before it kept.

Rows are the columns COLUMNS of documents; what else a table has is left out by the first stage.  A null or empty text
has no language and goes there; texts of any length are judged whole; rows equal in doc_id and text are copies, of which
one stays; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlane.llm import decontaminate, language, mixture, near, substrings
from factlane.llm.storage import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes where less than this share of its words is, with certainty, in one language.
LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: not ``und``, and mostly in one."""
    judged = language.identify(docs, language.train(docs))
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SCORE)).select(*COLUMNS)


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest id."""
    return near.keep_one(docs, near.jaccard_join(docs)).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; a document goes where nothing is left."""
    done = substrings.dedup_substrings(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    left = done.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    changed = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return left.select("doc_id", text.alias("text"), "lang", "source", changed.alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    hits = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit > 0")
    bad = hits.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    keyed = docs.withColumn("_own", F.xxhash64("text"))
    on = keyed["doc_id"].eqNullSafe(bad["_id"]) & (keyed["_own"] == bad["_digest"])
    return keyed.join(bad, on, "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixture.mix(docs).taken().select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", jaccard),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
]

#: No SQL can express the learned language model and the pseudorandom mix; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
