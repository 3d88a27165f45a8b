"""The stages of the corpus pipeline; each is ``stage(spark, docs, folder) -> documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import decontamination, language_id, mixing, pii, shingle_join
from pagequarry.llm.arrow import free_name
from pagequarry.session import pinned

#: A document stays when the posterior of its language is at least this.
LANGUAGE_SCORE = 0.5


def identified(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents written in a known language; the models learn from the rows not held out."""
    use = ~language_id.held_out(F.col("doc_id"))
    model = language_id.train(docs, "text", "lang", use, F.col("doc_id"))
    guess = free_name(docs, "guess")
    return (
        docs.withColumn(guess, language_id.predicted(F.col("text"), model))
        .where((F.col(f"{guess}.lang_pred") != language_id.UNKNOWN) & (F.col(f"{guess}.score") >= LANGUAGE_SCORE))
        .drop(guess)
    )


def distinct(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates: the one whose id names the group. Rows that share
    that id stay together; a document without words is in no group and stays."""
    groups = pinned(shingle_join.groups(docs).where("component_id <> doc_id").select("doc_id").distinct())
    return docs.join(groups, "doc_id", "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    return decontamination.clean(docs, benchmark)


def redacted(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with personal data replaced by its kind; ``n_chars`` follows the text."""
    return pii.redacted(docs).withColumn(
        "n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    )


def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents the mix takes, with how often (``copies``)."""
    return mixing.mixed(docs)


STAGES = [
    ("language_id", identified),
    ("near_duplicates", distinct),
    ("decontamination", decontaminated),
    ("pii", redacted),
    ("mixing", mixed),
]
