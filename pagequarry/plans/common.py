"""Reading the given tables, and SQL fragments used by several queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagequarry.session import balanced


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of texts, spread over the cores also when it is one small file."""
    return balanced(table(spark, folder, name))


def sql_tokens(text: str) -> str:
    return (
        rf"list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+'),"
        " lambda t: regexp_full_match(t, '[a-z0-9]+'))"
    )


def sql_ngrams(word: str, n: int = 3) -> str:
    return (
        f"CASE WHEN length({word}) < {n} THEN [{word}] ELSE"
        f" list_transform(range(1, length({word}) - {n - 1} + 1), lambda i: substr({word}, i, {n})) END"
    )


SQL_DOCUMENT_TOKENS = f"tok AS (SELECT doc_id, {sql_tokens('text')} AS tokens FROM documents)"
SQL_POSTINGS = (
    SQL_DOCUMENT_TOKENS
    + ", lens AS (SELECT doc_id, len(tokens) AS dl FROM tok)"
    + ", post AS (SELECT term, doc_id, count(*) AS frequency FROM"
    " (SELECT unnest(tokens) AS term, doc_id FROM tok) GROUP BY ALL)"
)
