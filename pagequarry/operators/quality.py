"""Constraints of the index tables, reported instead of enforced."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TEXT = 255


def repeated_urls(documents: DataFrame) -> DataFrame:
    return documents.groupBy("url").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def too_long(table: DataFrame, column: str) -> DataFrame:
    return table.where(F.length(F.col(column).cast("string")) > MAX_TEXT)


def orphans(postings: DataFrame, documents: DataFrame) -> DataFrame:
    """Document ids in postings without a document. Ids are made distinct before the join."""
    return postings.select("doc_id").distinct().join(documents.select("doc_id"), "doc_id", "left_anti")


def _counted(df: DataFrame, name: str, n: Column | None = None) -> DataFrame:
    total = F.count(F.lit(1)) if n is None else n
    return df.agg(F.coalesce(total, F.lit(0)).cast("long").alias("rows")).select(
        F.lit(name).alias("check_name"), "rows"
    )


def report(documents: DataFrame, postings: DataFrame, ngrams: DataFrame) -> DataFrame:
    """``check_name, rows``: how many rows break each constraint; a table is read once for all its
    length checks."""
    long_columns = {
        "documents": (documents, ["novel_name", "source", "content_hash"]),
        "postings": (postings, ["term"]),
        "ngrams": (ngrams, ["ngram", "term"]),
    }
    lengths = []
    for name, (table, columns) in long_columns.items():
        counted = table.agg(
            *[F.count_if(F.length(c) > MAX_TEXT).alias(f"{name}.{c} too long") for c in columns]
        )
        lengths.append(
            counted.unpivot([], [f"`{c}`" for c in counted.columns], "check_name", "rows")
        )
    others = [
        _counted(repeated_urls(documents), "documents.url repeated"),
        _counted(orphans(postings, documents), "postings.doc_id without document"),
    ]
    return reduce(DataFrame.unionByName, lengths + others)
