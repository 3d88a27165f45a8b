"""A training corpus from raw documents: every stage takes and returns a table of documents.

``STAGES`` in order; ``run`` writes each stage's result as Parquet to the shared folder and reads it
back, so a lost executor never repeats an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagequarry.llm import stages
from pagequarry.session import pinned

STAGES = stages.STAGES

#: Language models, boosted trees and alignments cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = pinned(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
