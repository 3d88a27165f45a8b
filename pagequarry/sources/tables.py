"""Batch and stream readers, and append sinks, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.operators.ordered import arrival_sequence
from pagequarry.operators.tasks import dead_letters, encoded, retries
from pagequarry.sources.batches import BatchLog


def stream_table(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files arriving in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """Submissions stored as Parquet with a ``raw`` column, as one queue partition in arrival order."""
    rows = arrival_sequence(spark.read.schema("raw STRING").parquet(path), "offset")
    return rows.select(F.lit(0).alias("partition"), "offset", "raw")


def kafka_submissions(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Submissions of a topic so far; needs the Kafka connector on the class path."""
    rows = spark.read.format("kafka").options(**options).load()
    return rows.select("partition", "offset", F.col("value").cast("string").alias("raw"))


RAW = T.StructType().add("raw", T.StringType())


def append_failures(log: BatchLog, batch: int, failed: DataFrame) -> None:
    """Failed tasks of a batch to the tables ``retries`` (read like submissions) and ``dead_letters``, in
    their JSON form. Both show the batch at once, when it is committed; a replay adds nothing."""
    log.write("retries", batch, encoded(retries(failed), "raw").select("raw"))
    log.write("dead_letters", batch, dead_letters(failed).select(F.col("payload").alias("raw")))
    log.commit(batch)
