"""Running a stream until its input is drained, and replay-safe batch folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter


def drain(writer: DataStreamWriter, checkpoint: str, timeout: float | None = None) -> int:
    """Processes all that is there, then stops; gives the rows left out as too late for the watermark.
    Raises if it takes longer than ``timeout`` seconds, where given."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        if timeout is None:
            query.awaitTermination()
        elif not query.awaitTermination(timeout):
            raise TimeoutError(f"stream still running after {timeout} s")
        return sum(
            state["numRowsDroppedByWatermark"]
            for progress in query.recentProgress
            for state in progress["stateOperators"]
        )
    finally:
        query.stop()


def batch_folder(root: str, batch: int) -> str:
    return f"{root}/batch={batch}"


def write_batch(df: DataFrame, root: str, batch: int) -> None:
    """A replayed batch overwrites its own folder."""
    df.write.mode("overwrite").parquet(batch_folder(root, batch))


def per_batch(stream: DataFrame, action: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    return stream.writeStream.foreachBatch(action)


def read_batches(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)
