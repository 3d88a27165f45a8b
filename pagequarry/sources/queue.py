"""The submission queue: a total order, batches of the oldest, and a cursor committed behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.operators.joins import lookup_join
from pagequarry.sources.batches import BatchLog

#: Of each partition of the queue, what a batch takes: offsets after ``after`` up to ``until``.
SPANS = T.StructType().add("partition", "integer").add("after", "long").add("until", "long")


class SubmissionQueue:
    """Submissions (``partition, offset, raw``) taken in batches, oldest first, by one consumer.

    The order over partitions is (offset, partition): total, the same for every reader, and fair to all
    partitions. A batch is planned before it is handed out, as a span of offsets of each partition, so a
    batch taken again after a failure has the same submissions, whatever has arrived since. The cursor
    moves when the batch is done.
    """

    def __init__(self, spark: SparkSession, root: str, submissions: DataFrame) -> None:
        self.log, self.submissions = BatchLog(spark, root), submissions

    def cursor(self) -> DataFrame:
        """Of each partition the last offset that is done with: one row a partition."""
        spans = self.log.read("spans", SPANS)
        return spans.groupBy("partition").agg(F.max("until").alias("after"))

    def pending(self) -> DataFrame:
        """Submissions behind the cursor."""
        rows = lookup_join(self.submissions, self.cursor(), "partition", ["offset"])
        return rows.where(F.col("after").isNull() | (F.col("offset") > F.col("after")))

    def take(self, batch: int, size: int) -> DataFrame:
        """The oldest ``size`` submissions, as batch number ``batch``; a batch taken before, as it was.

        Only partition and offset of the oldest of each task meet in one, so ``size`` should be what one
        task can sort. A row has its ``position`` in the order for the consumer to sort by.
        """
        planned = self.log.batches("plans")
        if batch not in planned:
            open_ones = set(planned) - set(self.log.batches())
            if open_ones:
                raise ValueError(f"batch {min(open_ones)} is taken and not done")
            pending = self.pending()
            oldest = pending.select("partition", "offset", "after").orderBy("offset", "partition").limit(size)
            spans = oldest.groupBy("partition").agg(
                F.coalesce(F.max("after"), F.min("offset") - 1).alias("after"), F.max("offset").alias("until")
            )
            self.log.write("spans", batch, spans)
            self.log.commit(batch, step="plans")
        spans = self.log.part("spans", batch, SPANS)
        rows = lookup_join(self.submissions, spans, "partition", ["offset"], "inner")
        taken = rows.where((F.col("offset") > F.col("after")) & (F.col("offset") <= F.col("until")))
        position = F.struct("offset", "partition").alias("position")
        return taken.select("partition", "offset", "raw", position)

    def done(self, batch: int) -> None:
        """The cursor moves past the batch."""
        self.log.commit(batch)
