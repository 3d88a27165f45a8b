"""Tables that grow by numbered batches and show a batch only once it is committed."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class BatchLog:
    """Tables below ``root`` that change together. One writer at a time.

    A batch writes a folder in each table it touches, and then one commit row with the ``facts`` of the
    batch. Readers see the folders of committed batches only, so a batch that died half-way shows nothing;
    run again, it overwrites its own folders, and a replay of a committed batch leaves the same rows.
    """

    def __init__(self, spark: SparkSession, root: str, facts: str = "") -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.facts = T.StructType.fromDDL(facts) if facts else T.StructType()

    def folder(self, table: str, batch: int) -> str:
        return f"{self.root}/{table}/batch={batch}"

    def write(self, table: str, batch: int, df: DataFrame) -> DataFrame:
        """Writes a batch's part of a table; gives it as read back, before any commit."""
        df.write.mode("overwrite").parquet(self.folder(table, batch))
        return self.part(table, batch, df.schema)

    def part(self, table: str, batch: int, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.folder(table, batch))

    def commit(self, batch: int, *facts, step: str = "commits") -> None:
        row = self.spark.createDataFrame([(True, *facts)], T.StructType([T.StructField("done", T.BooleanType()), *self.facts.fields]))
        row.coalesce(1).write.mode("overwrite").parquet(self.folder(step, batch))

    def commits(self, step: str = "commits") -> list:
        """One small row for each committed batch, in their order."""
        schema = T.StructType([*self.facts.fields, T.StructField("batch", T.IntegerType())])
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.root}/{step}").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(rows, key=lambda row: row["batch"])

    def batches(self, step: str = "commits") -> list[int]:
        return [row["batch"] for row in self.commits(step)]

    def read(self, table: str, schema: T.StructType, batches: list[int] | None = None) -> DataFrame:
        """Rows of committed batches (or of those of ``batches`` that are), with their ``batch``."""
        wanted = self.batches()
        if batches is not None:
            wanted = sorted(set(wanted) & set(batches))
        full = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])
        if not wanted:
            return self.spark.createDataFrame([], full)
        rows = self.spark.read.schema(full).parquet(f"{self.root}/{table}")
        # Folders are told by the first and last number and the gaps between, of which there are few.
        gaps = sorted(set(range(wanted[0], wanted[-1] + 1)) - set(wanted))
        shown = F.col("batch").between(wanted[0], wanted[-1])
        return rows.where(shown & ~F.col("batch").isin(gaps) if gaps else shown)
