"""Ordered per-key computations that stay parallel when one key holds much of the data.

A plain window puts a whole key in one task. Here every key is cut into chunks by its order column;
the window runs inside (key, chunk), and what a chunk needs from the earlier ones comes from a table
with one row per chunk. Arrival numbers are unique, so a chunk of N numbers has at most N rows,
whatever the skew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pagequarry.operators.joins import lookup_join
from pagequarry.session import pinned

CHUNK_ROWS = 1_000_000


def chunk_of(order: Column, chunk_rows: int = CHUNK_ROWS) -> Column:
    return F.floor(order / F.lit(chunk_rows)).cast("long")


def with_carry(
    rows: DataFrame,
    keys: list[str],
    chunk: str,
    totals: dict[str, Column],
    carries: dict[str, Callable[[WindowSpec], Column]],
) -> DataFrame:
    """``rows`` plus, per carry, a value over all earlier chunks of the same key.

    ``totals`` reduce a chunk to one row (combined before the shuffle); ``carries`` see only these.
    """
    summary = rows.groupBy(*keys, chunk).agg(*[e.alias(name) for name, e in totals.items()])
    earlier = (
        Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = summary.select(
        *keys, chunk, *[build(earlier).alias(name) for name, build in carries.items()]
    )
    return rows.join(carry, [*keys, chunk])


def ranked(
    df: DataFrame,
    keys: list[str],
    order: str,
    out: str,
    chunk_rows: int = CHUNK_ROWS,
    major: str | None = None,
) -> DataFrame:
    """Row number within ``keys`` by the unique number ``order``, exact for keys of any size; by
    ``major`` first, if given."""
    chunk = chunk_of(F.col(order), chunk_rows)
    if major:
        chunk = F.struct(F.col(major).alias("major"), chunk.alias("chunk"))
    rows = df.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    carried = with_carry(
        rows,
        keys,
        "_chunk",
        {"_rows": F.count(F.lit(1))},
        {"_before": lambda w: F.coalesce(F.sum("_rows").over(w), F.lit(0))},
    )
    return carried.withColumn(
        out, F.row_number().over(inside).cast("long") + F.col("_before")
    ).drop("_chunk", "_before")


def global_rank(df: DataFrame, order: list[str | Column], out: str, start: int = 1) -> DataFrame:
    """Dense numbering of all rows by ``order``, without a single-task window.

    Rows are range-sorted and pinned; each task numbers its own range and a table with one row per
    task gives the start of the range. ``order`` should end in a unique column.
    """
    slots = pinned(df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id()))
    # monotonically_increasing_id keeps the partition number above bit 33, the row number below.
    placed = slots.withColumn("_part", F.shiftright("_slot", 33)).withColumn(
        "_index", F.col("_slot") - F.shiftleft("_part", 33)
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    # One row per partition of the sort: bounded by the shuffle partition count.
    return placed.join(F.broadcast(starts), "_part").select(
        *df.columns, (F.col("_before") + F.col("_index") + start).cast("long").alias(out)
    )


def first_rows(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row per key. Each map task keeps one row per key before the shuffle
    (``WindowGroupLimit``), so a key with a third of all rows sends one row per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def arrival_sequence(df: DataFrame, out: str = "seq") -> DataFrame:
    """Numbers rows 1.. in file order and row order, straight from a Parquet scan.

    No row is shuffled: the scan knows each row's place in its file, and a table with one row per
    file gives the first number of the file.
    """
    rows = df.withColumns(
        {
            "_file": F.col("_metadata.file_path"),
            "_at": F.col("_metadata.row_index"),
        }
    )
    sizes = df.select(F.col("_metadata.file_path").alias("_file")).groupBy("_file").agg(
        F.count(F.lit(1)).alias("_rows")
    )
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_file", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    return (
        lookup_join(rows, starts, "_file", ["_at"], "inner")
        .withColumn(out, (F.col("_before") + F.col("_at") + 1).cast("long"))
        .drop("_file", "_at", "_before")
    )
