"""The visited set: one row per (namespace, day, URL hash)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.urls import url_hash
from pagequarry.operators.ordered import first_rows

KEYS = ["namespace", "day", "url_hash"]
KEEP_DAYS = 2


def keyed(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumn("url_hash", url_hash(F.col(url)))


def newly_visited(df: DataFrame, visited: DataFrame | None, order: list[str]) -> DataFrame:
    """The rows whose mark succeeds: first of their key in ``order`` and not yet in ``visited``.

    Copies shrink to one row per map task before the shuffle; what is joined to the visited set is
    one row per key, so a URL linked from everywhere is no hot key there either.
    """
    first = first_rows(df, KEYS, order)
    return first if visited is None else first.join(visited.select(*KEYS), KEYS, "left_anti")


def grown(visited: DataFrame, marked: DataFrame) -> DataFrame:
    return visited.select(*KEYS).unionByName(marked.select(*KEYS)).dropDuplicates(KEYS)


def unexpired(visited: DataFrame, today: Column, keep_days: int = KEEP_DAYS) -> DataFrame:
    """Days older than ``keep_days`` are gone. With ``day`` as partition column nothing else is read."""
    return visited.where(F.col("day") >= F.date_sub(today, keep_days))
