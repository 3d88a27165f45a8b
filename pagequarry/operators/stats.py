"""Crawl counters, monitor figures and idle stretches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.operators.frontier import micros
from pagequarry.operators.ordered import with_carry
from pagequarry.operators.tasks import fetched_ok

# The counters a crawl keeps, and the monitor's names for them.
SUMMARY = {
    "request_started": "total_requests",
    "request_success": "successful",
    "request_failed": "failed",
    "page_crawled": "pages_crawled",
    "url_discovered": "urls_discovered",
}
IDLE_SECONDS = 30


def fetch_metrics(fetched: DataFrame) -> DataFrame:
    """One event (``metric``) for each thing a crawl counts about a fetched task (``status``)."""
    happened = F.when(
        fetched_ok(F.col("status")),
        F.array(*[F.lit(m) for m in ("request_started", "request_success", "page_crawled")]),
    ).otherwise(F.array(F.lit("request_started"), F.lit("request_failed")))
    return fetched.select(F.explode(happened).alias("metric"))


def counters(events: DataFrame) -> DataFrame:
    return events.groupBy("metric").agg(F.count(F.lit(1)).alias("total"))


def monitor_summary(events: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """One row with a column per counter, in one pass."""
    return events.agg(
        *[F.count_if(F.col("metric") == m).alias(n) for m, n in (names or SUMMARY).items()]
    )


def counter_deltas(events: DataFrame, unit: str = "second") -> DataFrame:
    """Per metric and time bucket with events: count so far, and growth since the last such bucket.

    Events shrink to one row per bucket before the shuffle; the running sum works day by day.
    """
    buckets = events.groupBy("metric", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("bucket")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    rows = buckets.withColumn("_day", F.to_date("bucket"))
    inside = Window.partitionBy("metric", "_day").orderBy("bucket")
    rows = with_carry(
        rows,
        ["metric"],
        "_day",
        {"_sum": F.sum("_n")},
        {"_before": lambda w: F.coalesce(F.sum("_sum").over(w), F.lit(0))},
    )
    # The growth since the previous reading is what the bucket itself counted.
    return rows.select(
        "metric",
        "bucket",
        (F.col("_before") + F.sum("_n").over(inside)).alias("total"),
        F.col("_n").alias("delta"),
    )


def activity_bins(events: DataFrame, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """First and last event time and count per bin of ``idle_seconds``. Two events in one bin are
    never an idle stretch apart, so bins keep all that idle stretches depend on; there are as many
    as the time span has, not as the data has."""
    return (
        events.select(micros(F.col("ts")).alias("_us"))
        .groupBy(F.floor(F.col("_us") / (idle_seconds * 1_000_000)).cast("long").alias("bin"))
        .agg(F.min("_us").alias("first_us"), F.max("_us").alias("last_us"), F.count(F.lit(1)).alias("events"))
    )


def activity_spans(
    bins: DataFrame, idle_seconds: int = IDLE_SECONDS, bins_per_chunk: int = 100_000
) -> DataFrame:
    """Stretches of work separated by more than ``idle_seconds`` without any: ``span`` number,
    ``started``, ``ended``, ``events``, and ``idle_before_us`` (null for the first)."""
    rows = bins.withColumn("_chunk", F.floor(F.col("bin") / bins_per_chunk))
    inside = Window.partitionBy("_chunk").orderBy("bin")
    rows = with_carry(
        rows, [], "_chunk", {"_last": F.max("last_us")}, {"_previous": lambda w: F.max("_last").over(w)}
    )
    gap = F.col("first_us") - F.coalesce(F.lag("last_us").over(inside), F.col("_previous"))
    rows = rows.withColumn("_gap", gap).withColumn(
        "_opens", (F.col("_gap").isNull() | (F.col("_gap") > idle_seconds * 1_000_000)).cast("long")
    )
    # Only a chunk's number of openings is carried.
    rows = rows.drop("_previous")
    rows = with_carry(
        rows,
        [],
        "_chunk",
        {"_openings": F.sum("_opens")},
        {"_before": lambda w: F.coalesce(F.sum("_openings").over(w), F.lit(0))},
    ).withColumn("span", F.col("_before") + F.sum("_opens").over(inside))
    return rows.groupBy("span").agg(
        _time(F.min("first_us")).alias("started"),
        _time(F.max("last_us")).alias("ended"),
        F.sum("events").alias("events"),
        F.max(F.when(F.col("_opens") == 1, F.col("_gap"))).alias("idle_before_us"),
    )


def _time(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
