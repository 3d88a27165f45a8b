"""Counters and idle stretches over ``events``, an event's type being the metric."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry.operators import stats
from pagequarry.plans.common import table

NAMES = {
    "view": "total_requests",
    "click": "successful",
    "error": "failed",
    "purchase": "pages_crawled",
    "signup": "urls_discovered",
}
IDLE = 900


def _events(spark, folder):
    return table(spark, folder, "events").withColumnRenamed("event_type", "metric")


def crawl_counters(spark, folder):
    return stats.counters(_events(spark, folder))


def monitor_summary(spark, folder):
    return stats.monitor_summary(_events(spark, folder), NAMES)


def counter_delta(spark, folder):
    deltas = stats.counter_deltas(_events(spark, folder), "hour")
    return deltas.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss"))


def idle_spans(spark, folder):
    bins = stats.activity_bins(_events(spark, folder), IDLE)
    spans = stats.activity_spans(bins, IDLE, bins_per_chunk=300)
    return spans.withColumns(
        {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("started", "ended")}
    )


QUERIES = {
    "crawl_counters": crawl_counters,
    "monitor_summary": monitor_summary,
    "counter_delta": counter_delta,
    "idle_spans": idle_spans,
}

SQL = {
    "crawl_counters": "SELECT event_type AS metric, count(*) AS total FROM events GROUP BY event_type",
    "monitor_summary": "SELECT "
    + ", ".join(f"count_if(event_type = '{m}')::BIGINT AS {n}" for m, n in NAMES.items())
    + " FROM events",
    "counter_delta": """WITH b AS (SELECT event_type AS metric, date_trunc('hour', ts) AS bucket, count(*) AS n
  FROM events GROUP BY ALL),
c AS (SELECT metric, bucket, (sum(n) OVER (PARTITION BY metric ORDER BY bucket))::BIGINT AS total FROM b)
SELECT metric, strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, total,
  total - coalesce(lag(total) OVER (PARTITION BY metric ORDER BY bucket), 0) AS delta FROM c""",
    "idle_spans": f"""WITH g AS (SELECT ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) AS gap FROM events),
s AS (SELECT *, (sum((gap IS NULL OR gap > {IDLE}000000)::INT) OVER (ORDER BY ts))::BIGINT AS span FROM g)
SELECT span, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS ended,
  count(*) AS events, max(gap) FILTER (gap > {IDLE}000000) AS idle_before_us FROM s GROUP BY span""",
}
