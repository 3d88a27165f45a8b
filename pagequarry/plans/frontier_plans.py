"""Frontier, visited set, rate slots and retries over ``events``.

An event is a task or request of site ``event_type`` for item ``user_id``; its number is the arrival
number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.operators import frontier, tasks, visited
from pagequarry.operators.ordered import arrival_sequence
from pagequarry.plans.common import table

# Small enough that each site spans several chunks in the check.
CHUNK = 700
ROTATION = 3
TODAY = "2024-01-20"


def _events(spark, folder):
    return table(spark, folder, "events")


def _site():
    return F.concat(F.lit("https://"), "event_type", F.lit(".example/"))


def event_tasks(spark, folder) -> DataFrame:
    site = _site()
    return _events(spark, folder).select(
        F.concat(site, F.lit("item/"), "user_id").alias("url"),
        site.alias("site"),
        F.lit(1.0).alias("rate_limit"),
        (F.col("user_id") % 3).cast("int").alias("priority"),
        (F.floor("value") % 6).cast("int").alias("retry_count"),
        F.lit(3).alias("max_retries"),
        F.create_map(F.lit("User-Agent"), F.lit("crawler")).alias("headers"),
        (F.col("event_id") + 1).alias("seq"),
    )


def arrival_seq(spark, folder):
    return arrival_sequence(_events(spark, folder)).select("event_id", "seq")


def _frontier(spark, folder):
    return frontier.add_tasks(event_tasks(spark, folder))


def frontier_add(spark, folder):
    return _frontier(spark, folder).select(
        "site", "url", F.col("retry_count").cast("long").alias("retry_count"), "seq",
        F.col("headers")["User-Agent"].alias("user_agent"),
    )


def frontier_union(spark, folder):
    """Retries of failed tasks join the frontier."""
    tried = tasks.retries(event_tasks(spark, folder))
    return frontier.add_tasks(event_tasks(spark, folder), tried).select(
        "site", "url", F.col("retry_count").cast("long").alias("retry_count"), "seq"
    )


def active_sites(spark, folder):
    return frontier.active_sites(event_tasks(spark, folder))


def site_order(spark, folder):
    placed = frontier.site_positions(event_tasks(spark, folder), ROTATION)
    return placed.select("site", "site_rank", F.col("turn").cast("long").alias("turn"))


def frontier_order(spark, folder):
    return frontier.site_order(event_tasks(spark, folder), CHUNK).select("site", "seq", "score", "rn")


def round_robin(spark, folder):
    ordered = frontier.round_robin(event_tasks(spark, folder), ROTATION, CHUNK)
    return ordered.select("site", "seq", "rn", F.col("turn").cast("long").alias("turn"))


def next_batch(spark, folder):
    batch = frontier.next_batch(event_tasks(spark, folder), 100, ROTATION)
    return batch.select("site", "seq", F.col("rn").cast("long").alias("rn"))


def next_batch_capped(spark, folder):
    batch = frontier.next_batch(event_tasks(spark, folder), 100, ROTATION, per_site=7)
    return batch.select("site", "seq", F.col("rn").cast("long").alias("rn"))


def queue_sizes(spark, folder):
    return frontier.queue_sizes(event_tasks(spark, folder))


def queue_total(spark, folder):
    return frontier.queue_total(event_tasks(spark, folder))


def _requests(spark, folder):
    return _events(spark, folder).select(
        F.col("event_type").alias("site"),
        (F.col("event_id") + 1).alias("seq"),
        frontier.micros(F.col("ts")).alias("now_us"),
        ((F.col("user_id") % 40 + 1) * 60_000_000).alias("rate_us"),
    )


def rate_slots(spark, folder):
    return frontier.rate_slots(_requests(spark, folder), chunk_rows=CHUNK).select("site", "seq", "start_us")


def rate_state(spark, folder):
    return frontier.slot_state(frontier.rate_slots(_requests(spark, folder), chunk_rows=CHUNK))


def _marks(spark, folder):
    tail = F.element_at(F.array(F.lit(""), F.lit("/"), F.lit("#top")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = _events(spark, folder).select(
        "event_id",
        "value",
        _site().alias("namespace"),
        F.to_date("ts").alias("day"),
        F.concat(_site(), F.lit("item/"), "user_id", tail).alias("url"),
    )
    return visited.keyed(rows)


def _seen(spark, folder):
    """What cheap events marked before."""
    return _marks(spark, folder).where("value < 10").select(*visited.KEYS).distinct()


def _plain(df):
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def visited_new(spark, folder):
    new = visited.newly_visited(_marks(spark, folder), _seen(spark, folder), ["event_id"])
    return _plain(new).select("namespace", "day", "url_hash", "event_id")


def visited_grow(spark, folder):
    new = visited.newly_visited(_marks(spark, folder), _seen(spark, folder), ["event_id"])
    return _plain(visited.grown(_seen(spark, folder), new))


def visited_expire(spark, folder):
    kept = visited.unexpired(_seen(spark, folder), F.lit(TODAY).cast("date"))
    return _plain(kept)


def retry_split(spark, folder):
    routed = tasks.after_failure(event_tasks(spark, folder))
    return routed.select("seq", F.col("retry_count").cast("long").alias("retry_count"), "route")


def dead_letters(spark, folder):
    dead = tasks.dead_letters(event_tasks(spark, folder))
    read = tasks.decoded(dead.select("seq", "payload"))
    return dead.select("seq", "payload").join(
        read.select("seq", F.col("url").alias("decoded_url"), F.col("retry_count").cast("long").alias("decoded_retry")), "seq"
    )


QUERIES = {
    "arrival_seq": arrival_seq,
    "frontier_add": frontier_add,
    "frontier_union": frontier_union,
    "active_sites": active_sites,
    "site_order": site_order,
    "frontier_order": frontier_order,
    "round_robin": round_robin,
    "next_batch": next_batch,
    "next_batch_capped": next_batch_capped,
    "queue_sizes": queue_sizes,
    "queue_total": queue_total,
    "rate_slots": rate_slots,
    "rate_state": rate_state,
    "visited_new": visited_new,
    "visited_grow": visited_grow,
    "visited_expire": visited_expire,
    "retry_split": retry_split,
    "dead_letters": dead_letters,
}

_TASKS = """t AS (SELECT 'https://' || event_type || '.example/' AS site,
  'https://' || event_type || '.example/item/' || user_id AS url, user_id % 3 AS priority,
  floor(value)::BIGINT % 6 AS retry_count, event_id + 1 AS seq FROM events)"""
_SITES = f"""n AS (SELECT site, row_number() OVER (ORDER BY site) - 1 AS site_rank, count(*) OVER () AS k
  FROM (SELECT DISTINCT site FROM t)),
turns AS (SELECT site, site_rank, (site_rank - {ROTATION} % k + k) % k AS turn FROM n)"""
_ORDER = """o AS (SELECT site, seq, priority * 1000000000 + seq AS score,
  row_number() OVER (PARTITION BY site ORDER BY priority * 1000000000 + seq) AS rn FROM t)"""
_SLOTS = """r AS (SELECT event_type AS site, event_id + 1 AS seq, epoch_us(ts) AS now_us,
  (user_id % 40 + 1) * 60000000 AS rate_us FROM events),
g AS (SELECT *, coalesce(now_us - lag(now_us) OVER (PARTITION BY site ORDER BY seq) >= 3600000000, false) AS reset FROM r),
s AS (SELECT *, sum(reset::INT) OVER (PARTITION BY site ORDER BY seq) AS stretch FROM g),
c AS (SELECT *, coalesce(sum(rate_us) OVER (PARTITION BY site, stretch ORDER BY seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c FROM s),
slots AS (SELECT site, seq, now_us, rate_us, (c + max(now_us - c) OVER (PARTITION BY site, stretch ORDER BY seq))::BIGINT AS start_us FROM c)"""
_MARKS = """m AS (SELECT event_id, value, 'https://' || event_type || '.example/' AS namespace,
  strftime(ts, '%Y-%m-%d') AS day,
  sha1('https://' || event_type || '.example/item/' || user_id) AS url_hash FROM events),
seen AS (SELECT DISTINCT namespace, day, url_hash FROM m WHERE value < 10),
fresh AS (SELECT namespace, day, url_hash, min(event_id) AS event_id FROM m
  WHERE (namespace, day, url_hash) NOT IN (SELECT (namespace, day, url_hash) FROM seen) GROUP BY ALL)"""
_BATCH = """SELECT site, seq, rn FROM o JOIN turns USING (site) {where} ORDER BY rn, turn LIMIT 100"""

SQL = {
    "arrival_seq": "SELECT event_id, row_number() OVER (ORDER BY event_id) AS seq FROM events",
    "frontier_add": f"""WITH {_TASKS} SELECT site, url, retry_count, max(seq) AS seq, 'crawler' AS user_agent
FROM t GROUP BY site, url, priority, retry_count""",
    "frontier_union": f"""WITH {_TASKS} SELECT site, url, retry_count, max(seq) AS seq FROM (
  SELECT * FROM t UNION ALL SELECT site, url, priority, retry_count + 1, seq FROM t WHERE retry_count + 1 <= 3)
GROUP BY site, url, priority, retry_count""",
    "active_sites": f"WITH {_TASKS} SELECT DISTINCT site FROM t",
    "site_order": f"WITH {_TASKS}, {_SITES} SELECT * FROM turns",
    "frontier_order": f"WITH {_TASKS}, {_ORDER} SELECT * FROM o",
    "round_robin": f"WITH {_TASKS}, {_SITES}, {_ORDER} SELECT site, seq, rn, turn FROM o JOIN turns USING (site)",
    "next_batch": f"WITH {_TASKS}, {_SITES}, {_ORDER} {_BATCH.format(where='')}",
    "next_batch_capped": f"WITH {_TASKS}, {_SITES}, {_ORDER} {_BATCH.format(where='WHERE rn <= 7')}",
    "queue_sizes": f"WITH {_TASKS} SELECT site, count(*) AS tasks FROM t GROUP BY site",
    "queue_total": f"WITH {_TASKS} SELECT count(*) AS tasks, count(*) = 0 AS empty FROM t",
    "rate_slots": f"WITH {_SLOTS} SELECT site, seq, start_us FROM slots",
    "rate_state": f"""WITH {_SLOTS} SELECT site, arg_max(start_us + rate_us, seq) AS next_us,
  arg_max(now_us, seq) AS last_us FROM slots GROUP BY site""",
    "visited_new": f"WITH {_MARKS} SELECT * FROM fresh",
    "visited_grow": f"WITH {_MARKS} SELECT * FROM seen UNION SELECT namespace, day, url_hash FROM fresh",
    "visited_expire": f"WITH {_MARKS} SELECT * FROM seen WHERE day >= '2024-01-18'",
    "retry_split": f"""WITH {_TASKS} SELECT seq, retry_count + 1 AS retry_count,
  CASE WHEN retry_count + 1 <= 3 THEN 'retry' ELSE 'dead' END AS route FROM t""",
    "dead_letters": f"""WITH {_TASKS} SELECT seq, '{{"url":"' || url || '","site":"' || site || '","rate_limit":1.0,"priority":'
  || priority || ',"retry_count":' || (retry_count + 1) || ',"max_retries":3,"headers":{{"User-Agent":"crawler"}}}}' AS payload,
  url AS decoded_url, retry_count + 1 AS decoded_retry FROM t WHERE retry_count + 1 > 3""",
}
