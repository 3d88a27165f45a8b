"""Streams made of ``events`` and ``pages``, compared with the equal batch result.

The events arrive in slices in time order, one micro-batch each, so state is carried between batches. A closing heartbeat far in the future moves the watermark past all of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions.text import content_string
from pagequarry.functions.urls import slug_of
from pagequarry.operators.tasks import decoded
from pagequarry.plans import frontier_plans, site_plans
from pagequarry.plans.common import sql_ngrams, table
from pagequarry.session import pinned, shared_folder
from pagequarry.sources.batches import BatchLog
from pagequarry.sources.store import COPIED, IndexStore, copy_store, parquet_target
from pagequarry.sources.tables import stream_table
from pagequarry.plans import index_plans
from pagequarry.streaming import jobs
from pagequarry.streaming.runner import drain, read_batches

#: A slice of a stream has about so many rows, and there are several so that state is carried on.
SLICE_ROWS = 10_000_000
LEAST_SLICES = 3
LATE = "1 minute"
GAP = "20 minutes"


def _fresh_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _arrivals(spark, root, rows: DataFrame, order: str, heartbeat: DataFrame | None = None):
    """``rows`` arriving in slices by ``order``: (the stream, whose first slice is there; the others).
    Every slice is as many files as tasks write, and :func:`_drained` makes a micro-batch of it."""
    span = rows.agg(
        F.min(order).alias("low"), F.max(order).alias("high"), F.count(F.lit(1)).alias("rows")
    ).first()
    low, slices = span["low"], max(LEAST_SLICES, -(-span["rows"] // SLICE_ROWS))
    if low is None:
        parts = [rows]
    else:
        step = (span["high"] - low) / slices
        at = [F.lit(low + step * i) for i in range(slices)]
        parts = [
            rows.where(
                (F.col(order) >= at[i] if i else F.lit(True))
                & (F.col(order) < at[i + 1] if i < slices - 1 else F.lit(True))
            )
            for i in range(slices)
        ]
    if heartbeat is not None:
        parts.append(heartbeat)
    parts[0].write.mode("append").parquet(f"{root}/input")
    return stream_table(spark, f"{root}/input", rows.schema), parts[1:]


def _drained(root, writer, later: list[DataFrame]) -> int:
    """Runs the stream over each slice as it arrives; gives the rows that came too late."""
    dropped = drain(writer, f"{root}/checkpoint")
    for part in later:
        part.write.mode("append").parquet(f"{root}/input")
        dropped += drain(writer, f"{root}/checkpoint")
    return dropped


def _timed_events(spark, folder):
    return table(spark, folder, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("metric"),
        F.col("event_type").alias("site"),
        F.col("user_id").cast("string").alias("url_hash"),
        F.col("event_type").alias("namespace"),
        F.to_date("ts").alias("day"),
    )


def _with_heartbeat(spark, root, events):
    last = events.agg(F.max("ts").alias("ts"))
    beat = last.select(
        *[
            (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")
            if f.name == "ts"
            else F.lit("heartbeat").cast(f.dataType).alias(f.name)
            if f.dataType.simpleString() == "string"
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in events.schema.fields
        ]
    )
    return _arrivals(spark, root, events, "ts", beat)


def stream_dedupe(spark, folder):
    root = _fresh_folder(spark)
    stream, later = _arrivals(spark, root, _timed_events(spark, folder), "ts")
    unique = jobs.deduplicated(stream, ["event_id"])
    _drained(root, unique.writeStream.format("parquet").option("path", f"{root}/out"), later)
    kept = spark.read.schema(unique.schema).parquet(f"{root}/out")
    return kept.select("namespace", F.date_format("day", "yyyy-MM-dd").alias("day"), "url_hash")


def stream_counters(spark, folder):
    root = _fresh_folder(spark)
    stream, later = _with_heartbeat(spark, root, _timed_events(spark, folder))
    counts = jobs.windowed_counts(stream, LATE, "1 hour")
    _drained(root, counts.writeStream.format("parquet").option("path", f"{root}/out"), later)
    done = spark.read.schema(counts.schema).parquet(f"{root}/out").where("metric <> 'heartbeat'")
    return done.select(F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "metric", "events")


def stream_counters_late(spark, folder):
    """The same counts from events that arrive in no order, most of them long after their window closed."""
    root = _fresh_folder(spark)
    events = _timed_events(spark, folder).withColumn("turn", F.pmod(F.xxhash64("event_id"), F.lit(997)))
    stream, later = _arrivals(spark, root, events, "turn")
    log = BatchLog(spark, f"{root}/counters", jobs.LATE_FACTS)
    _drained(root, jobs.counts_with_late(stream, log, LATE, "1 hour"), later)
    counts = jobs.counts_merged(log)
    return counts.select(F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "metric", "events")


def stream_sessions(spark, folder):
    root = _fresh_folder(spark)
    stream, later = _with_heartbeat(spark, root, _timed_events(spark, folder))
    sessions = jobs.activity_sessions(stream, LATE, GAP)
    _drained(root, sessions.writeStream.format("parquet").option("path", f"{root}/out"), later)
    done = spark.read.schema(sessions.schema).parquet(f"{root}/out").where("site <> 'heartbeat'")
    time = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return done.select("site", F.date_format("started", time).alias("started"), F.date_format("ended", time).alias("ended"), "events")


def stream_retry(spark, folder):
    root = _fresh_folder(spark)
    stream, later = _arrivals(spark, root, frontier_plans.event_tasks(spark, folder), "seq")
    _drained(root, jobs.route_failures(stream, f"{root}/retry", f"{root}/dead"), later)
    routed = []
    for route in ("retry", "dead"):
        rows = decoded(read_batches(spark, f"{root}/{route}").select("seq", "payload"))
        routed.append(rows.select("seq", F.col("retry_count").cast("long").alias("retry_count"), F.lit(route).alias("route")))
    return routed[0].unionByName(routed[1])


def stream_slots(spark, folder):
    root = _fresh_folder(spark)
    stream, later = _arrivals(spark, root, frontier_plans._requests(spark, folder), "seq")
    _drained(root, jobs.reserve_slots(stream, f"{root}/slots", f"{root}/state"), later)
    return read_batches(spark, f"{root}/slots").select("site", "seq", "start_us")


def _all_submissions(spark, folder) -> DataFrame:
    """Submissions of all shapes, most of them unusable, and every page's plain URL."""
    mixed = site_plans.submissions(spark, folder).select((F.col("seq") * 2).alias("seq"), "raw")
    plain = table(spark, folder, "pages").select((F.col("page_id") * 2 + 1).alias("seq"), F.col("url").alias("raw"))
    return mixed.unionByName(plain)


def _indexed_store(spark, folder) -> IndexStore:
    root = _fresh_folder(spark)
    stream, later = _arrivals(spark, root, _all_submissions(spark, folder), "seq")
    store = IndexStore(spark, f"{root}/index", buckets=4)
    writer = jobs.index_submissions(
        stream,
        site_plans.host_registry(spark, folder),
        jobs.fetch_from(table(spark, folder, "pages"), "page_id"),
        store,
        lambda number: F.lit(site_plans.NOW).cast("timestamp_ntz"),
    )
    _drained(root, writer, later)
    return store


def stream_index(spark, folder):
    documents = _indexed_store(spark, folder).documents()
    content = content_string(F.col("novel_name"), F.col("description"), slug_of(F.col("url")))
    return documents.select("url", "novel_name", "source", F.col("doc_length").cast("long").alias("doc_length"), "content_hash", (F.sha2(content, 256) == F.col("content_hash")).alias("hash_fits"))


def stream_index_postings(spark, folder):
    store = _indexed_store(spark, folder)
    rows = store.postings().join(store.documents().select("doc_id", "url"), "doc_id")
    return rows.select("url", "term", "frequency")


def stream_index_ngrams(spark, folder):
    """N-grams of the store's terms, after several batches."""
    return _indexed_store(spark, folder).ngrams()


def store_compact(spark, folder):
    """Documents with their number of postings, after crowded buckets and then all segments were folded."""
    store = _indexed_store(spark, folder)
    last = store.batches()[-1]
    store.fold(last + 1)
    store.compact(last + 2)
    counts = store.postings().groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"))
    rows = store.documents().join(counts, "doc_id")
    return rows.select("url", "novel_name", F.col("doc_length").cast("long").alias("doc_length"), "terms", "content_hash")


def store_copy(spark, folder):
    """Documents as they arrive in a copied store."""
    write, read_back = parquet_target(spark, _fresh_folder(spark))
    # A copied table is read for its rows and for their number: both come from storage, as in a store, and
    # the texts are cut into terms once.
    postings = pinned(index_plans.stored_postings(spark, folder))
    ngrams = pinned(index_plans.index_build.term_ngrams(postings))
    tables = dict(zip(COPIED, (index_plans.stored_documents(spark, folder), postings, ngrams)))
    counts = copy_store(tables, write, read_back)
    rows = read_back("documents").withColumn("last_crawled_at", F.date_format("last_crawled_at", "yyyy-MM-dd"))
    return rows.withColumns(
        {"doc_length": F.col("doc_length").cast("long"), "copied_postings": F.lit(counts["inverted_index"]).cast("long")}
    )


QUERIES = {
    "stream_dedupe": stream_dedupe,
    "stream_counters": stream_counters,
    "stream_counters_late": stream_counters_late,
    "stream_sessions": stream_sessions,
    "stream_retry": stream_retry,
    "stream_slots": stream_slots,
    "stream_index": stream_index,
    "stream_index_postings": stream_index_postings,
    "stream_index_ngrams": stream_index_ngrams,
    "store_compact": store_compact,
    "store_copy": store_copy,
}

_INDEXED = f"""WITH {site_plans._REG}, s AS (SELECT DISTINCT url FROM pages),
p AS (SELECT url, arg_max(html, page_id) AS html FROM pages GROUP BY url),
f AS (SELECT url, regexp_extract({site_plans._ORIGIN}, '//(.*)', 1) AS source,
    trim(regexp_replace(regexp_replace(regexp_extract(html, '<article><h1>([^<]*)</h1>', 1), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) AS novel_name,
    trim(regexp_replace(regexp_replace(regexp_extract(html, '<div class="ad">([^<]*)</div>', 1), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) AS description,
    regexp_replace(list_last(string_split(regexp_replace(url, '/+$', ''), '/')), '[-_]', ' ', 'g') AS slug
  FROM p JOIN s USING (url) WHERE {site_plans._ITEM}),
d AS (SELECT *, novel_name || ' ' || description || ' ' || slug AS content FROM f)"""

_COUNTERS = """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS started, event_type AS metric,
  count(*) AS events FROM events GROUP BY ALL"""

SQL = {
    "stream_dedupe": """SELECT DISTINCT event_type AS namespace, strftime(ts, '%Y-%m-%d') AS day,
  user_id::VARCHAR AS url_hash FROM events""",
    "stream_counters": _COUNTERS,
    "stream_counters_late": _COUNTERS,
    "stream_sessions": """WITH g AS (SELECT event_type AS site, ts,
    (coalesce(ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) >= INTERVAL 20 MINUTES, true))::INT AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY site ORDER BY ts) AS span FROM g)
SELECT site, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS ended,
  count(*) AS events FROM s GROUP BY site, span""",
    "stream_retry": frontier_plans.SQL["retry_split"],
    "stream_slots": frontier_plans.SQL["rate_slots"],
    "stream_index": _INDEXED
    + f""" SELECT url, novel_name, source, len({index_plans.sql_tokens('content')}) AS doc_length,
  sha256(content) AS content_hash, true AS hash_fits FROM d""",
    "stream_index_postings": _INDEXED
    + f""" SELECT url, term, count(*) AS frequency
FROM (SELECT url, unnest({index_plans.sql_tokens('content')}) AS term FROM d) GROUP BY ALL""",
    "stream_index_ngrams": _INDEXED
    + f""", terms AS (SELECT DISTINCT unnest({index_plans.sql_tokens('content')}) AS term FROM d)
SELECT DISTINCT unnest({sql_ngrams('term')}) AS ngram, term FROM terms""",
    "store_compact": _INDEXED
    + f""" SELECT url, novel_name, len({index_plans.sql_tokens('content')}) AS doc_length,
  len(list_distinct({index_plans.sql_tokens('content')})) AS terms, sha256(content) AS content_hash FROM d""",
    "store_copy": f"""WITH {index_plans._STORED}, {index_plans._POSTED}
SELECT doc_id, url, novel_name, description, source, doc_length, '2024-01-01' AS last_crawled_at, content_hash,
  (SELECT count(*) FROM posted) AS copied_postings FROM st""",
}
