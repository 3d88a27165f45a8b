"""The streaming jobs: deduplication, counters, sessions, retry routing, rate slots, indexing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from pagequarry.operators import frontier, index_build, tasks
from pagequarry.operators.ordered import first_rows
from pagequarry.operators.visited import KEYS
from pagequarry.session import pinned
from pagequarry.sources.batches import BatchLog
from pagequarry.sources.store import IndexStore
from pagequarry.streaming.runner import batch_folder, per_batch, write_batch

KEEP = "2 days"
IDLE = "30 seconds"
SALTS = 16
LATE_FACTS = "watermark LONG"
COUNTS = T.StructType().add("started", "timestamp").add("metric", "string").add("events", "long")


def deduplicated(stream: DataFrame, spread: list[str], keys: list[str] | None = None, keep: str = KEEP) -> DataFrame:
    """First row per key, state kept for ``keep`` of event time (``ts``).

    Copies first meet in one of several tasks per key, chosen by a hash of ``spread``, and only one
    per task goes on to the key's own task: a URL that floods the stream is spread as well.
    """
    keys = keys or KEYS
    salted = stream.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)))
    marked = salted.withWatermark("ts", keep)
    return marked.dropDuplicatesWithinWatermark([*keys, "_salt"]).dropDuplicatesWithinWatermark(keys).drop("_salt")


def windowed_counts(stream: DataFrame, late: str, width: str = "1 second") -> DataFrame:
    """Events per metric and window; counts combine before the shuffle. Events more than ``late`` behind
    the latest are not counted; ``runner.drain`` tells how many rows that were."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "metric")
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.col("window.start").alias("started"), "metric", "events")
    )


def activity_sessions(stream: DataFrame, late: str, gap: str = IDLE) -> DataFrame:
    """Stretches of work per site, ended by ``gap`` without any. With the session setting
    ``sessionWindow.merge.sessions.in.local.partition`` a busy site's events merge before the shuffle. Later ones than ``late`` are left out and told by
    ``runner.drain``."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap), "site")
        .agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last"))
        .select("site", F.col("session_window.start").alias("started"), F.col("last").alias("ended"), "events")
    )


def route_failures(failed: DataFrame, retry_root: str, dead_root: str) -> DataStreamWriter:
    """Failed tasks of a stream to retry and dead-letter folders."""

    def route(batch: DataFrame, number: int) -> None:
        write_batch(tasks.encoded(tasks.retries(batch)), retry_root, number)
        write_batch(tasks.dead_letters(batch), dead_root, number)

    return per_batch(failed, route)


def reserve_slots(
    requests: DataFrame,
    slots_root: str,
    state_root: str,
    memory_seconds: int = frontier.SLOT_MEMORY_SECONDS,
    late_seconds: int = 0,
) -> DataStreamWriter:
    """Rate slots of a stream of requests; the sites' next free times go from batch to batch in a
    table. A batch is computed like a whole table, so a busy site is not one task's work.

    A site silent for ``memory_seconds`` leaves the table, as its next request is free anyway; so the
    table grows with the sites of that time, not with all ever seen. Requests may come up to
    ``late_seconds`` behind the newest one.
    """

    def reserve(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(batch_folder(state_root, number - 1)) if number else None
        write_batch(frontier.rate_slots(batch, before, memory_seconds), slots_root, number)
        slots = spark.read.parquet(batch_folder(slots_root, number))
        after = frontier.slot_state(slots)
        if before is not None:
            after = after.unionByName(before.join(after.select("site"), "site", "left_anti"))
        newest = slots.agg(F.max("now_us")).first()[0]
        if newest is not None:
            after = after.where(F.col("last_us") > newest - (memory_seconds + late_seconds) * 1_000_000)
        write_batch(after, state_root, number)

    return per_batch(requests, reserve)


def counts_with_late(
    stream: DataFrame, log: BatchLog, late: str, width: str = "1 second"
) -> DataStreamWriter:
    """Events per metric and window (``started, metric, events``), none left out.

    A batch adds its own sums, made before the shuffle, to one of two tables of ``log`` (with the facts of
    :data:`LATE_FACTS`): ``counts`` for windows still open, ``late`` for windows that lay more than
    ``late`` behind the latest event when the batch began. :func:`counts_merged` adds up both.
    """
    behind = F.expr(f"INTERVAL {late}")

    def count(batch: DataFrame, number: int) -> None:
        earlier = [row["watermark"] for row in log.commits() if row["batch"] < number]
        bound = max((mark for mark in earlier if mark is not None), default=None)
        sums = batch.where(F.col("ts").isNotNull()).groupBy(F.window("ts", width), "metric").agg(
            F.count(F.lit(1)).alias("events"), F.unix_micros(F.max("ts") - behind).alias("mark")
        )
        closed = F.lit(False) if bound is None else F.unix_micros("window.end") <= bound
        rows = sums.select(
            F.col("window.start").alias("started"), "metric", "events", "mark", closed.alias("late")
        )
        held = log.write("sums", number, rows)
        log.write("counts", number, held.where("NOT late").select(*COUNTS.fieldNames()))
        log.write("late", number, held.where("late").select(*COUNTS.fieldNames()))
        marks = [m for m in (bound, held.agg(F.max("mark")).first()[0]) if m is not None]
        log.commit(number, max(marks, default=None))

    return per_batch(stream, count)


def counts_merged(log: BatchLog) -> DataFrame:
    """Windows of :func:`counts_with_late` with all their events, and how many of them were ``late``."""
    on_time = log.read("counts", COUNTS).withColumn("late", F.lit(0).cast("long"))
    late = log.read("late", COUNTS).withColumn("late", F.col("events"))
    both = on_time.unionByName(late)
    return both.groupBy("started", "metric").agg(F.sum("events").alias("events"), F.sum("late").alias("late"))


def fetch_from(pages: DataFrame, newest: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """Fetching as a join with a table of pages, whatever the size of the batch. Of several pages of a URL
    the one with the largest ``newest`` counts. Pages of other URLs drop out before any HTML moves."""

    def fetch(wanted: DataFrame) -> DataFrame:
        asked = pages.join(wanted.select("url").distinct(), "url", "left_semi")
        found = first_rows(asked, ["url"], [F.desc(newest)]) if newest else asked
        return found.select("url", "html").join(wanted, "url")

    return fetch


def index_submissions(
    submissions: DataFrame,
    registry: DataFrame,
    fetch: Callable[[DataFrame], DataFrame],
    store: IndexStore,
    now: Callable[[int], Column],
) -> DataStreamWriter:
    """Submitted URLs (``seq``, ``raw``) to the index: decode, fetch, parse, index. No links are taken.

    ``fetch`` gets a batch's ``url, site, fetch_seq`` and adds ``html``, for example
    :func:`fetch_from` a table of pages. The micro-batch number is the index batch.
    """

    def index(batch: DataFrame, number: int) -> None:
        decoded = tasks.decode_submissions(batch, registry).where("outcome = 'task'")
        # Read several times below; once written its size is known, so that few URLs are broadcast and no
        # HTML moves to find their pages.
        wanted = pinned(decoded.groupBy("url", "site").agg(F.max("seq").alias("fetch_seq")))
        items = index_build.parsed_pages(index_build.item_pages(fetch(wanted), registry))
        store.apply(number, items, now(number))

    return per_batch(submissions, index)
