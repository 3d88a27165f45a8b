"""A crawl in rounds: tasks from the frontier, pages to the index, links to the frontier.

A round is a few jobs over tables. Its results go to several tables (frontier, visited set, dead letters,
counters, index) that are committed together by one manifest row, so a round that dies half-way has not
happened and is run again. What it fetched is kept as a step of its own: a round run again asks no server
a second time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.functions.urls import url_hash
from pagequarry.operators import admission, frontier, index_build, stats, tasks, visited
from pagequarry.operators.ordered import global_rank
from pagequarry.schemas import TASK
from pagequarry.sources.batches import BatchLog
from pagequarry.sources.store import IndexStore

FRONTIER = T.StructType([*TASK.fields, T.StructField("seq", T.LongType())])
FETCHED = T.StructType([*FRONTIER.fields]).add("status", "integer").add("html", "string")
VISITED = T.StructType().add("namespace", "string").add("day", "date").add("url_hash", "string")
DEAD = T.StructType([*FRONTIER.fields]).add("payload", "string")
COUNTERS = T.StructType().add("metric", "string").add("total", "long")


def seed_marks(seeds: DataFrame, day: Column) -> DataFrame:
    """Visited rows of tasks a crawl begins with, so that links to them are no discoveries."""
    marks = seeds.select(F.col("site").alias("namespace"), day.alias("day"), url_hash(F.col("url")).alias("url_hash"))
    return marks.distinct()


def fetch_from(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Fetching as a join with a table of pages (``url, status, html``, one row a URL); other URLs get no
    status and so have failed."""
    return lambda wanted: wanted.join(pages.select("url", "status", "html"), "url", "left")


class CrawlState:
    """The tables of a crawl below ``root``, as of the last committed round. One crawl at a time."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 256) -> None:
        self.log = BatchLog(spark, root, "next_seq LONG, day STRING")
        self.store = IndexStore(spark, f"{self.log.root}/index", buckets)

    def start(self, first: DataFrame, day: Column) -> None:
        """Round 0: the tasks to begin with (their fields and a unique ``seq`` from 1), marked visited."""
        held = self.log.write("frontier", 0, frontier.add_tasks(first.select(*FRONTIER.fieldNames())))
        self.log.write("visited", 0, seed_marks(held, day))
        self._commit(0, held.agg(F.coalesce(F.max("seq"), F.lit(0)) + 1).first()[0], day)

    def _commit(self, number: int, next_seq: int, day: Column) -> None:
        spark = self.log.spark
        self.log.commit(number, next_seq, spark.range(1).select(day.cast("string")).first()[0])

    def last(self) -> int:
        """Number of the last committed round."""
        return self.log.batches()[-1]

    def frontier(self) -> DataFrame:
        return self.log.part("frontier", self.last(), FRONTIER)

    def visited(self, day: Column | None = None) -> DataFrame:
        """Marks of the days still kept at ``day``; rounds of other days are not read."""
        batches = None
        if day is not None:
            limit = self.log.spark.range(1).select(F.date_sub(day, visited.KEEP_DAYS).cast("string")).first()[0]
            batches = [row["batch"] for row in self.log.commits() if row["day"] >= limit]
        rows = self.log.read("visited", VISITED, batches).select(*VISITED.fieldNames())
        return rows if day is None else visited.unexpired(rows, day)

    def dead_letters(self) -> DataFrame:
        return self.log.read("dead_letters", DEAD)

    def counters(self) -> DataFrame:
        """Totals over all rounds."""
        return self.log.read("counters", COUNTERS).groupBy("metric").agg(F.sum("total").alias("total"))

    def documents(self) -> DataFrame:
        return self.store.documents(before=self.last() + 1)


def fetched(
    state: CrawlState,
    number: int,
    fetch: Callable[[DataFrame], DataFrame],
    size: int | None,
    per_site: int | None,
) -> DataFrame:
    """The round's tasks with ``status`` and ``html``; fetched once, however often the round is run."""
    log = state.log
    if number not in log.batches("fetches"):
        held = state.frontier()
        batch = held if size is None else frontier.next_batch(held, size, number, per_site)
        log.write("fetched", number, fetch(batch.select(*FRONTIER.fieldNames())).select(*FETCHED.fieldNames()))
        log.commit(number, None, None, step="fetches")
    return log.part("fetched", number, FETCHED)


def run_round(
    state: CrawlState,
    registry: DataFrame,
    robots_rules: DataFrame,
    fetch: Callable[[DataFrame], DataFrame],
    day: Column,
    now: Column,
    size: int | None = None,
    per_site: int | None = None,
    recrawl_days: int = admission.RECRAWL_DAYS,
) -> int:
    """One round over the next ``size`` tasks in fair order (all tasks if not given); gives its number.

    Pages fetched with success are indexed where their site's patterns allow it, and their links, after
    the site's, robots', visited and recrawl tests, become tasks. Failed tasks return to the frontier
    while they have tries left and are dead letters otherwise. Tasks added are numbered in the order of
    the tasks they come from.
    """
    log, number = state.log, state.last() + 1
    done = fetched(state, number, fetch, size, per_site)
    ok = tasks.fetched_ok(F.col("status"))
    crawled = done.where(ok).select(F.col("seq").alias("task_seq"), F.col("seq").alias("fetch_seq"), "url", "html", "site")
    state.store.apply(number, index_build.parsed_pages(index_build.item_pages(crawled, registry)), now)

    links = admission.followed_links(crawled.drop("fetch_seq"), registry)
    documents = state.store.documents(before=number + 1)
    found, marks = admission.admitted(links, robots_rules, state.visited(day), documents, day, now, recrawl_days)
    log.write("visited", number, marks.select(*VISITED.fieldNames()))

    failed = done.where(~ok).drop("status", "html")
    log.write("dead_letters", number, tasks.dead_letters(failed).select(*DEAD.fieldNames()))
    again = tasks.retries(failed).withColumnRenamed("seq", "task_seq").withColumn("pos", F.lit(-1))
    fresh = log.write("added", number, again.select(*tasks.FIELDS, "task_seq", "pos").unionByName(found))
    next_seq = log.commits()[-1]["next_seq"]
    numbered = global_rank(fresh, ["task_seq", "pos"], "seq", start=next_seq).select(*FRONTIER.fieldNames())
    left = state.frontier().join(done.select("seq"), "seq", "left_anti")
    log.write("frontier", number, frontier.add_tasks(left.select(*FRONTIER.fieldNames()), numbered))

    discovered = fresh.where("pos >= 0").select(F.lit("url_discovered").alias("metric"))
    log.write("counters", number, stats.counters(stats.fetch_metrics(done).unionByName(discovered)))
    state._commit(number, next_seq + fresh.count(), day)
    return number


def crawl(state: CrawlState, most_rounds: int, **inputs) -> int:
    """Rounds until the frontier is drained, or ``most_rounds`` of them; gives how many were run."""
    for done in range(most_rounds):
        if state.frontier().isEmpty():
            return done
        run_round(state, **inputs)
    return most_rounds
