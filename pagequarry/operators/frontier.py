"""The crawl frontier as a table: adding, ordering, batches and polite time slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.operators.joins import lookup_join
from pagequarry.operators.ordered import CHUNK_ROWS, chunk_of, global_rank, ranked

PRIORITY_STEP = 1_000_000_000
SLOT_MEMORY_SECONDS = 3600


def score(priority: Column, seq: Column) -> Column:
    return priority.cast("long") * PRIORITY_STEP + seq


def add_tasks(frontier: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """One row per identical task, with its latest ``seq``.

    Grouping on the task's own fields combines copies before the shuffle, so a task submitted
    millions of times sends one row per map task.
    """
    rows = frontier if added is None else frontier.unionByName(added)
    fields = [c for c in rows.columns if c not in ("seq", "headers")]
    keyed = rows.withColumn("_headers", F.array_sort(F.map_entries("headers")))
    latest = keyed.groupBy(*fields, "_headers").agg(F.max("seq").alias("seq"))
    return latest.withColumn("headers", F.map_from_entries("_headers")).select(*rows.columns)


def active_sites(frontier: DataFrame) -> DataFrame:
    return frontier.select("site").distinct()


def site_positions(frontier: DataFrame, rotation: int = 0) -> DataFrame:
    """Sites by name, with their place in a rotation that has moved ``rotation`` steps."""
    numbered = global_rank(active_sites(frontier), ["site"], "site_rank", start=0)
    total = numbered.agg(F.count(F.lit(1)).alias("_sites"))
    # A one-row table.
    return numbered.crossJoin(F.broadcast(total)).select(
        "site",
        "site_rank",
        F.pmod(F.col("site_rank") - F.lit(rotation), F.col("_sites")).alias("turn"),
    )


def site_order(frontier: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``rn``: each task's place in its site's queue, by priority and then arrival number. The score
    is reported only: it cannot tell tasks apart once arrival numbers pass ``PRIORITY_STEP``."""
    scored = frontier.withColumn("score", score(F.col("priority"), F.col("seq")))
    return ranked(scored, ["site"], "seq", "rn", chunk_rows, major="priority")


def round_robin(
    frontier: DataFrame, rotation: int = 0, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Every task with ``rn`` and ``turn``; (rn, turn) is the fair order over sites."""
    ordered = site_order(frontier, chunk_rows)
    return lookup_join(ordered, site_positions(frontier, rotation), "site", ["seq"], "inner")


def next_batch(frontier: DataFrame, size: int, rotation: int = 0, per_site: int | None = None) -> DataFrame:
    """The next ``size`` tasks in round-robin order, at most ``per_site`` of a site.

    No site can have more than ``size`` of them, so map tasks send at most that many rows per site.
    """
    depth = min(size, per_site or size)
    scored = frontier.withColumn("score", score(F.col("priority"), F.col("seq")))
    queue = Window.partitionBy("site").orderBy("priority", "seq")
    heads = scored.withColumn("rn", F.row_number().over(queue)).where(F.col("rn") <= depth)
    return (
        heads.join(site_positions(frontier, rotation), "site")
        .orderBy("rn", "turn")
        .limit(size)
    )


def queue_sizes(frontier: DataFrame) -> DataFrame:
    return frontier.groupBy("site").agg(F.count(F.lit(1)).alias("tasks"))


def queue_total(frontier: DataFrame) -> DataFrame:
    """Tasks over all sites, and whether there is none."""
    return frontier.agg(F.count(F.lit(1)).alias("tasks")).withColumn("empty", F.col("tasks") == 0)


def micros(ts: Column) -> Column:
    """TIMESTAMP_NTZ to microseconds since 1970, whatever the session time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def rate_slots(
    requests: DataFrame,
    state: DataFrame | None = None,
    memory_seconds: int = SLOT_MEMORY_SECONDS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Polite start time of each request, in its site's arrival order.

    In: ``site, seq, now_us, rate_us`` (microseconds; integers make the sums exact in any grouping)
    and optionally ``state`` (``site, next_us, last_us``) from an earlier batch. A request starts at
    the later of its own time and its site's next free time, which then moves on by the rate. A site
    silent for ``memory_seconds`` is forgotten. Added: ``start_us``.

    Between two forgettings, with c the summed rates of the earlier requests, the start is
    c + max(now - c) so far. That is taken inside chunks of arrival numbers; a table with one row per
    chunk chains the chunks. One site with a third of all requests is still many tasks.
    """
    memory = memory_seconds * 1_000_000
    arrivals = Window.partitionBy("site", "_chunk").orderBy("seq")
    gap = F.col("now_us") - F.lag("now_us").over(arrivals) >= memory
    rows = requests.withColumn("_chunk", chunk_of(F.col("seq"), chunk_rows))
    rows = rows.withColumn("_forgot", F.coalesce(gap, F.lit(False)).cast("long"))
    rows = rows.withColumn("_stretch", F.sum("_forgot").over(arrivals))
    stretch = Window.partitionBy("site", "_chunk", "_stretch").orderBy("seq")
    earlier = stretch.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_c", F.coalesce(F.sum("rate_us").over(earlier), F.lit(0)))
    rows = rows.withColumn("_lead", F.max(F.col("now_us") - F.col("_c")).over(stretch))

    starts = _chunk_starts(rows, state, memory)
    return rows.join(starts, ["site", "_chunk"]).select(
        *requests.columns,
        (
            F.col("_c") + F.greatest("_lead", F.when(F.col("_stretch") == 0, F.col("_next")))
        ).alias("start_us"),
    )


def _chunk_starts(rows: DataFrame, state: DataFrame | None, memory: int) -> DataFrame:
    """``_next``: the site's next free time where each chunk begins, null where it is forgotten.

    A chunk whose end does not depend on its beginning (something was forgotten in it or right
    before it) is an anchor; behind an anchor the chunks chain like requests do.
    """
    first = F.col("_stretch") == 0
    chunks = rows.groupBy("site", "_chunk").agg(
        F.min_by("now_us", "seq").alias("_opens"),
        F.max_by("now_us", "seq").alias("_closes"),
        F.max("_stretch").alias("_forgettings"),
        F.sum(F.when(first, F.col("rate_us"))).alias("_rates"),
        F.max(F.when(first, F.col("_lead"))).alias("_top"),
        F.max_by(F.col("_c") + F.col("_lead") + F.col("rate_us"), "seq").alias("_end"),
    )
    if state is None:
        chunks = chunks.withColumns(
            {"_next0": F.lit(None).cast("long"), "_last0": F.lit(None).cast("long")}
        )
    else:
        chunks = chunks.join(
            state.select("site", F.col("next_us").alias("_next0"), F.col("last_us").alias("_last0")),
            "site",
            "left",
        )
    order = Window.partitionBy("site").orderBy("_chunk")
    silent = F.col("_opens") - F.coalesce(F.lag("_closes").over(order), F.col("_last0")) >= memory
    chunks = chunks.withColumn("_fresh", F.coalesce(silent, F.lit(False)))
    chunks = chunks.withColumn("_anchor", F.col("_fresh") | (F.col("_forgettings") > 0))
    chunks = chunks.withColumn("_chain", F.sum(F.col("_anchor").cast("long")).over(order))
    chain = Window.partitionBy("site", "_chain").orderBy("_chunk")
    moved = F.when(F.col("_anchor"), F.lit(0)).otherwise(F.col("_rates"))
    through = F.sum(moved).over(chain)
    chunks = chunks.withColumn("_through", through).withColumn("_before", F.col("_through") - moved)
    lead = F.when(F.col("_anchor"), F.col("_end")).otherwise(F.col("_top") - F.col("_before"))
    chunks = chunks.withColumn("_best", F.max(lead).over(chain))
    free = F.col("_through") + F.greatest(
        "_best", F.when(F.col("_chain") == 0, F.col("_next0"))
    )
    chunks = chunks.withColumn("_free", free)
    return chunks.select(
        "site",
        "_chunk",
        F.when(~F.col("_fresh"), F.coalesce(F.lag("_free").over(order), F.col("_next0"))).alias("_next"),
    )


def slot_state(slots: DataFrame) -> DataFrame:
    """Per site what the next batch needs: the next free time and when it was set."""
    last = F.max_by(F.struct("start_us", "rate_us", "now_us"), "seq")
    return slots.groupBy("site").agg(last.alias("_l")).select(
        "site",
        (F.col("_l.start_us") + F.col("_l.rate_us")).alias("next_us"),
        F.col("_l.now_us").alias("last_us"),
    )
