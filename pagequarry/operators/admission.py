"""From crawled pages to newly discovered tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.html import raw_hrefs, unescaped_hrefs
from pagequarry.functions.urls import base_parts, path_of, resolve_all, url_hash
from pagequarry.operators.registry import (
    blocked,
    follows,
    inside_site,
    path_allowed,
    with_site_config,
)
from pagequarry.operators.robots import with_robots
from pagequarry.operators.tasks import DISCOVERED_PRIORITY, FIELDS, with_task_fields
from pagequarry.operators.visited import KEYS, newly_visited
from pagequarry.session import pinned

RECRAWL_DAYS = 3


def page_links(pages: DataFrame, keep: list[str], html: str = "html", url: str = "url") -> DataFrame:
    """One row per anchor: the ``keep`` columns, ``pos`` in the page and the absolute ``link``."""
    hrefs = pages.select(
        *keep, base_parts(F.col(url)).alias("_base"), unescaped_hrefs(raw_hrefs(F.col(html))).alias("_hrefs")
    )
    links = hrefs.select(*keep, resolve_all(F.col("_base"), F.col("_hrefs")).alias("_links"))
    # The outer form: the plain one would test the array's size by a second search of the HTML.
    each = links.select(*keep, F.posexplode_outer("_links").alias("pos", "link"))
    return each.where(F.col("pos").isNotNull())


def recrawl_due(last_crawled: Column, now: Column, days: int = RECRAWL_DAYS) -> Column:
    """Never crawled, or more than ``days`` ago (exactly that long is not due)."""
    return last_crawled.isNull() | (last_crawled < now - F.make_dt_interval(F.lit(days)))


def with_recrawl_due(
    urls_df: DataFrame, documents: DataFrame, now: Column, days: int = RECRAWL_DAYS, url: str = "url"
) -> DataFrame:
    """Adds ``due`` by exact URL. ``documents`` has one row per URL."""
    known = documents.select(F.col("url").alias(url), F.col("last_crawled_at").alias("_last"))
    return urls_df.join(known, url, "left").withColumn("due", recrawl_due(F.col("_last"), now, days)).drop("_last")


def followed_links(crawled: DataFrame, registry: DataFrame) -> DataFrame:
    """Links the site's mode follows, with ``config``. Pages of one-way sites that are item pages are
    dropped before their HTML is searched for links."""
    pages = with_site_config(crawled, registry, ["url"]).where(F.col("config").isNotNull())
    pages = pages.withColumn("_item", path_allowed(path_of(F.col("url")), F.col("config.allowindb")))
    open_pages = pages.where(~(F.coalesce("config.unidirection", F.lit(False)) & F.col("_item")))
    links = page_links(open_pages, ["task_seq", "site", "config", "_item"])
    links = links.withColumn("link_is_item", path_allowed(path_of(F.col("link")), F.col("config.allowindb")))
    needed = F.struct(
        *[F.col(f"config.{c}") for c in ("base_url", "blocklist", "rate_limit", "user_agent")]
    )
    return links.where(
        follows(F.col("_item"), F.col("link"), F.col("link_is_item"), F.col("config"))
    ).select(
        "task_seq", "pos", "site", needed.alias("config"), "link_is_item", F.col("link").alias("url")
    )


def _rule_reasons(links: DataFrame, robots_rules: DataFrame) -> DataFrame:
    """The cheap tests in their order: site prefix, block list, robots."""
    tested = with_robots(links, robots_rules)
    return tested.withColumn(
        "reject_reason",
        F.coalesce(
            F.when(~inside_site(F.col("url"), F.col("config.base_url")), "outside"),
            F.when(blocked(F.col("url"), F.col("config.blocklist")), "blocked"),
            F.when(~F.col("can_fetch"), "robots"),
        ),
    )


def _marked(links: DataFrame, visited: DataFrame | None, day: Column) -> DataFrame:
    # Only today's part of the visited set is read.
    today = visited if visited is None else visited.where(F.col("day") == day)
    return newly_visited(
        links.withColumns(
            {
                "namespace": F.col("config.base_url"),
                "day": day,
                "url_hash": url_hash(F.col("url")),
            }
        ),
        today,
        ["task_seq", "pos"],
    )


def admitted(
    links: DataFrame,
    robots_rules: DataFrame,
    visited: DataFrame | None,
    documents: DataFrame,
    day: Column,
    now: Column,
    days: int = RECRAWL_DAYS,
) -> tuple[DataFrame, DataFrame]:
    """(tasks, marks): discovered tasks, and the visited rows of this round.

    A link is marked visited before its recrawl test, so a page not yet due stays visited that day.
    The marks are pinned: both results come from them, and pages are searched for links only once.
    """
    passing = _rule_reasons(links, robots_rules).where("reject_reason IS NULL")
    marked = pinned(_marked(passing, visited, day))
    due = with_recrawl_due(marked, documents, now, days).where(~F.col("link_is_item") | F.col("due"))
    tasks = with_task_fields(due, F.col("config"), DISCOVERED_PRIORITY)
    return tasks.select(*FIELDS, "task_seq", "pos"), marked.select(*KEYS)


def admission_report(
    links: DataFrame,
    robots_rules: DataFrame,
    visited: DataFrame | None,
    documents: DataFrame,
    day: Column,
    now: Column,
    days: int = RECRAWL_DAYS,
) -> DataFrame:
    """Every link with its ``reject_reason`` (null if admitted).

    Winners are joined back on (task_seq, pos), unique per link, and not on the URL, of which one
    may hold a third of the links.
    """
    ruled = pinned(_rule_reasons(links, robots_rules))
    winners = _marked(ruled.where("reject_reason IS NULL"), visited, day)
    winners = with_recrawl_due(winners, documents, now, days).select(
        "task_seq", "pos", (~F.col("link_is_item") | F.col("due")).alias("_admit")
    )
    return ruled.join(winners, ["task_seq", "pos"], "left").withColumn(
        "reject_reason",
        F.coalesce(
            "reject_reason",
            F.when(F.col("_admit").isNull(), "visited"),
            F.when(~F.col("_admit"), "not_due"),
        ),
    ).select("task_seq", "pos", "site", "url", "reject_reason")
