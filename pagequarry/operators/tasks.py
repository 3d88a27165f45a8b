"""Frontier tasks: creating, encoding, decoding submissions, retrying, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.urls import base_parts, resolve
from pagequarry.operators.registry import resolve_site
from pagequarry.schemas import TASK

FIELDS = TASK.fieldNames()
SEED_PRIORITY, DISCOVERED_PRIORITY = 1, 0
DEFAULT_RATE, DEFAULT_PRIORITY, MAX_RETRIES = 1.0, 1, 3
SEED_PAGES = 100
DEFAULT_USER_AGENT = "pagequarry/1.0"


def with_task_fields(
    df: DataFrame, config: Column, priority: int, user_agent: str = DEFAULT_USER_AGENT
) -> DataFrame:
    """Task columns of a new task for the row's ``url``, taken from its site configuration."""
    return df.withColumns(
        {
            "site": config["base_url"],
            "rate_limit": F.coalesce(config["rate_limit"], F.lit(DEFAULT_RATE)),
            "priority": F.lit(priority),
            "retry_count": F.lit(0),
            "max_retries": F.lit(MAX_RETRIES),
            "headers": F.create_map(
                F.lit("User-Agent"), F.coalesce(config["user_agent"], F.lit(user_agent))
            ),
        }
    )


def seeds(registry: DataFrame, pages: int = SEED_PAGES) -> DataFrame:
    """Listing pages 1..``pages`` of sites with a pagination template, else the site's seed URL.
    The row order of a site is ``page``."""
    site = registry.select(F.struct("*").alias("config")).withColumn(
        "_base", base_parts(F.col("config.base_url"))
    )
    template = F.col("config.pagination_template")
    paged = F.coalesce(template, F.lit("")) != ""
    numbered = site.withColumn(
        "page", F.explode(F.when(paged, F.sequence(F.lit(1), F.lit(pages))).otherwise(F.array(F.lit(1))))
    )
    link = F.when(
        paged, F.replace(template, F.lit("{page}"), F.col("page").cast("string"))
    ).otherwise(F.col("config.seed_url"))
    tasks = numbered.select("config", "page", resolve(F.col("_base"), link).alias("url"))
    return with_task_fields(tasks, F.col("config"), SEED_PRIORITY).select(*FIELDS, "page")


def encoded(df: DataFrame, out: str = "payload") -> DataFrame:
    """Adds the JSON form of each task."""
    return df.withColumn(out, F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"}))


def decoded(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Tasks from their JSON form; other columns are kept."""
    rest = [c for c in df.columns if c != payload and c not in FIELDS]
    return df.select(*rest, F.from_json(payload, TASK).alias("_task")).select(*rest, "_task.*")


def decode_submissions(raw: DataFrame, registry: DataFrame) -> DataFrame:
    """Submissions (``seq``, ``raw``) as tasks with an outcome.

    A JSON object with a ``url`` is a task, any other text is a bare URL. ``outcome`` is ``task``,
    ``dropped`` (no site) or ``quarantined`` with a ``reason``; the original would lose its worker on
    the latter rows. Missing fields take the task defaults, not the site's.
    """
    keys = F.json_object_keys("raw")
    parsed = raw.withColumns(
        {
            "_keys": keys,
            "_task": F.from_json("raw", TASK),
        }
    )
    is_task = F.coalesce(F.array_contains("_keys", "url"), F.lit(False))
    # Only a JSON string is a usable URL; from_json would turn a number into text.
    url_type = F.schema_of_variant(F.try_variant_get(F.try_parse_json("raw"), "$.url", "variant"))
    text_url = ~is_task | F.coalesce(url_type == "STRING", F.lit(False))
    split = parsed.withColumns(
        {
            "_is_task": is_task,
            "_text_url": text_url,
            "url": F.when(is_task, F.col("_task.url")).otherwise(F.col("raw")),
        }
    )
    sited = resolve_site(split, registry)
    unknown = F.size(F.array_except("_keys", F.array(*[F.lit(f) for f in FIELDS]))) > 0
    reason = (
        F.when(~F.col("_text_url"), "url is not text")
        .when(F.col("config").isNull(), F.lit(None))
        .when(F.col("_is_task") & unknown, "unknown field")
    )
    outcome = (
        F.when(reason.isNotNull(), "quarantined")
        .when(F.col("config").isNull(), "dropped")
        .otherwise("task")
    )
    headers = F.coalesce(F.col("_task.headers"), F.create_map().cast("map<string,string>"))
    agent = F.coalesce(headers["User-Agent"], F.lit(""))
    filled = F.when(agent != "", headers).otherwise(
        F.map_concat(
            F.map_filter(headers, lambda k, _: k != "User-Agent"),
            F.create_map(F.lit("User-Agent"), F.col("config.user_agent")),
        )
    )
    task = F.when(F.col("_is_task"), F.col("_task"))
    return sited.select(
        "seq",
        "raw",
        outcome.alias("outcome"),
        reason.alias("reason"),
        "url",
        F.col("config.base_url").alias("site"),
        F.coalesce(task["rate_limit"], F.lit(DEFAULT_RATE)).alias("rate_limit"),
        F.coalesce(task["priority"], F.lit(DEFAULT_PRIORITY)).alias("priority"),
        F.coalesce(task["retry_count"], F.lit(0)).alias("retry_count"),
        F.coalesce(task["max_retries"], F.lit(MAX_RETRIES)).alias("max_retries"),
        F.when(F.col("config").isNotNull(), filled).alias("headers"),
    )


def fetched_ok(status: Column) -> Column:
    return F.coalesce(status == 200, F.lit(False))


def after_failure(failed: DataFrame) -> DataFrame:
    """Counts the failed try; ``route`` is ``retry`` while tries are left, else ``dead``."""
    tried = failed.withColumn("retry_count", F.col("retry_count") + 1)
    return tried.withColumn(
        "route", F.when(F.col("retry_count") <= F.col("max_retries"), "retry").otherwise("dead")
    )


def retries(failed: DataFrame) -> DataFrame:
    return after_failure(failed).where("route = 'retry'").drop("route")


def dead_letters(failed: DataFrame) -> DataFrame:
    """The JSON form of tasks that have no try left."""
    return encoded(after_failure(failed).where("route = 'dead'").drop("route"))
