"""Robots rules as tables: parsing rule files and testing URLs against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions.urls import origin_of, percent_decoded
from pagequarry.operators.joins import lookup_join

_LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
_RULE_KEYS = ("allow", "disallow", "crawl-delay", "request-rate")


def _stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+\z", "")


def domain_status(http_status: Column) -> Column:
    """What a robots.txt answer means: 401/403 deny all, other 4xx allow all, 5xx or none
    unreachable (allowed), else the rules count."""
    return (
        F.when(http_status.isNull() | (http_status >= 500), "unreachable")
        .when(http_status.isin(401, 403), "deny_all")
        .when(http_status >= 400, "allow_all")
        .otherwise("rules")
    )


def rule_lines(robots: DataFrame) -> DataFrame:
    """One row per agent or rule line of a domain's groups: ``domain, group_no, pos, key, value``.

    A group starts at a user-agent line that does not follow another one. An empty line ends it, and
    rules outside a group do not count. Windows are per domain, so bounded by one robots.txt.
    """
    lines = robots.where(domain_status(F.col("http_status")) == "rules").select(
        "domain", F.posexplode(F.split(F.coalesce("robots_txt", F.lit("")), _LINE_BREAK)).alias("pos", "raw")
    )
    body = _stripped(F.substring_index("raw", "#", 1))
    key = F.lower(_stripped(F.substring_index(body, ":", 1)))
    lines = lines.select(
        "domain",
        "pos",
        F.when(F.col("raw") == "", "blank")
        .when(body.contains(":") & key.isin("user-agent", *_RULE_KEYS), key)
        .alias("key"),
        percent_decoded(_stripped(F.regexp_replace(body, r"^[^:]*:", ""))).alias("value"),
    ).where(F.col("key").isNotNull())
    order = Window.partitionBy("domain").orderBy("pos")
    agent = F.col("key") == "user-agent"
    opens = agent & (F.coalesce(F.lag("key").over(order), F.lit("blank")) != "user-agent")
    cut = lines.withColumn("_opens", (opens | (F.col("key") == "blank")).cast("int"))
    numbered = cut.withColumn("group_no", F.sum("_opens").over(order))
    whole = Window.partitionBy("domain", "group_no")
    return (
        numbered.withColumn("_agents", F.sum(agent.cast("int")).over(whole))
        .withColumn("_rules", F.sum(F.col("key").isin(*_RULE_KEYS).cast("int")).over(whole))
        .where("_agents > 0 AND _rules > 0 AND key <> 'blank'")
        .drop("_opens", "_agents", "_rules")
    )


def agent_rules(robots: DataFrame, agent: str) -> DataFrame:
    """One row per domain: ``status``, the chosen group's ``rules`` in file order, ``crawl_delay``.

    The chosen group is the first whose agent token occurs in our name (lower case, before ``/``),
    else the first for ``*``.
    """
    ours = agent.split("/")[0].lower()
    groups = (
        rule_lines(robots)
        .groupBy("domain", "group_no")
        .agg(
            F.collect_list(F.when(F.col("key") == "user-agent", F.lower("value"))).alias("_agents"),
            F.array_sort(
                F.collect_list(
                    F.when(
                        F.col("key").isin("allow", "disallow"),
                        F.struct(
                            "pos",
                            ((F.col("key") == "allow") | (F.col("value") == "")).alias("allow"),
                            F.col("value").alias("path"),
                        ),
                    )
                )
            ).alias("rules"),
            F.max_by(
                F.col("value").cast("double"),
                F.when((F.col("key") == "crawl-delay") & F.col("value").rlike(r"^\d+$"), F.col("pos")),
            ).alias("crawl_delay"),
        )
    )
    starred = F.array_contains("_agents", "*")
    named = F.exists("_agents", lambda token: F.contains(F.lit(ours), token))
    rank = F.when(~starred & named, F.struct(F.lit(0), "group_no")).when(
        starred, F.struct(F.lit(1), "group_no")
    )
    chosen = (
        groups.withColumn("_rank", rank)
        .where(F.col("_rank").isNotNull())
        .groupBy("domain")
        .agg(F.min_by(F.struct("rules", "crawl_delay"), "_rank").alias("_g"))
    )
    return (
        robots.select("domain", domain_status(F.col("http_status")).alias("status"))
        .join(chosen, "domain", "left")
        .select("domain", "status", "_g.rules", "_g.crawl_delay")
    )


def tested_path(url: Column) -> Column:
    """What rule paths are compared with: everything behind the host, percent-decoded."""
    rest = percent_decoded(F.regexp_extract(url, r"(?s)^[^:/?#]+://[^/?#]*(.*)$", 1))
    tidy = F.regexp_replace(F.regexp_replace(rest, r"#\z", ""), r"\?(?=#|\z)", "")
    return F.when(tidy == "", F.lit("/")).otherwise(tidy)


def with_robots(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``can_fetch`` and ``crawl_delay``. A domain's rules arrive as one array, so a URL is
    neither multiplied by rules nor shuffled again to pick the first that fits."""
    joined = lookup_join(urls.withColumn("domain", origin_of(F.col(url))), rules, "domain", [url])
    tested = joined.withColumn("_path", tested_path(F.col(url)))
    hit = F.get(
        F.filter("rules", lambda r: (r["path"] == "*") | F.col("_path").startswith(r["path"])), F.lit(0)
    )
    allowed = (
        F.when(F.col("status") == "deny_all", F.lit(False))
        .when(F.col("status") == "rules", F.coalesce(hit["allow"], F.lit(True)))
        .otherwise(F.lit(True))
    )
    return tested.withColumn("can_fetch", allowed).drop("_path", "rules", "status", "domain")
