"""Site configuration joined to tasks, URLs and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.operators.joins import lookup_join
from pagequarry.session import pinned


def with_site_config(tasks: DataFrame, registry: DataFrame, spread: list[str]) -> DataFrame:
    """Each task with its site's configuration in ``config`` (null when the site is unknown)."""
    configs = registry.select(F.col("base_url").alias("site"), F.struct("*").alias("config"))
    return lookup_join(tasks, configs, "site", spread)


def resolve_site(urls: DataFrame, registry: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``config``: the registry row with the lowest ``site_order`` whose base URL starts ``url``.

    Every distinct URL gives its beginnings of the lengths that base URLs have, and these are looked up
    by equality, whatever the number of sites of a host. No URL is paired with every site.
    """
    configs = pinned(
        registry.groupBy(F.col("base_url").alias("_base")).agg(
            F.min(F.struct("site_order", *[c for c in registry.columns if c != "site_order"])).alias("config")
        )
    )
    # One row with at most as many numbers as the longest base URL has characters.
    lengths = configs.agg(F.collect_set(F.length("_base")).alias("_lengths"))
    begun = urls.select(F.col(url).alias("_url")).distinct().crossJoin(F.broadcast(lengths)).select(
        "_url",
        F.explode(
            F.transform(
                F.filter("_lengths", lambda size: size <= F.length("_url")),
                lambda size: F.substring("_url", F.lit(1), size),
            )
        ).alias("_base"),
    )
    orders = configs.select("_base", F.col("config.site_order").alias("_order"))
    first = (
        lookup_join(begun, orders, "_base", ["_url"], "inner")
        .groupBy(F.col("_url").alias(url))
        .agg(F.min_by("_base", F.struct("_order", "_base")).alias("_base"))
    )
    spread = [f.name for f in urls.schema.fields if not isinstance(f.dataType, T.MapType)]
    found = lookup_join(urls, pinned(first), url, spread)
    return lookup_join(found, configs, "_base", [url]).select(*urls.columns, "config")


def path_allowed(path: Column, patterns: Column) -> Column:
    """True if any of the site's patterns matches the whole path.

    The patterns are tried as one: ``regexp_instr`` keeps the pattern it compiled last, so rows of one
    site in a row compile once. Patterns that number or name their groups are tried one by one.
    """
    whole = lambda p: F.regexp_instr(path, F.concat(F.lit(r"\A(?:"), p, F.lit(r")\z"))) > 0
    given = F.filter(patterns, lambda p: p.isNotNull())
    together = F.array_join(F.transform(given, lambda p: F.concat(F.lit("(?:"), p, F.lit(")"))), "|")
    alone = F.exists(given, lambda p: p.rlike(r"\\[1-9k]|\(\?<[A-Za-z]"))
    allowed = F.when(alone, F.exists(given, lambda p: F.coalesce(whole(p), F.lit(False)))).otherwise(
        (F.size(given) > 0) & whole(together)
    )
    return F.coalesce(allowed, F.lit(False))


def blocked(url: Column, blocklist: Column) -> Column:
    """True if any entry of the site's block list occurs anywhere in the URL."""
    return F.coalesce(F.exists(blocklist, lambda item: F.contains(url, item)), F.lit(False))


def inside_site(url: Column, base_url: Column) -> Column:
    return url.startswith(base_url)


def follows(
    page_is_item: Column, link: Column, link_is_item: Column, config: Column
) -> Column:
    """Whether a page's link is followed. A one-way site takes no links from item pages and
    elsewhere only listing links (its non-empty listing text occurs) or item links."""
    listing = config["unidirection_url_struct"]
    is_listing = F.coalesce((listing != "") & F.contains(link, listing), F.lit(False))
    return ~F.coalesce(config["unidirection"], F.lit(False)) | (
        ~page_is_item & (is_listing | link_is_item)
    )
