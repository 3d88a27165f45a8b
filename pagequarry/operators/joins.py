"""Lookup joins against per-site or per-domain tables when a few sites hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.session import pinned

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024
#: Rows of one key that a single task takes, unless the facts are so many that the share below is more.
TASK_ROWS = 1_000_000
#: A key with less than this share of all facts is not split; so at most this many keys are.
SHARE = 10_000


def is_small(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Measured, not estimated: at most ``max_rows`` rows of together ``max_bytes`` as JSON text.

    Rows and bytes are summed in each task; only the sums are shuffled.
    """
    size = (
        df.select(F.octet_length(F.to_json(F.struct(*df.columns))).alias("bytes"))
        .agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
        .first()
    )
    return size["rows"] <= max_rows and size["bytes"] <= max_bytes


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    spread: list[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """``facts`` joined with a table of sites, domains or the like.

    A lookup measured as small is broadcast and the facts never move; a larger one takes
    :func:`salted_join`.
    """
    if is_small(lookup, max_rows):
        return facts.join(F.broadcast(lookup), key, how)
    return salted_join(facts, lookup, key, spread, how, task_rows)


def salted_join(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    spread: list[str],
    how: str = "inner",
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """A shuffle join in which every key with more facts than a task takes is split by a hash of the
    ``spread`` columns, over as many tasks as its count asks for; only the lookup rows of such keys are
    copied once per salt. Facts without a key find nothing: a left join keeps them, dealt by ``spread``.
    The facts are read once more, keys only, to count them."""
    counts = pinned(facts.where(F.col(key).isNotNull()).groupBy(key).count())
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first()["n"]
    most = max(task_rows, -(-total // SHARE))
    # At most SHARE rows: each key here has more than 1 / SHARE of all facts.
    hot = counts.where(F.col("count") > most).select(
        key, F.ceil(F.col("count") / most).cast("long").alias("_salts")
    )
    dealt = F.xxhash64(*spread)
    salted = facts.join(F.broadcast(hot), key, "left").withColumn(
        "_salt",
        F.when(F.col(key).isNull(), dealt).otherwise(F.coalesce(F.pmod(dealt, F.col("_salts")), F.lit(0).cast("long"))),
    )
    copies = lookup.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)) - 1))
    )
    return salted.drop("_salts").join(copies.drop("_salts"), [key, "_salt"], how).drop("_salt")
