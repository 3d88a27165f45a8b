"""Mixing sources to target weights by hash-threshold histograms.

Every source gets a target number of words; a document is taken a whole number of times. All
documents of a source are taken ``copies`` times (target divided by size, rounded down), and the
documents whose hash lies under a threshold once more, so that the words taken come to the target.
The threshold is found without sorting: words are summed by source and hash bucket, the bucket in
which the budget runs out is found, and only that bucket is cut into finer buckets, level by level.
A larger budget gives a larger threshold, so mixes for growing budgets are nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.arrow import free_name
from pagequarry.operators.joins import lookup_join
from pagequarry.operators.ordered import global_rank
from pagequarry.session import pinned

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: A target stops at so many times its source's size.
MOST_COPIES = 3
#: Hash bits used, and bits of one level of refinement.
HASH_BITS, LEVEL_BITS = 48, 16


def words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A text that is never null, so that sources can be joined on; null differs from every name."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def row_hash(key: Column) -> Column:
    """First ``HASH_BITS`` bits of the MD5 of the key as text (null: of the empty text)."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``target`` for (source, source_size): all words shared by weight, none above ``MOST_COPIES``
    times its source's size, the excess shared again among the rest by weight until none is above.

    Weights go to the sources in code point order, null last. Each round is one aggregation; the
    driver sees its sums only. Sums are exact integers, so reruns give the same doubles.
    """
    ranked = global_rank(
        sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "_rank", start=0
    )
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]),
        (F.col("_rank") % len(weights) + 1).cast("int"),
    )
    rows = pinned(ranked.select("source", "source_size", weight.cast("long").alias("_weight")))
    top = F.col("source_size") * MOST_COPIES

    def exact(c: Column) -> Column:
        return c.cast("decimal(38,0)")

    share, base = None, None
    while True:
        # A source is full when its share of what is left reaches its top; full sources stay full.
        full = F.lit(False) if share is None else exact(top) * base <= exact(F.col("_weight")) * share
        seen = rows.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"),
            F.coalesce(F.sum(F.when(full, top)), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0)).alias("weight"),
            F.count(F.when(full, F.lit(1))).alias("n"),
        ).first()
        left, weight_left = seen["all"] - seen["full"], seen["weight"]
        if weight_left == 0 or (share is not None and (left, weight_left) == (share_left, base_left)):
            break
        share_left, base_left = left, weight_left
        share, base = F.lit(left).cast("decimal(38,0)"), F.lit(weight_left).cast("decimal(38,0)")
    if share is None:
        return rows.select("source", "source_size", F.lit(0.0).alias("target"))
    full = exact(top) * base <= exact(F.col("_weight")) * share
    given = (F.col("_weight") * F.lit(share_left)).cast("double") / F.lit(float(base_left))
    return rows.select(
        "source",
        "source_size",
        F.when(full, top.cast("double")).otherwise(given).alias("target"),
    )


def thresholds(hashed: DataFrame, budgets: DataFrame) -> DataFrame:
    """(key, threshold): documents with a hash below ``threshold`` have together the number of
    words nearest to ``budget`` (on a tie the smaller).

    ``hashed`` has key, size and hash, ``budgets`` key and budget. Level by level words are summed
    by bucket before the shuffle, and documents outside the bucket that holds the boundary drop out,
    so a source sends at most 2^LEVEL_BITS rows a task.
    """
    state = pinned(
        budgets.select(
            "key", "budget", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("under")
        )
    )
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        inside = F.shiftright("hash", shift + LEVEL_BITS) == F.shiftright("low", shift + LEVEL_BITS)
        sums = (
            lookup_join(hashed, state.select("key", "low"), "key", ["hash"], "inner")
            .where(inside)
            .groupBy("key", F.shiftright("hash", shift).alias("bucket"))
            .agg(F.sum("size").alias("words"))
        )
        earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(
            Window.unboundedPreceding, -1
        )
        # Both sides have one row per source, or 2^LEVEL_BITS at most.
        boundary = (
            sums.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
            .join(state.select("key", "budget", "under"), "key")
            .withColumn("before", F.col("before") + F.col("under"))
            .where("before <= budget")
            .groupBy("key")
            .agg(F.max_by(F.struct("bucket", "before", "words", "budget"), "bucket").alias("b"))
        )
        state = pinned(
            boundary.select(
                "key",
                "b.budget",
                F.shiftleft("b.bucket", shift).alias("low"),
                F.col("b.before").alias("under"),
                F.col("b.words").alias("words"),
            )
        )
    over = F.col("under") + F.col("words") - F.col("budget")
    take = over < F.col("budget") - F.col("under")
    return state.select("key", (F.col("low") + F.when(take, 1).otherwise(0)).alias("threshold"))


def plan(hashed: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: key, source_size, target, base_copies, threshold. ``hashed`` has source,
    key, size and hash of every document."""
    sizes = hashed.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = pinned(
        source_targets(sizes, weights)
        .withColumn(
            "base_copies",
            F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
            .otherwise(0)
            .cast("long"),
        )
        .select(
            source_key(F.col("source")).alias("key"),
            "source_size",
            "target",
            "base_copies",
            (F.col("target") - F.col("base_copies") * F.col("source_size")).alias("budget"),
        )
    )
    cut = thresholds(hashed.select("key", "size", "hash"), targets.select("key", "budget"))
    return pinned(
        targets.join(cut, "key", "left").select(
            "key",
            "source_size",
            "target",
            "base_copies",
            F.coalesce("threshold", F.lit(0)).cast("long").alias("threshold"),
        )
    )


def hashed_sizes(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        source_key(F.col(source)).alias("key"),
        words(F.col(text)).alias("size"),
        row_hash(F.col(doc_id)).alias("hash"),
    )


def copies(hashed: Column) -> Column:
    """How often a document is taken: the copies all documents of its source get, and one more under
    the threshold."""
    more = F.when(hashed < F.col("threshold"), 1).otherwise(0)
    return F.least(F.col("base_copies") + more, F.lit(MOST_COPIES)).cast("long")


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``copies``, ``taken`` of every row.

    ``taken`` = copies * size. Null is a source of its own, the last. Rows with the same id share a
    hash and are taken alike; a row without id counts as one with an empty id. A source without
    words has target 0 and is not taken. Reruns agree, whatever the partitioning.
    """
    d = pinned(hashed_sizes(docs, doc_id, text, source))
    return (
        lookup_join(d, plan(d, weights), "key", ["hash"], "inner")
        .select("doc_id", "size", "source_size", "target", copies(F.col("hash")).alias("copies"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of ``docs`` (a table of documents) that the mix takes, with all their columns and
    how often each is taken (``copies``; an input column of that name gives way)."""
    d = pinned(hashed_sizes(docs, "doc_id", "text", "source"))
    p = plan(d, weights).select("key", "base_copies", "threshold")
    rows = docs.drop("copies")
    names = {c: free_name(rows, c) for c in ("key", "base_copies", "threshold")}
    p = p.toDF(*names.values())
    hashed = row_hash(F.col("doc_id"))
    more = F.when(hashed < F.col(names["threshold"]), 1).otherwise(0)
    taken = F.least(F.col(names["base_copies"]) + more, F.lit(MOST_COPIES)).cast("long")
    keyed = rows.withColumn(names["key"], source_key(F.col("source")))
    joined = lookup_join(keyed, p, names["key"], ["doc_id"], "inner")
    return joined.select(*rows.columns, taken.alias("copies")).where("copies > 0")
