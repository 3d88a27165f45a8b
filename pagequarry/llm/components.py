"""Connected components of a link table, by alternating star operations.

A large star links the larger neighbours of a node to the smallest node it sees; a small star does so
with the smaller ones. Both keep components as they are, and after few rounds (logarithmic in the
longest path) every node is linked to the smallest node of its component. Minima are combined before
the shuffle, so the centre of a large star is not one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.session import pinned

#: Links a task joins at once before anything is shuffled.
LOCAL_LINKS = 200_000


def stars(links: DataFrame) -> DataFrame:
    """Links (a, b) replaced, within each task, by links of every node to the smallest one it is
    joined to there; never more rows than nodes."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.get(top, top)) != top:
                top = up
            while (up := parent.get(x, x)) != top:
                parent[x] = top
                x = up
            return top

        def done() -> pa.RecordBatch:
            pairs = [(x, root(x)) for x in parent]
            pairs = [p for p in pairs if p[0] != p[1]]
            return pa.RecordBatch.from_pydict(
                {
                    "a": pa.array([p[0] for p in pairs], pa.int64()),
                    "b": pa.array([p[1] for p in pairs], pa.int64()),
                }
            )

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    low, high = (a, b) if a < b else (b, a)
                    parent[high] = low
                    parent.setdefault(low, low)
            if len(parent) > LOCAL_LINKS:
                yield done()
                parent = {}
        yield done()

    return links.select("a", "b").mapInArrow(join, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); the component is its smallest node.

    Links to itself say nothing; repeated links count once; without links the result is empty.
    """
    links = pinned(stars(links.where("a <> b")))
    before = None
    while True:
        both = links.union(links.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = pinned(moved.union(low.toDF("a", "b")).distinct())
        now = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if now == before:
            break
        before = now
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.toDF("node", "component").union(roots.select("node", F.col("node").alias("component")))
