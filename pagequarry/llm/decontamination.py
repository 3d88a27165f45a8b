"""Benchmark decontamination by the q-gram lemma.

An item of m characters that occurs in a text with at most k edits shares m + 1 - q (k + 1) of its
q-grams with the text, and all of these lie on diagonals (place in the text less place in the item)
that differ by at most k. Shared q-grams are counted in overlapping diagonal bands of 2 (k + 1)
diagonals, so one band holds them all; bands that reach the bound are verified by an alignment
confined to the band. Before, counts over stretches of the text leave out almost everything.

Items and texts are compared in lower case with white space runs as one blank.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from pagequarry.llm.arrow import free_name, steps, utf8
from pagequarry.session import pinned

Q = 8
#: Edits allowed, in hundredths of the item's length.
EDIT_PERCENT = 10
#: Characters of benchmark items searched for in one pass over the texts.
BLOCK_CHARS = 1_000_000
#: Characters of text one step works on.
STEP_CHARS = 1 << 20
_BASE = 0x9E3779B97F4A7C15
MATCH = "array<struct<item_id:bigint,start:bigint,stop:bigint,edits:int>>"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def edit_budget(length: int) -> int:
    """Edits allowed in an item; fewer in short items, so that the lemma still asks for a q-gram."""
    return max(0, min(length * EDIT_PERCENT // 100, (length - Q) // Q))


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(codes: np.ndarray) -> np.ndarray:
    """Hash of the Q characters from each place on."""
    h, width = codes.astype(np.uint64), 1
    while width < Q:
        power = np.uint64(pow(_BASE, width, 1 << 64))
        h = h[:-width] * power + h[width:] if len(h) > width else h[:0]
        width *= 2
    return h * np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Items:
    """A block of benchmark items prepared for search."""

    ids: list[int]
    texts: list[str]

    def __post_init__(self) -> None:
        self.codes = [points(t) for t in self.texts]
        self.length = np.array([len(c) for c in self.codes], np.int64)
        self.budget = np.array([edit_budget(int(n)) for n in self.length], np.int64)
        self.bound = np.maximum(1, self.length + 1 - Q * (self.budget + 1))
        found = [(grams(c), k) for k, c in enumerate(self.codes) if len(c) >= Q]
        hashes = np.concatenate([h for h, _ in found]) if found else np.zeros(0, np.uint64)
        item = np.concatenate([np.full(len(h), k) for h, k in found]) if found else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(h)) for h, _ in found]) if found else np.zeros(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.item, self.place = item[order].astype(np.int64), place[order].astype(np.int64)
        self.gram, self.first, self.times = np.unique(
            hashes[order], return_index=True, return_counts=True
        )
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.gram >> np.uint64(44)).astype(np.int64)] = True
        self.short = {t: k for k, t in enumerate(self.texts) if 0 < len(self.codes[k]) < Q}
        self.stretch = int((self.length + self.budget).max(initial=Q)) + Q


def aligned(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """(edits, start, stop) of the best alignment of the item with a piece of the text, on diagonals
    low..high only; among equals the one that ends first."""
    width = high - low + 1
    step = np.arange(width)
    padded = np.full(width + len(item) + 1, 0xFFFFFFFF, np.uint32)
    a, b = max(0, low), min(len(text), high + len(item))
    if b > a:
        padded[a - low : b - low] = text[a:b]
    row = np.zeros(width, np.int64)
    begin = step.copy()  # diagonal on which the alignment began
    for i, c in enumerate(item):
        best = row + (padded[i : i + width] != c)
        start = begin.copy()
        gap = np.append(row[1:] + 1, 1 << 30)
        less = gap < best
        best[less], start[less] = gap[less], np.append(begin[1:], 0)[less]
        # characters of the text that the item lacks: the best place to the left, one edit a step
        level = best - step
        least = np.minimum.accumulate(level)
        at = np.maximum.accumulate(np.where(level == least, step, 0))
        moved = least + step
        change = moved < best
        start[change] = start[at[change]]
        row, begin = np.where(change, moved, best), start
    end = int(row.argmin())
    return int(row[end]), max(0, low + int(begin[end])), min(len(text), low + end + len(item))


def shared_grams(text: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the text, item, place in the item) of every q-gram the text shares with an item, in
    stretches of the text where the item may reach its bound.

    A region is no longer than a stretch, so it lies in two neighbours; an item's hits in both
    together must reach its bound.
    """
    none = np.zeros(0, np.int64)
    if len(text) < Q or not len(items.gram):
        return none, none, none
    h = grams(text)
    place = np.flatnonzero(items.maybe[(h >> np.uint64(44)).astype(np.int64)])
    at = np.minimum(np.searchsorted(items.gram, h[place]), len(items.gram) - 1)
    hit = items.gram[at] == h[place]
    place, at = place[hit], at[hit]
    if not len(place):
        return none, none, none
    # A hit for each place of the gram in each item.
    times = items.times[at]
    offset = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    entry = np.repeat(items.first[at], times) + offset
    place = np.repeat(place, times)
    item = items.item[entry]
    count = len(items.ids)
    stretch = place // items.stretch
    n = int(stretch[-1]) + 2
    seen = np.bincount(stretch * count + item, minlength=n * count).reshape(n, count)
    enough = seen[:-1] + seen[1:] >= items.bound
    live = np.zeros((n, count), bool)
    live[:-1] |= enough
    live[1:] |= enough
    keep = live[stretch, item]
    return place[keep], item[keep], items.place[entry[keep]]


def search(text: np.ndarray, items: Items) -> list[tuple[int, int, int, int]]:
    """(item, start, stop, edits) of every region of a text that holds an item within its budget."""
    place, item, own = shared_grams(text, items)
    if not len(place):
        return []
    diagonal = place - own
    half = items.budget[item] + 1
    band = np.floor_divide(diagonal, half)
    # Both bands of a diagonal; an item's place counts once a band.
    rows = np.concatenate(
        [np.stack([item, band, own, place], 1), np.stack([item, band - 1, own, place], 1)]
    )
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))]
    edge = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
    shared = np.diff(np.append(edge, len(rows)))
    passed = np.flatnonzero(shared >= items.bound[rows[edge, 0]])
    out: list[tuple[int, int, int, int]] = []
    for k in passed[np.argsort(-shared[passed], kind="stable")]:
        which, number, own_place, at = rows[edge[k]].tolist()
        codes, budget = items.codes[which], int(items.budget[which])
        start = at - own_place
        if any(r[0] == which and r[3] == 0 and r[1] - budget <= start <= r[1] + budget for r in out):
            continue
        if start >= 0 and np.array_equal(text[start : start + len(codes)], codes):
            edits, stop = 0, start + len(codes)
        else:
            low = number * (budget + 1)
            edits, start, stop = aligned(codes, text, low - budget, low + 3 * budget + 2)
        if edits <= budget:
            same = [r for r in out if r[0] == which and r[1] < stop and start < r[2]]
            if all(edits < r[3] for r in same):
                out = [r for r in out if r not in same]
                out.append((which, start, stop, edits))
    return sorted(out)


def regions(texts: list[str], items: Items) -> list[list[tuple[int, int, int, int]]]:
    """As :func:`search`, over every whole text. Short texts are filtered together; long ones are
    searched in overlapping steps."""
    cleaned = [normal(t) if t else "" for t in texts]
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    codes = points("\n".join(cleaned))
    begin = np.cumsum([0] + [len(t) + 1 for t in cleaned])
    rows: set[int] = set()
    for first in range(0, len(codes), STEP_CHARS):
        piece = codes[first : first + STEP_CHARS + 2 * items.stretch]
        place = shared_grams(piece, items)[0]
        if len(place):
            rows.update(np.unique(np.searchsorted(begin, place + first, side="right") - 1).tolist())
    for row, text in enumerate(cleaned):
        if items.short and text in items.short:
            out[row] = [(items.short[text], 0, len(text), 0)]
        elif row in rows:
            own = codes[begin[row] : begin[row] + len(text)]
            found: dict[tuple[int, int, int, int], None] = {}
            for first in range(0, len(own), STEP_CHARS):
                piece = own[first : first + STEP_CHARS + 2 * items.stretch]
                for which, start, stop, edits in search(piece, items):
                    found[which, start + first, stop + first, edits] = None
            out[row] = sorted(found)
    return out


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Items]:
    """The benchmark in blocks of about ``BLOCK_CHARS`` characters, each small enough to send to every
    task, however large the benchmark is."""
    rows = pinned(
        benchmark.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(
            F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")
        )
    )
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    count = max(1, -(-size // BLOCK_CHARS))
    for k in range(count):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()
        part = sorted({(r["item_id"], normal(r["text"])) for r in part})
        part = [(i, t) for i, t in part if t]
        if part:
            yield Items([i for i, _ in part], [t for _, t in part])


_PREPARED: dict[tuple, Items] = {}


def leaks(text: Column, items: Items) -> Column:
    """The regions of a text that hold an item of the block: ``MATCH``, places in code points of the
    normalised text; empty for a null text."""
    ids, texts = list(items.ids), list(items.texts)

    @arrow_udf(MATCH)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        key = (tuple(ids), hash(tuple(texts)))
        if key not in _PREPARED:
            _PREPARED.clear()
            _PREPARED[key] = Items(ids, texts)
        ready = _PREPARED[key]
        kind = pa.list_(
            pa.struct(
                [("item_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("edits", pa.int32())]
            )
        )
        for batch in batches:
            out = []
            _, offsets = utf8(batch)
            for first, last in steps(offsets):
                for found in regions(batch.slice(first, last - first).to_pylist(), ready):
                    out.append(
                        [
                            {"item_id": ready.ids[w], "start": a, "stop": b, "edits": e}
                            for w, a, b, e in found
                        ]
                    )
            yield pa.array(out, kind)

    return find(text)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``item_id``, ``start``, ``stop``, ``edits``: one row per region of a document that
    holds a benchmark item.

    Items of fewer than ``Q`` characters are found only as a whole text; empty ones never. Clean
    documents, and null and empty texts, have no row; repeated documents have their rows each.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = None
    for items in blocks(benchmark):
        part = (
            d.select("doc_id", leaks(F.col("text"), items).alias("found"))
            .select("doc_id", F.explode("found").alias("r"))
            .select("doc_id", "r.*")
        )
        out = part if out is None else out.union(part)
    if out is None:
        out = d.select("doc_id").limit(0).selectExpr(
            "doc_id", "0L AS item_id", "0L AS start", "0L AS stop", "0 AS edits"
        )
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any region of the benchmark; all columns are kept."""
    columns = docs.columns
    for items in blocks(benchmark):
        name = free_name(docs, "leaks")
        docs = docs.withColumn(name, leaks(F.col("text"), items)).where(F.size(name) == 0)
        docs = docs.select(*columns)
    return docs
