"""Severity of toxic language by cumulative-link ordinal regression.

Grades 0..3: not toxic, and toxic in rising severity. A document has one linear score from sparse word
features; the chance of a grade above k is the logistic function of the score less the k-th threshold.
The weights are shared by all thresholds, which are kept in order. The expected severity is the sum of
these chances.

Labels say only whether a document is toxic. A toxic document's grade is told by how many of its words
are marked, a word being marked when it stands in toxic documents far more often than in others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from pagequarry.llm.arrow import steps, utf8
from pagequarry.llm.shingles import scrambled
from pagequarry.session import pinned

#: Labelled documents the model is fitted on, about.
SAMPLE = 20_000
#: Word features kept, and hash buckets they are found by.
FEATURES, BUCKETS = 4_096, 1 << 20
#: Marked words that begin grades 1, 2 and 3.
GRADES = (1, 3, 6)
#: A word is marked when it is so many times likelier in a toxic document.
MARKED = 20.0
STEPS, RATE, DECAY = 300, 0.1, 1e-4
#: A document is toxic when the chance of a grade above 0 reaches this.
TOXIC = 0.5

_RANDOM = np.random.default_rng(20_260_103)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: letters, digits and everything beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every word, words before each text)."""
    rows = len(offsets) - 1
    is_word = _WORD[data]
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begins[edges] = is_word[edges]
    start = np.flatnonzero(begins)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    place = np.arange(len(data)) - start[np.maximum(np.cumsum(begins) - 1, 0)]
    place[~is_word] = 0
    power = np.cumprod(np.full(int(place.max()) + 1, _BASE, np.uint64))
    part = _BYTE[_LOWER[data]] * power[place]
    part[~is_word] = 0
    bucket = scrambled(np.add.reduceat(part, start)) % np.uint64(BUCKETS)
    return bucket.astype(np.int64), np.searchsorted(start, offsets)


@dataclass(frozen=True)
class Model:
    """Feature buckets (sorted) with their weights, and the thresholds in rising order."""

    buckets: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray


def occurrences(bucket: np.ndarray, before: np.ndarray, buckets: np.ndarray):
    """(row, feature, occurrences) of the words that are features."""
    if not len(buckets) or not len(bucket):
        none = np.zeros(0, np.int64)
        return none, none, none
    known = np.zeros(BUCKETS, bool)
    known[buckets] = True
    hit = np.flatnonzero(known[bucket])
    row = np.searchsorted(before, hit, side="right") - 1
    key, n = np.unique(row * len(buckets) + np.searchsorted(buckets, bucket[hit]), return_counts=True)
    return key // len(buckets), key % len(buckets), n


def chances(score: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """P(grade > k) for each k."""
    return 1 / (1 + np.exp(np.clip(cuts - score[:, None], -40, 40)))


def fit_ordinal(row, feature, value, grade: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, cuts) of the proportional-odds model, by Adam on the mean negative log likelihood.

    Cuts are the first and positive steps from it, so they stay in order.
    """
    levels = len(GRADES)
    share = [(grade > k).mean() for k in range(levels)]
    first = np.clip([np.log((1 - s + 1e-3) / (s + 1e-3)) for s in share], -6, 6)
    theta = np.concatenate([np.zeros(features), [first[0]], np.log(np.maximum(np.diff(first), 0.1))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n = len(grade)
    for step in range(1, STEPS + 1):
        w, gaps = theta[:features], np.exp(theta[features + 1 :])
        cuts = theta[features] + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(row, weights=value * w[feature], minlength=n)
        over = np.concatenate([np.ones((n, 1)), chances(score, cuts), np.zeros((n, 1))], axis=1)
        high, low = over[np.arange(n), grade], over[np.arange(n), grade + 1]
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p  # derivatives of the two chances
        g_score = -(d_high - d_low) / n
        g_cut = np.zeros(levels)
        for k in range(levels):  # cut k is the upper border of grade k and the lower one of grade k + 1
            g_cut[k] = (d_high[grade == k + 1].sum() - d_low[grade == k].sum()) / n
        g = np.empty_like(theta)
        g[:features] = np.bincount(feature, weights=value * g_score[row], minlength=features) + DECAY * w
        g[features] = g_cut.sum()
        g[features + 1 :] = gaps * np.cumsum(g_cut[::-1])[::-1][1:]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(theta[features + 1 :])
    return theta[:features], theta[features] + np.concatenate([[0], np.cumsum(gaps)])


def train(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> Model | None:
    """A model from about ``SAMPLE`` labelled documents; None without both toxic and other ones.

    A document labelled twice counts as toxic if one label says so; labels without document and null
    labels say nothing.
    """
    own = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg((F.max(label) > 0).cast("int").alias("_toxic"))
    )
    # Only ids move here; a label without document would count as an empty text.
    own = pinned(own.join(docs.select(F.col(doc_id).cast("long").alias("_id")), "_id", "left_semi"))
    total = own.count()
    share = int((1 << 20) * min(1.0, SAMPLE / max(1, total)))
    chosen = pinned(own.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < share))
    # About SAMPLE rows by the choice above.
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).join(
        F.broadcast(chosen), "_id"
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("_toxic").to_numpy()
            data, offsets = utf8(batch.column("_text"))
            for first, last in steps(offsets):
                at = offsets[first : last + 1]
                bucket, before = words(data[at[0] : at[-1]], at - at[0])
                row = np.repeat(np.arange(last - first), np.diff(before))
                pair, n = np.unique(row * BUCKETS + bucket, return_counts=True)
                yield pa.RecordBatch.from_pydict(
                    {
                        "_id": batch.column("_id").to_numpy()[first:last][pair // BUCKETS],
                        "toxic": toxic[first:last][pair // BUCKETS].astype(np.int32),
                        "bucket": (pair % BUCKETS).astype(np.int32),
                        "n": n.astype(np.int32),
                    }
                )

    counts = pinned(rows.mapInArrow(count, "_id long, toxic int, bucket int, n int"))
    sides = chosen.agg(F.sum("_toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, other = sides["t"] or 0, sides["n"] - (sides["t"] or 0)
    if not toxic or not other:
        return None
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("o") + 0.5) / (other + 1))
    useful = (
        counts.groupBy("bucket")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
        .where("t + o >= 3")
        .withColumn("odds", odds)
        .orderBy(F.desc(F.abs(F.col("odds")) * F.sqrt(F.col("t") + F.col("o"))), "bucket")
        .limit(FEATURES)
        .toArrow()
    )
    if not useful.num_rows:
        return None
    useful = useful.sort_by("bucket")
    buckets = useful.column("bucket").to_numpy().astype(np.int64)
    marked = useful.column("odds").to_numpy() >= np.log(MARKED)
    keep = counts.join(
        F.broadcast(docs.sparkSession.createDataFrame([(int(b),) for b in buckets], "bucket int")), "bucket"
    ).toArrow()
    ids = chosen.toArrow().sort_by("_id")
    known = ids.column("_id").to_numpy()
    row = np.searchsorted(known, keep.column("_id").to_numpy())
    feature = np.searchsorted(buckets, keep.column("bucket").to_numpy())
    n = keep.column("n").to_numpy()
    hits = np.bincount(row, weights=n * marked[feature], minlength=len(known))
    grade = np.where(
        ids.column("_toxic").to_numpy() > 0, np.maximum(1, np.searchsorted(GRADES, hits, side="right")), 0
    )
    weights, cuts = fit_ordinal(row, feature, np.log1p(n), grade, len(buckets))
    return Model(buckets, weights, cuts)


KIND = "struct<severity:double,grade:int,toxic:boolean>"


def graded(text: Column, model: Model | None) -> Column:
    """struct(severity, grade, toxic) of a text: the expected grade (0 to 3), the likeliest grade (the
    lower of equals), and whether the text is toxic. Without a model, and without words that are
    features, what the thresholds alone say; a null text counts as empty."""
    if model is None:
        return F.struct(
            F.lit(0.0).alias("severity"), F.lit(0).alias("grade"), F.lit(False).alias("toxic")
        )

    @arrow_udf(KIND)
    def grade(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            data, offsets = utf8(texts)
            score = np.zeros(len(texts))
            for first, last in steps(offsets):
                at = offsets[first : last + 1]
                bucket, before = words(data[at[0] : at[-1]], at - at[0])
                row, feature, n = occurrences(bucket, before, model.buckets)
                score[first:last] = np.bincount(
                    row, weights=np.log1p(n) * model.weights[feature], minlength=last - first
                )
            over = chances(score, model.cuts)
            each = -np.diff(np.concatenate([np.ones((len(over), 1)), over, np.zeros((len(over), 1))], axis=1))
            yield pa.StructArray.from_arrays(
                [
                    pa.array(over.sum(axis=1)),
                    pa.array(each.argmax(axis=1).astype(np.int32)),
                    pa.array(over[:, 0] >= TOXIC),
                ],
                ["severity", "grade", "toxic"],
            )

    return grade(text)


def severity(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic"
) -> DataFrame:
    """``doc_id``, ``severity``, ``grade``, ``toxic`` of every row of ``docs``; repeated rows each."""
    model = train(docs, labels, doc_id, text, label)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return d.select("doc_id", graded(F.col("text"), model).alias("g")).select(
        "doc_id", "g.severity", "g.grade", "g.toxic"
    )
