"""Embedding whitening by shifted CholeskyQR.

Every entry c becomes the whole number floor(1024 c) + 100000. The centred rows A are orthogonalised
again and again: a pass over the table gives the Gram matrix of the rows of A R^-1 (a triangular solve
a batch), its Cholesky factor is composed into R, and the first passes add a shift so that the factor
exists however ill-conditioned the rows are. Forming A'A just once would square the condition number;
the passes end when the Gram matrix is the identity, and the singular values of R are then those of A
to double precision. Components are the right singular vectors of R.

A pass is a scan without shuffled rows: tasks return their part of a matrix of dimensions x dimensions,
parts are summed by Spark, and only the sum reaches the driver. Nothing grows with the number of rows.

Defined cases: vectors that are null, empty or hold null or non-finite entries are left out; so are
vectors of another length than most have (ties: the longer length). Entries beyond 2^42 in size count as
2^42. Directions without variance give no component, so fewer than 8 may be returned, and none for one
row or for equal rows. A deviation past 64 bits is null. Rows with a null or repeated id are rows like
others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components returned.
COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Largest size of an entry that is told apart.
LARGEST = float(1 << 42)
#: A Gram matrix this close to the identity ends the passes; so does the number of passes.
CLOSE, MOST_PASSES = 1e-13, 6
ROUNDING = float(np.finfo(np.float64).eps) / 2

SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, "
    "identity_error double"
)


def usable(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has an entry and only finite ones."""
    finite = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    return embeddings.where((F.size(vector) > 0) & finite)


def common_length(vectors: DataFrame, vector: str = "embedding") -> int:
    """The length most vectors have; 0 without vectors."""
    counts = vectors.groupBy(F.size(vector).alias("length")).agg(F.count(F.lit(1)).alias("rows"))
    top = counts.orderBy(F.desc("rows"), F.desc("length")).first()
    return top.length if top else 0


def whole(column: pa.Array, dimensions: int) -> np.ndarray:
    """The vectors of a batch as whole numbers, one row each."""
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
    return np.floor(SCALE * np.clip(c, -LARGEST, LARGEST)).astype(np.int64) + SHIFT


class Centre:
    """Rows less their mean S / n, with the whole part of the mean taken off in whole numbers."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = [s % n for s in sums]

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - np.array([r / self.n for r in self.rest])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - S)^2, exactly; None past 64 bits."""
        away = x - self.base
        bound = (int(np.abs(away).max(initial=0)) + 1) * self.n
        if bound * bound * len(self.sums) < 1 << 63:
            scaled = away * self.n - np.array(self.rest, np.int64)
            return (scaled * scaled).sum(axis=1).tolist()
        scaled = away.astype(object) * self.n - np.array(self.rest, object)
        return [s if s < 1 << 63 else None for s in (scaled * scaled).sum(axis=1).tolist()]


def sums(vectors: DataFrame, dimensions: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension (high and low halves apart)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(dimensions, np.int64), np.zeros(dimensions, np.int64), 0
        for batch in batches:
            x = whole(batch.column(0), dimensions)
            high += (x >> 24).sum(axis=0)
            low += (x & 0xFFFFFF).sum(axis=0)
            n += len(x)
        columns = [np.arange(dimensions), np.full(dimensions, n), high, low]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "n", "high", "low"])

    found = vectors.mapInArrow(part, "i long, n long, high long, low long")
    total = found.groupBy("i").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")))
    rows = sorted(total.collect())
    return int(rows[0].n), [(int(r.high) << 24) + int(r.low) for r in rows]


def gram(vectors: DataFrame, dimensions: int, project: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum of y'y over all vectors, with y = project(x) of ``width`` columns."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            y = project(whole(batch.column(0), dimensions))
            total += y.T @ y
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "v"])

    found = vectors.mapInArrow(part, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    total = np.zeros((width, width))
    for row in found.collect():
        total[row.i, row.j] = total[row.j, row.i] = row.v
    return total


def factor(g: np.ndarray, shift: float) -> np.ndarray:
    """Upper Cholesky factor of g, with the least shift, from ``shift`` on, for which there is one."""
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(shift * 10, ROUNDING * max(float(np.trace(g)), np.finfo(np.float64).tiny))


def orthogonalised(vectors: DataFrame, dimensions: int, centre: Centre) -> np.ndarray:
    """R of the centred rows: the square matrix with R'R = A'A, to double precision."""
    r = np.eye(dimensions)
    for step in range(MOST_PASSES):

        def project(x: np.ndarray, r: np.ndarray = r) -> np.ndarray:
            return np.linalg.solve(r.T, centre.rows(x).T).T

        g = gram(vectors, dimensions, project if step else centre.rows, dimensions)
        if np.abs(g - np.eye(dimensions)).max() <= CLOSE * dimensions or not g.any():
            break
        entries = centre.n * dimensions + dimensions * (dimensions + 1)
        shift = 11 * entries * ROUNDING * float(np.linalg.norm(g, 2)) if step == 0 else 0.0
        if step < MOST_PASSES - 1:
            r = factor(g, shift) @ r
    # What the last Gram matrix still says; directions without variance keep none.
    size, axes = np.linalg.eigh(g)
    return (axes * np.sqrt(np.maximum(size, 0))).T @ r


def components(r: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues, unit eigenvectors (columns) and shares of the variance, of what r'r / n leads."""
    _, s, axes = np.linalg.svd(r)
    e = s * s / n
    real = s > len(s) * 16 * ROUNDING * max(float(s[0]), np.finfo(np.float64).tiny)
    keep = np.flatnonzero(real)[:COMPONENTS]
    axes = axes[keep].T
    if len(keep):
        axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(keep))] < 0, -1.0, 1.0)
    return e[keep], axes, e[keep] / e.sum() if len(keep) else e[keep]


def whiten(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Whitened coordinates of every usable vector, one row a component; see the module's docstring."""
    spark = embeddings.sparkSession
    vectors = usable(embeddings.select(F.col(key).alias("vec_id"), F.col(vector).alias("embedding")))
    dimensions = common_length(vectors)
    if not dimensions:
        return spark.createDataFrame([], SCHEMA)
    vectors = vectors.where(F.size("embedding") == dimensions)
    only = vectors.select("embedding")
    n, totals = sums(only, dimensions)
    centre = Centre(n, totals)
    e, axes, share = components(orthogonalised(only, dimensions, centre), n)
    if not len(e):
        return spark.createDataFrame([], SCHEMA)
    width = len(e)
    scaled = axes / np.sqrt(e)

    def project(x: np.ndarray) -> np.ndarray:
        return centre.rows(x) @ scaled

    error = float(np.abs(gram(only, dimensions, project, width) / n - np.eye(width)).max())

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(batch.column("embedding"), dimensions)
            rows = len(x)
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), width)))
            deviations = pa.array(centre.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(rows), width)))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.cast(pa.int64()),
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * width, n)),
                    deviations,
                    pa.array(project(x).reshape(-1)),
                    pa.array(np.tile(share, rows)),
                    pa.array(np.full(rows * width, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(part, SCHEMA)
