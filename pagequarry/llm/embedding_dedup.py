"""Near-duplicate embeddings: spherical k-means cells and blocked cosine products.

Equal vectors are one. Centroids are fitted on a bounded sample; every vector belongs to the cell of
its nearest centroid. A pair that is similar enough can still lie on two sides of a border, so a vector
near the border of another cell is also compared there, as a guest: with the unit normal u of the
border, a neighbour y beyond it has y.u <= 0, hence x.u <= sqrt(1 - threshold^2) for any link. That
bound is the ``margin`` used, so every link is found.

Inside a cell, vectors are dealt into blocks of bounded size and each pair of blocks is one matrix
product. It returns sums of links and a spanning forest, never the pairs, so a group of thousands of
copies costs its rows, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.components import components
from pagequarry.session import pinned

THRESHOLD = 0.9


def exact_margin(threshold: float) -> float:
    """How far from the border of a cell a vector can be that has a link beyond it; rounding aside."""
    return float(np.sqrt(1 - np.clip(threshold, 0, 1) ** 2)) + 1e-6


MARGIN = exact_margin(THRESHOLD)
#: Vectors the centroids are fitted on, about; rounds of fitting.
SAMPLE, ROUNDS = 20_000, 8
#: Vectors per cell aimed at; least and most cells.
CELL, LEAST_CELLS, MOST_CELLS = 1_000, 16, 1_024
#: Vectors of a block, and rows of one product.
BLOCK, ROWS = 4_096, 512


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles, scaled to length one."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_means(x: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of unit vectors: seeded far apart by a fixed random choice, then moved to the means."""
    random = np.random.default_rng(7)
    centres = x[random.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        length = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(length[:, None] > 0, sums / np.maximum(length, 1e-12)[:, None], centres)
    return np.unique(centres, axis=0)


def homes_and_guests(x: np.ndarray, centres: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell of every vector, table of the cells it visits). A vector visits later cells only, so
    that a pair meets once."""
    near = x @ centres.T
    home = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 1e-18))
    lead = near[np.arange(len(x)), home][:, None] - near
    visits = (lead <= margin * apart[home]) & (np.arange(len(centres)) > home[:, None])
    return home, visits


def fitted(unique: DataFrame, total: int) -> np.ndarray | None:
    """Centroids from about ``SAMPLE`` vectors of the most common length."""
    lengths = unique.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return None
    share = int((1 << 20) * min(1.0, SAMPLE / max(1, lengths["count"])))
    sample = (
        unique.where((F.size("embedding") == lengths["d"]) & (F.pmod("h1", F.lit(1 << 20)) < share))
        .select("h1", "embedding")
        .toArrow()
        .sort_by("h1")
        .column("embedding")
        .combine_chunks()
    )
    if not len(sample):
        return None
    return spherical_means(matrix(sample), int(np.clip(total // CELL, LEAST_CELLS, MOST_CELLS)))


def dealt(batch: pa.RecordBatch, centres: np.ndarray, margin: float):
    """(row numbers, cell, home?) of a batch; vectors of another length than the centroids' have one
    cell per length, numbered below 0."""
    column = batch.column("embedding")
    length = column.value_lengths().to_numpy(zero_copy_only=False)
    rows, cells, home = [], [], []
    same = np.flatnonzero(length == centres.shape[1])
    for first in range(0, len(same), ROWS * 8):
        part = same[first : first + ROWS * 8]
        own, visits = homes_and_guests(matrix(column.take(pa.array(part))), centres, margin)
        at, where = np.nonzero(visits)
        rows += [part, part[at]]
        cells += [own, where]
        home += [np.ones(len(part), bool), np.zeros(len(at), bool)]
    other = np.flatnonzero(length != centres.shape[1])
    rows.append(other)
    cells.append(-length[other].astype(np.int64))
    home.append(np.ones(len(other), bool))
    return np.concatenate(rows), np.concatenate(cells).astype(np.int64), np.concatenate(home)


def compared(unique: DataFrame, centres: np.ndarray, threshold: float, margin: float) -> DataFrame:
    """(id, links, root): for every vector and product with a link, the number of vectors linked (copies
    counted) and the smallest vector it is joined to there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, cells, home = dealt(batch, centres, margin)
            key, n = np.unique(np.stack([cells, home]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_pydict({"cell": key[0], "home": key[1] == 1, "n": n})

    # Two rows a cell at most.
    sizes = (
        unique.select("embedding")
        .mapInArrow(count, "cell long, home boolean, n long")
        .groupBy("cell", "home")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    blocks = {(r["cell"], r["home"]): -(-r["n"] // BLOCK) for r in sizes}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cells, home = dealt(batch, centres, margin)
            name = batch.column("h1").to_numpy().astype(np.uint64)
            out: list[tuple] = []
            for row, cell, own in zip(rows.tolist(), cells.tolist(), home.tolist(), strict=True):
                others, guests = blocks.get((cell, True), 1), blocks.get((cell, False), 0)
                mine = int(name[row] % np.uint64(others if own else max(1, guests)))
                if own:
                    out += [(row, cell, min(mine, k), max(mine, k), True, k < mine) for k in range(others)]
                    out += [(row, cell, mine, k, False, False) for k in range(guests)]
                else:
                    out += [(row, cell, k, mine, False, True) for k in range(others)]
            for first in range(0, len(out), 4096):
                part = out[first : first + 4096]
                take = pa.array([p[0] for p in part], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[
                            pa.array([p[c] for p in part], kind)
                            for c, kind in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32()), (4, pa.bool_()), (5, pa.bool_()))
                        ],
                        *[batch.column(c).take(take) for c in ("id", "n", "embedding")],
                    ],
                    ["cell", "i", "j", "own", "second", "id", "n", "embedding"],
                )

    def product(table: pa.Table) -> pa.Table:
        none = pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        inside = table.column("own")[0].as_py() and table.column("i")[0].as_py() == table.column("j")[0].as_py()
        table = table.sort_by("id")
        x = matrix(table.column("embedding").combine_chunks())
        ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
        second = table.column("second").to_numpy(zero_copy_only=False)
        left = np.arange(len(x)) if inside else np.flatnonzero(~second)
        right = np.arange(len(x)) if inside else np.flatnonzero(second)
        if not len(left) or not len(right):
            return none
        links = np.zeros(len(x), np.int64)
        root = np.arange(len(x))
        pieces = []
        for first in range(0, len(left), ROWS):
            part = left[first : first + ROWS]
            near = x[part] @ x[right].T >= threshold
            if inside:
                near[np.arange(len(part)), part] = False
            a, b = near.any(axis=1), near.any(axis=0)
            if not a.any():
                continue
            links[part] += near @ n[right]
            if not inside:
                links[right] += n[part] @ near
            pieces.append((part[a], right[b], near[np.ix_(a, b)]))
        # The smallest vector reachable, by repeated minima over the linked rows only.
        changed = bool(pieces)
        while changed:
            before = root.copy()
            for a, b, near in pieces:
                low = np.where(near, root[b][None, :], len(x))
                root[a] = np.minimum(root[a], low.min(axis=1))
                high = np.where(near, root[a][:, None], len(x))
                root[b] = np.minimum(root[b], high.min(axis=0))
            changed = bool((root != before).any())
        found = np.flatnonzero(links)
        return pa.table({"id": ids[found], "links": links[found], "root": ids[root[found]]})

    kind = unique.schema["embedding"].dataType.simpleString()
    return (
        unique.select("id", "n", "h1", "embedding")
        .mapInArrow(
            deal,
            f"cell long, i int, j int, own boolean, second boolean, id long, n long, embedding {kind}",
        )
        .groupBy("cell", "i", "j", "own")
        .applyInArrow(product, "id long, links long, root long")
    )


def dedupe(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    threshold: float = THRESHOLD,
    margin: float | None = None,
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every row of ``vectors``.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing; neither
    do vectors of different lengths. Equal vectors always link. Ids should be unique; rows that share
    one are rows of their own with that id. A row without id is compared with nothing and not kept.
    Without a margin the exact one of the threshold is taken.
    """
    if margin is None:
        margin = exact_margin(threshold)
    e = F.col("embedding")
    fine = (
        F.col("vec_id").isNotNull()
        & e.isNotNull()
        & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(e, lambda x: x != 0)
    )
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    # Adding 0 makes -0.0 and 0.0 one value.
    v = v.withColumn("embedding", F.transform(e, lambda x: x + F.lit(0).cast("float"))).withColumn(
        "fine", F.coalesce(fine, F.lit(False))
    )
    v = v.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    unique = pinned(
        v.where("fine")
        .groupBy("h1", "h2")
        .agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
    )
    total = unique.count()
    centres = fitted(unique, total)
    rows = v.select("vec_id", "fine", "h1", "h2")
    if centres is None:
        return rows.select(
            "vec_id",
            F.lit(0).cast("long").alias("n_links"),
            F.col("vec_id").alias("component_id"),
            F.col("vec_id").isNotNull().alias("kept"),
        )
    found = pinned(compared(unique, centres, threshold, margin))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = (
        unique.select("h1", "h2", "id", "n")
        .join(links, "id", "left")
        .join(label.withColumnRenamed("node", "id"), "id", "left")
        .select(
            "h1",
            "h2",
            F.lit(True).alias("fine"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    return (
        rows.join(pinned(known), ["h1", "h2", "fine"], "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
