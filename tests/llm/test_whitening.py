"""Embedding whitening against numpy and exact whole-number sums."""

import numpy as np
import pytest

from pagequarry.llm import whitening

VECTORS = "vec_id long, embedding array<double>, n string, Component int"


def table(spark, vectors):
    return spark.createDataFrame([(k, v, "n", 1) for k, v in enumerate(vectors)], VECTORS)


def brute(vectors):
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for v in vectors], object)
    away = x * len(x) - x.sum(axis=0)
    a = away.astype(float) / len(x)
    # Of the rows themselves: their covariance has lost the smallest directions of ill-conditioned ones.
    _, s, axes = np.linalg.svd(a, full_matrices=False)
    return [int(d) for d in (away * away).sum(axis=1)], a, s * s / len(x), axes.T


def check(vectors, rows, ids):
    deviations, a, e, axes = brute(vectors)
    got = {(r.vec_id, r.component): r for r in rows}
    count = max(r.component for r in rows)
    assert len(got) == len(rows) == len(ids) * count
    for c in range(1, count + 1):
        want = a @ axes[:, c - 1] / np.sqrt(e[c - 1])
        have = np.array([got[i, c].whitened for i in ids])
        want *= np.sign(want @ have)
        assert np.abs(want - have).max() < 1e-6
        assert all(abs(got[i, c].explained - e[c - 1] / e.sum()) <= 1e-9 * e[c - 1] / e.sum() for i in ids)
    assert [got[i, 1].deviation for i in ids] == [d if d < 1 << 63 else None for d in deviations]
    assert all(r.n == len(ids) and r.identity_error < 1e-9 for r in rows)
    return count


def test_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    kept = [r for r in rows.collect() if r.embedding and np.isfinite(np.array(r.embedding, float)).all()]
    assert check([r.embedding for r in kept], whitening.whiten(rows).collect(), [r.vec_id for r in kept]) == 8


def test_ill_conditioned_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 6)) * np.array([1e5, 1e4, 1e3, 1e2, 10, 1])
    turned = base @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    assert check(turned.tolist(), whitening.whiten(table(spark, turned.tolist())).collect(), range(400)) == 6


def test_directions_without_variance_give_no_component(spark):
    vectors = [[float(k), 2.0 * k, 7.0, float(k % 3)] for k in range(30)]
    assert check(vectors, whitening.whiten(table(spark, vectors)).collect(), range(30)) == 2


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 2.0, 3.0], [1.0, 2.0], [1.5, 2.0], [1.5, 2.0], [0.0, -4.0]]
    rows = whitening.whiten(table(spark, vectors)).collect()
    assert check(vectors[6:], rows, [6, 7, 8, 9]) == 2


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_nothing_to_whiten(spark, vectors):
    assert whitening.whiten(table(spark, vectors)).collect() == []


def test_huge_entries(spark):
    rows = whitening.whiten(table(spark, [[1e300, 0.0], [-1e300, 1.0], [0.0, 3.0]])).collect()
    assert {r.deviation for r in rows} == {None} or all(r.deviation is None or r.deviation < 1 << 63 for r in rows)
    assert all(r.identity_error < 1e-4 for r in rows)
