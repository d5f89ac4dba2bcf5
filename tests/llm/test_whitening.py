"""Whitening against exact integers and a general eigensolver."""

import math
import random

import numpy as np
import pytest

from stavelight.llm import queries as Q
from stavelight.llm import whitening as W

SF = "/root/testdata/sf0.001"


def brute(rows, scale=1024, shift=100_000):
    """By id: x as Python integers; eigenvalues and axes of the covariance by numpy."""
    kept = [(i, [math.floor(scale * c) + shift for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, sums = len(kept), [sum(c) for c in zip(*(x for _, x in kept), strict=True)]
    d = np.array([[x * n - s for x, s in zip(v, sums, strict=True)] for _, v in kept], object)
    v = (d.T @ d / n**3).astype(np.float64)
    e, q = np.linalg.eigh(v)
    return kept, n, d, v, e[::-1], q[:, ::-1]


def compare(out, rows):
    kept, n, d, v, e, q = brute(rows)
    found = {}
    for r in out:
        found.setdefault(r.vec_id, []).append(r)
    assert len(out) == len(kept) * min(8, len(e)) and {r.n for r in out} == {n}
    w = np.array([[r.whitened for r in sorted(found[i], key=lambda r: r.component)] for i, _ in kept])
    k = w.shape[1]
    want = (d / n).astype(np.float64) @ (q[:, :k] / np.sqrt(e[:k]))
    sign = np.sign((w * want).sum(axis=0))
    assert np.allclose(w * sign, want, atol=1e-6)
    assert [found[i][0].deviation for i, _ in kept] == [int((r * r).sum()) for r in d]
    share = {r.component: r.explained for r in out}
    assert np.allclose([share[c + 1] for c in range(k)], e[:k] / np.trace(v), rtol=1e-9)
    error = np.abs(np.cov(w.T, bias=True) - np.eye(k)).max()
    assert {r.identity_error for r in out} == {out[0].identity_error} and out[0].identity_error < 1e-9 and error < 1e-9


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    compare(Q.op12_whiten(spark, SF).collect(), rows)


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) * 10**k for k in range(-3, 3)]) for i in range(200)]
    bad = [(900, None), (901, [1.0] * 5 + [None]), (902, [1.0] * 5 + [math.nan]), (903, [math.inf] + [1.0] * 5)]
    other = [(904, [1.0]), (905, []), (906, [1e300] * 6)]
    table = spark.createDataFrame([(v, i, "a", 1, 2.0) for i, v in [*rows, *bad, *other]], "embedding array<double>, vec_id long, N string, whitened int, Deviation double")
    compare(W.whitened_rows(table).collect(), rows)
    full = W.whiten(table)
    assert sorted(c.lower() for c in full.columns) == ["deviation", "explained", "identity_error", "n", "vec_id", "whitened"]
    assert W.whitened_rows(table.limit(0)).collect() == [] and W.whitened_rows(table.where("vec_id = 900")).collect() == []
    same = spark.createDataFrame([(None, [1.0, 2.0])] * 3, "vec_id long, embedding array<double>")
    out = W.whitened_rows(same).collect()
    assert len(out) == 6 and {(r.vec_id, r.deviation, r.whitened, r.explained, r.identity_error) for r in out} == {(None, 0, None, None, None)}


def test_dependent_dimensions_have_no_component(spark):
    rng = random.Random(4)
    rows = [(i, [x := rng.random(), y := rng.random(), x, y]) for i in range(100)]
    out = W.whitened_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in out if r.whitened is None} == {3, 4} and out[0].identity_error < 1e-9


def test_far_means_and_many_parts(spark):
    rng = random.Random(5)
    rows = [(i, [1e7 + rng.random(), -3e8 + 50 * rng.random(), rng.random() / 2]) for i in range(3000)]
    compare(W.whitened_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)).collect(), rows)


@pytest.mark.parametrize("size", [1, 2, 7, 40])
def test_jacobi(size):
    rng = np.random.default_rng(size)
    a = rng.normal(size=(size, size))
    v = a @ a.T
    e, q = W.jacobi(v)
    assert np.allclose(q @ np.diag(e) @ q.T, v) and np.allclose(q.T @ q, np.eye(size)) and (np.diff(e) <= 0).all()


def test_jacobi_is_accurate_for_small_eigenvalues():
    # graded: eigenvalues span 40 orders of magnitude, beyond what a method of absolute accuracy can tell
    scale = 10.0 ** np.array([0, -10, -20])
    v = np.array([[1, 0.5, 0.2], [0.5, 1, 0.3], [0.2, 0.3, 1]]) * np.outer(scale, scale)
    e, _ = W.jacobi(v)
    assert math.isclose(np.prod(e), 10.0**-60 * np.linalg.det([[1, 0.5, 0.2], [0.5, 1, 0.3], [0.2, 0.3, 1]]), rel_tol=1e-12)
    assert math.isclose(e[1], 0.75e-20, rel_tol=1e-12)
