"""Whitening: eigenpairs against numpy's, counts against spectra, the query's rows against plain formulas."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm import spectrum, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, component string, _c int"


def symmetric(values, seed):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return (q * np.array(values, float)) @ q.T


SPECTRA = [[5, 4, 3, 2, 1], [1214.2, 1210.1, 1184.8, 1176.2, 3, 2, 1], [7, 7, 7, 1], [9, 5, 5, 5, 5, 0], [1, 1 - 1e-9, 1 - 2e-9, 0.5], [1, 0, 0], [2, 2], [3], [1e-9, 1e-10, 1e-12, 0], [1e12, 1, 0.5], [-1, -2, -3], [4, 4 - 1e-14, 1]]


@pytest.mark.parametrize("values", SPECTRA)
def test_leading_pairs(values):
    a = symmetric(values, 3)
    scale = max(map(abs, values))
    found, vectors = spectrum.leading(a, 4)
    want = sorted(values, reverse=True)[:4]
    assert np.allclose(found, want, rtol=0, atol=1e-12 * scale)
    assert np.allclose(vectors @ vectors.T, np.eye(len(found)), atol=1e-12)
    assert np.abs(a @ vectors.T - vectors.T * found).max() < 2e-12 * scale
    assert all(v[np.abs(v).argmax()] > 0 for v in vectors)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-9, 9), min_size=1, max_size=12), st.integers(0, 99), st.floats(-10, 10))
def test_inertia_counts(values, seed, shift):
    a = symmetric(values, seed)
    if min(abs(v - shift) for v in values) > 1e-6:
        assert spectrum.counter(a)(shift) == sum(v > shift for v in values)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(1, 6), st.integers(0, 10**6))
def test_leading_equals_a_dense_solver(n, most, seed):
    x = np.random.default_rng(seed).standard_normal((n + 3, n))
    a = x.T @ x
    found, vectors = spectrum.leading(a, most)
    want, basis = np.linalg.eigh(a)
    assert np.allclose(found, want[::-1][:most], rtol=1e-11, atol=1e-11 * want[-1])
    assert np.allclose(np.abs(np.sum(vectors * basis.T[::-1][:most], axis=1)), 1, atol=1e-6)


def test_zero_and_diagonal_matrices():
    assert spectrum.leading(np.zeros((3, 3)), 2)[0].tolist() == [0, 0]
    found, vectors = spectrum.leading(np.diag([1.0, 3.0, 2.0]), 3)
    assert np.allclose(found, [3, 2, 1]) and np.allclose(np.abs(vectors), np.eye(3)[[1, 2, 0]])


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "x", "y", 1) for i, v in enumerate(vectors)], SCHEMA).repartition(3)


def plainly(vectors):
    """Stepped vectors by id, their distinct ones, and the eigenpairs of the covariance by numpy."""
    kept = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = np.array(sorted({tuple(x) for x in kept.values()}), dtype=float)
    centred = fit - fit.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(fit))
    return kept, fit, values[::-1], axes.T[::-1]


def check(rows, vectors, d, most=4):
    kept, fit, values, axes = plainly(vectors)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    shown = [j for j in range(min(most, d)) if values[j] > 1e-9]
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(got) == len(kept) * len(shown)
    sign = {}
    for (i, c), r in got.items():
        x = kept[i]
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        want = float((np.array(x) - np.array(sums) / n) @ axes[c - 1] / math.sqrt(values[c - 1]))
        if abs(want) > 1e-3:
            sign.setdefault(c, math.copysign(1, want * r.whitened))
        assert math.isclose(r.whitened, sign.get(c, 1) * want, rel_tol=1e-7, abs_tol=1e-7)
        assert math.isclose(r.explained, values[c - 1] / values.sum(), rel_tol=1e-9) and r.identity_error < 1e-9


def test_query_equals_plain_formulas(spark):
    rng = random.Random(1)
    vectors = [[rng.gauss(0.1 * j, 1 + j) for j in range(6)] for _ in range(200)]
    vectors += [vectors[0]] * 90 + [None, [None, 1.0, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf"), *[0.0] * 5], [-0.0] * 6, [0.0] * 6, [1e-9] * 6, [-1e-9] * 6]
    check(whitening.whitened(frame(spark, vectors)).collect(), vectors, 6)


def test_clusters_and_ranks_below_the_dimension(spark):
    cross = [[s if j == k else 0.0 for j in range(4)] for k in range(4) for s in (1.0, -1.0)]
    rows = whitening.whitened(frame(spark, cross)).collect()
    w = np.zeros((8, 4))
    for r in rows:
        w[r.vec_id, r.component - 1] = r.whitened
    assert np.allclose(w.T @ w / 8, np.eye(4)) and all(math.isclose(r.explained, 0.25) for r in rows)
    line = [[float(k), 2.0 * k, 0.0] for k in range(5)]
    assert {r.component for r in whitening.whitened(frame(spark, line)).collect()} == {1}


def test_edges(spark):
    assert whitening.whitened(frame(spark, [])).collect() == []
    assert whitening.whitened(frame(spark, [None, []])).collect() == []
    assert whitening.whitened(frame(spark, [[1.0, 2.0]] * 5)).collect() == []
    mixed = [[1.0, 2.0], [2.0, 1.0], [5.0, 5.0], [1.0, 2.0, 3.0], [9.0], []]
    assert {r.vec_id for r in whitening.whitened(frame(spark, mixed)).collect()} == {0, 1, 2}
    twice = spark.createDataFrame([(None, [1.0, 2.0], 0, "", "", 0), (1, [2.0, 5.0], 0, "", "", 0), (1, [2.0, 5.0], 0, "", "", 0)], SCHEMA)
    rows = whitening.whitened(twice).collect()
    assert sorted((r.vec_id is None, r.component) for r in rows) == [(False, 1), (False, 1), (True, 1)] and {r.n for r in rows} == {2}


def test_exact_deviations_of_large_numbers(spark):
    big = [[1e12, -3e12], [2e12, 1.0], [0.0, 0.0]]
    rows = whitening.whitened(frame(spark, big)).collect()
    assert len(rows) == 6 and all(r.deviation is None or r.deviation >= 0 for r in rows)
    assert whitening._squares(np.array([[3, 4]]), 2**31, [0, 0]) == [None]
    assert whitening._squares(np.array([[1, 1]]), 2**30, [5, 7]) == [(2**30 - 5) ** 2 + (2**30 - 7) ** 2]
