"""Rank-one updates and whitening against a dense eigendecomposition."""

from __future__ import annotations

import math

import numpy as np
import pytest

from passagemill.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, component int, n long, v string"


def matrix(kind, rng):
    x = rng.normal(size=(60, 6))
    if kind == "constant columns":
        x[:, 2:4] = 1.0
    elif kind == "equal columns":
        x[:, 4] = x[:, 1]
    elif kind == "repeats":
        x = np.repeat(x[:3], 20, axis=0)
    elif kind == "scales":
        x *= 10.0 ** np.arange(-3, 3)
    elif kind == "isotropic":
        x = np.vstack([np.eye(6), -np.eye(6)] * 5)
    return x


@pytest.mark.parametrize("kind", ["plain", "constant columns", "equal columns", "repeats", "scales", "isotropic"])
def test_updates_and_merges_equal_a_dense_decomposition(kind):
    rows = np.floor(1024 * matrix(kind, np.random.default_rng(3))) + 100_000
    scatter = (rows - rows.mean(axis=0)).T @ (rows - rows.mean(axis=0))
    wanted = np.linalg.eigvalsh(scatter)
    whole, left, right = (whitening.Spectrum(6) for _ in range(3))
    for k, row in enumerate(rows):
        whole.add(row)
        (left if k % 3 else right).add(row)
    left.merge(right)
    for s in (whole, left):
        assert s.n == len(rows)
        assert np.allclose(s.d, wanted, rtol=1e-11, atol=1e-11 * wanted[-1])
        assert np.allclose(s.q.T @ s.q, np.eye(6), atol=1e-12)
        assert np.allclose(s.q * s.d @ s.q.T, scatter, atol=1e-11 * wanted[-1])


def test_roots_lie_between_poles():
    d, w = np.array([0.0, 1.0, 1.0 + 1e-9, 5.0]), np.array([1e-14, 2.0, 1e-3, 0.5])
    roots, _ = whitening.secular_roots(d, w, 0.7)
    assert np.all(np.diff(roots) > 0) and np.all(roots[:-1] > d[:-1]) and np.all(roots[:-1] < d[1:])
    assert np.isclose(roots.sum(), d.sum() + 0.7 * w.sum())


def test_whitens_all_rows(spark):
    rng = np.random.default_rng(5)
    vectors = [list(map(float, row)) for row in rng.normal(size=(90, 10)) * np.linspace(0.1, 1, 10)]
    bad = [None, [], [1.0, None] + [0.0] * 8, [float("nan")] * 10, [float("inf")] * 10, [1.0] * 4, [1e300] * 10]
    rows = list(enumerate(vectors + bad)) + [(None, vectors[0]), (4, vectors[4])]
    table = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA).repartition(20)
    found = whitening.whiten(table).collect()
    x = np.floor(1024 * np.array(vectors + [vectors[0], vectors[4]])) + 100_000
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    y = (x - x.mean(axis=0)) @ axes[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    n, total = len(x), x.sum(axis=0)
    exact = ((n * x - total) ** 2).sum(axis=1)
    assert len(found) == 8 * n and {r.n for r in found} == {n}
    sign = {}
    for r in found:
        at = n - 2 if r.vec_id is None else r.vec_id
        sign.setdefault(r.component, math.copysign(1, r.whitened * y[at, r.component - 1]))
        assert r.whitened * sign[r.component] == pytest.approx(y[at, r.component - 1], rel=1e-8, abs=1e-8)
        assert int(r.deviation) == int(exact[at])
        assert r.explained == pytest.approx(values[::-1][r.component - 1] / values.sum(), rel=1e-10)
        assert r.identity_error < 1e-9


def test_few_equal_or_no_rows(spark):
    def run(vectors):
        table = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in enumerate(vectors)], SCHEMA)
        return whitening.whiten(table).collect()

    assert run([]) == [] and run([None]) == [] and run([[1.0, 2.0]] * 3) == []
    line = run([[0.0, 1.0], [1.0, 1.0], [2.0, 1.0]])
    assert [r.component for r in line] == [1, 1, 1] and line[0].explained == pytest.approx(1.0)
    wide = run([[1e15, 0.0], [-1e15, 1.0]] * 3)
    assert int(wide[0].deviation) > 1 << 63
