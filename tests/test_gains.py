"""Gain compensation against a dense solve."""

from __future__ import annotations

import numpy as np
import pytest

from waymark.operators import gains as N


def test_gains_against_a_dense_solve(spark):
    """Twelve clouds in two groups with strong overlaps, one without any."""
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(900):
        a, b = (int(v) for v in rng.integers(0, 6, 2) + 6 * int(rng.integers(0, 2)))
        rows.append((a, b, float(60 + 15 * a + rng.normal()), float(60 + 15 * b + rng.normal())))
    sizes = {i: 40 + i for i in range(13)}
    n, mean = np.zeros((13, 13)), np.zeros((13, 13))
    for a, b, va, vb in rows:
        if a != b:
            n[a, b] += 1
            n[b, a] += 1
            mean[a, b] += va
            mean[b, a] += vb
    mean /= np.maximum(n, 1)
    left = -2 * N.ALPHA * mean * mean.T * n
    right = np.array([N.BETA * (sizes[i] + n[i].sum()) for i in range(13)])
    left[np.diag_indices(13)] = right + (2 * N.ALPHA * mean**2 * n).sum(1)
    want = np.linalg.solve(left, right)
    pairs = spark.createDataFrame(rows, "a int, b int, va double, vb double").repartition(3)
    got = {r["node"]: r["gain"] for r in N.gains(spark, spark.createDataFrame(list(sizes.items()), "node int, n int"), N.overlap_means(pairs)).collect()}
    assert np.allclose([got[i] for i in range(13)], want, atol=1e-9) and got[12] == pytest.approx(1.0) and max(abs(want - 1)) > 0.2


def test_no_clouds_and_a_solve_that_does_not_end(spark):
    none = N.overlap_means(spark.createDataFrame([], "a int, b int, va double, vb double"))
    assert N.gains(spark, spark.createDataFrame([], "node int, n int"), none).count() == 0
    pairs = N.overlap_means(spark.createDataFrame([(1, 2, 9.0, 5.0)], "a int, b int, va double, vb double"))
    with pytest.raises(RuntimeError, match="not solved"):
        N.solve(spark, *N.normal_equations(spark.createDataFrame([(1, 5), (2, 9)], "node int, n int"), pairs), most=1)
