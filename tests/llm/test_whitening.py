"""Whitening against exact Python integers and plain NumPy."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from waymark.llm import whitening as W


def _plain(vectors: list) -> tuple[np.ndarray, list[int]]:
    x = [[int(np.floor(1024 * float(c))) + 100000 for c in v] for v in vectors]
    n = len(x)
    s = [sum(r[j] for r in x) for j in range(len(x[0]))]
    z = [[n * r[j] - s[j] for j in range(len(s))] for r in x]
    return np.array([[sum(r[i] * r[j] for r in z) for j in range(len(s))] for i in range(len(s))], object), [sum(c * c for c in r) for r in z]


def _check(rows, ids, vectors):
    scatter, deviation = _plain(vectors)
    n = len(vectors)
    v = np.array([[a / n**3 for a in r] for r in scatter.tolist()])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    x = np.floor(1024 * np.array(vectors, float)) + 100000
    w = (x - x.mean(0)) @ axes[:, :8] / np.sqrt(values[:8])
    got = defaultdict(dict)
    for r in rows:
        got[r["vec_id"]][r["component"]] = r
        assert r["n"] == n and r["identity_error"] < 1e-6
    assert sorted(got) == sorted(ids)
    for c in range(1, min(8, len(values)) + 1):
        sign = np.sign(sum(got[i][c]["whitened"] * w[k, c - 1] for k, i in enumerate(ids)))
        for k, i in enumerate(ids):
            assert got[i][c]["deviation"] == deviation[k]
            assert got[i][c]["whitened"] == pytest.approx(sign * w[k, c - 1], abs=1e-6)
            assert got[i][c]["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)


def test_query_against_exact_integers(spark):
    t = pq.read_table("/root/testdata/sf0.001/embeddings.parquet")
    _check(W.op13_embedding_whitening(spark, "/root/testdata/sf0.001").collect(), t["vec_id"].to_pylist(), t["embedding"].to_pylist())


def test_unusable_vectors_and_clashing_names(spark, tmp_path):
    rng = np.random.default_rng(2)
    vectors: list = [list(map(float, rng.normal(size=5))) for _ in range(40)]
    good = [i for i in range(40) if i not in (3, 4, 5, 6, 7)]
    vectors[3], vectors[4], vectors[5], vectors[6], vectors[7] = None, [float("nan")] * 5, [1.0, None, 1.0, 1.0, 1.0], [float("-inf")] + [0.0] * 4, [1.0] * 3
    vectors[9], vectors[11] = [0.0] * 5, vectors[12]
    pq.write_table(pa.table({"vec_id": range(40), "embedding": pa.array(vectors, pa.list_(pa.float64())), "x": ["s"] * 40, "component": [1] * 40, "n": [0] * 40}), tmp_path / "embeddings.parquet")
    _check(W.op13_embedding_whitening(spark, str(tmp_path)).collect(), good, [vectors[i] for i in good])
    pq.write_table(pq.read_table(tmp_path / "embeddings.parquet").slice(0, 0), tmp_path / "empty.parquet")
    assert W.whiten(spark, spark.read.parquet(str(tmp_path / "empty.parquet"))).count() == 0
    assert W.whiten(spark, spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")).count() == 0


def test_no_variance_is_null(spark):
    one = W.whiten(spark, spark.createDataFrame([(1, [0.5, 0.25])], "vec_id long, embedding array<float>")).collect()
    assert [(r["component"], r["whitened"], r["deviation"], r["explained"], r["identity_error"]) for r in one] == [(1, None, 0, 0.0, 0.0), (2, None, 0, 0.0, 0.0)]
    line = W.whiten(spark, spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)], "vec_id long, embedding array<double>")).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in line) and all(r["identity_error"] < 1e-9 for r in line)


def test_scatter_beyond_64_bits(spark):
    """Entries near the limit need many primes, and the scatter is still exact."""
    rng = np.random.default_rng(7)
    vectors = [[float(c) for c in rng.integers(-(2**41), 2**41, 3)] for _ in range(50)]
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(5)
    x, dim = W.usable_rows(rows, "vec_id", "embedding", W.SCALE, W.SHIFT)
    scatter, deviation = _plain(vectors)
    assert max(abs(a) for a in scatter.ravel()) > 2**100
    assert (W.fit(spark, x, dim).scatter == scatter).all()
    assert {r["vec_id"]: int(r["deviation"]) for r in W.whiten(spark, rows).collect()} == dict(enumerate(deviation))


def test_remainder_and_primes():
    primes = W.primes_for(1 << 200)
    assert len(set(primes)) == len(primes) and all(p < W.PRIME_LIMIT and all(p % d for d in range(2, int(p**0.5) + 1)) for p in primes)
    values = np.array([[-(1 << 198), 5], [0, (1 << 198) + 17]], object)
    assert (W.remainder([(values % p).astype(np.int64) for p in primes], primes) == values).all()
    z = np.full((W.BLOCK * 2 + 3, 2), primes[0] // 2)
    assert residue_is_exact(z, primes[0])


def residue_is_exact(z: np.ndarray, p: int) -> bool:
    want = len(z) * int(z[0, 0]) ** 2 % p
    return bool((W.residue_scatter(z, p) == want).all())
