"""Whitening of embeddings from an exact scatter matrix, computed in a residue number system.

Every entry becomes a whole number (scaled, rounded down, shifted), so the centred scatter of n vectors, the sum of
(n*x - S)(n*x - S)' with S the sum of all x, is a matrix of whole numbers. A task never forms those large numbers: it takes
the centred vectors modulo several primes and multiplies them in double precision, where blocks are so short that each
product is exact, and keeps residues. Residues of all tasks are summed by Spark, and Chinese remaindering gives the exact
scatter, whatever the order or the number of tasks. How many primes are needed follows from the number of rows and the
range of the entries. The covariance, the scatter over n^3, is rounded once, to double, and decomposed (``eigh``).

Three passes over the vectors: sums and ranges, residues, and the covariance of the whitened rows, which measures how far
it is from the identity. No pass shuffles vectors; what is shuffled and gathered is of the size of the matrix.

Defined edge cases: vectors that are null, or of another size than the most frequent one (the smaller at ties), or that hold null or
non-finite entries, or entries whose scaled value is 2^52 or more, take no part and have no row; repeated rows count and
are returned each; rows with a null id count as any other; zero vectors take part; components with no variance
(eigenvalue within rounding of zero) have null ``whitened``, and identity_error covers the others; no vector gives
an empty result. ``deviation`` is a decimal of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.session import prepare

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Primes are below this, and residues lie around 0: a product of two is at most 2^40, a sum of 4,096 at most 2^52.
PRIME_LIMIT, BLOCK = 1 << 21, 4096
_LARGEST = float(1 << 52)


@dataclass
class Fit:
    """Number of rows, sums of each dimension, bound of an entry of n*x - S, and the exact scatter as Python integers."""

    n: int
    sums: list[int]
    bound: int
    scatter: np.ndarray

    def decompose(self, components: int) -> tuple[np.ndarray, np.ndarray, float]:
        """(eigenvalues, unit eigenvectors as columns, trace) by falling eigenvalue; true division rounds an integer quotient once."""
        cube = self.n**3
        v = np.array([[float(a / cube) for a in row] for row in self.scatter.tolist()])
        values, vectors = np.linalg.eigh(v)
        take = np.argsort(-values, kind="stable")[:components]
        return values[take], vectors[:, take], float(np.trace(v))


def primes_for(bound: int) -> list[int]:
    """The largest primes below PRIME_LIMIT whose product exceeds ``bound``."""
    divisors = [d for d in range(2, int(PRIME_LIMIT**0.5) + 1) if all(d % e for e in range(2, int(d**0.5) + 1))]
    found, product, at = [], 1, PRIME_LIMIT - 1
    while product <= bound:
        if all(at % d for d in divisors):
            found.append(at)
            product *= at
        at -= 1
    return found


def residue_scatter(z: np.ndarray, p: int) -> np.ndarray:
    """Sum of z z' modulo p, for rows of residues around 0, by exact products in double precision."""
    total = np.zeros((z.shape[1], z.shape[1]), np.int64)
    for at in range(0, len(z), BLOCK):
        block = z[at : at + BLOCK].astype(np.float64)
        total = (total + (block.T @ block).astype(np.int64)) % p
    return total


def remainder(residues: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The whole numbers of least absolute value that have these residues."""
    product = 1
    for p in primes:
        product *= p
    total = np.zeros(residues[0].shape, object)
    for r, p in zip(residues, primes, strict=True):
        rest = product // p
        total = (total + r.astype(object) * (rest * pow(rest, -1, p))) % product
    return np.where(total > product // 2, total - product, total)


def scaled(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long") + F.lit(shift))


def _rows_of(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def usable_rows(rows: DataFrame, key: str, vector: str, scale: int, shift: int) -> tuple[DataFrame, int]:
    """((id, x), dimensions): the vectors that take part, scaled to whole numbers."""
    sizes = rows.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = sizes["n"] if sizes else 0
    v = F.col(vector)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) * F.lit(float(scale)) < F.lit(_LARGEST)))
    good = rows.filter(v.isNotNull() & (F.size(v) == dim) & F.coalesce(finite, F.lit(False)))
    return good.select(F.col(key).alias("id"), scaled(v, scale, shift).alias("x")), dim


def fit(spark: SparkSession, x: DataFrame, dim: int) -> Fit | None:
    """Counts, sums and the exact scatter of all rows of (id, x)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, lo, hi = 0, np.zeros(dim, object), np.full(dim, np.iinfo(np.int64).max), np.full(dim, np.iinfo(np.int64).min)
        for batch in batches:
            if batch.num_rows:
                own = _rows_of(batch, dim)
                n += len(own)
                high = own >> 26  # two halves, so that no sum can leave 64 bits
                total += (high.sum(0).astype(object) << 26) + (own - (high << 26)).sum(0).astype(object)
                lo, hi = np.minimum(lo, own.min(0)), np.maximum(hi, own.max(0))
        if n:
            half = [int(t) >> 26 for t in total]
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(half, pa.int64()), pa.array([int(t) - (h << 26) for t, h in zip(total, half, strict=True)], pa.int64()), pa.array(lo), pa.array(hi)], names=["i", "n", "high", "low", "lo", "hi"])

    counted = x.select("x").mapInArrow(sums, "i int, n long, high long, low long, lo long, hi long")
    found = counted.groupBy("i").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ("high", "low")), F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("i").collect()  # one row for each dimension
    if not found:
        return None
    n = int(found[0]["n"])
    total = [(int(r["high"]) << 26) + int(r["low"]) for r in found]
    bound = max(max(abs(n * r["lo"] - s), abs(n * r["hi"] - s)) for r, s in zip(found, total, strict=True))
    primes = primes_for(2 * n * bound**2 + 1)
    upper = np.triu_indices(dim)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros((dim, dim), np.int64) for _ in primes]
        seen = False
        for batch in batches:
            if batch.num_rows:
                own, seen = _rows_of(batch, dim), True
                for k, p in enumerate(primes):
                    z = ((n % p) * (own % p) - np.array([s % p for s in total])) % p
                    kept[k] = (kept[k] + residue_scatter(np.where(z > p // 2, z - p, z), p)) % p
        if seen:
            for k, r in enumerate(kept):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(upper[0]), k, np.int32)), pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(r[upper])], names=["k", "cell", "r"])

    summed = x.select("x").mapInArrow(residues, "k int, cell int, r long").groupBy("k", "cell").agg(F.sum("r").alias("r")).collect()  # primes times cells of the matrix
    of = np.zeros((len(primes), len(upper[0])), np.int64)
    for r in summed:
        of[r["k"], r["cell"]] = r["r"] % primes[r["k"]]
    scatter = np.zeros((dim, dim), object)
    scatter[upper] = remainder(list(of), primes)
    scatter.T[upper] = scatter[upper]
    return Fit(n, total, bound, scatter)


def whiten(spark: SparkSession, rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error), a row for each vector and component, numbered from 1."""
    prepare(spark)
    x, dim = usable_rows(rows, key, vector, scale, shift)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fit(spark, x, dim) if dim else None
    if model is None:
        return spark.createDataFrame([], schema)
    n, sums, narrow = model.n, model.sums, model.bound < 1 << 62
    values, vectors, trace = model.decompose(components)
    live = values > dim * np.finfo(float).eps * max(float(values[0]), 0.0)
    root = np.sqrt(np.where(live, values, 1.0))
    exact = narrow and dim * model.bound**2 < 1 << 63

    def centred(own: np.ndarray) -> np.ndarray:
        return n * own - np.array(sums, np.int64) if narrow else n * own.astype(object) - np.array(sums, object)

    def project(z: np.ndarray) -> np.ndarray:
        return (z / n).astype(np.float64) @ vectors / root

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = project(centred(_rows_of(batch, dim)))
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(w[:, j])) for j in range(w.shape[1])], names=[f"w{j}" for j in range(w.shape[1])])

    own = [j for j in range(len(values)) if live[j]]
    error = 0.0
    if own:
        w = x.select("x").mapInArrow(whitened, ", ".join(f"w{j} double" for j in range(len(values))))
        pairs = [(i, j) for i in own for j in own if i <= j]
        found = w.agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs)).first()  # centred as it is aggregated
        error = max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    explained = values / trace if trace > 0 else np.zeros(len(values))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                z = centred(_rows_of(part, dim))
                w = project(z)
                square = (z * z).sum(1) if exact else np.array([int(s) for s in (z.astype(object) ** 2).sum(1)], object)
                m = part.num_rows
                each = np.repeat(np.arange(m), k)
                null = np.tile(~live, m)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                        pa.array(square).cast(pa.decimal128(38, 0)).take(pa.array(each)) if exact else pa.array([_decimal(s) for s in square], pa.decimal128(38, 0)).take(pa.array(each)),
                        pa.array(w.ravel(), mask=null), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return x.mapInArrow(expand, schema)


def _decimal(value: int):
    from decimal import Decimal

    return Decimal(value) if abs(value) < 10**38 else None


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight whitened components of every usable vector of ``embeddings``."""
    out = whiten(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))
