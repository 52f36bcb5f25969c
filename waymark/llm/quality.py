"""Quality scoring with a factorisation machine.

Features of a text: hashed words (normalised counts), binned structure statistics of the whole text, and binned
numeric metadata. The machine adds a bias, a linear part and low-rank pairwise interactions; the pairwise part is
scored in linear time as half the sum over factors of (sum of v x) squared minus the sum of (v x) squared.

Defined edge cases: null and empty texts have only the bins of an empty text, and get a score like any other; null
metadata have a bin of their own; repeated rows score alike; labels other than 0 and 1 are ignored, and of repeated
labels of a document the largest counts; without labels of both kinds every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.sampling import bounded_per_class, fold_of, gather
from waymark.llm.text import NOT_SPACE, Words, blocks, column_bytes
from waymark.session import prepare

WORD_BITS = 16
#: Bins of each statistic: edges of shares, and powers of two for sizes.
SHARE_EDGES = np.array([0.0005, 0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
SIZE_EDGES = 2.0 ** np.arange(0, 40, 1)
BINS = 48
#: Labelled documents taken for fitting, per label at most.
PER_CLASS = 3000
RANK = 8

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:'\"()-?"]] = True
_ODD = ~(_LETTER | _DIGIT | _MARK | ~NOT_SPACE)


def _per_row(mask: np.ndarray, edge: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return sums[edge[1:]] - sums[edge[:-1]]


def features(offsets: np.ndarray, data: np.ndarray, at: int, end: int, metadata: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: first position of each row (n + 1), feature indices, values."""
    w = Words(offsets, data, at, end, fold=True)
    n = end - at
    raw, edge = w.raw, w.edge
    size = np.maximum(np.diff(edge), 1)
    letters = np.maximum(_per_row(_LETTER[raw], edge), 1)
    words = np.maximum(w.count, 1)
    bucket = (w.hashes() >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    key, times = np.unique((w.row.astype(np.int64) << WORD_BITS) | bucket, return_counts=True)
    row = key >> WORD_BITS
    distinct = np.bincount(row, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, row, times)
    norm = np.sqrt(np.bincount(row, weights=times.astype(float) ** 2, minlength=n))
    lines = _per_row(raw == 0x0A, edge) + 1
    odd = _ODD[raw]
    shares = [
        _per_row(_UPPER[raw], edge) / letters,
        _per_row(_DIGIT[raw], edge) / size,
        _per_row(odd, edge) / size,
        _per_row(_MARK[raw], edge) / size,
        _per_row(raw == 0x21, edge) / size,
        distinct / words,
        top / words,
        np.bincount(w.row, weights=odd[w.stop - 1] if len(w.stop) else None, minlength=n) / words,
    ]
    sizes = [np.diff(edge), w.count, np.diff(edge) / words, lines, w.count / lines]
    binned = [np.searchsorted(SHARE_EDGES, s) for s in shares] + [np.searchsorted(SIZE_EDGES, s) for s in sizes]
    for m in metadata:
        known = np.isfinite(m)
        binned.append(np.where(known, np.minimum(np.searchsorted(SIZE_EDGES, np.where(known, m, 0)), BINS - 2), BINS - 1))
    base = 1 << WORD_BITS
    stats = np.stack([base + j * BINS + np.minimum(b, BINS - 1) for j, b in enumerate(binned)], 1)
    width = stats.shape[1]
    first = np.concatenate([[0], np.cumsum(distinct + width)])
    idx, val = np.empty(int(first[-1]), np.int32), np.empty(int(first[-1]), np.float32)
    spot = (first[:-1, None] + np.arange(width)).ravel()
    idx[spot], val[spot] = stats.ravel(), 1 / np.sqrt(width)
    place = np.arange(len(key)) + np.repeat(np.arange(1, n + 1) * width, distinct)
    idx[place], val[place] = key & (base - 1), times / norm[row]
    return first, idx, val


def dimension(n_metadata: int) -> int:
    return (1 << WORD_BITS) + (13 + n_metadata) * BINS


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, first: np.ndarray, idx: np.ndarray, val: np.ndarray) -> np.ndarray:
        """Probability of label 1, by the sum-of-squares identity; rows are never empty."""
        start = first[:-1]
        out = self.bias + np.add.reduceat(self.linear[idx] * val, start, dtype=np.float64)
        for f in range(self.factors.shape[1]):
            vx = self.factors[:, f][idx] * val
            out += 0.5 * (np.add.reduceat(vx, start, dtype=np.float64) ** 2 - np.add.reduceat(vx * vx, start, dtype=np.float64))
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, dim: int, *, rank: int = RANK, epochs: int = 5, rate: float = 0.15, decay: float = 2e-5, seed: int = 11) -> FactorisationMachine:
    """Adaptive gradient descent on the logistic loss; both labels weigh alike."""
    rng = np.random.default_rng(seed)
    bias, bias_g = 0.0, 1e-6
    w, w_g = np.zeros(dim), np.full(dim, 1e-6)
    v, v_g = rng.normal(0, 0.02, (dim, rank)), np.full((dim, rank), 1e-4)
    ones = int(label.sum())
    if not 0 < ones < len(label):
        return FactorisationMachine(0.0, np.zeros(dim, np.float32), np.zeros((dim, rank), np.float32))
    weight = np.where(label == 1, len(label) / (2 * ones), len(label) / (2 * (len(label) - ones)))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            idx, x = rows[i]
            own = v[idx]
            vx = own * x[:, None]
            total = vx.sum(0)
            z = bias + w[idx] @ x + 0.5 * (total @ total - (vx * vx).sum())
            g = weight[i] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label[i])
            bias_g += g * g
            bias -= rate * g / np.sqrt(bias_g)
            step = g * x + decay * w[idx]
            w_g[idx] += step * step
            w[idx] -= rate * step / np.sqrt(w_g[idx])
            step = g * (x[:, None] * total - own * (x * x)[:, None]) + decay * own
            v_g[idx] += step * step
            v[idx] = own - rate * step / np.sqrt(v_g[idx])
    return FactorisationMachine(bias, w.astype(np.float32), v.astype(np.float32))


def _metadata_arrays(batch: pa.RecordBatch, names: Sequence[str]) -> list[np.ndarray]:
    return [np.array(batch.column(m).cast(pa.float64()).to_pylist(), dtype=float) for m in names]


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, metadata: Sequence[str] = (), per_class: int = PER_CLASS) -> FactorisationMachine:
    """Fit on at most ``per_class`` labelled documents of each label, one row of each key. ``docs``: key, text and metadata; ``labels``: key, label."""
    prepare(spark)
    names = list(metadata)
    one = labels.filter(F.col("label").isin(0, 1) & F.col("key").isNotNull()).groupBy("key").agg(F.max("label").cast("int").alias("label"))
    sample = bounded_per_class(one, "label", "key", per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = column_bytes(batch.column("text"))
            meta = _metadata_arrays(batch, names)
            for at, end in blocks(offsets):
                first, idx, val = features(offsets, data, at, end, [m[at:end] for m in meta])
                pieces = [(idx[first[r] : first[r + 1]].tobytes(), val[first[r] : first[r + 1]].tobytes()) for r in range(end - at)]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(at, end - at), batch.column("label").slice(at, end - at), pa.array([p[0] for p in pieces], pa.binary()), pa.array([p[1] for p in pieces], pa.binary())], names=["key", "label", "idx", "val"])

    # the sample's size is bounded by per_class, so it may be broadcast
    taken = docs.select("key", "text", *names).join(F.broadcast(sample), "key").select("key", "label", "text", *names)
    found = gather(spark, taken.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, label int, idx binary, val binary"), "key")
    found.sort(key=lambda r: (r[0], bytes(r[1]), bytes(r[2])))
    rows = [(np.frombuffer(r[1], np.int32), np.frombuffer(r[2], np.float32).astype(np.float64)) for r in found]
    return fit(rows, np.array([r[0] for r in found], float), dimension(len(names)))


def score(spark: SparkSession, docs: DataFrame, model: FactorisationMachine, *, key: str = "doc_id", text: str = "text", metadata: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """(key, score, columns of ``keep``) of every row, over whole texts and without a shuffle. The model's size is fixed."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    names, out_cols = list(metadata), list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            offsets, data = column_bytes(batch.column("__text"))
            meta = _metadata_arrays(batch, [f"__meta_{m}" for m in names])
            for at, end in blocks(offsets):
                s = machine.score(*features(offsets, data, at, end, [m[at:end] for m in meta]))
                yield pa.RecordBatch.from_arrays([batch.column("__key").slice(at, end - at), pa.array(s), *(batch.column(f"__keep_{c}").slice(at, end - at) for c in out_cols)], names=["__key", "__score", *(f"__keep_{c}" for c in out_cols)])

    taken = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"), *(F.col(m).alias(f"__meta_{m}") for m in names), *(F.col(c).alias(f"__keep_{c}") for c in out_cols))
    schema = ", ".join([f"__key {docs.schema[key].dataType.simpleString()}", "__score double", *(f"`__keep_{c}` {docs.schema[c].dataType.simpleString()}" for c in out_cols)])
    return taken.mapInArrow(run, schema).select(F.col("__key").alias(key), F.col("__score").alias("score"), *(F.col(f"__keep_{c}").alias(c) for c in out_cols))


def fit_on_labels(spark: SparkSession, docs: DataFrame, labels: DataFrame, target: str = "quality") -> FactorisationMachine:
    """The machine for ``documents`` and ``labels``, learned only where crc32(doc_id) mod 3 is not 1."""
    own = labels.filter(fold_of("doc_id", 3) != 1).select(F.col("doc_id").alias("key"), F.col(target).alias("label"))
    return train(spark, docs.select(F.col("doc_id").alias("key"), "text", "n_chars"), own, metadata=["n_chars"])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; predicted is 1 where the score is 0.5 or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_on_labels(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(spark, docs, model, metadata=["n_chars"])
    held = F.coalesce(fold_of("doc_id", 3) == 1, F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
