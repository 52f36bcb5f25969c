"""Toxicity as severity grades, by cumulative-link (ordinal) regression on sparse text features.

A text's features are the presence of hashed words and of their first four, five and six bytes. One weight vector is
shared by all ordered thresholds: P(grade <= j) = logistic(threshold_j - w.x). The expected severity is the sum of the
probabilities of exceeding each threshold. Weights are sparse (proximal steps), so plain texts rest on the thresholds.

Defined edge cases: null, empty and wordless texts have no feature and get the grade probabilities of the thresholds
alone; repeated rows score alike; null and negative grades are ignored and of repeated labels the largest counts; with fewer than
two grades in the labels every expected severity is 0. Labels with more than 64 grades are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.sampling import bounded_per_class, fold_of, gather
from waymark.llm.text import ALNUM, Words, blocks, column_bytes
from waymark.session import prepare

BITS = 20
PREFIXES = (4, 5, 6)
#: Labelled documents taken for fitting, per grade at most.
PER_CLASS = 3000
#: Features kept by their chi-square with the label.
SELECTED = 2048


def presence(offsets: np.ndarray, data: np.ndarray, at: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word and prefix of rows at..end, with repetitions."""
    w = Words(offsets, data, at, end, table=ALNUM, fold=True)
    ids = [w.hashes()]
    rows = [w.row]
    for n in PREFIXES:
        long = np.flatnonzero(w.stop - w.start > n)
        with np.errstate(over="ignore"):
            ids.append(w.span_hash(w.start[long], w.start[long] + n) + np.uint64(n << 40))
        rows.append(w.row[long])
    return np.concatenate(rows), (np.concatenate(ids) >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class OrdinalModel:
    """``position[f]`` is the place of hashed feature f among the selected ones, or -1."""

    position: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def exceed(self, offsets: np.ndarray, data: np.ndarray, at: int, end: int) -> np.ndarray:
        """P(grade > j) of each row, one column for each threshold."""
        rows, ids = presence(offsets, data, at, end)
        place = self.position[ids]
        known = place >= 0
        key = np.unique(rows[known].astype(np.int64) * len(self.weights) + place[known])
        s = np.bincount(key // len(self.weights), weights=self.weights[key % len(self.weights)], minlength=end - at)
        return _logistic(s[:, None] - self.thresholds[None, :])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grade: np.ndarray, width: int, *, steps: int = 400, rate: float = 0.08, sparsity: float = 2e-4, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by full-batch adaptive gradients with soft-thresholded weights."""
    n, top = len(grade), int(grade.max())
    share = np.array([(grade <= j).mean() for j in range(top)]).clip(1e-3, 1 - 1e-3)
    theta = np.log(share / (1 - share))
    gap = np.log(np.maximum(np.diff(theta), 1e-2))
    w, base = np.zeros(width), theta[0]
    m, v = np.zeros(width + top), np.zeros(width + top)
    for t in range(1, steps + 1):
        theta = base + np.concatenate([[0.0], np.cumsum(np.exp(gap))])
        s = np.bincount(rows, weights=w[cols], minlength=n)
        padded = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = _cdf(padded[grade + 1] - s), _cdf(padded[grade] - s)
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_s = (d_hi - d_lo) / n  # of the negative log-likelihood
        g_theta = np.zeros(top)
        inner = grade < top
        np.add.at(g_theta, grade[inner], -d_hi[inner] / n)
        inner = grade > 0
        np.add.at(g_theta, grade[inner] - 1, d_lo[inner] / n)
        tail = np.cumsum(g_theta[::-1])[::-1]
        grad = np.concatenate([np.bincount(cols, weights=g_s[rows], minlength=width) + ridge * w, [tail[0]], tail[1:] * np.exp(gap)])
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step[:width]
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparsity / (np.sqrt(v[:width] / (1 - 0.999**t)) + 1e-3), 0)
        base -= step[width]
        gap -= step[width + 1 :]
    return w, base + np.concatenate([[0.0], np.cumsum(np.exp(gap))])


def _cdf(x: np.ndarray) -> np.ndarray:
    return np.where(np.isposinf(x), 1.0, np.where(np.isneginf(x), 0.0, _logistic(np.where(np.isfinite(x), x, 0))))


def fit(features: list[np.ndarray], grade: np.ndarray) -> OrdinalModel:
    """Select features by chi-square of presence with grade > 0, and fit one threshold between each two grades that the labels have.

    Binary labels thus give one threshold, and the expected severity is the probability of the label.
    """
    if not len(grade) or len(np.unique(grade)) < 2:
        return OrdinalModel(np.full(1 << BITS, -1, np.int32), np.zeros(1), np.full(1, 40.0))
    toxic = grade > 0
    counts = [np.zeros(1 << BITS), np.zeros(1 << BITS)]
    for f, y in zip(features, toxic, strict=True):
        counts[int(y)][f] += 1
    clean, bad = counts
    n_bad, n_clean = toxic.sum(), (~toxic).sum()
    seen = clean + bad
    expected = seen * n_bad / len(grade)
    chi = np.where(seen >= 3, (bad - expected) ** 2 / np.maximum(expected, 1e-9) + (clean - (seen - expected)) ** 2 / np.maximum(seen - expected, 1e-9), 0)
    chosen = np.sort(np.argsort(-chi, kind="stable")[:SELECTED])
    chosen = chosen[chi[chosen] > 6.6]
    if not len(chosen):
        chosen = np.array([int(chi.argmax())])
    position = np.full(1 << BITS, -1, np.int32)
    position[chosen] = np.arange(len(chosen))
    places = [position[f] for f in features]
    places = [np.unique(p[p >= 0]) for p in places]
    _, grade = np.unique(grade, return_inverse=True)
    rows = np.repeat(np.arange(len(places)), [len(p) for p in places])
    weights, thresholds = fit_ordinal(rows, np.concatenate(places), grade.astype(int), len(chosen))
    return OrdinalModel(position, weights, thresholds)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = column_bytes(batch.column("text"))
        for at, end in blocks(offsets):
            rows, ids = presence(offsets, data, at, end)
            key = np.unique((rows.astype(np.int64) << BITS) | ids)
            first = np.searchsorted(key, np.arange(end - at + 1) << BITS)
            ids = (key & ((1 << BITS) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("key").slice(at, end - at), batch.column("grade").slice(at, end - at), pa.array([ids[first[r] : first[r + 1]].tobytes() for r in range(end - at)], pa.binary())], names=["key", "grade", "ids"])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS) -> OrdinalModel:
    """Fit on at most ``per_class`` documents of each grade, one row of each key. ``docs``: key, text; ``labels``: key, grade (0 is clean)."""
    prepare(spark)
    one = labels.filter((F.col("grade") >= 0) & F.col("key").isNotNull()).groupBy("key").agg(F.max("grade").cast("int").alias("grade"))
    sample = bounded_per_class(one, "grade", "key", per_class)
    # the sample's size is bounded by per_class, so it may be broadcast
    taken = docs.select("key", "text").join(F.broadcast(sample), "key").select("key", "grade", "text")
    found = gather(spark, taken.mapInArrow(_examples, f"key {docs.schema['key'].dataType.simpleString()}, grade int, ids binary"), "key")
    found.sort(key=lambda r: (r[0], bytes(r[1])))
    return fit([np.frombuffer(r[1], np.int32) for r in found], np.array([r[0] for r in found], int))


def severity(spark: SparkSession, docs: DataFrame, model: OrdinalModel, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, expected_severity, severity) of every row: P(grade > 0), the expected grade, the median grade."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            offsets, data = column_bytes(batch.column(1))
            for at, end in blocks(offsets):
                p = fitted.exceed(offsets, data, at, end)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(p[:, 0]), pa.array(p.sum(1)), pa.array((p >= 0.5).sum(1).astype(np.int32))], names=[key, "score", "expected_severity", "severity"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double, expected_severity double, severity int")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, learned where crc32(doc_id) mod 3 is not 1; predicted is 1 where P(toxic) >= 0.5."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold_of("doc_id", 3) != 1).select(F.col("doc_id").alias("key"), F.col("toxic").alias("grade"))
    model = train(spark, docs.withColumnRenamed("doc_id", "key"), labels)
    held = F.coalesce(fold_of("doc_id", 3) == 1, F.lit(True))
    out = severity(spark, docs, model)
    return out.select("doc_id", held.alias("held_out"), "score", "expected_severity", "severity", (F.col("score") >= 0.5).cast("int").alias("predicted"))
