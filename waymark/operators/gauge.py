"""Robust planar gauge of each component: how its local frame lies in the map's, by consensus of its candidates, or a reason why not.

Hypotheses are the means of pairs of candidates. The pairs are drawn by arithmetic hashes of the candidates' ids, the smallest of
each draw, so they depend on neither order nor partitions; their number is fixed, and every hypothesis is held against every
candidate of its component. Components of up to TASK_CANDIDATES are dealt to tasks as they are, and there drawn and held in NumPy, so
only candidates are shuffled; larger ones are spread, with counts combined on the map side: work is linear in a component. The winner
must be large enough and well ahead of the best hypothesis with other inliers; then its inliers are averaged with Huber
weights. A component that fails a gate has no gauge: nothing falls back to a plain mean.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geometry import normalize_angle
from waymark.session import fresh_path, materialize

#: Hypotheses, gates and scales of the estimate (metres, radians, shares).
HYPOTHESES, SAMPLE, LEAST_CANDIDATES, LEAST_SPAN = 64, 2, 3, 2.0
SIGMA, SIGMA_YAW, INLIER = 0.5, 0.2, 2.0
LEAST_INLIERS, LEAST_RATIO, LEAST_MARGIN = 3, 0.5, 0.15
HUBER_ROUNDS, HUBER_DELTA = 4, 2.0
#: Candidates of the largest component that goes to one task, and about as many as a task gets.
TASK_CANDIDATES = 1 << 16
#: Modulus and multipliers of the draws' two steps.
DRAW = (2147483647, 1103515245, 7654321, 48271, 1566083941)


def joint_residual(x: Column, y: Column, yaw: Column, mx: Column, my: Column, myaw: Column) -> Column:
    """Distance and turn from a model, each over its scale."""
    return F.sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) / SIGMA + F.abs(normalize_angle(yaw - myaw)) / SIGMA_YAW


def hypotheses(candidates: DataFrame, *, by: list[str]) -> DataFrame:
    """(by..., k, mx, my, myaw): means of pairs of two candidates (by..., id, x, y, yaw)."""
    m, a, step, low, high = DRAW
    j = F.col("j")
    drawn = candidates.select(*by, "id", "x", "y", "yaw", F.explode(F.sequence(F.lit(0), F.lit(2 * HYPOTHESES - 1))).alias("j"))
    u = (F.pmod("id", F.lit(m)) * a + j * F.lit(step).cast("long")) % m
    h = (u * low + F.floor(u / 32768) * high) % m
    one = drawn.groupBy(*by, "j").agg(F.min_by(F.struct("id", "x", "y", "yaw"), F.struct(h, F.col("id"))).alias("c"))
    pair = one.groupBy(*by, F.floor(j / 2).alias("k")).agg(*(F.max(F.when(j % 2 == s, F.col("c"))).alias(n) for s, n in ((0, "a"), (1, "b")))).filter("a.id <> b.id")
    mean = lambda c: (F.col(f"a.{c}") + F.col(f"b.{c}")) / 2
    yaw = F.atan2(F.sin("a.yaw") + F.sin("b.yaw"), F.cos("a.yaw") + F.cos("b.yaw"))
    return pair.select(*by, "k", mean("x").alias("mx"), mean("y").alias("my"), yaw.alias("myaw"))


def robust_gauge(candidates: DataFrame, *, by: list[str]) -> DataFrame:
    """(by..., candidates, inliers, ratio, second_ratio, reason, x, y, yaw); ``reason`` is null and the gauge given where it is anchored.

    ``candidates`` is (by..., id, x, y, yaw, weight, raw_x, raw_y), ids being distinct whole numbers in a component.
    """
    unnamed = F.greatest(F.lit(0), *(F.col(b).isNull().cast("int") for b in by)) > 0
    found = candidates.groupBy(*by).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.count_if((F.col("n") > TASK_CANDIDATES) | unnamed).alias("large")).first()
    if not found["large"]:
        return _dealt(candidates, by, found["rows"] or 0)
    sized = candidates.withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    large = (F.col("_n") > TASK_CANDIDATES) | unnamed
    spark = candidates.sparkSession
    spread = materialize(spark, sized.filter(large).drop("_n"), "large", path=fresh_path(spark, "large"))
    return _dealt(sized.filter(~large).drop("_n"), by, found["rows"]).unionByName(_spread(spread, by))


def _dealt(candidates: DataFrame, by: list[str], rows: int) -> DataFrame:
    """``robust_gauge`` of components that are small, many to a task."""
    kinds = dict(candidates.dtypes)
    values = ("x", "y", "yaw", "weight", "raw_x", "raw_y")
    plain = candidates.select(*by, F.col("id").cast("long").alias("id"), *(F.col(c).cast("double").alias(c) for c in values))
    bucket = F.pmod(F.xxhash64(*by), F.lit(rows // TASK_CANDIDATES + 1)).alias("_bucket")

    def run(t: pa.Table) -> pa.Table:
        codes = [t.column(b).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) for b in by]
        order = np.lexsort((t.column("id").to_numpy(), *codes))
        first = np.ones(t.num_rows, bool)
        first[1:] = np.any([c[order][1:] != c[order][:-1] for c in codes], axis=0)
        starts = np.flatnonzero(first)
        t = t.take(pa.array(order))
        own = {c: t.column(c).to_numpy(zero_copy_only=False) for c in ("id", "x", "y", "yaw")}
        own["weight"] = t.column("weight").fill_null(0.0).to_numpy(zero_copy_only=False)
        raw = [(t.column(c).fill_null(math.inf).to_numpy(), t.column(c).fill_null(-math.inf).to_numpy()) for c in ("raw_x", "raw_y")]
        with np.errstate(all="ignore"):
            out = _gauges(own, raw, starts)
        return pa.Table.from_arrays([*(t.column(b).take(pa.array(starts)) for b in by), *out], names=[*by, "candidates", "inliers", "ratio", "second_ratio", "reason", "x", "y", "yaw"])

    schema = ", ".join(f"`{b}` {kinds[b]}" for b in by) + ", candidates long, inliers long, ratio double, second_ratio double, reason string, x double, y double, yaw double"
    return plain.groupBy(bucket).applyInArrow(run, schema)


def _gauges(own: dict[str, np.ndarray], raw: list[tuple[np.ndarray, np.ndarray]], starts: np.ndarray) -> list[pa.Array]:
    """Columns of the components that begin at ``starts``, of candidates sorted by component and id."""
    ids, x, y, yaw, weight = (own[c] for c in ("id", "x", "y", "yaw", "weight"))
    n = np.diff(np.append(starts, len(ids)))
    seg = np.repeat(np.arange(len(starts)), n)
    total = lambda v: np.add.reduceat(v, starts)
    m, a, step, low, high = DRAW

    def drawn(j: int) -> np.ndarray:
        u = (np.mod(ids, m) * a + j * step) % m
        h = (u * low + u // 32768 * high) % m
        at = np.flatnonzero(h == np.minimum.reduceat(h, starts)[seg])
        return at[np.append(True, seg[at][1:] != seg[at][:-1])]

    def joint(mx: np.ndarray, my: np.ndarray, myaw: np.ndarray) -> np.ndarray:
        dx, dy, turn = x - mx[seg], y - my[seg], yaw - myaw[seg]
        return np.sqrt(dx * dx + dy * dy) / SIGMA + np.abs(math.pi - np.mod(math.pi - turn, 2 * math.pi)) / SIGMA_YAW

    mark = ids.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0x9E3779B97F4A7C15)):
        mark = ((mark + np.uint64(0x9E3779B97F4A7C15)) ^ (mark >> np.uint64(shift))) * np.uint64(factor)
    models, counts, marks = [], [], []
    for k in range(HYPOTHESES):
        p, q = drawn(2 * k), drawn(2 * k + 1)
        models.append(np.stack([(x[p] + x[q]) / 2, (y[p] + y[q]) / 2, np.arctan2(np.sin(yaw[p]) + np.sin(yaw[q]), np.cos(yaw[p]) + np.cos(yaw[q]))]))
        on = (joint(*models[-1]) < INLIER) & (ids[p] != ids[q])[seg]
        counts.append(total(on.astype(np.int64)))
        held = np.where(on, mark, np.uint64(0))
        marks.append(np.stack([np.bitwise_xor.reduceat(held, starts), total(held)]))
    counts, marks, models = np.stack(counts), np.stack(marks), np.stack(models)
    best, each = counts.argmax(0), np.arange(len(starts))
    inliers = counts[best, each]
    second = np.where((marks != marks[best, :, each].T).any(1), counts, 0).max(0)
    ratio, second_ratio = inliers / n, second / n
    span = np.sqrt(sum((np.maximum.reduceat(hi, starts) - np.minimum.reduceat(lo, starts)) ** 2 for lo, hi in raw))
    reason = np.select(
        [n < SAMPLE, (n < LEAST_CANDIDATES) & (span <= LEAST_SPAN), inliers < LEAST_INLIERS, (second > 0) & (ratio - second_ratio < LEAST_MARGIN), ratio < LEAST_RATIO],
        ["insufficient_candidates", "trajectory_span_too_small", "insufficient_consensus", "ambiguous_clusters", "low_consensus_ratio"], "",
    ).astype(object)
    anchored = reason == ""
    kept = (joint(*models[best, :, each].T) < INLIER) & anchored[seg]
    w = weight
    for i in range(HUBER_ROUNDS + 1):
        if i:
            j = joint(*mean)
            w = weight * np.where(j <= HUBER_DELTA, 1.0, HUBER_DELTA / j)
        sums = [total(np.where(kept, w * v, 0.0)) for v in (x, y, np.sin(yaw), np.cos(yaw), np.ones(len(w)))]
        mean = np.stack([sums[0] / sums[4], sums[1] / sums[4], np.arctan2(sums[2], sums[3])])
    finite = anchored & np.isfinite(mean.sum(0))
    reason[anchored] = None
    reason[anchored & ~finite] = "non_finite_gauge"
    return [pa.array(n), pa.array(inliers), pa.array(ratio), pa.array(second_ratio), pa.array(reason, pa.string()), *(pa.array(v, mask=~finite) for v in mean)]


def _spread(candidates: DataFrame, by: list[str]) -> DataFrame:
    """``robust_gauge`` of components of any size."""
    facts = candidates.groupBy(*by).agg(F.count("*").alias("candidates"), *(f(c).alias(f"{n}_{c}") for c in ("raw_x", "raw_y") for n, f in (("lo", F.min), ("hi", F.max))))
    span = F.sqrt(F.pow(F.col("hi_raw_x") - F.col("lo_raw_x"), 2) + F.pow(F.col("hi_raw_y") - F.col("lo_raw_y"), 2))
    model = hypotheses(candidates, by=by)
    near = joint_residual(*map(F.col, ("x", "y", "yaw", "mx", "my", "myaw"))) < INLIER
    mark = F.xxhash64("id")
    counts = candidates.join(model, by).filter(near).groupBy(*by, "k", "mx", "my", "myaw").agg(F.count("*").alias("n"), F.bit_xor(mark).alias("m1"), F.sum(mark.cast("decimal(20,0)")).alias("m2"))
    best = counts.groupBy(*by).agg(F.max(F.struct("n", (-F.col("k")).alias("k"), "mx", "my", "myaw", "m1", "m2")).alias("best"))
    other = counts.join(best, by).filter((F.col("m1") != F.col("best.m1")) | (F.col("m2") != F.col("best.m2"))).groupBy(*by).agg(F.max("n").alias("second"))
    found = facts.join(best, by, "left").join(other, by, "left")
    inliers, second = F.coalesce(F.col("best.n"), F.lit(0)), F.coalesce(F.col("second"), F.lit(0))
    ratio, second_ratio = inliers / F.col("candidates"), second / F.col("candidates")
    reason = (
        F.when(F.col("candidates") < SAMPLE, "insufficient_candidates").when((F.col("candidates") < LEAST_CANDIDATES) & (span <= LEAST_SPAN), "trajectory_span_too_small")
        .when(inliers < LEAST_INLIERS, "insufficient_consensus").when((second > 0) & (ratio - second_ratio < LEAST_MARGIN), "ambiguous_clusters").when(ratio < LEAST_RATIO, "low_consensus_ratio")
    )
    judged = found.select(*by, "candidates", inliers.alias("inliers"), ratio.alias("ratio"), second_ratio.alias("second_ratio"), reason.alias("reason"), "best.mx", "best.my", "best.myaw")
    kept = candidates.join(judged.filter("reason is null").select(*by, "mx", "my", "myaw"), by).filter(near).select(*by, "x", "y", "yaw", "weight")
    mean = _mean(kept, F.col("weight"), by)
    for _ in range(HUBER_ROUNDS):
        joint = joint_residual(*map(F.col, ("x", "y", "yaw", "gx", "gy", "gyaw")))
        huber = F.when(joint <= HUBER_DELTA, 1.0).otherwise(HUBER_DELTA / joint)
        mean = _mean(kept.join(mean, by), F.col("weight") * huber, by)
    out = judged.join(mean, by, "left")
    finite = F.coalesce(F.abs(F.col("gx") + F.col("gy") + F.col("gyaw")) < math.inf, F.lit(False))
    reason = F.coalesce("reason", F.when(~finite, "non_finite_gauge"))
    return out.select(*by, "candidates", "inliers", "ratio", "second_ratio", reason.alias("reason"), *(F.when(finite, F.col(g)).alias(c) for g, c in (("gx", "x"), ("gy", "y"), ("gyaw", "yaw"))))


def _mean(rows: DataFrame, weight: Column, by: list[str]) -> DataFrame:
    """Weighted mean place and circular mean of the yaw."""
    x, y, s, c = (F.sum(weight * v) for v in (F.col("x"), F.col("y"), F.sin("yaw"), F.cos("yaw")))
    return rows.groupBy(*by).agg((x / F.sum(weight)).alias("gx"), (y / F.sum(weight)).alias("gy"), F.atan2(s, c).alias("gyaw"))
