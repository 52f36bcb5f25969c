"""Time series of a key: deltas, islands, sessions, durations, resampling, as-of and interval joins.

Every function works inside ``by`` keys, so a series is one window partition; none orders a whole table in one task.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def deltas(df: DataFrame, value: str, *, by: list[str], order: list[str]) -> DataFrame:
    """Difference of each value and the one before it; null on the first row."""
    return df.withColumn("delta", F.col(value) - F.lag(value).over(_w(by, order)))


def running_distance(df: DataFrame, axes: list[str], *, by: list[str], order: list[str]) -> DataFrame:
    """Step length and distance along the series, 0 on the first row."""
    w = _w(by, order)
    step = F.sqrt(sum(((F.col(a) - F.lag(a).over(w)) * (F.col(a) - F.lag(a).over(w)) for a in axes), F.lit(0.0)))
    out = df.withColumn("step", F.coalesce(step, F.lit(0.0)))
    return out.withColumn("distance", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def islands(df: DataFrame, value: str, *, by: list[str], order: list[str]) -> DataFrame:
    """Adds ``run``, the number of the run of equal values; null breaks a run and belongs to none."""
    w = _w(by, order)
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    run = F.sum(changed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("run", F.when(F.col(value).isNotNull(), run))


def run_summary(df: DataFrame, value: str, *, by: list[str], order: list[str], time: str) -> DataFrame:
    """First and last time and length of each run, with the value of the run before (runs are numbered with nulls between)."""
    runs = islands(df, value, by=by, order=order).filter("run is not null")
    out = runs.groupBy(*by, "run").agg(F.first(value).alias(value), F.min(time).alias("from_time"), F.max(time).alias("to_time"), F.count("*").alias("n"))
    return out.withColumn("previous", F.lag(value).over(_w(by, ["run"])))


def sessions(df: DataFrame, time: str, gap: float, *, by: list[str], order: list[str]) -> DataFrame:
    """Adds ``session``: a new one starts where the absolute time step is above the gap."""
    w = _w(by, order)
    far = F.coalesce(F.abs(F.col(time) - F.lag(time).over(w)) > gap, F.lit(False))
    return df.withColumn("session", F.sum(far.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def state_durations(df: DataFrame, state: str, time: str, *, by: list[str], order: list[str]) -> DataFrame:
    """Total time of each state; a row lasts until the next one, the last until the series' last time."""
    until = F.coalesce(F.lead(time).over(_w(by, order)), F.col(time))
    return df.withColumn("_d", until - F.col(time)).groupBy(*by, state).agg(F.sum("_d").alias("duration"), F.count("*").alias("n"))


def worst_of_bucket(df: DataFrame, bucket: Column, order: list[Column], *, by: list[str], last: list[str]) -> DataFrame:
    """The first row of each bucket by ``order`` (ascending, nulls first), and the very last row of the series (by ``last``, which tells its rows apart).

    One aggregation gives each bucket's first and last row; which of the last rows ends the series is seen from these few.
    """
    row = F.struct(*(F.col(c) for c in df.columns))
    both = df.groupBy(*by, bucket.alias("_b")).agg(F.min_by(row, F.struct(*order)).alias("_first"), F.max_by(row, F.struct(*last)).alias("_last"))
    ends = F.row_number().over(Window.partitionBy(*by).orderBy(*(F.desc(f"_last.{c}") for c in last))) == 1
    same = reduce(lambda p, q: p & q, (F.col(f"_first.{c}").eqNullSafe(F.col(f"_last.{c}")) for c in last))
    taken = F.when(ends & ~same, F.array("_first", "_last")).otherwise(F.array("_first"))
    return both.select(taken.alias("_t")).select(F.inline("_t"))


def local_maxima(df: DataFrame, value: str, *, by: list[str], order: list[str]) -> DataFrame:
    """Rows above both neighbours; the ends are held against one."""
    w = _w(by, order)
    v, before, after = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    alone = before.isNull() & after.isNull()
    return df.withColumn("_m", F.coalesce(v > before, F.lit(True)) & F.coalesce(v > after, F.lit(True)) & ~alone).filter("_m").drop("_m")


def stride(df: DataFrame, k: int, *, by: list[str], order: list[str]) -> DataFrame:
    """Every k-th row and always the last."""
    w = _w(by, order)
    return df.withColumn("_n", F.row_number().over(w) - 1).withColumn("_l", F.lead(order[0]).over(w).isNull()).filter((F.col("_n") % k == 0) | F.col("_l")).drop("_n", "_l")


def evenly(df: DataFrame, limit: int, *, by: list[str], order: list[str]) -> DataFrame:
    """At most ``limit`` rows of each series at the indices round(i * (n - 1) / (limit - 1)), halves to even; one row if limit is 1 or less.

    Row j is taken if some i has it as its index, so the indices need no table of their own.
    """
    w = _w(by, order)
    out = df.withColumn("_j", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    if limit <= 1:
        return out.filter("_j = 0").drop("_j", "_n")
    span = F.lit(limit - 1)
    i = F.col("_j") * span / F.greatest(F.col("_n") - 1, F.lit(1))
    near = [F.bround(F.floor(i + d) * (F.col("_n") - 1) / span).cast("long") == F.col("_j") for d in (0, 1)]
    valid = [(F.floor(i + d) <= limit - 1) for d in (0, 1)]
    hit = (near[0] & valid[0]) | (near[1] & valid[1])
    return out.filter((F.col("_n") <= limit) | hit).drop("_j", "_n")


def not_increasing(df: DataFrame, time: str, *, by: list[str], order: list[str]) -> DataFrame:
    """Rows whose time is not above the one before."""
    return df.withColumn("_p", F.lag(time).over(_w(by, order))).filter(F.col(time) <= F.col("_p")).drop("_p")


def clock_offsets(df: DataFrame, monotonic: str, utc: str, limit: float, *, by: list[str], order: list[str]) -> DataFrame:
    """Adds ``discontinuity``: the offset of the two clocks moved by more than the limit since the row before."""
    w = _w(by, order)
    offset = F.col(utc) - F.col(monotonic)
    return df.withColumn("offset", offset).withColumn("discontinuity", F.coalesce(F.abs(F.col("offset") - F.lag("offset").over(w)) > limit, F.lit(False)))


def _merge(left: DataFrame, right: DataFrame, *, by: list[str], time: str, right_time: str, payload: list[str]) -> DataFrame:
    """Both series in one table, ready for one sort: ``_right`` marks the right one's rows."""
    cols = [F.col(c) for c in by]
    a = left.select(*cols, F.col(time).cast("double").alias("_t"), F.struct(*left.columns).alias("_row"), F.lit(0).alias("_right"), F.lit(None).cast(right.select(F.struct(F.col(right_time).cast("double").alias("t"), *payload)).schema[0].dataType).alias("_m"))
    b = right.filter(F.col(right_time).isNotNull() & ~F.isnan(F.col(right_time).cast("double"))).select(*cols, F.col(right_time).cast("double").alias("_t"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row"), F.lit(1).alias("_right"), F.struct(F.col(right_time).cast("double").alias("t"), *payload).alias("_m"))
    return a.unionByName(b)


def bracket(left: DataFrame, right: DataFrame, *, by: list[str], time: str, right_time: str, payload: list[str]) -> DataFrame:
    """Left rows with ``before`` and ``after``: the right rows (t, payload) around them, one sort for both.

    ``before`` is the last right row at or before the time, ``after`` the first at or after it. Among right rows of one
    time the first by payload counts.
    """
    once = right.groupBy(*by, right_time).agg(F.min(F.struct(*payload)).alias("_p")).select(*by, right_time, "_p.*")
    rows = _merge(left, once, by=by, time=time, right_time=right_time, payload=payload)
    back = Window.partitionBy(*by).orderBy(F.col("_t"), F.desc("_right")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(F.desc("_t"), F.desc("_right")).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("before", F.last("_m", ignorenulls=True).over(back)).withColumn("after", F.last("_m", ignorenulls=True).over(ahead))
    return out.filter("_right = 0").select("_row.*", "before", "after")


def nearest(left: DataFrame, right: DataFrame, *, by: list[str], time: str, right_time: str, payload: list[str], limit: float = math.inf) -> DataFrame:
    """Left rows with ``match``: the right row nearest in time, the earlier at ties, null beyond the limit."""
    out = bracket(left, right, by=by, time=time, right_time=right_time, payload=payload)
    t = F.col(time).cast("double")
    db, da = t - F.col("before.t"), F.col("after.t") - t
    pick = F.when(db.isNotNull() & (da.isNull() | (db <= da)), F.col("before")).otherwise(F.col("after"))
    gap = F.least(db, da)
    return out.withColumn("match", F.when(gap <= limit, pick)).drop("before", "after")


def interpolate(left: DataFrame, right: DataFrame, *, by: list[str], time: str, right_time: str, value: str, max_gap: float = math.inf) -> DataFrame:
    """Left rows with ``value`` interpolated between the right rows around them; null outside, or across a longer gap."""
    out = bracket(left, right, by=by, time=time, right_time=right_time, payload=[value])
    t, t0, t1 = F.col(time).cast("double"), F.col("before.t"), F.col("after.t")
    v0, v1 = F.col(f"before.{value}"), F.col(f"after.{value}")
    inner = F.when(t1 == t0, v0).otherwise(v0 + (v1 - v0) * (t - t0) / (t1 - t0))
    return out.withColumn("interpolated", F.when((t1 - t0) <= max_gap, inner)).drop("before", "after")


def truth_between(left: DataFrame, truth: DataFrame, *, by: list[str], time: str, truth_time: str, value: str, limit: float) -> DataFrame:
    """Left rows with ``truth`` interpolated, only those that have one: a truth row strictly after the time, one at or before it, and gaps to both within the limit.

    A row at a truth row's very time takes its value whatever the gap after it; at or after the last truth row there is none.
    """
    out = bracket(left, truth, by=by, time=time, right_time=truth_time, payload=[value])
    last = truth.groupBy(*by).agg(F.max(truth_time).cast("double").alias("_last"))
    t, t0, t1 = F.col(time).cast("double"), F.col("before.t"), F.col("after.t")
    v0, v1 = F.col(f"before.{value}"), F.col(f"after.{value}")
    between = F.when(t == t0, v0).when((t1 - t <= limit) & (t - t0 <= limit), v0 + (v1 - v0) * (t - t0) / (t1 - t0))
    found = out.join(last, by).filter(t0.isNotNull() & (t < F.col("_last"))).withColumn("truth", between).filter((t == t0) | ((t1 - t <= limit) & (t - t0 <= limit)))
    return found.drop("before", "after", "_last")


def following(df: DataFrame, *, by: list[str], order: str, width: int = 1 << 16, into: str = "next") -> DataFrame:
    """Rows with the next larger-or-equal value of ``order``, a whole number, among the rows of their key; null for the last.

    A task sorts only the values of one key within ``width``; the last row of such a stretch gets the first value of the next one
    that has rows, from a table of one row for each. Keys that are null go together.
    """
    rows = df.withColumn("_b", F.floor(F.col(order) / width))
    inner = F.lead(order).over(Window.partitionBy(*by, "_b").orderBy(order))
    names = [f"_k{i}" for i in range(len(by))]
    first = rows.groupBy(*(F.col(c).alias(n) for c, n in zip(by, names, strict=True)), F.col("_b").alias("_kb")).agg(F.min(order).alias("_f"))
    first = first.withColumn("_n", F.lead("_f").over(Window.partitionBy(*names).orderBy("_kb"))).drop("_f")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(n)) for c, n in zip([*by, "_b"], [*names, "_kb"], strict=True)))
    return rows.withColumn("_i", inner).join(first, same).withColumn(into, F.coalesce("_i", "_n")).select(*df.columns, into)


def resample(df: DataFrame, time: str, value: str, period: float, *, by: list[str], max_gap: float) -> DataFrame:
    """(by..., t, value, status): a row each period from the first to the last time, interpolated over gaps up to ``max_gap``."""
    ends = df.groupBy(*by).agg(F.ceil(F.min(time) / period).cast("long").alias("lo"), F.floor(F.max(time) / period).cast("long").alias("hi")).filter("lo <= hi")
    ticks = ends.withColumn("_k", F.explode(F.sequence("lo", "hi"))).select(*by, (F.col("_k") * period).alias("t"))
    out = interpolate(ticks, df.select(*by, F.col(time).alias("_rt"), value), by=by, time="t", right_time="_rt", value=value, max_gap=max_gap)
    return out.select(*by, "t", F.col("interpolated").alias("value"), F.when(F.col("interpolated").isNull(), "no_reliable_position").otherwise("interpolated").alias("status"))


def stab(points: DataFrame, intervals: DataFrame, *, by: list[str], time: str, start: str, end: str, width: float) -> DataFrame:
    """Points joined with the intervals (closed at both ends) they lie in, by an equi-join on buckets of ``width``."""
    a = points.withColumn("_k", F.floor(F.col(time) / width).cast("long"))
    b = intervals.withColumn("_k", F.explode(F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor(F.col(end) / width).cast("long"))))
    return a.join(b, [*by, "_k"]).filter(F.col(time).between(F.col(start), F.col(end))).drop("_k")


def overlaps(left: DataFrame, right: DataFrame, *, by: list[str], start: str, end: str, other_start: str, other_end: str, width: float) -> DataFrame:
    """Pairs of intervals that overlap, ends included: they meet in the first bucket that both cover, and only there."""
    a = left.withColumn("_k", F.explode(F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor(F.col(end) / width).cast("long"))))
    b = right.withColumn("_k", F.explode(F.sequence(F.floor(F.col(other_start) / width).cast("long"), F.floor(F.col(other_end) / width).cast("long"))))
    first = F.floor(F.greatest(F.col(start), F.col(other_start)) / width).cast("long")
    return a.join(b, [*by, "_k"]).filter((F.col(end) >= F.col(other_start)) & (F.col(start) <= F.col(other_end)) & (F.col("_k") == first)).drop("_k")


def correlate(left: DataFrame, right: DataFrame, *, by: list[str], index: str, a: str, b: str) -> DataFrame:
    """(by..., lag, n, xcorr, xcov) at all lags that occur: pairs, raw cross-correlation, and raw cross-covariance about each side's mean.

    Every row of a key meets every row of it on the other side, as all lags need: quadratic in the indices of a key (days, not seconds).
    """
    w = Window.partitionBy(*by)
    x = left.select(*by, F.col(index).alias("_i"), F.col(a).alias("_a"), (F.col(a) - F.avg(a).over(w)).alias("_da"))
    y = right.select(*by, F.col(index).alias("_j"), F.col(b).alias("_b"), (F.col(b) - F.avg(b).over(w)).alias("_db"))
    pairs = x.join(y, by).groupBy(*by, (F.col("_j") - F.col("_i")).cast("int").alias("lag"))
    return pairs.agg(F.count("*").alias("n"), F.sum(F.col("_a") * F.col("_b")).alias("xcorr"), F.sum(F.col("_da") * F.col("_db")).alias("xcov"))


def latest_before(frames: DataFrame, values: DataFrame, *, by: list[str], time: str, value_time: str, value: str) -> DataFrame:
    """A latch: each frame takes the last value that came since the frame before it; older ones are replaced or gone."""
    w = _w(by, [time])
    held = frames.withColumn("_prev", F.lag(time).over(w))
    out = bracket(held, values, by=by, time=time, right_time=value_time, payload=[value])
    fresh = F.col("before.t").isNotNull() & (F.col("_prev").isNull() | (F.col("before.t") > F.col("_prev")))
    return out.withColumn("latched", F.when(fresh, F.col(f"before.{value}"))).drop("_prev", "before", "after")
