"""Stateful stream operators: admission by rate, covariance accumulation, latching, rehearsal and bounded memory.

State is one small row for each key, whatever the stream's length. Inside a micro-batch rows are taken in time order;
rows older than the state are handled as each operator says, since the source has no watermark of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _in_order(frames: Iterator[pd.DataFrame], *columns: str) -> pd.DataFrame:
    parts = [f for f in frames if len(f)]
    return pd.concat(parts).sort_values(list(columns), kind="stable") if parts else pd.DataFrame()


def admit(stream: DataFrame, *, key: str, time: str, period: float, variance: str | None = None) -> DataFrame:
    """Rows at least ``period`` after the last accepted one; rows older than it pass too.

    With ``variance``, an accepted row carries the largest variance since the one before (``max_variance``).
    """
    names = [f.name for f in stream.schema]
    extra = ", max_variance double" if variance else ""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema) + extra

    def run(_key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, worst = state.get if state.exists else (None, 0.0)
        rows, keep, seen = _in_order(frames, time), [], []
        for i, t in enumerate(rows[time].astype(float) if len(rows) else []):
            if variance:
                worst = max(worst, float(rows[variance].iloc[i]))
            if last is None or not 0 < t - last < period:
                keep.append(i)
                seen.append(worst)
                last, worst = t, 0.0
        state.update((last, worst))
        if keep:
            out = rows.iloc[keep][names].copy()
            if variance:
                out["max_variance"] = seen
            yield out

    return stream.groupBy(key).applyInPandasWithState(run, schema, "last double, worst double", "append", GroupStateTimeout.NoTimeout)


def gate_frames(stream: DataFrame, *, key: str, arrival: str, stamp: str, is_sample: str, value: str, buffer: int = 64) -> DataFrame:
    """Frames (key, arrival, stamp, sample) that lie within the samples received so far, each with the sample interpolated at its stamp.

    A frame older than the first sample received, or not older than the last one, is skipped; before any sample all frames pass,
    without a value. The newest ``buffer`` samples are kept, so a frame older than these passes without a value too.
    """
    kinds = dict(stream.dtypes)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        oldest, newest, times, values = state.get if state.exists else (None, None, [], [])
        times, values, out = list(times), list(values), []
        rows = _in_order(frames, arrival)
        for row in rows.itertuples(index=False) if len(rows) else []:
            t = float(getattr(row, stamp))
            if getattr(row, is_sample):
                oldest, newest = t if oldest is None else oldest, t
                times, values = [*times, t][-buffer:], [*values, float(getattr(row, value))][-buffer:]
            elif oldest is None or oldest <= t < newest:
                before = max(((a, v) for a, v in zip(times, values, strict=True) if a <= t), default=None)
                after = min(((a, v) for a, v in zip(times, values, strict=True) if a > t), default=None)
                between = before[1] + (after[1] - before[1]) * (t - before[0]) / (after[0] - before[0]) if before and after else None
                out.append((k[0], getattr(row, arrival), t, between))
        state.update((oldest, newest, times, values))
        if out:
            yield pd.DataFrame(out, columns=[key, arrival, stamp, "sample"]).astype({"sample": float})

    schema = f"`{key}` {kinds[key]}, `{arrival}` {kinds[arrival]}, `{stamp}` double, sample double"
    return stream.groupBy(key).applyInPandasWithState(run, schema, "oldest double, newest double, times array<double>, readings array<double>", "append", GroupStateTimeout.NoTimeout)


def latch(stream: DataFrame, *, key: str, time: str, is_frame: str, value: str) -> DataFrame:
    """Frames (key, time, latched): each takes the last value that came since the frame before, and clears it."""
    kinds = dict(stream.dtypes)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else None
        out = []
        rows = _in_order(frames, time)
        for row in rows.itertuples(index=False) if len(rows) else []:
            if getattr(row, is_frame):
                out.append((k[0], getattr(row, time), held))
                held = None
            else:
                held = getattr(row, value)
        state.update((held,))
        if out:
            yield pd.DataFrame(out, columns=[key, time, "latched"])

    return stream.groupBy(key).applyInPandasWithState(run, f"`{key}` {kinds[key]}, `{time}` {kinds[time]}, latched {kinds[value]}", f"held {kinds[value]}", "append", GroupStateTimeout.NoTimeout)


def rehearse(stream: DataFrame, *, key: str, time: str, words: str, threshold: float, memory: int) -> DataFrame:
    """Places (key, time, weight, merged_into): a row like the place before it adds to that place's weight instead of making one.

    Words are a list of strings; likeness is the share of words in common. ``memory`` places are remembered for each
    key, the lightest and then oldest being forgotten first; ``forgotten`` is the time of one that was.
    """
    kinds = dict(stream.dtypes)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, weights, last = (list(state.get[0]), list(state.get[1]), list(state.get[2])) if state.exists else ([], [], [])
        out = []
        rows = _in_order(frames, time)
        for t, own in zip(rows[time].astype(float), rows[words], strict=True) if len(rows) else []:
            own = list(own) if own is not None else []
            most = max(len(own), len(last))
            common = sum(min(own.count(x), last.count(x)) for x in set(own))
            if times and most and common / most >= threshold:
                weights[-1] += 1
                out.append((k[0], t, weights[-1], times[-1], None))
            else:
                gone = None
                if len(times) >= memory:
                    drop = min(range(len(times)), key=lambda i: (weights[i], times[i]))
                    gone = times.pop(drop)
                    weights.pop(drop)
                times.append(t)
                weights.append(0)
                last = own
                out.append((k[0], t, 0, None, gone))
        state.update((times, weights, last))
        if out:
            yield pd.DataFrame(out, columns=[key, time, "weight", "merged_into", "forgotten"])

    schema = f"`{key}` {kinds[key]}, `{time}` double, weight int, merged_into double, forgotten double"
    return stream.groupBy(key).applyInPandasWithState(run, schema, "times array<double>, weights array<int>, last array<string>", "append", GroupStateTimeout.NoTimeout)


def windowed(stream: DataFrame, *, time: str, late: str, size: str, slide: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Counts and sums in tumbling or sliding windows; rows later than ``late`` behind the newest are dropped."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(w.alias("window"), *(by or [])).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, *, time: str, late: str, gap: str, by: list[str]) -> DataFrame:
    """Sessions that end after a gap."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("window"), *by).agg(F.count("*").alias("n"))
