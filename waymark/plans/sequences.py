"""Sequence queries; a user's events are a trajectory in time, ``value`` its coordinate, ``event_type`` its state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators import sequences as S
from waymark.plans.base import query

_E = "WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1000000.0::DOUBLE AS t, props FROM events)"


def events(table) -> DataFrame:
    return table("events").select("event_id", "user_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"), "props")


BY, ORDER = ["user_id"], ["t", "event_id"]


@query("WIN-01 AGG-12", f"{_E} SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id), 6) AS delta FROM e")
def consecutive_deltas(table):
    """Change of value from event to event."""
    return S.deltas(events(table), "value", by=BY, order=ORDER).select("event_id", F.round("delta", 6).alias("delta"))


@query(
    "WIN-02 AGG-11",
    f"""{_E}, s AS (SELECT *, coalesce(abs(value - lag(value) OVER w), 0) AS step FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, round(step, 4) AS step, round(sum(step) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 2) AS distance FROM s""",
)
def trajectory_distance(table):
    """Distance along each trajectory."""
    out = S.running_distance(events(table), ["value"], by=BY, order=ORDER)
    return out.select("event_id", F.round("step", 4).alias("step"), F.round("distance", 2).alias("distance"))


_RUNS = f"""{_E}, f AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f),
g AS (SELECT user_id, run, min(event_type) AS event_type, min(t) AS from_time, max(t) AS to_time, count(*) AS n FROM r GROUP BY user_id, run)"""


@query("WIN-03 WIN-04 GRA-09", f"{_RUNS} SELECT user_id, CAST(run AS BIGINT) AS run, event_type, from_time, to_time, n, lag(event_type) OVER (PARTITION BY user_id ORDER BY run) AS previous FROM g")
def gaps_islands_runs(table):
    """Runs of one state with their ends, length and the state before."""
    return S.run_summary(events(table), "event_type", by=BY, order=ORDER, time="t").select("user_id", F.col("run").cast("long").alias("run"), "event_type", "from_time", "to_time", "n", "previous")


_SESS = f"""{_E}, f AS (SELECT *, CASE WHEN abs(t - lag(t) OVER w) > 21600 THEN 1 ELSE 0 END AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM f)"""


@query("WIN-08", f"{_SESS} SELECT event_id, CAST(session AS BIGINT) AS session FROM s")
def session_split(table):
    """Sessions split at gaps of more than six hours."""
    return S.sessions(events(table), "t", 21600, by=BY, order=ORDER).select("event_id", "session")


@query(
    "AGG-09 AGG-07 AGG-08",
    f"""{_SESS} SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, round(min(value), 4) AS lo, round(max(value), 4) AS hi, round(avg(value), 7) AS mean, round(coalesce(var_samp(value), 0), 6) AS variance, round(sum(value), 3) AS total, round(sum(value * value), 4) AS squares, round(100.0 * count(value) / count(*), 2) AS known FROM s GROUP BY user_id, session""",
)
def session_stats(table):
    """Statistics of each session."""
    v = F.col("value")
    out = S.sessions(events(table), "t", 21600, by=BY, order=ORDER).groupBy("user_id", "session")
    return out.agg(F.count("*").alias("n"), F.round(F.min(v), 4).alias("lo"), F.round(F.max(v), 4).alias("hi"), F.round(F.avg(v), 7).alias("mean"), F.round(F.coalesce(F.var_samp(v), F.lit(0.0)), 6).alias("variance"), F.round(F.sum(v), 3).alias("total"), F.round(F.sum(v * v), 4).alias("squares"), F.round(100.0 * F.count(v) / F.count("*"), 2).alias("known"))


@query("AGG-24", f"{_E}, d AS (SELECT user_id, event_type, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id), t) - t AS d FROM e) SELECT user_id, event_type, round(sum(d), 2) AS duration, count(*) AS n FROM d GROUP BY ALL")
def state_durations(table):
    """Time each user spends in each state."""
    return S.state_durations(events(table), "event_type", "t", by=BY, order=ORDER).select("user_id", "event_type", F.round("duration", 2).alias("duration"), "n")


@query(
    "WIN-10",
    f"""{_E}, r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, floor(t / 86400) ORDER BY CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END DESC, value, t DESC, event_id) AS rn, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) IS NULL AS e FROM e)
SELECT event_id FROM r WHERE rn = 1 OR e""",
)
def per_bucket_worst(table):
    """The row of highest risk of each user and day, and the last of all."""
    risk = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).otherwise(1)
    rows = events(table).select("event_id", "user_id", "t", "value", (-risk).alias("risk"))
    return S.worst_of_bucket(rows, F.floor(F.col("t") / 86400), [F.col("risk"), F.col("value"), -F.col("t"), F.col("event_id")], by=BY, last=ORDER).select("event_id")


@query("WIN-11", f"{_E}, n AS (SELECT event_id, value, lag(value) OVER w AS b, lead(value) OVER w AS a FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) SELECT event_id FROM n WHERE coalesce(value > b, true) AND coalesce(value > a, true) AND NOT (a IS NULL AND b IS NULL)")
def local_maxima(table):
    """Events above both neighbours."""
    return S.local_maxima(events(table), "value", by=BY, order=ORDER).select("event_id")


@query("WIN-06 TOP-11", f"{_E}, n AS (SELECT event_id, row_number() OVER w - 1 AS n, lead(t) OVER w IS NULL AS l FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) SELECT event_id FROM n WHERE n % 8 = 0 OR l")
def stride_sample(table):
    """Every eighth event of a user and the last."""
    return S.stride(events(table), 8, by=BY, order=ORDER).select("event_id")


@query(
    "WIN-07",
    f"""{_E}, n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS j, count(*) OVER (PARTITION BY user_id) AS n FROM e),
k AS (SELECT DISTINCT user_id, CAST(round_even(i * (n - 1) / 9.0, 0) AS BIGINT) AS j FROM (SELECT DISTINCT user_id, n FROM n) CROSS JOIN range(10) r(i))
SELECT event_id FROM n JOIN k USING (user_id, j)""",
)
def evenly_sampled(table):
    """Ten evenly spaced events of each user."""
    return S.evenly(events(table), 10, by=BY, order=ORDER).select("event_id")


@query("WIN-14", f"{_E}, n AS (SELECT event_id, t, lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM e) SELECT event_id FROM n WHERE t <= p")
def not_increasing(table):
    """Events that are not later than the user's event before, by id."""
    return S.not_increasing(events(table), "t", by=BY, order=["event_id"]).select("event_id")


@query("WIN-13 STR-10", f"{_E}, o AS (SELECT event_id, user_id, t - value AS o FROM e), p AS (SELECT event_id, o, lag(o) OVER (PARTITION BY user_id ORDER BY event_id) AS q FROM o) SELECT event_id, coalesce(abs(o - q) > 86400, false) AS discontinuity FROM p")
def clock_discontinuities(table):
    """Where the offset of two clocks jumps by more than a day."""
    return S.clock_offsets(events(table), "value", "t", 86400, by=BY, order=["event_id"]).select("event_id", "discontinuity")


_VC = f"{_E}, v AS (SELECT * FROM e WHERE event_type = 'view'), c AS (SELECT user_id, t, min(event_id) AS event_id FROM e WHERE event_type = 'click' GROUP BY user_id, t)"


def _views_clicks(table):
    e = events(table)
    return e.filter("event_type = 'view'").select("event_id", "user_id", "t"), e.filter("event_type = 'click'").select("user_id", F.col("t").alias("ct"), F.col("event_id").alias("click"))


@query("JOIN-11", f"{_VC} SELECT v.event_id, b.event_id AS before, a.event_id AS after FROM v ASOF LEFT JOIN c b ON v.user_id = b.user_id AND v.t >= b.t ASOF LEFT JOIN c a ON v.user_id = a.user_id AND v.t <= a.t")
def asof_bracket(table):
    """The clicks around each view."""
    v, c = _views_clicks(table)
    out = S.bracket(v, c, by=BY, time="t", right_time="ct", payload=["click"])
    return out.select("event_id", F.col("before.click").alias("before"), F.col("after.click").alias("after"))


@query(
    "JOIN-10",
    f"""{_VC}, m AS (SELECT v.event_id, v.t - b.t AS db, a.t - v.t AS da, b.event_id AS b, a.event_id AS a FROM v ASOF LEFT JOIN c b ON v.user_id = b.user_id AND v.t >= b.t ASOF LEFT JOIN c a ON v.user_id = a.user_id AND v.t <= a.t)
SELECT event_id, CASE WHEN least(db, da) <= 7200 THEN CASE WHEN db IS NOT NULL AND (da IS NULL OR db <= da) THEN b ELSE a END END AS click FROM m""",
)
def asof_nearest(table):
    """The click nearest to each view, within two hours."""
    v, c = _views_clicks(table)
    return S.nearest(v, c, by=BY, time="t", right_time="ct", payload=["click"], limit=7200).select("event_id", F.col("match.click").alias("click"))


@query(
    "WIN-09",
    f"""{_E}, u AS (SELECT user_id, t, arg_min(value, value) AS value FROM e GROUP BY user_id, t),
k AS (SELECT user_id, unnest(range(CAST(ceil(min(t) / 3600) AS BIGINT), CAST(floor(max(t) / 3600) AS BIGINT) + 1)) * 3600.0::DOUBLE AS t FROM e GROUP BY user_id),
m AS (SELECT k.user_id, k.t, b.t AS t0, b.value AS v0, a.t AS t1, a.value AS v1 FROM k ASOF LEFT JOIN u b ON k.user_id = b.user_id AND k.t >= b.t ASOF LEFT JOIN u a ON k.user_id = a.user_id AND k.t <= a.t)
SELECT user_id, t, round(CASE WHEN t1 - t0 <= 10800 THEN CASE WHEN t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END END, 4) AS value,
CASE WHEN t1 - t0 <= 10800 THEN 'interpolated' ELSE 'no_reliable_position' END AS status FROM m""",
)
def resample_hourly(table):
    """Values each hour, interpolated over gaps of up to three hours."""
    return S.resample(events(table), "t", "value", 3600.0, by=BY, max_gap=10800).select("user_id", "t", F.round("value", 4).alias("value"), "status")


@query("STR-06", f"{_VC}, p AS (SELECT event_id, user_id, t, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS prev FROM v) SELECT p.event_id, CASE WHEN prev IS NULL OR c.t > prev THEN c.event_id END AS latched FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.t >= c.t")
def latched_click(table):
    """The last click since the view before."""
    v, c = _views_clicks(table)
    return S.latest_before(v, c, by=BY, time="t", value_time="ct", value="click").select("event_id", "latched")


_IV = f"{_E}, i AS (SELECT event_id AS iv, user_id, t AS lo, t + 1800 + 100 * value AS hi FROM e WHERE event_type = 'purchase')"


def _intervals(table) -> DataFrame:
    return events(table).filter("event_type = 'purchase'").select(F.col("event_id").alias("iv"), "user_id", F.col("t").alias("lo"), (F.col("t") + 1800 + 100 * F.col("value")).alias("hi"))


@query("JOIN-12", f"{_IV} SELECT e.event_id, iv FROM e JOIN i ON e.user_id = i.user_id AND e.t BETWEEN lo AND hi")
def interval_stab(table):
    """Events inside the intervals that purchases open."""
    return S.stab(events(table).select("event_id", "user_id", "t"), _intervals(table), by=BY, time="t", start="lo", end="hi", width=3600.0).select("event_id", "iv")


@query("JOIN-13", f"{_IV} SELECT a.iv, b.iv AS other FROM i a JOIN i b ON a.user_id = b.user_id AND a.iv < b.iv AND a.hi >= b.lo AND a.lo <= b.hi")
def interval_overlap(table):
    """Pairs of intervals of a user that overlap."""
    i = _intervals(table)
    o = i.select("user_id", F.col("iv").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    return S.overlaps(i, o, by=BY, start="lo", end="hi", other_start="lo2", other_end="hi2", width=3600.0).filter("iv < other").select("iv", "other")


@query(
    "WIN-12",
    f"""{_E}, d AS (SELECT user_id, CAST(floor(t / 86400) AS BIGINT) AS day, count(*) FILTER (WHERE event_type = 'view') AS a, count(*) FILTER (WHERE event_type = 'click') AS b FROM e GROUP BY ALL)
SELECT x.user_id, CAST(y.day - x.day AS INTEGER) AS lag, CAST(sum(x.a * y.b) AS BIGINT) AS xcorr FROM d x JOIN d y ON x.user_id = y.user_id GROUP BY ALL""",
)
def xcorr(table):
    """Cross-correlation of a user's daily views and clicks over all lags, from days with events."""
    d = events(table).groupBy("user_id", F.floor(F.col("t") / 86400).alias("day")).agg(F.count_if(F.col("event_type") == "view").alias("a"), F.count_if(F.col("event_type") == "click").alias("b"))
    return S.correlate(d, d, by=BY, index="day", a="a", b="b").select("user_id", "lag", "xcorr")


@query(
    "WIN-12",
    f"""{_E}, k AS (SELECT user_id, CAST(floor(t / 86400) AS BIGINT) AS day, count(*) FILTER (WHERE event_type = 'view') AS a, count(*) FILTER (WHERE event_type = 'click') AS b FROM e GROUP BY ALL),
s AS (SELECT user_id, unnest(range(min(day), max(day) + 1)) AS day FROM k GROUP BY user_id),
d AS (SELECT user_id, day, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM s LEFT JOIN k USING (user_id, day)),
m AS (SELECT *, a - avg(a) OVER (PARTITION BY user_id) AS da, b - avg(b) OVER (PARTITION BY user_id) AS db FROM d)
SELECT x.user_id, CAST(y.day - x.day AS INTEGER) AS lag, count(*) AS n, CAST(sum(x.a * y.b) AS BIGINT) AS xcorr, round(sum(x.da * y.db), 6) + 0.0::DOUBLE AS xcov FROM m x JOIN m y ON x.user_id = y.user_id GROUP BY ALL""",
)
def xcorr_all_lags(table):
    """Cross-correlation and cross-covariance of a user's daily views and clicks over all lags; days without events count as zero."""
    day = F.floor(F.col("t") / 86400).alias("day")
    k = events(table).groupBy("user_id", day).agg(F.count_if(F.col("event_type") == "view").alias("a"), F.count_if(F.col("event_type") == "click").alias("b"))
    days = k.groupBy("user_id").agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select("user_id", F.explode(F.sequence("lo", "hi")).alias("day"))
    d = days.join(k, ["user_id", "day"], "left").fillna(0, ["a", "b"])
    return S.correlate(d, d, by=BY, index="day", a="a", b="b").withColumn("xcov", F.round("xcov", 6) + F.lit(0.0))  # no negative zero


@query("STR-04", f"{_E} SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS map_id FROM e")
def reset_sessions(table):
    """Map ids: a reset (an error) starts a new one."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events(table).select("event_id", F.sum((F.col("event_type") == "error").cast("long")).over(w).alias("map_id"))
