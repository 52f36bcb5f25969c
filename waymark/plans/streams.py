"""Stream operators driven over the events table to its end; results are what a running query has appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.plans.base import query
from waymark.session import fresh_path
from waymark.streaming import admission as A


def drain(stream: DataFrame) -> DataFrame:
    """Run a stream over what its source has now and return what it wrote."""
    spark = stream.sparkSession
    out, state = fresh_path(spark, "stream-out"), fresh_path(spark, "stream-state")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _stream(table) -> DataFrame:
    """The events as a file stream."""
    events = table("events")
    path = events.inputFiles()[0]
    spark = events.sparkSession
    base, _, name = path.rpartition("/")
    folder, pattern = (base.rpartition("/")[0], "events.parquet") if base.endswith("events.parquet") else (base, name)
    reader = spark.readStream.schema(events.schema).option("pathGlobFilter", pattern if folder == base else "*")
    return reader.parquet(folder if folder == base else base).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6))


_E = "WITH RECURSIVE e AS (SELECT user_id, event_id, value, event_type, epoch_us(ts) / 1e6::DOUBLE AS t FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM e)"


@query("STR-01 STR-03", f"""{_E},
k AS (SELECT user_id, rn, event_id, t AS last, true AS kept, value AS worst, value AS seen FROM n WHERE rn = 1
UNION ALL SELECT n.user_id, n.rn, n.event_id, CASE WHEN NOT (n.t - k.last > 0 AND n.t - k.last < 43200) THEN n.t ELSE k.last END, NOT (n.t - k.last > 0 AND n.t - k.last < 43200),
CASE WHEN k.kept THEN n.value ELSE greatest(k.worst, n.value) END, CASE WHEN k.kept THEN n.value ELSE greatest(k.worst, n.value) END FROM k JOIN n ON n.user_id = k.user_id AND n.rn = k.rn + 1)
SELECT event_id, round(seen, 4) AS max_variance FROM k WHERE kept""")
def stream_admission(table):
    """Admitted events with the largest value since the one admitted before."""
    out = drain(A.admit(_stream(table).select("user_id", "event_id", "t", "value"), key="user_id", time="t", period=43200.0, variance="value"))
    return out.select("event_id", F.round("max_variance", 4).alias("max_variance"))


@query("STR-06", """WITH e AS (SELECT user_id, epoch_us(ts) / 1e6::DOUBLE AS t, event_id, event_type FROM events WHERE event_type IN ('view', 'click')),
m AS (SELECT *, max(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id, g) AS held FROM (SELECT *, count(*) FILTER (WHERE event_type = 'view') OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g0, 0 AS g FROM e)),
c AS (SELECT user_id, coalesce(g0, 0) AS g, arg_max(event_id, (t, event_id)) FILTER (WHERE event_type = 'click') AS latched FROM m GROUP BY 1, 2)
SELECT m.user_id, m.t, c.latched FROM m JOIN c ON c.user_id = m.user_id AND c.g = coalesce(m.g0, 0) WHERE m.event_type = 'view'""")
def stream_latch(table):
    """Each view takes the last click since the view before."""
    s = _stream(table).filter("event_type in ('view', 'click')").select("user_id", "t", (F.col("event_type") == "view").alias("frame"), "event_id")
    return drain(A.latch(s, key="user_id", time="t", is_frame="frame", value="event_id"))


@query("RET-13 RET-14 STR-05")
def stream_rehearsal(table):
    """Places of each user, merged with the one before where alike, five being remembered."""
    s = _stream(table).select("user_id", "t", F.array("event_type").alias("words"))
    return drain(A.rehearse(s, key="user_id", time="t", words="words", threshold=0.9, memory=5))


@query("STR-13", "SELECT CAST(epoch_us(time_bucket(INTERVAL 6 HOURS, ts)) // 1000000 AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def window_counts(table):
    """Counts in six-hour windows, as a batch over the operator's windows."""
    out = A.windowed(table("events").withColumn("ts", F.col("ts").cast("timestamp")), time="ts", late="10 minutes", size="6 hours", by=["event_type"])
    return out.select(F.unix_seconds("window.start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query(
    "STR-07",
    """WITH e AS (SELECT event_id, user_id, event_type <> 'purchase' AS imu, value, epoch_us(ts) / 1e6::DOUBLE + CASE WHEN event_type = 'purchase' THEN (2 - event_id % 7) * 40000 ELSE 0 END AS t FROM events WHERE event_type IN ('view', 'click', 'purchase')),
w AS (SELECT *, first_value(CASE WHEN imu THEN t END IGNORE NULLS) OVER z AS oldest, last_value(CASE WHEN imu THEN t END IGNORE NULLS) OVER z AS newest, list(CASE WHEN imu THEN {'t': t, 'v': value} END) OVER z AS l FROM e WINDOW z AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
g AS (SELECT event_id, t, list_filter(l, lambda x: x IS NOT NULL)[-16:] AS s FROM w WHERE NOT imu AND (oldest IS NULL OR (t >= oldest AND t < newest))),
b AS (SELECT *, list_reverse_sort(list_filter(s, lambda x: x.t <= t))[1] AS p, list_sort(list_filter(s, lambda x: x.t > t))[1] AS n FROM g)
SELECT event_id, round(p.v + (n.v - p.v) * (t - p.t) / (n.t - p.t), 4) AS sample FROM b""",
)
def stream_gated_frames(table):
    """Purchases as frames, late or early, that the samples (views and clicks) received before them enclose, with the value at their stamp."""
    frame = F.col("event_type") == "purchase"
    rows = _stream(table).filter("event_type in ('view', 'click', 'purchase')")
    rows = rows.select("user_id", "event_id", (F.col("t") + F.when(frame, (2 - F.col("event_id") % 7) * 40000).otherwise(0)).alias("stamp"), (~frame).alias("is_sample"), "value")
    out = drain(A.gate_frames(rows, key="user_id", arrival="event_id", stamp="stamp", is_sample="is_sample", value="value", buffer=16))
    return out.select("event_id", F.round("sample", 4).alias("sample"))
