"""Order-dependent queries, each over the trajectories of users or the clouds of suppliers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.operators import greedy as Y
from waymark.plans.base import query
from waymark.plans.clouds import cloud
from waymark.plans.sequences import events


_EVENTS = "e AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) / 1e6::DOUBLE AS t FROM events)"
_POINTS = "c AS (SELECT l_suppkey AS cloud, l_orderkey * 8 + l_linenumber AS id, min(l_quantity) AS x, min(l_extendedprice / 1000) AS y, min(l_discount * 100) AS z FROM lineitem GROUP BY ALL)"


@query("TOP-09", f"""WITH RECURSIVE {_EVENTS},
n AS (SELECT user_id, event_id, value AS x, t % 86400 / 3600 AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS many FROM e),
k AS (SELECT user_id, rn, many, event_id, [{{'x': x, 'y': y}}] AS held, true AS kept FROM n WHERE rn = 1
UNION ALL SELECT user_id, rn, many, event_id, CASE WHEN apart THEN list_append(held, {{'x': x, 'y': y}}) ELSE held END, apart FROM (
SELECT n.*, k.held, list_min(list_transform(k.held, lambda h: (h.x - n.x) * (h.x - n.x) + (h.y - n.y) * (h.y - n.y))) > 25 AS apart FROM k JOIN n ON n.user_id = k.user_id AND n.rn = k.rn + 1))
SELECT event_id FROM k WHERE kept OR rn = many OR many <= 2""")
def greedy_radius(table):
    """Poses of each trajectory that keep their distance."""
    e = events(table).withColumn("hour", F.pmod(F.col("t"), F.lit(86400.0)) / 3600)
    return Y.radius_poses(e, by=["user_id"], order=["event_id"], axes=["value", "hour"], radius=5.0).select("event_id")


@query("GEO-10", f"""WITH RECURSIVE {_POINTS},
n AS (SELECT *, row_number() OVER (PARTITION BY cloud ORDER BY id) AS rn FROM c),
k AS (SELECT cloud, rn, [{{'x': x, 'y': y, 'z': z}}] AS seeds, CAST(0 AS INTEGER) AS cluster FROM n WHERE rn = 1
UNION ALL SELECT cloud, rn, CASE WHEN list_min(d) <= 64 THEN seeds ELSE list_append(seeds, {{'x': x, 'y': y, 'z': z}}) END, CAST(CASE WHEN list_min(d) <= 64 THEN list_position(d, list_min(d)) - 1 ELSE len(seeds) END AS INTEGER) FROM (
SELECT n.*, k.seeds, list_transform(k.seeds, lambda s: (s.x - n.x) * (s.x - n.x) + (s.y - n.y) * (s.y - n.y) + (s.z - n.z) * (s.z - n.z)) AS d FROM k JOIN n ON n.cloud = k.cloud AND n.rn = k.rn + 1))
SELECT cloud, cluster, count(*) AS n FROM k GROUP BY cloud, cluster""")
def seed_cluster(table):
    """Seed clusters of each cloud."""
    c = cloud(table).groupBy("cloud", "id").agg(*(F.min(a).alias(a) for a in "xyz"))
    return Y.seed_clusters(c, by=["cloud"], order=["id"], axes=["x", "y", "z"], radius=8.0).groupBy("cloud", "cluster").agg(F.count("*").alias("n"))


@query("STR-01", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE AS t FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM e),
k AS (SELECT user_id, rn, event_id, t, t AS last, true AS kept FROM n WHERE rn = 1
UNION ALL SELECT n.user_id, n.rn, n.event_id, n.t, CASE WHEN NOT (n.t - k.last > 0 AND n.t - k.last < 43200) THEN n.t ELSE k.last END, NOT (n.t - k.last > 0 AND n.t - k.last < 43200) FROM k JOIN n ON n.user_id = k.user_id AND n.rn = k.rn + 1)
SELECT event_id FROM k WHERE kept""")
def rate_limit(table):
    """Events admitted at most every twelve hours after the last admitted one."""
    return Y.since_last_kept(events(table), by=["user_id"], order=["t", "event_id"], value="t", limit=43200.0).select("event_id")


@query("TOP-06 TOP-03", f"""WITH RECURSIVE {_POINTS},
n AS (SELECT *, row_number() OVER (PARTITION BY cloud ORDER BY y, id) AS rn FROM c),
k AS (SELECT cloud, rn, id, [{{'x': x, 'z': z}}] AS held, true AS kept FROM n WHERE rn = 1
UNION ALL SELECT cloud, rn, id, CASE WHEN apart THEN list_append(held, {{'x': x, 'z': z}}) ELSE held END, apart FROM (
SELECT n.*, k.held, len(k.held) < 5 AND list_min(list_transform(k.held, lambda h: (h.x - n.x) * (h.x - n.x) + (h.z - n.z) * (h.z - n.z))) >= 100 AS apart FROM k JOIN n ON n.cloud = k.cloud AND n.rn = k.rn + 1))
SELECT cloud, id FROM k WHERE kept""")
def diverse_candidates(table):
    """The five cheapest points of each cloud that are apart from each other."""
    c = cloud(table).groupBy("cloud", "id").agg(*(F.min(a).alias(a) for a in "xyz"))
    return Y.diverse_best(c, by=["cloud"], cost="y", key="id", axes=["x", "z"], separation=10.0, limit=5).select("cloud", "id")


@query("JOIN-16", f"""WITH RECURSIVE {_EVENTS},
p AS (SELECT v.user_id, v.event_id AS a, b.event_id AS b, abs(v.t - b.t) AS d FROM e v JOIN e b ON b.user_id = v.user_id WHERE v.event_type = 'view' AND b.event_type = 'purchase' AND abs(v.t - b.t) <= 86400),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d, a, b) AS rn FROM p),
k AS (SELECT user_id, rn, a, b, [a] AS ua, [b] AS ub, true AS kept FROM n WHERE rn = 1
UNION ALL SELECT user_id, rn, a, b, CASE WHEN free THEN list_append(ua, a) ELSE ua END, CASE WHEN free THEN list_append(ub, b) ELSE ub END, free FROM (
SELECT n.*, k.ua, k.ub, NOT list_contains(k.ua, n.a) AND NOT list_contains(k.ub, n.b) AS free FROM k JOIN n ON n.user_id = k.user_id AND n.rn = k.rn + 1))
SELECT a, b FROM k WHERE kept""")
def greedy_pairs(table):
    """One-to-one pairs of views and purchases of a user, nearest in time first."""
    e = events(table)
    v = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("a"), F.col("t").alias("ta"), F.floor(F.col("t") / 86400).alias("k"))
    p = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("b"), F.col("t").alias("tb"), F.explode(F.sequence(F.floor(F.col("t") / 86400) - 1, F.floor(F.col("t") / 86400) + 1)).alias("k"))
    pairs = v.join(p, ["user_id", "k"]).withColumn("d", F.abs(F.col("ta") - F.col("tb"))).filter("d <= 86400")
    return Y.pair_greedily(pairs, by=["user_id"], a="a", b="b", distance="d", limit=86400.0).select("a", "b")


@query("RET-11", f"""WITH RECURSIVE {_EVENTS},
d AS (SELECT user_id, CAST(floor(t / 86400) AS BIGINT) AS day, avg(value) AS m FROM e GROUP BY ALL),
n AS (SELECT user_id, day, list_transform(range(10), lambda i: exp(-abs(m - i * 10 - 5) / 10)) AS l, row_number() OVER (PARTITION BY user_id ORDER BY day) AS rn FROM d),
k AS (SELECT user_id, CAST(NULL AS BIGINT) AS day, CAST(0 AS BIGINT) AS rn, list_transform(range(10), lambda i: 0.1::DOUBLE) AS p FROM n WHERE rn = 1
UNION ALL SELECT user_id, day, rn, list_transform(u, lambda x: x / list_sum(u)) FROM (
SELECT n.user_id, n.day, n.rn, list_transform(range(1, 11), lambda i: n.l[i] * (0.6 * k.p[i] + 0.2 * k.p[greatest(i - 1, 1)] + 0.2 * k.p[least(i + 1, 10)])) AS u FROM k JOIN n ON n.user_id = k.user_id AND n.rn = k.rn + 1))
SELECT user_id, day, CAST(place - 1 AS INTEGER) AS place, round(p[place], 6) AS posterior FROM (SELECT *, unnest(range(1, 11)) AS place FROM k WHERE rn > 0)""")
def bayes_chain(table):
    """Posterior over ten places along each user's days; the day's mean value is near a place or not."""
    d = events(table).groupBy("user_id", F.floor(F.col("t") / 86400).alias("day")).agg(F.avg("value").alias("m"))
    places = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("place")
    like = F.exp(-F.abs(F.col("m") - F.col("place") * 10 - 5) / 10)
    rows = d.select("user_id", "day", "m", places).select("user_id", "day", F.col("place").cast("int").alias("place"), like.alias("likelihood"))
    out = Y.bayes_chain(rows, by=["user_id"], step="day", node="place", likelihood="likelihood")
    return out.select("user_id", "day", "place", F.round("posterior", 6).alias("posterior"))


@query("GRA-19")
def correction_field(table):
    """Smoothed corrections of each trajectory, drawn towards the values of its purchases."""
    e = events(table).withColumn("target", F.when(F.col("event_type") == "purchase", F.col("value") / 10)).withColumn("weight", F.lit(10.0))
    return Y.smooth_corrections(e, by=["user_id"], order=["t", "event_id"], target="target", weight="weight").select("event_id", F.round("correction", 6).alias("correction"))


@query("STR-11", f"""WITH RECURSIVE {_EVENTS},
n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, row_number() OVER (PARTITION BY user_id ORDER BY event_id) * 1.25::DOUBLE AS t, event_type <> 'error' AS normal, event_id % 4 > 0 AS accepted,
CASE WHEN event_id % 9 > 0 THEN floor(value / 40) / 16 END AS cx, event_id % 2 / 32.0::DOUBLE AS cy, event_id % 3 / 64.0::DOUBLE AS cyaw, 60 + event_id % 60 AS points, event_id % 10 / 20.0::DOUBLE AS uniqueness FROM e),
k AS (SELECT user_id, event_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS DOUBLE) AS lx, CAST(NULL AS DOUBLE) AS ly, CAST(NULL AS DOUBLE) AS lw, 0 AS run, false AS applied, 0 AS trusted, 0 AS rejected, CAST(NULL AS DOUBLE) AS last, '' AS state FROM n WHERE rn = 1
UNION ALL SELECT user_id, event_id, rn, cx, cy, cyaw, run, applied, trusted, rejected, last,
CASE WHEN NOT normal THEN 'lost' WHEN last IS NULL THEN CASE WHEN rejected >= 3 THEN 'weak' ELSE 'initializing' END WHEN t - last > 10 THEN 'lost' WHEN t - last > 4 OR rejected >= 3 THEN 'weak' WHEN applied AND trusted >= 3 AND points >= 80 AND uniqueness >= 0.22 THEN 'stable' ELSE 'usable' END FROM (
SELECT *, CASE WHEN applied THEN trusted0 + 1 ELSE 0 END AS trusted, CASE WHEN applied THEN 0 ELSE rejected0 + 1 END AS rejected, CASE WHEN applied THEN t ELSE last0 END AS last FROM (
SELECT *, has AND accepted AND run >= 2 AS applied FROM (
SELECT n.user_id, n.event_id, n.rn, n.t, n.normal, n.accepted, n.points, n.uniqueness, CASE WHEN n.normal THEN n.cx END AS cx, n.cy, n.cyaw, n.normal AND n.cx IS NOT NULL AS has, k.trusted AS trusted0, k.rejected AS rejected0, k.last AS last0,
CASE WHEN NOT (n.normal AND n.cx IS NOT NULL) THEN 0 WHEN k.lx IS NOT NULL AND sqrt(power(n.cx - k.lx, 2) + power(n.cy - k.ly, 2)) <= 0.12 AND abs(n.cyaw - k.lw) <= radians(3) THEN k.run + 1 ELSE 1 END AS run
FROM k JOIN n ON n.user_id = k.user_id AND n.rn = k.rn + 1))))
SELECT user_id, event_id, applied, trusted, rejected, state FROM k WHERE rn > 0""")
def localisation_states(table):
    """State of each user's localiser after every event."""
    k = F.col("event_id")
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) * 1.25
    frames = table("events").select(
        "user_id", "event_id", t.alias("t"), (F.col("event_type") != "error").alias("normal"), (k % 4 > 0).alias("accepted"), F.when(k % 9 > 0, F.floor(F.col("value") / 40) / 16).alias("cx"),
        (k % 2 / 32).alias("cy"), (k % 3 / 64).alias("cyaw"), (k % 60 + 60).alias("points"), (k % 10 / 20).alias("uniqueness"),
    )
    return Y.localisation_states(frames, by=["user_id"], order=["event_id"], time="t")


@query("GRA-17b", f"""WITH RECURSIVE {_EVENTS},
p AS (SELECT user_id, event_id, event_type, event_id // 300 AS map, round(value / 64, 3) AS x, event_id % 30 / 8.0::DOUBLE AS y, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS many, row_number() OVER w * 0.5::DOUBLE AS t FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
h AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lag(map) OVER w AS pm, lead(map) OVER w AS nm FROM p WINDOW w AS (PARTITION BY user_id ORDER BY rn)),
a AS (SELECT *, sqrt(power(x - px, 2) + power(y - py, 2)) AS d1, sqrt(power(nx - x, 2) + power(ny - y, 2)) AS d2, atan2(y - py, x - px) AS h1, atan2(ny - y, nx - x) AS h2 FROM h),
n AS (SELECT *, rn = 1 OR rn = many OR event_type = 'purchase' OR map <> pm OR map <> nm OR coalesce(d1 >= 0.05 AND d2 >= 0.05 AND abs(pi() - ((pi() - (h2 - h1)) - 2 * pi() * floor((pi() - (h2 - h1)) / (2 * pi())))) >= radians(150), false) AS must FROM a),
k AS (SELECT user_id, rn, event_id, x AS ax, y AS ay, t AS seen, true AS kept FROM n WHERE rn = 1
UNION ALL SELECT user_id, rn, event_id, CASE WHEN kept THEN x ELSE ax END, CASE WHEN kept THEN y ELSE ay END, CASE WHEN kept THEN t ELSE seen END, kept FROM (
SELECT *, coalesce(must, false) OR d >= CASE WHEN c >= radians(150) / 2 THEN 1.25 ELSE 2.5 END OR c >= radians(120) OR t - seen >= 2.5 AS kept FROM (
SELECT n.*, k.ax, k.ay, k.seen, sqrt(power(n.x - k.ax, 2) + power(n.y - k.ay, 2)) AS d, CASE WHEN sqrt(power(n.x - k.ax, 2) + power(n.y - k.ay, 2)) >= 0.05 AND n.d1 >= 0.05 THEN abs(pi() - ((pi() - (n.h1 - atan2(n.py - k.ay, n.px - k.ax))) - 2 * pi() * floor((pi() - (n.h1 - atan2(n.py - k.ay, n.px - k.ax))) / (2 * pi())))) ELSE 0 END AS c
FROM k JOIN n ON n.user_id = k.user_id AND n.rn = k.rn + 1)))
SELECT event_id FROM k WHERE kept""")
def adaptive_skeleton(table):
    """Nodes that each trajectory's graph is optimised on: ends, purchases, map changes, turns, and rows by distance, turn and time."""
    k, w = F.col("event_id"), Window.partitionBy("user_id").orderBy("event_id")
    e = table("events").withColumn("map", F.floor(k / 300))
    must = F.coalesce((F.col("event_type") == "purchase") | F.coalesce(F.col("map") != F.lag("map").over(w), F.lit(False)) | F.coalesce(F.col("map") != F.lead("map").over(w), F.lit(False)), F.lit(False))
    rows = e.select("user_id", "event_id", F.round(F.col("value") / 64, 3).alias("x"), (k % 30 / 8).alias("y"), (F.row_number().over(w) * 0.5).alias("t"), must.alias("must"))
    return Y.skeleton(rows, by=["user_id"], order=["event_id"], x="x", y="y", time="t", must="must", straight=2.5, tight=1.25, angle=120, seconds=2.5, turn=150).select("event_id")
