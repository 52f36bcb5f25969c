"""Pose graphs over events: nodes are a user's events, neighbour links join those that follow each other within a map."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geometry import from_euler, pose2
from waymark.operators import gauge as Q
from waymark.operators import links as K
from waymark.operators import propagation as P
from waymark.plans.base import query

# an error starts a new map: no neighbour link leads to it; loops lead nine events back, and purchases see landmarks (ids below 0)
_LINKS = """n AS (SELECT user_id, event_id AS node, value, event_type, lag(event_id) OVER w AS back, lag(event_id, 9) OVER w AS far, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
l AS (SELECT user_id, 3 * node AS id, back AS src, node AS dst, 0 AS rank, 0.5::DOUBLE + node % 11 / 10.0::DOUBLE AS dx, node % 3 / 10.0::DOUBLE AS dy, node % 7 / 10.0::DOUBLE - 0.3 AS dyaw FROM n WHERE back IS NOT NULL AND event_type <> 'error'
UNION ALL SELECT user_id, 3 * node + 1, node, far, 1, node % 5 / 10.0::DOUBLE - 4, node % 9 / 10.0::DOUBLE, 0.25 FROM n WHERE far IS NOT NULL AND i % 4 = 0
UNION ALL SELECT user_id, 3 * node + 2, node, -(user_id * 3 + node % 3) - 1, 2, 1 + node % 4 / 4.0::DOUBLE, -0.5, 0.0 FROM n WHERE event_type = 'purchase')"""


def links(table) -> DataFrame:
    """(user_id, id, src, dst, rank, dx, dy, dyaw) of the events' pose graphs."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.col("node")
    n = table("events").select("user_id", F.col("event_id").alias("node"), "event_type", F.lag("event_id").over(w).alias("back"), F.lag("event_id", 9).over(w).alias("far"), F.row_number().over(w).alias("i"))
    near = n.filter("back is not null and event_type <> 'error'").select("user_id", (3 * k).alias("id"), F.col("back").alias("src"), k.alias("dst"), F.lit(0).alias("rank"), (0.5 + k % 11 / 10).alias("dx"), (k % 3 / 10).alias("dy"), (k % 7 / 10 - 0.3).alias("dyaw"))
    loop = n.filter("far is not null and i % 4 = 0").select("user_id", (3 * k + 1).alias("id"), k.alias("src"), F.col("far").alias("dst"), F.lit(1).alias("rank"), (k % 5 / 10 - 4).alias("dx"), (k % 9 / 10).alias("dy"), F.lit(0.25).alias("dyaw"))
    mark = n.filter("event_type = 'purchase'").select("user_id", (3 * k + 2).alias("id"), k.alias("src"), (-(F.col("user_id") * 3 + k % 3) - 1).alias("dst"), F.lit(2).alias("rank"), (1 + k % 4 / 4).alias("dx"), F.lit(-0.5).alias("dy"), F.lit(0.0).alias("dyaw"))
    return near.unionByName(loop).unionByName(mark)


@query(
    "GRA-05",
    f"""WITH RECURSIVE {_LINKS},
u AS (SELECT user_id, rank, least(src, dst) AS lo, greatest(src, dst) AS hi, arg_min({{'s': src, 'd': dst, 'x': dx, 'y': dy, 'a': dyaw}}, id) AS m FROM l WHERE src <> dst GROUP BY ALL),
e AS (SELECT user_id, rank, lo, hi, m.s AS a, m.d AS b, m.x AS x, m.y AS y, m.a AS yaw FROM u
  UNION ALL SELECT user_id, rank, lo, hi, m.d, m.s, -(cos(m.a) * m.x + sin(m.a) * m.y), sin(m.a) * m.x - cos(m.a) * m.y, -m.a FROM u),
r(user_id, seen, poses) AS (SELECT user_id, [min(event_id)], [{{'x': arg_min(value, event_id), 'y': user_id::DOUBLE, 'a': 0.5::DOUBLE}}] FROM events GROUP BY user_id
  UNION ALL SELECT user_id, list_append(seen, b), list_append(poses, {{'x': p.x + cos(p.a) * x - sin(p.a) * y, 'y': p.y + sin(p.a) * x + cos(p.a) * y, 'a': p.a + yaw}}) FROM (
    SELECT r.user_id, seen, poses, e.b, e.x, e.y, e.yaw, list_extract(poses, list_position(seen, e.a)) AS p, row_number() OVER (PARTITION BY r.user_id ORDER BY rank, lo, hi) AS rn
    FROM r JOIN e ON e.user_id = r.user_id AND list_contains(seen, e.a) AND NOT list_contains(seen, e.b)) WHERE rn = 1),
f AS (SELECT user_id, arg_max(seen, len(seen)) AS seen, arg_max(poses, len(seen)) AS poses FROM r GROUP BY user_id),
o AS (SELECT user_id, seen[1] AS root, unnest(seen) AS node, unnest(poses) AS p FROM f)
SELECT node, root, round(p.x, 4) + 0.0::DOUBLE AS x, round(p.y, 4) + 0.0::DOUBLE AS y, round(cos(p.a), 4) + 0.0::DOUBLE AS c, round(sin(p.a), 4) + 0.0::DOUBLE AS s FROM o""",
)
def propagated_poses(table):
    """Poses of all nodes connected with each user's first event, composed along neighbour links before loops before landmarks."""
    e = table("events")
    t = links(table).withColumn("t", pose2(F.col("dx"), F.col("dy"), F.col("dyaw")))
    start = e.groupBy("user_id").agg(F.min(F.struct("event_id", "value")).alias("m")).select(F.col("m.event_id").alias("node"), pose2(F.col("m.value"), F.col("user_id"), F.lit(0.5)).alias("pose"))
    out = P.propagate(e.sparkSession, t, start)
    yaw = F.col("pose.yaw")
    return out.select("node", "root", *((F.round(v, 4) + F.lit(0.0)).alias(n) for n, v in (("x", F.col("pose.x")), ("y", F.col("pose.y")), ("c", F.cos(yaw)), ("s", F.sin(yaw)))))  # no negative zero


# a customer is a component, its orders are candidates: most agree but for a few centimetres, of every third customer those of status P with each other, one in eleven with none
_CANDIDATES = """c AS (SELECT o_custkey AS component, o_orderkey AS id, o_custkey % 10 + (o_orderkey % 7 - 3) / 20.0::DOUBLE + sqrt(o_orderkey) / 1000 + CASE WHEN o_orderstatus = 'P' AND o_custkey % 3 = 0 THEN 4 WHEN o_orderkey % 11 = 0 THEN o_orderkey % 97 ELSE 0 END AS x, o_custkey % 4 + (o_orderkey % 5 - 2) / 20.0::DOUBLE + sqrt(o_orderkey) / 2000 AS y,
o_custkey % 6 - 2.5::DOUBLE + (o_orderkey % 9 - 4) / 50.0::DOUBLE AS yaw, 1.0::DOUBLE + o_orderkey % 3 AS weight, o_orderkey % 13 / 5.0::DOUBLE AS raw_x, o_orderkey % 17 / 8.0::DOUBLE AS raw_y FROM orders)"""
_JOINT = "sqrt(power(c.x - {x}, 2) + power(c.y - {y}, 2)) / 0.5 + abs(atan2(sin(c.yaw - {a}), cos(c.yaw - {a}))) / 0.2"
_WMEAN = "sum(w * x) / sum(w) AS x, sum(w * y) / sum(w) AS y, atan2(sum(w * sin(yaw)), sum(w * cos(yaw))) AS a"


def _huber(i: int) -> str:
    joint = _JOINT.format(x=f"g{i - 1}.x", y=f"g{i - 1}.y", a=f"g{i - 1}.a")
    return f"g{i} AS (SELECT component, {_WMEAN} FROM (SELECT c.component, c.x, c.y, c.yaw, c.weight * CASE WHEN {joint} <= 2 THEN 1 ELSE 2 / ({joint}) END AS w FROM inl c JOIN g{i - 1} ON g{i - 1}.component = c.component) GROUP BY component)"


@query(
    "GRA-17c",
    f"""WITH {_CANDIDATES},
f AS (SELECT component, count(*) AS candidates, sqrt(power(max(raw_x) - min(raw_x), 2) + power(max(raw_y) - min(raw_y), 2)) AS span FROM c GROUP BY component),
d AS (SELECT component, j, arg_min({{'id': id, 'x': x, 'y': y, 'a': yaw}}, [(u * 48271 + u // 32768 * 1566083941) % 2147483647, id]) AS m FROM (SELECT *, (id % 2147483647 * 1103515245 + j * 7654321) % 2147483647 AS u FROM c, range(128) r(j)) GROUP BY component, j),
h AS (SELECT a.component, a.j // 2 AS k, (a.m.x + b.m.x) / 2 AS x, (a.m.y + b.m.y) / 2 AS y, atan2(sin(a.m.a) + sin(b.m.a), cos(a.m.a) + cos(b.m.a)) AS a FROM d a JOIN d b ON b.component = a.component AND b.j = a.j + 1 WHERE a.j % 2 = 0 AND a.m.id <> b.m.id),
n AS (SELECT h.component, k, h.x, h.y, h.a, count(*) AS n, string_agg(c.id, ',' ORDER BY c.id) AS mask FROM h JOIN c ON c.component = h.component WHERE {_JOINT.format(x="h.x", y="h.y", a="h.a")} < 2 GROUP BY ALL),
b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY component ORDER BY n DESC, k) = 1),
s AS (SELECT n.component, max(n.n) AS second FROM n JOIN b USING (component) WHERE n.mask <> b.mask GROUP BY 1),
o AS (SELECT f.component, candidates, coalesce(b.n, 0) AS inliers, coalesce(second, 0) AS second, span, b.x, b.y, b.a FROM f LEFT JOIN b USING (component) LEFT JOIN s USING (component)),
q AS (SELECT *, CASE WHEN candidates < 2 THEN 'insufficient_candidates' WHEN candidates < 3 AND span <= 2 THEN 'trajectory_span_too_small' WHEN inliers < 3 THEN 'insufficient_consensus'
  WHEN second > 0 AND inliers / candidates::DOUBLE - second / candidates::DOUBLE < 0.15 THEN 'ambiguous_clusters' WHEN inliers / candidates::DOUBLE < 0.5 THEN 'low_consensus_ratio' END AS reason FROM o),
inl AS (SELECT c.* FROM c JOIN q ON q.component = c.component AND reason IS NULL WHERE {_JOINT.format(x="q.x", y="q.y", a="q.a")} < 2),
g0 AS (SELECT component, {_WMEAN.replace("w * ", "weight * ").replace("sum(w)", "sum(weight)")} FROM inl GROUP BY component),
{", ".join(_huber(i) for i in range(1, 5))}
SELECT q.component, candidates, inliers, round(second / candidates::DOUBLE, 6) AS second_ratio, reason, round(g4.x, 4) AS x, round(g4.y, 4) AS y, round(g4.a, 4) AS yaw FROM q LEFT JOIN g4 USING (component)""",
)
def robust_gauge(table):
    """Gauge of each customer's candidates, or why it has none."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    off = F.when((F.col("o_orderstatus") == "P") & (c % 3 == 0), 4).when(k % 11 == 0, k % 97).otherwise(0)
    rows = table("orders").select(
        c.alias("component"), k.alias("id"), (c % 10 + (k % 7 - 3) / 20 + F.sqrt(k) / 1000 + off).alias("x"), (c % 4 + (k % 5 - 2) / 20 + F.sqrt(k) / 2000).alias("y"), (c % 6 - 2.5 + (k % 9 - 4) / 50).alias("yaw"),
        (1.0 + k % 3).alias("weight"), (k % 13 / 5).alias("raw_x"), (k % 17 / 8).alias("raw_y"),
    )
    out = Q.robust_gauge(rows, by=["component"])
    return out.select("component", "candidates", "inliers", F.round("second_ratio", 6).alias("second_ratio"), "reason", *(F.round(v, 4).alias(v) for v in ("x", "y", "yaw")))


# links between a user's events that follow each other; information matrices of three equal blocks of two by two
_MERGE = """n AS (SELECT user_id, event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
l AS (SELECT *, 0.5::DOUBLE + src % 11 / 10.0::DOUBLE AS x, src % 3 / 10.0::DOUBLE AS y, src % 5 / 8.0::DOUBLE AS z, src % 7 / 10.0::DOUBLE - 0.3 AS yaw, 2.137::DOUBLE + src % 5 AS a, src % 3 / 2.3::DOUBLE AS b, 3.071::DOUBLE + src % 7 AS d FROM n WHERE dst IS NOT NULL)"""


@query(
    "GRA-11",
    f"""WITH {_MERGE}, m AS (SELECT p.src AS id, q.dst AS dst, p.src % 2 = 0 AS merged, p.x + cos(p.yaw) * q.x - sin(p.yaw) * q.y AS x, p.y + sin(p.yaw) * q.x + cos(p.yaw) * q.y AS y, p.z + q.z AS z, p.a AS pa, p.b AS pb, p.d AS pd, q.a AS qa, q.b AS qb, q.d AS qd, p.a * p.d - p.b * p.b AS pe, q.a * q.d - q.b * q.b AS qe FROM l p JOIN l q ON q.src = p.dst),
s AS (SELECT *, pd / pe + qd / qe AS u, -(pb / pe + qb / qe) AS v, pa / pe + qa / qe AS w FROM m), r AS (SELECT *, u * w - v * v AS e FROM s)
SELECT id, dst, merged, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z, round(CASE WHEN merged THEN w / e WHEN pa < qa THEN pa ELSE qa END, 4) AS i00, round(CASE WHEN merged THEN -v / e WHEN pa < qa THEN pb ELSE qb END, 4) + 0.0::DOUBLE AS i01, round(CASE WHEN merged THEN u / e WHEN pa < qa THEN pd ELSE qd END, 4) AS i55 FROM r""",
)
def merged_links(table):
    """Each two links of a user that follow each other as one: composed transforms and merged information."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.col("src")
    n = table("events").select(F.col("event_id").alias("src"), F.lead("event_id").over(w).alias("dst")).filter("dst is not null")
    zero = F.lit(0.0)
    a, b, d = 2.137 + k % 5, k % 3 / 2.3, 3.071 + k % 7
    info = F.array(*({(0, 0): a, (0, 1): b, (1, 0): b, (1, 1): d}[i % 2, j % 2] if i // 2 == j // 2 else zero for i in range(6) for j in range(6)))
    links_ = n.select(k.alias("id"), "src", "dst", (k % 2 == 0).alias("merged"), from_euler(0.5 + k % 11 / 10, k % 3 / 10, k % 5 / 8, zero, zero, k % 7 / 10 - 0.3).alias("t"), info.alias("info"))
    out = K.merge_links(links_, links_.select("src", "dst", "t", "info"))
    t, i = F.col("t"), F.col("info")
    return out.select("id", "dst", "merged", F.round(t[3], 5).alias("x"), F.round(t[7], 5).alias("y"), F.round(t[11], 5).alias("z"), F.round(i[0], 4).alias("i00"), (F.round(i[1], 4) + 0.0).alias("i01"), F.round(i[35], 4).alias("i55"))
