"""Map queries: parts as shelves of a floor, events as poses."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import maps as A
from waymark.operators import rasters as Z
from waymark.plans.base import query


@query("GEO-06 FLT-22", "SELECT p_partkey, round((p_partkey + cos(radians(p_size)) * 200 - sin(radians(p_size)) * 50) / 100, 6) AS x, round(30 - (p_retailprice + sin(radians(p_size)) * 200 + cos(radians(p_size)) * 50) / 100, 6) AS y FROM part")
def element_corners(table):
    """The far corner of each turned shelf."""
    d = lambda c: F.col(c).cast("double")
    ring = A.rectangle(d("p_partkey"), d("p_retailprice"), F.lit(200.0), F.lit(50.0), d("p_size"), 30.0)
    return table("part").select("p_partkey", ring.alias("r")).select("p_partkey", F.round(F.col("r")[2]["x"], 6).alias("x"), F.round(F.col("r")[2]["y"], 6).alias("y"))


@query("GEO-29", "SELECT p_partkey AS id, round(CASE WHEN d IS NULL OR p_size % 4 = 0 THEN x ELSE x + (fx - x) * CASE WHEN d > 0 THEN least(d * 0.15, 0.25) / d ELSE 0 END END, 6) AS x, CASE WHEN d IS NULL THEN 'lost' WHEN p_size % 4 = 0 THEN 'weak' WHEN d > 1.0 THEN 'usable' ELSE 'stable' END AS state FROM (SELECT *, p_size::DOUBLE AS x, floor(p_size / 7.0::DOUBLE) * 7 AS fx, CASE WHEN p_partkey % 5 > 0 THEN p_size - floor(p_size / 7.0::DOUBLE) * 7 END AS d FROM part)")
def road_attraction(table):
    """Poses drawn to the nearest road, and their state."""
    x = F.col("p_size").cast("double")
    foot = F.floor(x / 7) * 7
    p = table("part")
    poses = p.select(F.col("p_partkey").alias("id"), x.alias("x"), F.lit(0.0).alias("y"))
    near = p.filter("p_partkey % 5 > 0").select(F.col("p_partkey").alias("id"), (x - foot).alias("distance"), F.when(F.col("p_size") % 4 == 0, 0.1).otherwise(2.0).alias("margin"), foot.cast("double").alias("fx"), F.lit(0.0).alias("fy"))
    return A.attract(poses, near, key="id").select("id", F.round("x", 6).alias("x"), "state")


@query("JOIN-08 GRA-10", """WITH p AS (SELECT user_id, event_id AS id, value AS x, (event_id % 50)::DOUBLE AS y, (event_id % 60) / 10.0::DOUBLE - 3 AS yaw FROM events)
SELECT a.user_id, a.id AS a, b.id AS b FROM p a JOIN p b ON a.user_id = b.user_id AND b.id - a.id > 20 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 9 AND abs(pi() - ((pi() - (a.yaw - b.yaw)) - 2 * pi() * floor((pi() - (a.yaw - b.yaw)) / (2 * pi())))) <= 0.5""")
def loop_candidates(table):
    """Pairs of a user's poses that are near in place and heading but not in time."""
    e = table("events")
    p = e.select("user_id", F.col("event_id").alias("id"), F.col("value").alias("x"), (F.col("event_id") % 50).cast("double").alias("y"), ((F.col("event_id") % 60) / 10 - 3).alias("yaw"))
    return A.loop_candidates(p, 3.0, 0.5, 20, by=["user_id"])


@query("", """WITH f AS (SELECT DISTINCT s_suppkey % 50 AS ix, (s_suppkey * 13) % 50 AS iy FROM supplier), k AS (SELECT i AS candidate, i * 0.5::DOUBLE AS x, i * 0.25::DOUBLE AS y FROM range(12) t(i)),
c AS (SELECT candidate, CAST(floor(x + p_size) AS BIGINT) AS ix, CAST(floor(y + p_partkey % 50) AS BIGINT) AS iy FROM k CROSS JOIN part)
SELECT c.candidate, round(avg(CASE WHEN f.ix IS NULL THEN 0.45::DOUBLE * 0.45::DOUBLE ELSE 0 END), 9) AS cost FROM c LEFT JOIN f ON f.ix = c.ix AND f.iy = c.iy GROUP BY c.candidate""")
def scan_match(table):
    """Cost of each candidate placement of a scan against a field."""
    field = table("supplier").select((F.col("s_suppkey") % 50).alias("ix"), ((F.col("s_suppkey") * 13) % 50).alias("iy")).distinct().withColumn("d", F.lit(0.0))
    i = F.col("id")
    grid = field.sparkSession.range(12).select(i.alias("candidate"), (i * 0.5).alias("x"), (i * 0.25).alias("y"), F.lit(0.0).alias("yaw"))
    points = table("part").select(F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 50).cast("double").alias("y"))
    return Z.match_candidates(grid, points, field, size=1.0, cap=0.45).select("candidate", F.round("cost", 9).alias("cost"))
