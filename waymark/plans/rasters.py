"""Raster queries over cells of line items and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import rasters as Z
from waymark.plans.base import query

_RAYS = "r AS (SELECT p_partkey AS ray, p_size::BIGINT AS x0, (p_partkey % 40)::BIGINT AS y0, ((p_partkey * 7) % 60)::BIGINT AS x1, ((p_partkey * 11) % 60)::BIGINT AS y1 FROM part)"
_CELLS = f"""WITH {_RAYS}, n AS (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0)) AS n FROM r), s AS (SELECT *, unnest(range(0, n + 1)) AS step FROM n),
c AS (SELECT ray, step, CAST(floor(x0 + (x1 - x0) * (CASE WHEN n > 0 THEN step / n::DOUBLE ELSE 0 END) + 0.5) AS BIGINT) AS ix, CAST(floor(y0 + (y1 - y0) * (CASE WHEN n > 0 THEN step / n::DOUBLE ELSE 0 END) + 0.5) AS BIGINT) AS iy FROM s)"""


def _rays(table):
    k = F.col("p_partkey")
    return table("part").select(k.alias("ray"), F.col("p_size").cast("long").alias("x0"), (k % 40).alias("y0"), ((k * 7) % 60).alias("x1"), ((k * 11) % 60).alias("y1"))


@query("GEO-13 GEO-20", f"{_CELLS} SELECT ix, iy, count(*) AS n FROM c GROUP BY ix, iy")
def line_cells(table):
    """How many lines pass each cell."""
    return Z.line_cells(_rays(table), "x0", "y0", "x1", "y1").groupBy("ix", "iy").agg(F.count("*").alias("n"))


@query("GEO-14", f"{_CELLS}, o AS (SELECT DISTINCT s_suppkey % 60 AS ix, (s_suppkey * 13) % 60 AS iy FROM supplier), h AS (SELECT ray, min(step) AS stop FROM c JOIN o USING (ix, iy) GROUP BY ray) SELECT c.ray, count(*) AS free FROM c LEFT JOIN h ON h.ray = c.ray WHERE stop IS NULL OR step < stop GROUP BY c.ray")
def ray_trace(table):
    """Free cells of each ray before an obstacle."""
    o = table("supplier").select((F.col("s_suppkey") % 60).alias("ix"), ((F.col("s_suppkey") * 13) % 60).alias("iy"))
    return Z.ray_trace(_rays(table), o, key="ray").groupBy("ray").agg(F.count("*").alias("free"))


@query("WIN-17", "WITH c AS (SELECT l_suppkey AS row, CAST(l_quantity AS BIGINT) AS col, max(l_tax) >= 0.07 AS v FROM lineitem GROUP BY 1, 2), f AS (SELECT *, CASE WHEN v = lag(v) OVER w AND col - lag(col) OVER w = 1 THEN 0 ELSE 1 END AS b FROM c WINDOW w AS (PARTITION BY row ORDER BY col)), g AS (SELECT *, sum(b) OVER (PARTITION BY row ORDER BY col ROWS UNBOUNDED PRECEDING) AS r FROM f) SELECT row, min(col) AS start, count(*) AS n, any_value(v) AS v FROM g GROUP BY row, r")
def row_runs(table):
    """Run lengths of the cells of each row."""
    c = table("lineitem").groupBy(F.col("l_suppkey").alias("row"), F.col("l_quantity").cast("long").alias("col")).agg((F.max("l_tax") >= 0.07).alias("v"))
    return Z.run_lengths(c, "v", row=["row"], column="col").select("row", "start", "n", "v")


@query("GEO-19", "WITH s AS (SELECT DISTINCT s_suppkey % 50 AS x, (s_suppkey * 13) % 50 AS y FROM supplier), c AS (SELECT x + a AS ix, y + b AS iy, greatest(abs(a), abs(b)) + (sqrt(2::DOUBLE) - 1) * least(abs(a), abs(b)) AS d FROM s, range(-4, 5) t(a), range(-4, 5) u(b)) SELECT ix, iy, round(min(d), 6) AS d FROM c WHERE d <= 4 GROUP BY ix, iy")
def distance_field(table):
    """Truncated eight-neighbour distance from obstacle cells."""
    o = table("supplier").select((F.col("s_suppkey") % 50).alias("ix"), ((F.col("s_suppkey") * 13) % 50).alias("iy"))
    return Z.distance_field(o.sparkSession, o, 4.0, by=[]).select("ix", "iy", F.round("d", 6).alias("d"))
