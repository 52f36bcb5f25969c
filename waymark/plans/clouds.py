"""Point-cloud queries; a line item is a point (quantity, price / 1000, 100 * discount) of its supplier's cloud."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators import clouds as C
from waymark.plans.base import query

_CLOUD = "WITH c AS (SELECT l_suppkey AS cloud, l_orderkey * 8 + l_linenumber AS id, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z, l_returnflag AS flag FROM lineitem)"


def cloud(table) -> DataFrame:
    return table("lineitem").select(F.col("l_suppkey").alias("cloud"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"), F.col("l_returnflag").alias("flag"))


def _ids(df: DataFrame) -> DataFrame:
    return df.select("cloud", "id")


@query("FLT-05", f"{_CLOUD} SELECT cloud, id FROM c WHERE x*x + y*y + z*z >= 100.0 AND x*x + y*y + z*z <= 1600.0")
def range_filter(table):
    """Points between 10 and 40 from the origin."""
    return _ids(C.range_filter(cloud(table), 10, 40))


@query("FLT-06", f"{_CLOUD} SELECT cloud, x*x + y*y < 900.0 AS near, count(*) AS n FROM c GROUP BY ALL")
def range_split(table):
    """Near and far points of each cloud, in the plane."""
    return C.range_split(cloud(table), 30, ("x", "y")).groupBy("cloud", "near").agg(F.count("*").alias("n"))


@query("FLT-07", f"{_CLOUD} SELECT cloud, id FROM c WHERE NOT (x BETWEEN 5 AND 45)")
def pass_through(table):
    """Points outside of a span of x."""
    return _ids(C.pass_through(cloud(table), "x", 5, 45, negative=True))


@query("FLT-08 GEO-01 GEO-03", f"{_CLOUD} SELECT cloud, id FROM c WHERE (x - 25) * cos(0.5) + (y - 40) * sin(0.5) BETWEEN -10 AND 10 AND (y - 40) * cos(0.5) - (x - 25) * sin(0.5) BETWEEN -15 AND 15 AND z - 5 BETWEEN -3 AND 3")
def crop_box(table):
    """Points inside a turned box."""
    return _ids(C.crop_box(cloud(table), (-10, -15, -3), (10, 15, 3), transform=(25, 40, 5, 0.5)))


@query("FLT-09", f"{_CLOUD} SELECT cloud, id FROM c WHERE x BETWEEN 2 AND 45 AND abs(y) <= x * tan(1.2) AND abs(z) <= x * tan(0.2)")
def frustum_filter(table):
    """Points seen by a camera that looks along x."""
    return _ids(C.frustum(cloud(table), hfov=2.4, vfov=0.4, near=2, far=45))


@query(
    "FLT-12 JOIN-08",
    f"""{_CLOUD}, k AS (SELECT a.cloud, a.id FROM c a JOIN c b ON b.cloud = a.cloud WHERE b.id <> a.id AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 9.0 GROUP BY a.cloud, a.id HAVING count(*) >= 3) SELECT cloud, id FROM c WHERE (cloud, id) IN (SELECT cloud, id FROM k)""",
)
def radius_outlier(table):
    """Points with three others within 3."""
    return _ids(C.radius_outliers(cloud(table), 3.0, 3, by=["cloud"]))


@query(
    "FLT-14",
    f"""{_CLOUD} , k AS (SELECT DISTINCT a.cloud, a.id FROM c a JOIN c b ON b.cloud = a.cloud WHERE a.flag = 'N' AND b.flag = 'R' AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 9.0) SELECT cloud, id FROM c WHERE flag = 'N' AND (cloud, id) NOT IN (SELECT cloud, id FROM k)""",
)
def subtract_filter(table):
    """Points of one kind without a point of another within 3."""
    c = cloud(table)
    return _ids(C.subtract(c.filter("flag = 'N'"), c.filter("flag = 'R'"), 3.0, by=["cloud"]))


@query(
    "JOIN-18 JOIN-07",
    f"""{_CLOUD}, p AS (SELECT a.cloud, a.id AS a, b.id AS b, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2 FROM c a JOIN c b ON a.cloud = b.cloud WHERE a.flag = 'A' AND b.flag = 'R'),
r AS (SELECT *, row_number() OVER (PARTITION BY cloud, a ORDER BY d2, b) AS rn FROM p WHERE d2 <= 16.0)
SELECT cloud, a, b, round(d2, 4) AS d2 FROM r WHERE rn = 1""",
)
def nearest_correspondence(table):
    """The nearest partner within 4 of each point of another kind."""
    c = cloud(table)
    return C.nearest_within(c.filter("flag = 'A'"), c.filter("flag = 'R'"), 4.0, by=["cloud"]).select("cloud", "a", "b", F.round("d2", 4).alias("d2"))


@query("AGG-16 AGG-17", f"{_CLOUD} SELECT cloud, CAST(floor(x / 5) AS BIGINT) AS cx, CAST(floor(y / 5) AS BIGINT) AS cy, CAST(floor(z / 5) AS BIGINT) AS cz, count(*) AS n, round(avg(x), 7) AS x, round(avg(y), 7) AS y, round(avg(z), 7) AS z FROM c GROUP BY ALL")
def voxel_centroid(table):
    """Centroids of 5-unit voxels."""
    out = C.voxels(cloud(table), 5.0, ["x", "y", "z"], by=["cloud"])
    return out.select("cloud", "cx", "cy", "cz", "n", *(F.round(a, 7).alias(a) for a in "xyz"))


@query("TOP-07", f"{_CLOUD} SELECT cloud, id FROM (SELECT *, row_number() OVER (PARTITION BY cloud ORDER BY id) - 1 AS rn FROM c) WHERE rn % 7 = 0")
def every_seventh(table):
    """Every seventh point of each cloud."""
    return _ids(C.every(cloud(table), 7, by=["cloud"], order=["id"]))


@query("TOP-08", f"{_CLOUD} SELECT cloud, id FROM (SELECT *, row_number() OVER (PARTITION BY cloud ORDER BY md5('0:' || id), id) AS rn FROM c) WHERE rn <= 20")
def random_points(table):
    """Twenty points of each cloud, by a hash of their ids."""
    return _ids(C.random_sample(cloud(table), 20, by=["cloud"]))


@query("AGG-15", f"{_CLOUD} SELECT cloud, min(x) AS min_x, max(x) AS max_x, round(min(y), 5) AS min_y, round(max(y), 5) AS max_y, min(z) AS min_z, max(z) AS max_z FROM c GROUP BY cloud")
def cloud_bounds(table):
    """Bounding box of each cloud."""
    out = C.bounds(cloud(table), by=["cloud"])
    return out.withColumn("min_y", F.round("min_y", 5)).withColumn("max_y", F.round("max_y", 5))


_CELLS = f"{_CLOUD}, g AS (SELECT CAST(floor(x / 2) AS BIGINT) AS ix, CAST(floor(y / 2) AS BIGINT) AS iy, flag = 'R' AS occupied FROM c)"


def _grid(table) -> DataFrame:
    return cloud(table).select(C.cell_of("x", 2.0).alias("ix"), C.cell_of("y", 2.0).alias("iy"), (F.col("flag") == "R").alias("occupied"))


@query(
    "AGG-18 AGG-19",
    f"""{_CELLS} SELECT ix, iy, count(*) FILTER (WHERE occupied) AS occ, count(*) FILTER (WHERE NOT occupied) AS free,
CASE WHEN count(*) FILTER (WHERE occupied) BETWEEN 1 AND 2 AND count(*) FILTER (WHERE NOT occupied) >= 3 THEN 'CONFLICT' WHEN count(*) FILTER (WHERE occupied) > 0 THEN 'OCCUPIED' ELSE 'FREE' END AS class FROM g GROUP BY ix, iy""",
)
def occupancy_classify(table):
    """Occupancy class of each grid cell."""
    return C.occupancy(_grid(table), by=["ix", "iy"])


@query("GEO-15", f"{_CELLS}, o AS (SELECT DISTINCT ix, iy FROM g WHERE occupied), n AS (SELECT ix + a AS ix, iy + b AS iy, count(*) AS n FROM o, (VALUES (-1), (0), (1)) s(a), (VALUES (-1), (0), (1)) t(b) GROUP BY ALL) SELECT n.ix, n.iy, n.n = 9 AS eroded FROM n")
def morphology(table):
    """Dilated cells, and whether they are in the eroded set too."""
    occupied = _grid(table).filter("occupied").select("ix", "iy").distinct()
    eroded = C.erode(occupied, by=[]).withColumn("eroded", F.lit(True))
    return C.dilate(occupied, by=[]).join(eroded, ["ix", "iy"], "left").select("ix", "iy", F.coalesce("eroded", F.lit(False)).alias("eroded"))


@query("FLT-10 SCL-01", "SELECT count(*) AS n, count(*) FILTER (WHERE isfinite(y)) AS finite FROM (SELECT CASE WHEN l_quantity = 50 THEN 'NaN'::DOUBLE WHEN l_quantity = 49 THEN NULL ELSE l_extendedprice END AS y FROM lineitem)")
def finite_points(table):
    """Points left when NaN and null coordinates are dropped."""
    y = F.when(F.col("l_quantity") == 50, F.lit(float("nan"))).when(F.col("l_quantity") == 49, F.lit(None)).otherwise(F.col("l_extendedprice"))
    return table("lineitem").select(y.alias("y")).agg(F.count("*").alias("n"), F.count_if(C.finite("y")).alias("finite"))
