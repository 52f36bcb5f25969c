"""Point clouds as rows: range, box and frustum filters, neighbour counts over hashed cells, voxels and sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def finite(*names: str) -> Column:
    tests = [F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double")) & (F.abs(F.col(n)) != float("inf")) for n in names]
    return reduce(lambda a, b: a & b, tests)


def squared_norm(*names: str) -> Column:
    return reduce(lambda a, b: a + b, [F.col(n) * F.col(n) for n in names])


def range_filter(cloud: DataFrame, low: float, high: float, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Points at low <= distance <= high from the origin; a bound of 0 is none, and points that are not finite go."""
    test = finite(*axes)
    if low > 0:
        test &= squared_norm(*axes) >= low * low
    if high > 0:
        test &= squared_norm(*axes) <= high * high
    return cloud.filter(test)


def range_split(cloud: DataFrame, distance: float, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Adds ``near``; null where a point is not finite."""
    return cloud.withColumn("near", F.when(finite(*axes), squared_norm(*axes) < distance * distance))


def pass_through(cloud: DataFrame, axis: str, low: float, high: float, *, negative: bool = False) -> DataFrame:
    """Points with low <= axis <= high, or the others that are finite."""
    if high <= low:
        raise ValueError("high must be above low")
    test = F.col(axis).between(low, high)
    return cloud.filter(finite(axis) & (~test if negative else test))


def to_frame(transform: tuple[float, float, float, float] | None) -> dict[str, Column]:
    """Columns of x, y, z seen from a frame (x, y, z, yaw)."""
    if transform is None:
        return {a: F.col(a) for a in AXES}
    import math

    tx, ty, tz, yaw = transform
    c, s = math.cos(yaw), math.sin(yaw)
    dx, dy = F.col("x") - tx, F.col("y") - ty
    return {"x": dx * c + dy * s, "y": dy * c - dx * s, "z": F.col("z") - tz}


def crop_box(cloud: DataFrame, low: tuple[float, ...], high: tuple[float, ...], *, transform: tuple[float, float, float, float] | None = None, negative: bool = False) -> DataFrame:
    """Points inside a box given in its own frame, or outside of it."""
    own = to_frame(transform)
    inside = reduce(lambda a, b: a & b, [own[a].between(lo, hi) for a, lo, hi in zip(AXES, low, high, strict=True)])
    return cloud.filter(finite(*AXES) & (~inside if negative else inside))


def frustum(cloud: DataFrame, *, hfov: float, vfov: float, near: float, far: float, negative: bool = False) -> DataFrame:
    """Points in a frustum that looks along x, with opening angles in radians."""
    import math

    inside = F.col("x").between(near, far) & (F.abs("y") <= F.col("x") * math.tan(hfov / 2)) & (F.abs("z") <= F.col("x") * math.tan(vfov / 2))
    return cloud.filter(finite(*AXES) & (~inside if negative else inside))


def cell_of(name: str | Column, size: float | Column) -> Column:
    col = F.col(name) if isinstance(name, str) else name
    return F.floor(col / size).cast("long")


def near_pairs(left: DataFrame, right: DataFrame, radius: float, *, by: list[str], axes: tuple[str, ...] = AXES, left_id: str = "id", right_id: str = "id", keep: dict[str, Column] | None = None, keep_right: dict[str, Column] | None = None) -> DataFrame:
    """(by..., left id as a, right id as b, d2) of points at most ``radius`` apart, by an equi-join on blocks of space.

    What is named in ``keep`` and ``keep_right`` is carried along from the left and right points, so that pairs need not meet them again.

    A block's edge is three radii. A right point goes to its own block and to those whose border is within the radius, so
    it is repeated less than five times on average in three dimensions; no pair is made outside blocks. Points that are not
    finite have no partner.
    """
    blocks = [f"_c{i}" for i in range(len(axes))]
    edge, reach = 3 * radius, radius * (1 + 1e-9)
    own, its = keep or {}, keep_right or {}
    a = left.filter(finite(*axes)).select(*by, F.col(left_id).alias("a"), *(c.alias(n) for n, c in own.items()), *(F.col(x).alias(f"_a{i}") for i, x in enumerate(axes)), *(cell_of(x, edge).alias(c) for x, c in zip(axes, blocks, strict=True)))
    b = right.filter(finite(*axes)).select(*by, F.col(right_id).alias("b"), *(c.alias(n) for n, c in its.items()), *(F.col(x).alias(f"_b{i}") for i, x in enumerate(axes)))
    for i, c in enumerate(blocks):
        b = b.withColumn(c, F.explode(F.sequence(cell_of(F.col(f"_b{i}") - reach, edge), cell_of(F.col(f"_b{i}") + reach, edge))))
    d2 = reduce(lambda p, q: p + q, [(F.col(f"_a{i}") - F.col(f"_b{i}")) * (F.col(f"_a{i}") - F.col(f"_b{i}")) for i in range(len(axes))])
    return a.join(b, [*by, *blocks]).withColumn("d2", d2).filter(F.col("d2") <= radius * radius).select(*by, "a", "b", "d2", *own, *its)


def radius_outliers(cloud: DataFrame, radius: float, least: int, *, by: list[str], axes: tuple[str, ...] = AXES, key: str = "id") -> DataFrame:
    """Points with at least ``least`` other points within the radius.

    A cell with the radius as diagonal that has more points than that keeps them all, so crowded cells make no pairs among themselves.
    """
    cells = [f"_k{i}" for i in range(len(axes))]
    small = cloud.filter(finite(*axes)).withColumns({c: cell_of(x, 0.999999 * radius / len(axes) ** 0.5) for x, c in zip(axes, cells, strict=True)})
    sparse = small.groupBy(*by, *cells).agg(F.count("*").alias("_n")).filter(F.col("_n") <= least)
    open_ = small.join(sparse, [*by, *cells], "left_semi").drop(*cells)
    pairs = near_pairs(open_, cloud, radius, by=by, axes=axes, left_id=key, right_id=key).filter("a <> b")
    few = pairs.groupBy(*by, "a").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(*by, F.col("a").alias(key))
    crowded = small.join(sparse, [*by, *cells], "left_anti").select(*by, key)
    return cloud.join(few.unionByName(crowded), [*by, key], "left_semi")


def subtract(cloud: DataFrame, other: DataFrame, radius: float, *, by: list[str], least: int = 1, axes: tuple[str, ...] = AXES, key: str = "id") -> DataFrame:
    """Points with fewer than ``least`` points of the other cloud within the radius."""
    pairs = near_pairs(cloud, other, radius, by=by, axes=axes, left_id=key, right_id=key)
    covered = pairs.groupBy(*by, "a").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(*by, F.col("a").alias(key))
    return cloud.join(covered, [*by, key], "left_anti")


def nearest_within(left: DataFrame, right: DataFrame, radius: float, *, by: list[str], axes: tuple[str, ...] = AXES, key: str = "id") -> DataFrame:
    """(by..., a, b, d2): the nearest right point of each left one within the radius; ties to the smaller id."""
    pairs = near_pairs(left, right, radius, by=by, axes=axes, left_id=key, right_id=key)
    best = pairs.groupBy(*by, "a").agg(F.min(F.struct("d2", "b")).alias("m"))
    return best.select(*by, "a", F.col("m.b").alias("b"), F.col("m.d2").alias("d2"))


def voxels(cloud: DataFrame, size: float, fields: list[str], *, by: list[str], axes: tuple[str, ...] = AXES) -> DataFrame:
    """Centroid of all fields in each cell, with the number of points; 64-bit cells need no splitting of space."""
    cells = [cell_of(a, size).alias(f"c{a}") for a in axes]
    return cloud.filter(finite(*axes)).groupBy(*by, *cells).agg(F.count("*").alias("n"), *(F.avg(f).alias(f) for f in fields))


def every(cloud: DataFrame, step: int, *, by: list[str], order: list[str]) -> DataFrame:
    """Every step-th point of each cloud in its order, the first included."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return cloud.withColumn("_rn", rn - 1).filter(F.col("_rn") % step == 0).drop("_rn")


def random_sample(cloud: DataFrame, n: int, *, by: list[str], key: str = "id", seed: int = 0) -> DataFrame:
    """n points of each cloud, chosen by a hash of the key, so that a run can be repeated."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(F.md5(F.concat_ws(":", F.lit(seed), key)), key))
    return cloud.withColumn("_rn", rn).filter(F.col("_rn") <= n).drop("_rn")


def bounds(cloud: DataFrame, *, by: list[str], axes: tuple[str, ...] = AXES) -> DataFrame:
    return cloud.filter(finite(*axes)).groupBy(*by).agg(*(f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))))


def occupancy(cells: DataFrame, *, by: list[str]) -> DataFrame:
    """Hits and misses of each cell and its class. Few hits under many misses are a conflict."""
    out = cells.groupBy(*by).agg(F.count_if("occupied").alias("occ"), F.count_if(~F.col("occupied")).alias("free"))
    kind = F.when((F.col("occ") > 0) & (F.col("occ") < 3) & (F.col("free") >= 3), "CONFLICT").when(F.col("occ") > 0, "OCCUPIED").when(F.col("free") > 0, "FREE").otherwise("UNKNOWN")
    return out.withColumn("class", kind)


def dilate(cells: DataFrame, *, by: list[str]) -> DataFrame:
    """Cells (ix, iy) and their eight neighbours."""
    d = F.array(F.lit(-1), F.lit(0), F.lit(1))
    grown = cells.withColumn("_dx", F.explode(d)).withColumn("_dy", F.explode(d))
    return grown.select(*by, (F.col("ix") + F.col("_dx")).alias("ix"), (F.col("iy") + F.col("_dy")).alias("iy")).distinct()


def erode(cells: DataFrame, *, by: list[str]) -> DataFrame:
    """Cells whose eight neighbours are all there."""
    d = F.array(F.lit(-1), F.lit(0), F.lit(1))
    votes = cells.distinct().withColumn("_dx", F.explode(d)).withColumn("_dy", F.explode(d))
    votes = votes.groupBy(*by, (F.col("ix") + F.col("_dx")).alias("ix"), (F.col("iy") + F.col("_dy")).alias("iy")).agg(F.count("*").alias("n"))
    return votes.filter("n = 9").select(*by, "ix", "iy")


def euclidean_clusters(cloud: DataFrame, tolerance: float, least: int, most: int, *, by: str, axes: tuple[str, ...] = AXES, key: str = "id") -> DataFrame:
    """(by, cluster, n, biggest): clusters of ``least`` to ``most`` points linked by steps of at most the tolerance, named by their smallest id."""
    from waymark.operators.graph import components

    pairs = near_pairs(cloud, cloud, tolerance, by=[by], axes=axes, left_id=key, right_id=key).filter("a < b")
    links = pairs.select(F.struct(F.col(by).alias("g"), F.col("a").alias("i")).alias("src"), F.struct(F.col(by).alias("g"), F.col("b").alias("i")).alias("dst"))
    labels = components(cloud.sparkSession, links, cloud.select(F.struct(F.col(by).alias("g"), F.col(key).alias("i")).alias("node")))
    sizes = labels.groupBy(F.col("component.g").alias(by), F.col("component.i").alias("cluster")).agg(F.count("*").alias("n")).filter(F.col("n").between(least, most))
    first = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "cluster"))
    return sizes.withColumn("biggest", first == 1).select(by, "cluster", "n", "biggest")
