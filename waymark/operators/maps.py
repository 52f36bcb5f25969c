"""Map elements and poses on them: element geometry, road attraction, loop candidates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geometry as G
from waymark.operators import clouds as C
from waymark.operators import sequences as S

#: Gain and largest step of the attraction to a road, in metres, and the margin below which it is ambiguous.
ROAD_GAIN, ROAD_CAP, ROAD_MARGIN = 0.15, 0.25, 0.35


def rectangle(x_cm: Column, y_cm: Column, width_cm: Column, depth_cm: Column, cw_degrees: Column, height_m: float, *, pivot_centre: bool = False) -> Column:
    """Corners (array of x, y in metres, y upwards) of an element anchored at its top left corner and turned clockwise.

    The turn is about the anchor, or about the centre for maps of the older kind.
    """
    a = F.radians(cw_degrees)
    px, py = (x_cm + width_cm / 2, y_cm + depth_cm / 2) if pivot_centre else (x_cm, y_cm)

    def corner(u: Column, v: Column) -> Column:
        dx, dy = u - px, v - py
        return F.struct(((px + F.cos(a) * dx - F.sin(a) * dy) / 100).alias("x"), (F.lit(height_m) - (py + F.sin(a) * dx + F.cos(a) * dy) / 100).alias("y"))

    return F.array(corner(x_cm, y_cm), corner(x_cm + width_cm, y_cm), corner(x_cm + width_cm, y_cm + depth_cm), corner(x_cm, y_cm + depth_cm))


def attract(poses: DataFrame, nearest: DataFrame, *, key: str) -> DataFrame:
    """Poses moved towards their nearest road: a share of the offset, never more than the cap; state by distance and margin.

    ``nearest`` has key, distance, margin and the foot (fx, fy); a pose without one stays and is lost.
    """
    rows = poses.join(nearest, key, "left")
    step = F.least(F.col("distance") * ROAD_GAIN, F.lit(ROAD_CAP))
    share = F.when(F.col("distance") > 0, step / F.col("distance")).otherwise(F.lit(0.0))
    ambiguous = F.col("margin").isNotNull() & (F.col("margin") < ROAD_MARGIN)
    state = F.when(F.col("distance").isNull(), "lost").when(ambiguous, "weak").when(F.col("distance") > 1.0, "usable").otherwise("stable")
    moved = F.col("distance").isNotNull() & ~ambiguous
    x = F.when(moved, F.col("x") + (F.col("fx") - F.col("x")) * share).otherwise(F.col("x"))
    y = F.when(moved, F.col("y") + (F.col("fy") - F.col("y")) * share).otherwise(F.col("y"))
    return rows.select(key, x.alias("x"), y.alias("y"), state.alias("state"))


def loop_candidates(poses: DataFrame, radius: float, angle: float, gap: int, *, by: list[str], key: str = "id") -> DataFrame:
    """(by..., a, b) of poses near each other in place and heading whose ids are more than ``gap`` apart."""
    pairs = C.near_pairs(poses, poses, radius, by=by, axes=("x", "y"), left_id=key, right_id=key).filter(F.col("b") - F.col("a") > gap)
    yaw = poses.select(*by, F.col(key), F.col("yaw"))
    both = pairs.join(yaw.select(*by, F.col(key).alias("a"), F.col("yaw").alias("ya")), [*by, "a"]).join(yaw.select(*by, F.col(key).alias("b"), F.col("yaw").alias("yb")), [*by, "b"])
    return both.filter(F.abs(G.normalize_angle(F.col("ya") - F.col("yb"))) <= angle).select(*by, "a", "b")


def aisle_constraints(poses: DataFrame, events: DataFrame, segments: DataFrame, *, by: list[str], event: str, order: list[str], stride: int = 4, width: float) -> DataFrame:
    """(event, pose columns..., cx, cy, cyaw, distance): poses of a manual assignment to an aisle, put on the aisle.

    ``events``: by..., event, aisle, start, end (in either order); ``poses``: by..., t, x, y, yaw; ``segments``: aisle, segment, ax, ay, bx,
    by_. Of the poses within the closed interval every ``stride``-th counts, and is projected on the aisle's nearest segment
    (the first at ties), headed along it in the direction nearer to its own. Aisles have few segments.
    """
    spans = events.select(*by, event, "aisle", F.least("start", "end").alias("_lo"), F.greatest("start", "end").alias("_hi"))
    inside = S.stab(poses, spans, by=by, time="t", start="_lo", end="_hi", width=width).drop("_lo", "_hi")
    w = Window.partitionBy(event).orderBy(*order)
    taken = inside.withColumn("_i", F.row_number().over(w) - 1).filter(F.col("_i") % stride == 0).drop("_i")
    of = segments.filter((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by_"))).groupBy("aisle").agg(F.collect_list(F.struct("segment", "ax", "ay", "bx", "by_")).alias("_s"))

    def put(s: Column) -> Column:
        foot = G.project_on_segment(F.col("x"), F.col("y"), s["ax"], s["ay"], s["bx"], s["by_"])
        return F.struct(foot["distance"].alias("distance"), s["segment"].alias("segment"), foot["x"].alias("x"), foot["y"].alias("y"), F.atan2(s["by_"] - s["ay"], s["bx"] - s["ax"]).alias("yaw"))

    best = taken.join(of, "aisle").withColumn("m", F.array_min(F.transform("_s", put)))
    back = G.normalize_angle(F.col("m.yaw") + math.pi)
    turn = lambda a: F.abs(G.normalize_angle(a - F.col("yaw")))
    yaw = F.when(turn(F.col("m.yaw")) <= turn(back), F.col("m.yaw")).otherwise(back)
    return best.select(*inside.columns, F.col("m.x").alias("cx"), F.col("m.y").alias("cy"), yaw.alias("cyaw"), F.col("m.distance").alias("distance"))
