"""Rigid transforms and geodesy as column expressions. Poses are structs (x, y, yaw) or rows of twelve numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84 semi-major axis and flattening.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563


def normalize_angle(a: Column) -> Column:
    """In (-pi, pi]."""
    return F.lit(math.pi) - F.pmod(F.lit(math.pi) - a, F.lit(2 * math.pi))


def pose2(x: Column, y: Column, yaw: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), yaw.cast("double").alias("yaw"))


def compose2(a: Column, b: Column) -> Column:
    """a then b: b is given in a's frame."""
    c, s = F.cos(a["yaw"]), F.sin(a["yaw"])
    return pose2(a["x"] + c * b["x"] - s * b["y"], a["y"] + s * b["x"] + c * b["y"], normalize_angle(a["yaw"] + b["yaw"]))


def inverse2(a: Column) -> Column:
    c, s = F.cos(a["yaw"]), F.sin(a["yaw"])
    return pose2(-(c * a["x"] + s * a["y"]), s * a["x"] - c * a["y"], normalize_angle(-a["yaw"]))


def relative2(a: Column, b: Column) -> Column:
    """b seen from a."""
    return compose2(inverse2(a), b)


def blend2(a: Column, b: Column, ratio: Column) -> Column:
    """Between two poses, the angle along the shorter arc."""
    return pose2(a["x"] + (b["x"] - a["x"]) * ratio, a["y"] + (b["y"] - a["y"]) * ratio, normalize_angle(a["yaw"] + normalize_angle(b["yaw"] - a["yaw"]) * ratio))


def move_point(raw: Column, optimized: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point that goes along when its pose is corrected: optimized * raw^-1 * point."""
    c, s = F.cos(raw["yaw"]), F.sin(raw["yaw"])
    dx, dy = x - raw["x"], y - raw["y"]
    lx, ly = c * dx + s * dy, c * dy - s * dx
    c, s = F.cos(optimized["yaw"]), F.sin(optimized["yaw"])
    return optimized["x"] + c * lx - s * ly, optimized["y"] + s * lx + c * ly


def pose3(*rows: Column) -> Column:
    """Twelve numbers, row by row: rotation and translation."""
    return F.array(*rows)


def from_euler(x: Column, y: Column, z: Column, roll: Column, pitch: Column, yaw: Column) -> Column:
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    return F.array(cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr, x, sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr, y, -sp, cp * sr, cp * cr, z)


def compose3(a: Column, b: Column) -> Column:
    def at(r: int, c: int) -> Column:
        total = a[4 * r] * b[c] + a[4 * r + 1] * b[4 + c] + a[4 * r + 2] * b[8 + c]
        return total + a[4 * r + 3] if c == 3 else total

    return F.array(*(at(r, c) for r in range(3) for c in range(4)))


def inverse3(a: Column) -> Column:
    def shift(c: int) -> Column:
        return -(a[c] * a[3] + a[4 + c] * a[7] + a[8 + c] * a[11])

    return F.array(*(x for c in range(3) for x in (a[c], a[4 + c], a[8 + c], shift(c))))


def apply3(a: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return tuple(a[4 * r] * x + a[4 * r + 1] * y + a[4 * r + 2] * z + a[4 * r + 3] for r in range(3))


def translation_norm(a: Column) -> Column:
    return F.sqrt(a[3] * a[3] + a[7] * a[7] + a[11] * a[11])


def rotation_angle(a: Column) -> Column:
    """Angle of the rotation part, from its trace."""
    return F.acos(F.least(F.greatest((a[0] + a[5] + a[10] - 1) / 2, F.lit(-1.0)), F.lit(1.0)))


def euler_of(a: Column) -> tuple[Column, Column, Column]:
    """Roll, pitch and yaw."""
    return F.atan2(a[9], a[10]), F.asin(F.least(F.greatest(-a[8], F.lit(-1.0)), F.lit(1.0))), F.atan2(a[4], a[0])


def to_planar(a: Column) -> Column:
    """Position and yaw alone."""
    yaw = euler_of(a)[2]
    zero = F.lit(0.0)
    return from_euler(a[3], a[7], zero, zero, zero, yaw)


def geocentric(lat_deg: Column, lon_deg: Column, alt: Column) -> tuple[Column, Column, Column]:
    e2 = WGS84_F * (2 - WGS84_F)
    lat, lon = F.radians(lat_deg), F.radians(lon_deg)
    n = F.lit(WGS84_A) / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return (n + alt) * F.cos(lat) * F.cos(lon), (n + alt) * F.cos(lat) * F.sin(lon), (n * (1 - e2) + alt) * F.sin(lat)


def east_north_up(lat: Column, lon: Column, alt: Column, origin_lat: Column, origin_lon: Column, origin_alt: Column) -> tuple[Column, Column, Column]:
    x, y, z = geocentric(lat, lon, alt)
    ox, oy, oz = geocentric(origin_lat, origin_lon, origin_alt)
    dx, dy, dz = x - ox, y - oy, z - oz
    sla, cla, slo, clo = F.sin(F.radians(origin_lat)), F.cos(F.radians(origin_lat)), F.sin(F.radians(origin_lon)), F.cos(F.radians(origin_lon))
    return -slo * dx + clo * dy, -sla * clo * dx - sla * slo * dy + cla * dz, cla * clo * dx + cla * slo * dy + sla * dz


def map_units(x_cm: Column, y_cm: Column, cw_degrees: Column, height_m: float) -> Column:
    """Metres with y upwards and counter-clockwise radians, from centimetres with y downwards and clockwise degrees."""
    return pose2(x_cm / 100, F.lit(height_m) - y_cm / 100, normalize_angle(-F.radians(cw_degrees)))


def project_on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column, *, relative: bool = False) -> Column:
    """(x, y, ratio, distance) of the nearest point of a segment.

    The distance is that from (x, y), or with ``relative`` taken in offsets from the segment's start: both round differently.
    """
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / square, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    x, y = ax + t * dx, ay + t * dy
    u, v = (px - ax - t * dx, py - ay - t * dy) if relative else (px - x, py - y)
    return F.struct(x.alias("x"), y.alias("y"), t.alias("ratio"), F.sqrt(u * u + v * v).alias("distance"))


def in_polygon(px: Column, py: Column, ring: Column) -> Column:
    """Even-odd rule over an array of structs (x, y); the ring closes itself."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, F.when(i == n, F.lit(1)).otherwise(i + 1))
        spans = (a["y"] > py) != (b["y"] > py)
        return F.when(spans & (px < (b["x"] - a["x"]) * (py - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0)

    return F.when(n >= 3, F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), crosses), F.lit(0), lambda s, x: s + x) % 2 == 1).otherwise(F.lit(False))


def on_ring(px: Column, py: Column, ring: Column) -> Column:
    """Whether a point lies on an edge of a ring of structs (x, y), ends included."""
    n = F.size(ring)

    def touches(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, F.when(i == n, F.lit(1)).otherwise(i + 1))
        cross = (b["x"] - a["x"]) * (py - a["y"]) - (b["y"] - a["y"]) * (px - a["x"])
        return (cross == 0) & px.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & py.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    return (n > 0) & F.exists(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), touches)


def segments_cross(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """Whether two segments meet in one point, ends included; parallel ones do not."""
    rx, ry, sx, sy = bx - ax, by - ay, dx - cx, dy - cy
    det = rx * sy - ry * sx
    t = ((cx - ax) * sy - (cy - ay) * sx) / det
    u = ((cx - ax) * ry - (cy - ay) * rx) / det
    return F.when(det == 0, F.lit(False)).otherwise(t.between(0, 1) & u.between(0, 1))


def sight_blocked(ax: Column, ay: Column, bx: Column, by: Column, ring: Column, most: float) -> Column:
    """Whether the sight from a to b meets a polygon: b lies inside, or an edge is crossed no farther than ``most`` from b. Parallel edges do not count."""
    n = F.size(ring)

    def near(i: Column) -> Column:
        c, d = F.element_at(ring, i), F.element_at(ring, F.when(i == n, F.lit(1)).otherwise(i + 1))
        rx, ry, sx, sy = bx - ax, by - ay, d["x"] - c["x"], d["y"] - c["y"]
        det = rx * sy - ry * sx
        t, u = ((c["x"] - ax) * sy - (c["y"] - ay) * sx) / det, ((c["x"] - ax) * ry - (c["y"] - ay) * rx) / det
        return F.when(F.abs(det) <= 1e-12, F.lit(False)).otherwise(t.between(0, 1) & u.between(0, 1) & ((1 - t) * F.sqrt(rx * rx + ry * ry) <= most))

    return (n >= 3) & (in_polygon(bx, by, ring) | F.exists(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), near))


def depth_to_point(u: Column, v: Column, depth: Column, cx: float, cy: float, fx: float, fy: float) -> tuple[Column, Column, Column]:
    """A pixel's point in the camera's frame; null without depth."""
    ok = depth > 0
    return F.when(ok, (u - cx) * depth / fx), F.when(ok, (v - cy) * depth / fy), F.when(ok, depth)


def overlap_ratio(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Common area of two rectangles (x0, y0, x1, y1) over the smaller one's; 1 where that has none."""
    zero = F.lit(0.0)
    common = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), zero) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), zero)
    smaller = F.least((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
    return F.when(smaller > 0, common / smaller).otherwise(F.lit(1.0))
