"""Memory management: which places to forget, recall or keep, journals of manual edits, and keypoint selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def removable(nodes: DataFrame, linked: DataFrame, *, n: int, recent_share: float) -> DataFrame:
    """The n places to forget first: by weight, then age, then id.

    ``nodes`` is (node, weight, stamp). Places of ``linked`` (node; those that short-term memory links to) stay, and so does
    the youngest share of the rest.
    """
    open_ = nodes.join(linked, "node", "left_anti")
    total = open_.agg(F.floor(F.count("*") * recent_share).cast("int").alias("n")).first()["n"]
    if total:
        edge = open_.select(F.struct("stamp", "node").alias("k")).orderBy(F.desc("k")).limit(total).agg(F.min("k").alias("edge"))
        open_ = open_.join(F.broadcast(edge), F.struct("stamp", "node") < F.col("edge")).drop("edge")  # one row
    return open_.orderBy("weight", "stamp", "node").limit(n)


def recall(wanted: DataFrame, working: DataFrame, long_term: DataFrame, *, limit: int) -> DataFrame:
    """Places to bring back from long-term memory: wanted (node, priority), not in working memory, the most wanted first."""
    missing = wanted.join(working.select("node"), "node", "left_anti").orderBy(F.desc("priority"), "node").limit(limit)
    return long_term.join(missing, "node")


def replay_edits(edits: DataFrame, *, cursor: str, key: str, order: str) -> DataFrame:
    """The last edit of each key at or before its journal's cursor: what undo and redo leave in force."""
    rows = edits.filter(F.col(order) <= F.col(cursor))
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def strongest(points: DataFrame, n: int, *, by: list[str], response: str, key: str, cells: list[str] | None = None) -> DataFrame:
    """The n points of largest response of each image, or of each cell of each image."""
    w = Window.partitionBy(*by, *(cells or [])).orderBy(F.desc(response), key)
    return points.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def common_start(poses: DataFrame, *, device: str, order: str, reference: int) -> DataFrame:
    """(device, dx, dy): offset of each device's first position to that of the reference device."""
    first = poses.groupBy(device).agg(F.min_by(F.struct("x", "y"), order).alias("p"))
    ref = first.filter(F.col(device) == reference).select(F.col("p").alias("r"))
    return first.join(F.broadcast(ref), F.lit(True)).select(device, (F.col("r.x") - F.col("p.x")).alias("dx"), (F.col("r.y") - F.col("p.y")).alias("dy"))  # one row


def chained_shifts(segments: DataFrame, *, by: list[str], order: str) -> DataFrame:
    """(..., sx, sy): shift that puts each segment's start on the end of the one before, added up along the chain.

    Segments have start (x0, y0) and end (x1, y1).
    """
    w = Window.partitionBy(*by).orderBy(order)
    step = [F.coalesce(F.lag(f"{a}1").over(w) - F.col(f"{a}0"), F.lit(0.0)) for a in "xy"]
    rows = segments.withColumn("_dx", step[0]).withColumn("_dy", step[1])
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("sx", F.sum("_dx").over(run)).withColumn("sy", F.sum("_dy").over(run)).drop("_dx", "_dy")


def deskew(points: DataFrame, *, by: list[str], time: str, vx: str, vy: str, wz: str) -> DataFrame:
    """Points moved to the time of their scan's first one under constant planar velocity; scans without duration have no rows."""
    span = points.groupBy(*by).agg(F.min(time).alias("_t0"), F.max(time).alias("_t1")).filter("_t1 > _t0")
    rows = points.join(span, by)
    dt = F.col(time) - F.col("_t0")
    a = F.col(wz) * dt
    x = F.cos(a) * F.col("x") - F.sin(a) * F.col("y") + F.col(vx) * dt
    y = F.sin(a) * F.col("x") + F.cos(a) * F.col("y") + F.col(vy) * dt
    return rows.withColumn("_x", x).withColumn("_y", y).drop("x", "y", "_t0", "_t1").withColumnRenamed("_x", "x").withColumnRenamed("_y", "y")


def unique_association(tags: DataFrame, shelves: DataFrame, *, code: str) -> DataFrame:
    """Tags whose code exactly one shelf has, with that shelf, if the offset lies on its edge."""
    once = shelves.groupBy(code).agg(F.count("*").alias("_n"), F.first("shelf").alias("shelf"), F.first("length").alias("length")).filter("_n = 1").drop("_n")
    return tags.join(once, code).filter(F.col("offset").between(F.lit(0.0), F.col("length")))


def new_nodes(poses: DataFrame, mapped: DataFrame, *, tolerance: float) -> DataFrame:
    """(node, rebuild): nodes to add to a map; all of them, flagged, if a mapped pose moved by more than the tolerance or none is left."""
    both = poses.join(mapped.select("node", F.col("x").alias("mx"), F.col("y").alias("my")), "node", "left")
    moved = F.sqrt((F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")) + (F.col("y") - F.col("my")) * (F.col("y") - F.col("my"))) > tolerance
    facts = both.agg(F.coalesce(F.max(moved), F.lit(False)).alias("_moved"), F.count("mx").alias("_common"))
    rows = both.join(F.broadcast(facts), F.lit(True)).withColumn("rebuild", F.col("_moved") | (F.col("_common") == 0))  # one row
    return rows.filter(F.col("rebuild") | F.col("mx").isNull()).select("node", "rebuild")
