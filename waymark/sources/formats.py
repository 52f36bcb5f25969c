"""Text and file formats of trajectories, points and records, read as DataFrames."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the pose formats that are one pose per line: separators, how many header lines or comment marks, and
#: where time, translation and rotation stand. Rotation is a quaternion (x, y, z, w), a yaw, or twelve numbers.
POSE_FORMATS: dict[str, dict] = {
    "raw": {"matrix": 0},
    "rgbd": {"time": 0, "xyz": (1, 2, 3), "quaternion": (4, 5, 6, 7)},
    "rgbd_id": {"time": 0, "xyz": (1, 2, 3), "quaternion": (4, 5, 6, 7), "id": 8},
    "kitti": {"matrix": 0},
    "new_college": {"time": 0, "xyz": (1, 2, 3), "yaw": 6},
    "malaga": {"time": 0, "xyz": (8, 9, 10)},
    "st_lucia": {"time": 0, "xyz": (5, 4, 6)},
    "karlsruhe": {"time": 0, "xyz": (8, 9, 10), "yaw": 6},
    "euroc": {"time": 0, "time_scale": 1e-9, "xyz": (1, 2, 3), "quaternion_wxyz": (4, 5, 6, 7), "separator": ","},
}


def _rotation(q: tuple[Column, Column, Column, Column]) -> list[list[Column]]:
    x, y, z, w = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def read_poses(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """(line, id, stamp, pose): pose as twelve numbers. Comment lines and lines that are too short are left out.

    ``line`` is the position in the file; a file is read as one split, as its line numbers need, files in parallel.
    """
    if fmt == "g2o":
        raise ValueError("g2o files can be written but not read")
    if fmt == "toro":
        return _read_toro(spark, path)
    spec = POSE_FORMATS[fmt]
    rows = _lines(spark, path, spec.get("separator"))
    v = lambda i: F.expr(f"try_cast(f[{i}] AS double)")
    if "matrix" in spec:
        at = spec["matrix"]
        stamp, pose = F.lit(None).cast("double"), F.array(*(v(at + i) for i in range(12)))
        need = at + 12
    else:
        stamp = v(spec["time"]) * spec.get("time_scale", 1.0)
        xyz = [v(i) for i in spec["xyz"]]
        if "quaternion" in spec or "quaternion_wxyz" in spec:
            q = [v(i) for i in spec.get("quaternion", spec.get("quaternion_wxyz"))]
            if "quaternion_wxyz" in spec:
                q = [q[1], q[2], q[3], q[0]]
            r = _rotation(tuple(q))
        else:
            yaw = v(spec["yaw"]) if "yaw" in spec else F.lit(0.0)
            zero, one = F.lit(0.0), F.lit(1.0)
            r = [[F.cos(yaw), -F.sin(yaw), zero], [F.sin(yaw), F.cos(yaw), zero], [zero, zero, one]]
        pose = F.array(*(x for row, t in zip(r, xyz, strict=True) for x in (*row, t)))
        need = 1 + max(i for k, x in spec.items() if k not in ("separator", "time_scale") for i in (x if isinstance(x, tuple) else (x,)))
    ident = v(spec["id"]).cast("int") if "id" in spec else (F.col("line") + 1).cast("int")
    return rows.filter(F.size("f") >= need).select("line", ident.alias("id"), stamp.alias("stamp"), pose.alias("pose")).filter(~F.exists("pose", lambda x: x.isNull()))


def _lines(spark: SparkSession, path: str, separator: str | None) -> DataFrame:
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    return text.filter(~F.col("value").rlike(r"^\s*([#%]|$)")).withColumn("f", F.split(F.trim("value"), separator or r"[\s,]+"))


def _read_toro(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of a graph file: VERTEX3 id x y z roll pitch yaw, or VERTEX2 id x y yaw."""
    rows = _lines(spark, path, None)
    v = lambda i: F.expr(f"try_cast(f[{i}] AS double)")
    from waymark.functions.geometry import from_euler

    flat = F.col("f")[0] == "VERTEX2"
    zero = F.lit(0.0)
    pose = from_euler(v(2), v(3), F.when(flat, zero).otherwise(v(4)), F.when(flat, zero).otherwise(v(5)), F.when(flat, zero).otherwise(v(6)), F.when(flat, v(4)).otherwise(v(7)))
    return rows.filter(F.col("f")[0].isin("VERTEX2", "VERTEX3")).select("line", v(1).cast("int").alias("id"), F.lit(None).cast("double").alias("stamp"), pose.alias("pose"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, z, kind, segment, node) of CSV points: rows whose x or y is no number go, the kind is ``occupied`` by default."""
    df = spark.read.option("header", True).csv(path)
    names = {c.lower().replace("_", ""): c for c in df.columns}

    def pick(*options: str) -> Column:
        found = [F.col(f"`{names[o]}`") for o in options if o in names]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    number = lambda c: c.try_cast("double")
    out = df.select(number(pick("x", "xm")).alias("x"), number(pick("y", "ym")).alias("y"), F.coalesce(number(pick("z", "zm")), F.lit(0.0)).alias("z"), F.coalesce(F.nullif(F.lower(F.trim(pick("kind", "type"))), F.lit("")), F.lit("occupied")).alias("kind"), pick("segmentindex", "segment").try_cast("int").alias("segment"), pick("nodeid", "node").try_cast("int").alias("node"))
    return out.filter("x is not null and y is not null and not isnan(x) and not isnan(y)")


class _Strict(ValueError):
    pass


def _reject_constant(name: str):
    raise _Strict(f"constant {name}")


def _pairs(items: list) -> dict:
    out = {}
    for k, v in items:
        if k in out:
            raise _Strict(f"duplicate key {k}")
        out[k] = v
    return out


def check_record(line: str, allowed: dict[str, str] | None = None, required: tuple[str, ...] = (), depth: int = 16) -> str | None:
    """Why a line isn't a strict record, or None. ``allowed`` maps field names to int, number, bool, string, array, object or any."""
    if not line.strip():
        return "blank line"
    try:
        record = json.loads(line, object_pairs_hook=_pairs, parse_constant=_reject_constant)
    except _Strict as e:
        return str(e)
    except (ValueError, RecursionError):
        return "not JSON"
    if not isinstance(record, dict):
        return "not an object"

    def deep(v, level: int) -> bool:
        if level > depth:
            return True
        return any(deep(x, level + 1) for x in (v.values() if isinstance(v, dict) else v)) if isinstance(v, (dict, list)) else isinstance(v, float) and not math.isfinite(v)

    if deep(record, 0):
        return "nested too deep or not finite"
    for name in required:
        if name not in record:
            return f"missing field {name}"
    kinds = {"int": lambda v: type(v) is int, "number": lambda v: type(v) in (int, float), "bool": lambda v: type(v) is bool, "string": lambda v: isinstance(v, str), "array": lambda v: isinstance(v, list), "object": lambda v: isinstance(v, dict), "any": lambda v: True}
    for name, v in record.items():
        if allowed is not None:
            if name not in allowed:
                return f"unknown field {name}"
            if v is not None and not kinds[allowed[name]](v):
                return f"field {name} is not {allowed[name]}"
    return None


def read_strict_jsonl(spark: SparkSession, path: str, *, allowed: dict[str, str] | None = None, required: tuple[str, ...] = (), increasing: str | None = None, unique: str | None = None) -> DataFrame:
    """(file, line, value, reason) of every line; ``reason`` is null for a valid one.

    Besides each line's own checks: the last line must end with a newline, ``increasing`` must rise strictly along a
    file and ``unique`` must not repeat in it.
    """
    from pyspark.sql import Window

    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    text = text.withColumn("ended", F.endswith("value", F.lit("\n")) | (F.length("value") == 0)).withColumn("value", F.regexp_replace("value", "\n$", ""))
    # the text itself must not be carried along with each of its lines
    whole = text.filter("value <> '' or not ended").select("file", "ended", F.size(F.split("value", "\n")).alias("n"), F.split("value", "\n").alias("lines"))
    lines = whole.select("file", "ended", "n", F.posexplode("lines").alias("line", "value"))

    @F.pandas_udf("string")
    def check(values: pd.Series) -> pd.Series:
        return values.map(lambda x: check_record(x, allowed, required))

    out = lines.withColumn("reason", F.coalesce(check("value"), F.when(~F.col("ended") & (F.col("line") == F.col("n") - 1), "no final newline")))
    w = Window.partitionBy("file").orderBy("line")
    if increasing:
        now = F.get_json_object("value", f"$.{increasing}").try_cast("double")
        out = out.withColumn("_t", F.when(F.col("reason").isNull(), now)).withColumn("_m", F.max("_t").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        out = out.withColumn("reason", F.coalesce("reason", F.when(F.col("_t") <= F.col("_m"), f"{increasing} does not rise"))).drop("_t", "_m")
    if unique:
        out = out.withColumn("_u", F.get_json_object("value", f"$.{unique}"))
        seen = F.row_number().over(Window.partitionBy("file", "_u").orderBy("line"))
        out = out.withColumn("_s", seen).withColumn("reason", F.coalesce("reason", F.when(F.col("_u").isNotNull() & (F.col("_s") > 1), f"{unique} repeats"))).drop("_u", "_s")
    return out.select("file", "line", "value", "reason")


def read_csv_strict(spark: SparkSession, path: str) -> DataFrame:
    """RFC 4180: quoted fields may hold separators, doubled quotes and line breaks."""
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def replay(nodes: DataFrame, *, start: int = 0, stop: int = 0, start_map: int = 0, stop_map: int = -1, skip_intermediate: bool = True) -> DataFrame:
    """Stored nodes (node, map_id, weight) in the order and range of a replay; ``stop`` 0 and ``stop_map`` -1 are open."""
    out = nodes.filter(F.col("node") >= start).filter(F.col("map_id") >= start_map)
    if stop:
        out = out.filter(F.col("node") <= stop)
    if stop_map >= 0:
        out = out.filter(F.col("map_id") <= stop_map)
    return (out.filter("weight <> -1") if skip_intermediate else out).orderBy("node")


def _planar(x: Column, y: Column, z: Column, axes: str) -> tuple[Column, Column]:
    return {"xy": (x, y), "xz": (x, z)}[axes]


def read_price_tags(spark: SparkSession, path: str, *, axes: str = "xy") -> DataFrame:
    """(tag_id, payload, segment, node_count, x, y, yaw, stamp) of JSON arrays of tags, fields in either spelling; what is no object is left out."""
    text = spark.read.text(path, wholetext=True)
    kind = "array<struct<tagIdentifier:string,id:string,payload:string,segmentIndex:int,segment_index:int,nodeCount:int,x:double,y:double,z:double,yaw:double,timestamp:double>>"
    t = text.select(F.explode(F.from_json("value", kind)).alias("t")).filter("t is not null").select("t.*")
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    word = lambda *cs: F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in cs), F.lit(""))
    x, y = _planar(number("x"), number("y"), number("z"), axes)
    segment = F.coalesce(F.nullif(F.col("segmentIndex"), F.lit(0)), F.col("segment_index"), F.lit(0))
    return t.select(word("tagIdentifier", "id").alias("tag_id"), word("payload").alias("payload"), segment.alias("segment"), F.col("nodeCount").alias("node_count"), x.alias("x"), y.alias("y"), number("yaw").alias("yaw"), F.col("timestamp").alias("stamp"))


def read_trajectory(spark: SparkSession, json_path: str | None, csv_path: str | None, *, axes: str = "xy") -> DataFrame:
    """(node, x, y, yaw, stamp) of trajectory samples: a JSON array, or the CSV file where that holds none; rows without numbers go."""
    number = lambda c: F.col(c).try_cast("double")
    fields = ("x", "y", "z", "yaw", "nodeCount", "node_id", "timestamp", "stamp")
    rows = None
    if json_path:
        kind = "array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>"
        rows = spark.read.text(json_path, wholetext=True).select(F.posexplode(F.from_json("value", kind)).alias("i", "t")).filter("t is not null").select("i", "t.*")
    if (rows is None or rows.isEmpty()) and csv_path:
        found = spark.read.option("header", True).csv(csv_path).withColumn("i", F.monotonically_increasing_id())
        rows = found.select("i", *(F.col(f) if f in found.columns else F.lit(None).cast("string").alias(f) for f in fields))
    if rows is None:
        return spark.createDataFrame([], "node int, x double, y double, yaw double, stamp double")
    filled = rows.select("i", *(F.when(F.col(f).isNull(), F.lit(0.0)).otherwise(number(f)).alias(f) for f in ("x", "y", "z", "yaw")), F.coalesce(*(number(c) for c in ("nodeCount", "node_id")), F.col("i") + 1.0).cast("int").alias("node"), F.coalesce(number("timestamp"), number("stamp")).alias("stamp"))
    x, y = _planar(F.col("x"), F.col("y"), F.col("z"), axes)
    return filled.filter("x is not null and y is not null and z is not null and yaw is not null").select("node", x.alias("x"), y.alias("y"), "yaw", "stamp")
