"""Exports: pose files, canonical JSON, GeoJSON, graphs, manifests, upserts and versioned publishing."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pose_lines(poses: DataFrame, fmt: str) -> DataFrame:
    """(id, line) of poses (id, stamp, pose of twelve numbers) as raw, kitti, rgbd, rgbd_id, toro or g2o lines."""
    from waymark.functions.geometry import euler_of

    p = F.col("pose")
    number = lambda c, d=6: F.format_string(f"%.{d}f", c)
    if fmt in ("raw", "kitti"):
        line = F.concat_ws(" ", *(number(p[i]) for i in range(12)))
    elif fmt in ("rgbd", "rgbd_id", "g2o"):
        trace = p[0] + p[5] + p[10]
        # the largest component first keeps the root away from zero
        w, x, y, z = (F.sqrt(F.greatest(F.lit(0.0), e)) / 2 for e in (1 + trace, 1 + p[0] - p[5] - p[10], 1 - p[0] + p[5] - p[10], 1 - p[0] - p[5] + p[10]))
        signed = lambda m, s: F.when(s < 0, -m).otherwise(m)
        q = [signed(x, p[9] - p[6]), signed(y, p[2] - p[8]), signed(z, p[4] - p[1]), w]
        body = [number(c) for c in (p[3], p[7], p[11], *q)]
        if fmt == "g2o":
            line = F.concat_ws(" ", F.lit("VERTEX_SE3:QUAT"), F.col("id").cast("string"), *body)
        else:
            line = F.concat_ws(" ", number(F.col("stamp")), *body, *([F.col("id").cast("string")] if fmt == "rgbd_id" else []))
    elif fmt == "toro":
        roll, pitch, yaw = euler_of(p)
        line = F.concat_ws(" ", F.lit("VERTEX3"), F.col("id").cast("string"), *(number(c) for c in (p[3], p[7], p[11], roll, pitch, yaw)))
    else:
        raise ValueError(fmt)
    return poses.select("id", line.alias("line"))


def write_lines(lines: DataFrame, path: str, order: str = "id") -> None:
    lines.orderBy(order).select("line").write.mode("overwrite").text(path)


def kml(points: DataFrame) -> Column:
    """Coordinates of a KML line string, in order, from collected (order, lon, lat, alt) structs."""
    return F.array_join(F.transform(F.array_sort("points"), lambda p: F.concat_ws(",", *(p[c].cast("string") for c in ("lon", "lat", "alt")))), " ")


def geojson_points(df: DataFrame, x: str, y: str, properties: list[str]) -> DataFrame:
    """One feature a row, as text."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(x), F.col(y)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))
    return df.select(F.to_json(feature).alias("value"))


def geojson_lines(points: DataFrame, *, by: list[str], order: str, x: str, y: str, kind: str = "trajectory") -> DataFrame:
    """One line-string feature for each key with two points or more, as text; points in order, one trajectory is one row."""
    lines = points.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, x, y))).alias("_p")).filter(F.size("_p") >= 2)
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform("_p", lambda p: F.array(p[x], p[y])).alias("coordinates"))
    properties = F.struct(*by, F.lit(kind).alias("kind"), F.size("_p").alias("nodes"))
    return lines.select(*by, F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("value"))


def append_rows(df: DataFrame, path: str, *, partition: str) -> None:
    """Add rows to a stored table, one folder for each value of ``partition``; readers see a finished append or nothing of it."""
    df.write.mode("append").partitionBy(partition).parquet(path)


def dot_edges(links: DataFrame) -> DataFrame:
    return links.select(F.format_string('  "%s" -> "%s" [label="%s"];', F.col("src").cast("string"), F.col("dst").cast("string"), F.col("type").cast("string")).alias("value"))


def canonical_json(text: str) -> str:
    """Sorted keys, no spaces, integers without a fraction, and no negative zero."""

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        if isinstance(v, float) and v == int(v) and abs(v) < 2**53:
            return int(v)
        return v

    return json.dumps(plain(json.loads(text)), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def with_canonical_digest(df: DataFrame, column: str) -> DataFrame:
    """Adds the canonical text of a JSON column and its SHA-256."""

    @F.pandas_udf("string")
    def canonical(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else canonical_json(x))

    return df.withColumn("canonical", canonical(column)).withColumn("sha256", F.sha2("canonical", 256))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def upsert(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Stored rows with the columns of ``changes`` replaced where these are not null, and new rows added."""
    new = changes.select(F.col(key), *(F.col(c).alias(f"_n_{c}") for c in changes.columns if c != key))
    both = stored.join(new, key, "full_outer")
    return both.select(*(F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c) if c in changes.columns and c != key else F.col(c) for c in stored.columns))


def replace_children(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Delete-then-insert: all stored rows of a key that ``fresh`` has go, and the fresh ones come in."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def _files(spark: SparkSession, base: str):
    """(file system, function that makes its paths) of a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def publish(spark: SparkSession, df: DataFrame, base: str, version: str, check=None) -> str:
    """Write a version beside the others, check it, and only then name it in a new pointer; a failed check leaves what was.

    Pointers are numbered and never replaced or deleted, so a reader finds a version at any moment: that of the highest number.
    """
    fs, path = _files(spark, base)
    staging, final = f"{base}/.staging-{uuid.uuid4().hex}", f"{base}/{version}"
    df.write.parquet(staging)
    if check is not None and not check(spark.read.parquet(staging)):
        fs.delete(path(staging), True)
        raise ValueError("the new version did not pass its check")
    if fs.exists(path(final)) or not fs.rename(path(staging), path(final)):
        raise ValueError(f"version {version} is there already")
    number = max([n for n, _ in _pointers(fs, path, base)], default=0)
    while True:  # creating a file that is there fails, so of two writers one takes the next number
        number += 1
        try:
            out = fs.create(path(f"{base}/CURRENT-{number:012d}"), False)
        except Exception:  # noqa: BLE001  any file system's own exception
            if not fs.exists(path(f"{base}/CURRENT-{number:012d}")):
                raise
            continue
        out.write(bytearray(version.encode()))
        out.close()
        return final


def _pointers(fs, path, base: str) -> list[tuple[int, str]]:
    """(number, file) of all pointers."""
    found = fs.globStatus(path(f"{base}/CURRENT-*")) or []
    return sorted((int(f.getPath().getName().rpartition("-")[2]), str(f.getPath().toString())) for f in found)


def current_version(spark: SparkSession, base: str) -> str:
    """The version of the highest pointer that names a whole one; a pointer that is still empty or names none is passed over."""
    fs, path = _files(spark, base)
    for _, file in reversed(_pointers(fs, path, base)):
        line = spark.read.text(file).first()
        if line and fs.exists(path(f"{base}/{line[0]}/_SUCCESS")):
            return line[0]
    raise ValueError(f"no version is published in {base}")


def remove_stale(spark: SparkSession, base: str, older_than_s: float) -> int:
    """Delete staging folders that writers left behind, last changed that long ago; the number of them."""
    import time

    fs, path = _files(spark, base)
    old = [f.getPath() for f in fs.globStatus(path(f"{base}/.staging-*")) or [] if f.getModificationTime() / 1000 <= time.time() - older_than_s]
    return sum(bool(fs.delete(p, True)) for p in old)
