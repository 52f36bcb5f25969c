"""Session helpers: shipping the package to executors, the shared folder, and tables written there."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Upper bound of one Arrow batch handed to a Python worker, so that long texts cannot pile up in one batch.
ARROW_BATCH_BYTES = 16 << 20
_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable on every executor and bound Arrow batches. Safe to call often."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="waymark-"), "waymark.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        sc.addPyFile(target)
        _SHIPPED.add(sc.applicationId)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    _broadcast_what_is_measured(spark)
    return spark


def _broadcast_what_is_measured(spark: SparkSession) -> None:
    """Joins without a hint broadcast a side only by its size as shuffled, up to the session's threshold.

    Planned sizes are those of compressed files, and rows made by explode count as one: a table of 1 MB can be 1 GB on the driver.
    """
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get("spark.sql.adaptive.enabled") == "true" and spark.conf.get(planned) != "-1":
        if spark.conf.get(measured, None) is None:
            spark.conf.set(measured, spark.conf.get(planned))
        spark.conf.set(planned, "-1")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Only a local master gets a temporary one where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="waymark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    if "://" not in found and not found.startswith("file:"):
        found = "file://" + os.path.abspath(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/waymark/{name}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df: DataFrame, name: str, *, path: str | None = None, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends there, and executors may be lost.

    Shuffle files of the write are released as soon as it has ended.
    """
    path = path or fresh_path(spark, name)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.mode("overwrite").option("compression", codec).parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path written by :func:`materialize`."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
