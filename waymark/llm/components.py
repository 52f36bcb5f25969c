"""Connected components of an edge table: in one task up to a counted number of edges, else by minimum labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.graph import roots
from waymark.session import drop_path, fresh_path, materialize

#: Edges that one task may take (16 MB); beyond it the work is shared out.
TASK_EDGES = 1 << 20


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    ids, ends = np.unique(np.concatenate([t.column("a").to_numpy(), t.column("b").to_numpy()]), return_inverse=True)
    root = roots(len(ids), ends[: t.num_rows], ends[t.num_rows :])
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["id", "component"])


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, component) of every end of the edges (a, b); the component is the smallest id in it.

    ``edges`` should be a written table, as it is counted first. Each round takes the smallest label around a node and then
    the label of that label, and is written to the shared folder. Hubs are combined on the map side, and joins on them can be
    split by the engine.
    """
    if edges.count() <= TASK_EDGES:
        return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInArrow(_in_one_task, "id long, component long")
    both_path = fresh_path(spark, "edges")
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("other"))).distinct()
    both = materialize(spark, both, "edges", path=both_path)
    path = fresh_path(spark, "labels")
    labels = materialize(spark, both.groupBy("id").agg(F.min("other").alias("o")).select("id", F.least("id", "o").alias("component")), "labels", path=path)
    while True:
        around = both.join(labels.select(F.col("id").alias("other"), "component"), "other").groupBy("id").agg(F.min("component").alias("near"))
        lower = labels.join(around, "id").select("id", F.col("component").alias("before"), F.least("component", "near").alias("label"))
        jump = lower.join(labels.select(F.col("id").alias("label"), F.col("component").alias("further")), "label", "left")
        after = jump.select("id", F.least("label", F.coalesce("further", "label")).alias("component"), "before")
        old, path = path, fresh_path(spark, "labels")
        written = materialize(spark, after, "labels", path=path)
        done = written.filter(F.col("component") != F.col("before")).isEmpty()
        drop_path(spark, old)
        labels = written.select("id", "component")
        if done:
            drop_path(spark, both_path)
            return labels
