"""Link tables (src, dst, type) and node tables: filters, orientation, direction-free deduplication, uniqueness."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geometry as G

#: Link types. SELF stands for src = dst in filters, whatever the stored type.
NEIGHBOR, GLOBAL_CLOSURE, LOCAL_SPACE, LOCAL_TIME, USER, VIRTUAL, NEIGHBOR_MERGED, POSE_PRIOR, LANDMARK, GRAVITY = range(10)
SELF, ALL_WITH_LANDMARKS, ALL = 97, 98, 99


def filter_links(links: DataFrame, kind: int, *, inverted: bool = False) -> DataFrame:
    """Links whose type is not ``kind``, or is where inverted. SELF keeps links between different nodes, or loops."""
    match: Column = F.col("src") == F.col("dst") if kind == SELF else F.col("type") == kind
    return links.filter(match if inverted else ~match)


def unordered(links: DataFrame) -> DataFrame:
    return links.withColumn("lo", F.least("src", "dst")).withColumn("hi", F.greatest("src", "dst"))


def deduplicate(links: DataFrame, order: str = "id") -> DataFrame:
    """One link of each unordered pair and type: the first by ``order``."""
    w = Window.partitionBy("lo", "hi", "type").orderBy(order)
    return unordered(links).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "lo", "hi")


def between(links: DataFrame, a: int, b: int, *, both_ways: bool = True, kind: int = ALL) -> DataFrame:
    """Links from a to b (and from b to a), the given direction first."""
    hit = (F.col("src") == a) & (F.col("dst") == b)
    back = (F.col("src") == b) & (F.col("dst") == a)
    out = links.filter(hit | back if both_ways else hit)
    return out if kind == ALL else out.filter(F.col("type") == kind)


def touching(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links of each node of ``nodes`` (node), seen from it: ``other`` and whether the link was turned around."""
    out = links.select(F.col("src").alias("node"), F.col("dst").alias("other"), "type", F.lit(False).alias("turned"))
    back = links.filter("src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("other"), "type", F.lit(True).alias("turned"))
    return out.unionByName(back).join(nodes, "node", "left_semi")


def type_histogram(links: DataFrame) -> DataFrame:
    return links.groupBy("type").agg(F.count("*").alias("n"))


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def missing_ends(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links that name a node that isn't there: what a foreign key would refuse."""
    ids = nodes.select("node")
    return links.join(ids.withColumnRenamed("node", "src"), "src", "left_anti").unionByName(links.join(ids.withColumnRenamed("node", "dst"), "dst", "left_anti").select(links.columns)).distinct()


def node_ids(nodes: DataFrame, links: DataFrame, *, ignore_children: bool = False, ignore_bad: bool = False, compat: bool = True) -> DataFrame:
    """Node ids by weight and links.

    With ``compat`` the child test holds for every node of weight above -9, as the query it stands for does; without
    it, nodes that no other node links to or that link to another node stay.
    """
    out = nodes
    if ignore_children:
        out = out.filter("weight > -9")
        if not compat:
            outgoing = links.filter("src <> dst").select(F.col("src").alias("node"))
            incoming = links.filter("src <> dst").select(F.col("dst").alias("node"))
            out = out.join(outgoing, "node", "left_semi").unionByName(out.join(incoming, "node", "left_anti")).distinct()
    if ignore_bad:
        out = out.join(links.select(F.col("src").alias("node")), "node", "left_semi")
    return out.select("node")


def max_information(links: DataFrame, axes: list[str]) -> DataFrame:
    """The largest information of each axis over neighbour links; no row where the first axis has none."""
    out = links.filter(F.col("type").isin(NEIGHBOR, NEIGHBOR_MERGED)).agg(*(F.max(a).alias(a) for a in axes))
    return out.filter(F.coalesce(F.col(axes[0]), F.lit(0.0)) != 0)


def chains(turns: DataFrame, group: str, order: str, linked: Column) -> DataFrame:
    """Island number of consecutive rows that are linked, within a group."""
    w = Window.partitionBy(group).orderBy(order)
    return turns.withColumn("chain", F.sum(F.when(F.coalesce(linked, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def merge_links(first: DataFrame, second: DataFrame, *, merged: str = "merged") -> DataFrame:
    """(id, src, dst, merged, t, info): each link followed by one that begins where it ends, as one link.

    ``first`` is (id, src, dst, merged, t, info), ``second`` (src, dst, t, info); ``t`` has the twelve numbers of a pose, ``info`` the 36 of a 6 by 6
    information matrix. Where ``merged`` holds, uncertainties add up: (A^-1 + B^-1)^-1. Else the matrix with the smaller first entry
    is taken. Two null transforms give null and the identity, one gives null for both; so does a matrix without an inverse.
    """
    b = second.select(F.col("src").alias("dst"), F.col("dst").alias("_to"), F.col("t").alias("_t"), F.col("info").alias("_b"))
    pairs = first.select("id", "src", "dst", F.col(merged).alias("merged"), "t", F.col("info").alias("_a")).join(b, "dst")
    pairs = pairs.select("id", "src", F.col("_to").alias("dst"), "merged", F.when(F.col("t").isNotNull() & F.col("_t").isNotNull(), G.compose3(F.col("t"), F.col("_t"))).alias("t"), (F.col("t").isNull() & F.col("_t").isNull()).alias("_none"), "_a", "_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            info = [None] * batch.num_rows
            both = np.array([a.is_valid and b.is_valid for a, b in zip(batch.column("_a"), batch.column("_b"), strict=True)], bool)
            has = np.flatnonzero(both & batch.column("t").is_valid().to_numpy(zero_copy_only=False))
            if len(has):
                a, b = (batch.column(c).take(pa.array(has)).flatten().to_numpy(zero_copy_only=False).reshape(-1, 6, 6) for c in ("_a", "_b"))
                add = batch.column("merged").take(pa.array(has)).to_numpy(zero_copy_only=False).astype(bool)
                out = np.where((a[:, 0, 0] < b[:, 0, 0])[:, None, None], a, b)
                able = np.array([np.linalg.matrix_rank(x) == 6 and np.linalg.matrix_rank(y) == 6 for x, y in zip(a, b, strict=True)])
                sums = add & able
                out[sums] = np.linalg.inv(np.linalg.inv(a[sums]) + np.linalg.inv(b[sums]))
                for i, value, fine in zip(has, out, able | ~add, strict=True):
                    info[i] = value.ravel() if fine else None
            for i in np.flatnonzero(batch.column("_none").to_numpy(zero_copy_only=False)):
                info[i] = np.eye(6).ravel()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "src", "dst", "merged", "t")), pa.array(info, pa.list_(pa.float64()))], names=["id", "src", "dst", "merged", "t", "info"])

    kinds = dict(pairs.dtypes)
    return pairs.mapInArrow(run, f"id {kinds['id']}, src {kinds['src']}, dst {kinds['dst']}, merged boolean, t array<double>, info array<double>")
