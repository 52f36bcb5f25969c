"""Poses composed along the spanning forest of a graph, by contraction with offsets.

Every node knows its place in the frame of its component's root. A round hooks each component along its best link to
another one, which gives the root's place in the other root's frame; hooks of hooks are composed by pointer doubling
(composition is associative), the ends of links move into the frames of the new roots, and links inside a component go. Links
have a total order, so the hooks of all rounds make up the one minimum spanning forest, whatever the number of
tasks; a chain of n nodes takes some log n joins, not n. Every table that a round leaves is in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geometry as G
from waymark.session import drop_path, fresh_path, materialize

Compose = Callable[[Column, Column], Column]
Inverse = Callable[[Column], Column]


def unique_links(links: DataFrame, *, inverse: Inverse = G.inverse2) -> DataFrame:
    """(rank, lo, hi, t): of the links (id, src, dst, rank, t) between two nodes with one rank, whatever their direction, that of smallest id.

    ``t`` is the place of ``dst`` seen from ``src``, and comes out as that of ``hi`` seen from ``lo``; links of a node with itself go.
    """
    forward = F.col("src") < F.col("dst")
    ends = links.filter("src <> dst").select("id", "rank", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), F.when(forward, F.col("t")).otherwise(inverse(F.col("t"))).alias("t"))
    return ends.groupBy("rank", "lo", "hi").agg(F.min_by("t", "id").alias("t"))


def _doubled(spark: SparkSession, hook: DataFrame, path: str, compose: Compose) -> tuple[DataFrame, str]:
    """Hooks (a, to, p) followed until every one leads to a root, with the places composed on the way."""
    while True:
        on = hook.select(F.col("a").alias("to"), F.col("to").alias("next"), F.col("p").alias("q"))
        step = hook.join(on, "to").select("a", F.col("next").alias("to"), F.when(F.col("next") == F.col("to"), F.col("p")).otherwise(compose(F.col("q"), F.col("p"))).alias("p"), (F.col("next") != F.col("to")).alias("moved"))
        old, path = path, fresh_path(spark, "hooks")
        hook = materialize(spark, step, "hooks", path=path)
        drop_path(spark, old)
        if hook.filter("moved").isEmpty():
            return hook.select("a", "to", "p"), path
        hook = hook.select("a", "to", "p")


def propagate(spark: SparkSession, links: DataFrame, start: DataFrame, *, compose: Compose = G.compose2, inverse: Inverse = G.inverse2, unit: Column | None = None) -> DataFrame:
    """(node, root, pose): poses of all nodes that a start reaches, composed from it along the spanning tree of best links.

    ``links`` is (id, src, dst, rank, t): links of a smaller rank (neighbours before loops before landmarks) are taken first, and
    of equal ranks the one with the smallest lower, then higher end. ``start`` is (node, pose); ``root`` is the start that a pose comes
    from, the smallest one of a component. Nodes that no start reaches have no row; a start without links is its own row.
    """
    unit = G.pose2(F.lit(0.0), F.lit(0.0), F.lit(0.0)) if unit is None else unit
    one = unique_links(links, inverse=inverse).select(F.struct("rank", "lo", "hi").alias("w"), F.col("lo").alias("a"), F.col("hi").alias("b"), "t")
    two = one.unionByName(one.select("w", F.col("b").alias("a"), F.col("a").alias("b"), inverse(F.col("t")).alias("t")))
    path = fresh_path(spark, "links")
    both = materialize(spark, two, "links", path=path)
    nodes = both.select(F.col("a").alias("node")).unionByName(start.select("node")).distinct()
    places = materialize(spark, nodes.select("node", F.col("node").alias("root"), unit.alias("pose")), "places", path=fresh_path(spark, "places"))
    hooks: list[DataFrame] = []
    while not both.isEmpty():
        best = both.groupBy("a").agg(F.min_by(F.struct("b", "t"), "w").alias("m")).select("a", F.col("m.b").alias("to"), inverse(F.col("m.t")).alias("p"))
        back = best.select(F.col("a").alias("to"), F.col("to").alias("back"))
        rooted = (F.col("back") == F.col("a")) & (F.col("a") < F.col("to"))  # of two that hook each other the smaller one is a root
        hook = best.join(back, "to").select("a", F.when(rooted, F.col("a")).otherwise(F.col("to")).alias("to"), F.when(rooted, unit).otherwise(F.col("p")).alias("p"))
        at = fresh_path(spark, "hooks")
        hook, at = _doubled(spark, materialize(spark, hook, "hooks", path=at), at, compose)
        hooks.append(hook)
        moved = both.join(hook.select("a", F.col("to").alias("ra"), F.col("p").alias("pa")), "a").join(hook.select(F.col("a").alias("b"), F.col("to").alias("rb"), F.col("p").alias("pb")), "b").filter("ra <> rb")
        moved = moved.select("w", F.col("ra").alias("a"), F.col("rb").alias("b"), compose(compose(F.col("pa"), F.col("t")), inverse(F.col("pb"))).alias("t"))
        old, path = path, fresh_path(spark, "links")
        both = materialize(spark, moved.groupBy("a", "b").agg(F.min(F.struct("w", "t")).alias("m")).select("m.w", "a", "b", "m.t"), "links", path=path)
        drop_path(spark, old)
    drop_path(spark, path)
    for hook in hooks:
        places = places.join(hook.select(F.col("a").alias("root"), "to", "p"), "root", "left").select("node", F.coalesce("to", "root").alias("root"), F.when(F.col("to").isNull(), F.col("pose")).otherwise(compose(F.col("p"), F.col("pose"))).alias("pose"))
    places = materialize(spark, places, "places", path=fresh_path(spark, "places"))
    given = places.join(start.select("node", F.col("pose").alias("at")), "node").select("root", "node", compose(F.col("at"), inverse(F.col("pose"))).alias("base"))
    first = given.groupBy("root").agg(F.min(F.struct("node", "base")).alias("m"))
    return places.join(first, "root").select("node", F.col("m.node").alias("root"), compose(F.col("m.base"), F.col("pose")).alias("pose"))
