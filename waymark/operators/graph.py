"""Graph search as iterated joins: bounded breadth-first search, shortest paths, components, reduction.

Each round is one join of the frontier with the edges and one aggregation; rounds are cut from each other by tables in
the shared folder, and a round without change ends the search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.session import drop_path, fresh_path, materialize


#: Edges that one task may take (16 MB), counted first.
TASK_EDGES = 1 << 20


def roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest position that each of n positions reaches over the pairs (x, y)."""
    root = np.arange(n)
    while True:
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
        if not len(x):
            return root
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while (root[root] != root).any():
            root = root[root]


def _hooks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (src, dst) of a counted number: gives (src, to), the smallest end that each end reaches."""
    t = pa.Table.from_batches(list(batches), pa.schema([("src", pa.int64()), ("dst", pa.int64())]))
    ids, ends = np.unique(np.concatenate([t.column("src").to_numpy(), t.column("dst").to_numpy()]), return_inverse=True)
    found = roots(len(ids), ends[: t.num_rows], ends[t.num_rows :])
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[found])], names=["src", "to"])


def both_ways(edges: DataFrame, *extra: str) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *extra)
    return edges.select("src", "dst", *extra).unionByName(back)


def relax(spark: SparkSession, edges: DataFrame, start: DataFrame, *, limit: float | None = None, max_rounds: int = 1000, routes: bool = False) -> DataFrame:
    """(origin, node, cost): least cost from each origin over directed edges (src, dst, cost >= 0), up to ``limit``.

    ``start`` is (origin, node). A round extends only the nodes whose cost fell in the round before; edges are written
    once. With ``routes`` there is also the route, an array of nodes, the smallest one of equal costs (costs must be above 0
    then). A search that is not over after ``max_rounds`` rounds is an error, as its costs are not final.
    """
    edge_path, path = fresh_path(spark, "edges"), fresh_path(spark, "costs")
    edges = materialize(spark, edges.select("src", "dst", F.col("cost").cast("double").alias("step")), "edges", path=edge_path)
    way = [F.array("node").alias("route")] if routes else []
    extra = ["route"] if routes else []
    costs = materialize(spark, start.select("origin", "node", F.lit(0.0).alias("cost"), *way, F.lit(True).alias("fresh")).distinct(), "costs", path=path)
    for _ in range(max_rounds):
        step = costs.filter("fresh").withColumnRenamed("node", "src").join(edges, "src")
        longer = [F.concat("route", F.array("dst")).alias("route")] if routes else []
        step = step.select("origin", F.col("dst").alias("node"), (F.col("cost") + F.col("step")).alias("cost"), *longer)
        if limit is not None:
            step = step.filter(F.col("cost") <= limit)
        found = step.groupBy("origin", "node").agg(F.min(F.struct("cost", *extra)).alias("new"))
        merged = costs.join(found, ["origin", "node"], "full_outer")
        better = F.col("new").isNotNull() & (F.col("cost").isNull() | (F.col("new") < F.struct("cost", *extra)))
        merged = merged.select("origin", "node", *(F.when(better, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in ["cost", *extra]), better.alias("fresh"))
        old, path = path, fresh_path(spark, "costs")
        costs = materialize(spark, merged, "costs", path=path)
        drop_path(spark, old)
        if costs.filter("fresh").isEmpty():
            drop_path(spark, edge_path)
            return costs.select("origin", "node", "cost", *extra)
    raise RuntimeError(f"the search was not over after {max_rounds} rounds")


def margins(spark: SparkSession, links: DataFrame, start: DataFrame, depth: int, *, loops_cost: bool = False, free: DataFrame | None = None) -> DataFrame:
    """(origin, node, margin): nodes within ``depth`` neighbour links (0: unlimited).

    ``links`` is (src, dst, type), used both ways. Links other than neighbour ones keep the margin unless
    ``loops_cost``; nodes of ``free`` (node) do not use a step.
    """
    edges = both_ways(links, "type").withColumn("cost", F.when((F.col("type") == 0) | F.lit(loops_cost), 1.0).otherwise(0.0)).select("src", "dst", "cost")
    if free is not None:
        edges = edges.join(free.select(F.col("node").alias("dst"), F.lit(True).alias("_free")), "dst", "left").select("src", "dst", F.when(F.col("_free"), 0.0).otherwise(F.col("cost")).alias("cost"))
    out = relax(spark, edges, start, limit=float(depth) if depth else None)
    return out.select("origin", "node", F.col("cost").cast("int").alias("margin"))


def components(spark: SparkSession, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached, by contraction.

    A round hooks every node to the neighbour with the smallest hash, or to itself if its own is smaller, follows two hooks
    more, and replaces the ends of the edges by what they are hooked to; edges inside a contracted node go. Hashes differ
    from round to round, so that a chain shrinks to a third or less however its nodes are numbered. As soon as no more than
    TASK_EDGES are left (of whole-numbered nodes), one task hooks what they connect. The hooks of all rounds are composed in
    the end. Ends of edges that are not in ``nodes`` connect, but are not returned.
    """
    whole = dict(edges.dtypes)["src"] in ("int", "bigint") and dict(edges.dtypes)["dst"] in ("int", "bigint")
    hooks: list[DataFrame] = []
    path = fresh_path(spark, "edges")
    both = materialize(spark, both_ways(edges.select("src", "dst")).filter("src <> dst").distinct(), "edges", path=path)
    while left := both.count():
        if whole and left <= TASK_EDGES:
            hooks.append(materialize(spark, both.select(F.col("src").cast("long"), F.col("dst").cast("long")).coalesce(1).mapInArrow(_hooks, "src long, to long"), "hooks", path=fresh_path(spark, "hooks")))
            break
        mark = len(hooks)
        low = both.groupBy("src").agg(F.min(F.struct(F.xxhash64("dst", F.lit(mark)).alias("h"), F.col("dst").alias("to"))).alias("m"))
        low = low.select("src", F.least("m", F.struct(F.xxhash64("src", F.lit(mark)).alias("h"), F.col("src").alias("to")))["to"].alias("to"))
        for _ in range(2):
            low = low.join(low.select(F.col("src").alias("to"), F.col("to").alias("next")), "to").select("src", F.col("next").alias("to"))
        hook = materialize(spark, low, "hooks", path=fresh_path(spark, "hooks"))
        hooks.append(hook)
        moved = both.join(hook.withColumnRenamed("to", "a"), "src").join(hook.select(F.col("src").alias("dst"), F.col("to").alias("b")), "dst")
        old, path = path, fresh_path(spark, "edges")
        both = materialize(spark, moved.filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "edges", path=path)
        drop_path(spark, old)
    drop_path(spark, path)
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))) if hooks else None
    labels = (nodes.select("node").unionByName(ends) if hooks else nodes.select("node")).distinct().withColumn("component", F.col("node"))
    for hook in hooks:
        labels = labels.join(hook.select(F.col("src").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    labels = materialize(spark, labels, "labels", path=fresh_path(spark, "labels"))
    least = labels.groupBy("component").agg(F.min("node").alias("least"))
    return labels.join(least, "component").join(nodes.select("node").distinct(), "node", "left_semi").select("node", F.col("least").alias("component"))


def reduce_by(labels: DataFrame, links: DataFrame, order: str = "id") -> DataFrame:
    """One link of each unordered pair of components, neighbour links first: the links of the reduced graph."""
    ends = links.join(labels.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst").filter("a <> b")
    best = ends.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min(F.struct((F.col("type") != 0).alias("other"), F.col(order).alias("id"), "type")).alias("m"))
    return best.select("lo", "hi", F.col("m.id").alias("id"), F.col("m.type").alias("type"))


def place_prediction(margins_: DataFrame, places: int, profile: list[float], *, epsilon: float = 0.01) -> DataFrame:
    """(origin, node, p): how likely one moves from a place to another, by the margin between them.

    ``profile`` is the probability of the virtual place (of being nowhere known), then that of margins 0, 1, ...; rows of
    ``margins_`` (origin, node, margin) are within it. What neighbours that are missing would have had goes to the place itself, and
    what the profile leaves below 1 is spread over all places that have nothing. A place's row is scaled to 1 less the virtual
    place's share, and values below ``epsilon`` times the spread's share become 0. The matrix is sparse: node -1 is the
    virtual place, node -2 any place that has no row of its own.
    """
    total, spread = sum(profile), max(0.0, 1.0 - sum(profile)) / places
    at = F.element_at(F.array(*(F.lit(float(x)) for x in profile[1:])), F.col("margin") + 1)
    rows = margins_.filter(F.col("margin") < len(profile) - 1).select("origin", "node", at.alias("p"))
    sums = rows.groupBy("origin").agg(F.sum("p").alias("found"), F.count("*").alias("named"))
    missing = F.greatest(F.lit(total - profile[0]) - F.col("found"), F.lit(0.0))
    whole = F.col("found") + missing + F.lit(spread) * (places - F.col("named"))
    sums = sums.select("origin", missing.alias("missing"), ((1 - profile[0]) / whole).alias("scale"))
    named = rows.join(sums, "origin").select("origin", "node", ((F.col("p") + F.when(F.col("origin") == F.col("node"), F.col("missing")).otherwise(0.0)) * F.col("scale")).alias("p"))
    rest = sums.select("origin", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("node"), F.lit(float(profile[0])).alias("p")), F.struct(F.lit(-2).cast("long").alias("node"), (F.lit(spread) * F.col("scale")).alias("p")))).alias("x")).select("origin", "x.node", "x.p")
    small = epsilon * (1 - profile[0]) / places
    return named.unionByName(rest).select("origin", "node", F.when(F.col("p") < small, 0.0).otherwise(F.col("p")).alias("p"))


def predicted(prediction: DataFrame, prior: DataFrame) -> DataFrame:
    """(node, p): where one is after a move, from the sparse prediction and a prior (node, p) over real places.

    Each place gives its spread to every place but the named ones, so the spreads are summed once and taken back where named.
    """
    moved = prediction.join(prior.select(F.col("node").alias("origin"), F.col("p").alias("was")), "origin")
    spread = moved.filter("node = -2").select("origin", (F.col("p") * F.col("was")).alias("s"))
    named = moved.filter("node >= 0").join(spread, "origin").groupBy("node").agg(F.sum(F.col("p") * F.col("was") - F.col("s")).alias("p"))
    everywhere = spread.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("all"))
    return prior.select("node").join(named, "node", "left").crossJoin(F.broadcast(everywhere)).select("node", (F.coalesce("p", F.lit(0.0)) + F.col("all")).alias("p"))  # one row


def statistics(spark: SparkSession, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, edges (each unordered pair once, without loops), components, isolated nodes, size of the largest component."""
    sizes = components(spark, links, nodes).groupBy("component").agg(F.count("*").alias("n"))
    of_sizes = sizes.agg(F.sum("n").alias("nodes"), F.count("*").alias("components"), F.count_if(F.col("n") == 1).alias("isolated"), F.max("n").alias("largest"))
    edges = links.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().agg(F.count("*").alias("edges"))
    return of_sizes.crossJoin(F.broadcast(edges)).select("nodes", "edges", "components", "isolated", "largest")  # one row each


def within_radius(spark: SparkSession, links: DataFrame, poses: DataFrame, start: DataFrame, radius: float, *, depth: int = 0) -> DataFrame:
    """(origin, node, d2): nodes reached from an origin over nodes whose squared distance to it is below radius^2, within ``depth`` links (0: any).

    ``links`` is (src, dst), used both ways, ``poses`` (node, x, y), ``start`` (node). A radius of 0 has no limit.
    """
    place = poses.select("node", "x", "y")
    origins = start.select("node").distinct().join(place, "node").select(F.col("node").alias("origin"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    edge_path = fresh_path(spark, "edges")
    edges = materialize(spark, both_ways(links.select("src", "dst")).distinct().join(place.withColumnRenamed("node", "dst"), "dst"), "edges", path=edge_path)
    path = fresh_path(spark, "reached")
    reached = materialize(spark, origins.select("origin", F.col("origin").alias("node"), "ox", "oy", F.lit(0.0).alias("d2"), F.lit(0).alias("level")), "reached", path=path)
    level = 0
    while not depth or level < depth:
        step = reached.filter(F.col("level") == level).withColumnRenamed("node", "src").join(edges, "src")
        d2 = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
        step = step.select("origin", F.col("dst").alias("node"), "ox", "oy", d2.alias("d2"), F.lit(level + 1).alias("level"))
        if radius > 0:
            step = step.filter(F.col("d2") < radius * radius)
        fresh = step.dropDuplicates(["origin", "node"]).join(reached.select("origin", "node"), ["origin", "node"], "left_anti")
        old, path = path, fresh_path(spark, "reached")
        reached = materialize(spark, reached.unionByName(fresh), "reached", path=path)
        drop_path(spark, old)
        level += 1
        if reached.filter(F.col("level") == level).isEmpty():
            break
    drop_path(spark, edge_path)
    return reached.select("origin", "node", "d2")
