"""Graph queries over customers, orders and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators import graph as G
from waymark.operators import sequences as S
from waymark.plans.base import query

# a sparse graph of parts: each links to the next of its size, and to one of another size
_G = """e AS (SELECT p_partkey AS src, lead(p_partkey) OVER (PARTITION BY p_size ORDER BY p_partkey) AS dst, 0 AS type, 1.0 + p_partkey % 7 AS cost FROM part
UNION ALL SELECT p_partkey, (p_partkey * 7) % (SELECT count(*) FROM part), 1, 5.0 FROM part WHERE p_partkey % 97 = 0),
g AS (SELECT src, dst, type, cost FROM e WHERE dst IS NOT NULL AND src <> dst),
b AS (SELECT src, dst, type, cost FROM g UNION ALL SELECT dst, src, type, cost FROM g)"""


def graph(table) -> DataFrame:
    part = table("part").select("p_partkey", "p_size")
    n = part.agg(F.count("*").alias("n"))
    k = F.col("p_partkey")
    chain = S.following(part, by=["p_size"], order="p_partkey").select(k.alias("src"), F.col("next").alias("dst"), F.lit(0).alias("type"), (k % 7 + 1.0).alias("cost"))
    jump = part.filter(k % 97 == 0).join(F.broadcast(n), F.lit(True)).select(k.alias("src"), ((k * 7) % F.col("n")).alias("dst"), F.lit(1).alias("type"), F.lit(5.0).alias("cost"))  # one row
    return chain.unionByName(jump).filter("dst is not null and src <> dst")


@query("GRA-06", f"""WITH RECURSIVE {_G}, r AS (SELECT p_partkey AS node, p_partkey AS root FROM part UNION SELECT b.dst, r.root FROM r JOIN b ON b.src = r.node)
SELECT node, min(root) AS component FROM r GROUP BY node""")
def components(table):
    """Component of each part."""
    g = graph(table)
    return G.components(g.sparkSession, g, table("part").select(F.col("p_partkey").alias("node")))


@query("GRA-03", f"""WITH RECURSIVE {_G}, s(node, cost) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS DOUBLE) UNION SELECT b.dst, s.cost + b.cost FROM s JOIN b ON b.src = s.node WHERE s.cost + b.cost <= 40)
SELECT CAST(0 AS BIGINT) AS origin, node, min(cost) AS cost FROM s GROUP BY node""")
def shortest_path(table):
    """Least costs from part 0 up to 40."""
    g = graph(table)
    start = table("part").filter("p_partkey = 0").select(F.col("p_partkey").alias("origin"), F.col("p_partkey").alias("node"))
    return G.relax(g.sparkSession, G.both_ways(g, "cost"), start, limit=40.0)


@query("GRA-15", f"""WITH RECURSIVE {_G}, s(node, cost, route) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS DOUBLE), [CAST(0 AS BIGINT)] UNION ALL
  SELECT b.dst, s.cost + b.cost, list_append(s.route, b.dst) FROM s JOIN b ON b.src = s.node WHERE s.cost + b.cost <= 40 AND NOT list_contains(s.route, b.dst)),
m AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY cost, route) AS rn FROM s)
SELECT node AS goal, cost, CAST(len(route) - 1 AS INTEGER) AS hops, route[2] AS next_node, array_to_string(route, '>') AS route FROM m WHERE rn = 1""")
def planned_route(table):
    """Route from part 0 to each goal within a cost of 40, with the next node to go to; of equal costs the smallest route."""
    g = graph(table)
    start = table("part").filter("p_partkey = 0").select(F.col("p_partkey").alias("origin"), F.col("p_partkey").alias("node"))
    found = G.relax(g.sparkSession, G.both_ways(g, "cost"), start, limit=40.0, routes=True)
    hops = F.size("route") - 1
    return found.select(F.col("node").alias("goal"), "cost", hops.alias("hops"), F.try_element_at("route", F.lit(2)).alias("next_node"), F.array_join(F.transform("route", lambda x: x.cast("string")), ">").alias("route"))


@query("GRA-01", f"""WITH RECURSIVE {_G}, s(node, m) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT b.dst, s.m + CASE WHEN type = 0 THEN 1 ELSE 0 END FROM s JOIN b ON b.src = s.node WHERE s.m + CASE WHEN type = 0 THEN 1 ELSE 0 END <= 5)
SELECT CAST(0 AS BIGINT) AS origin, node, min(m) AS margin FROM s GROUP BY node""")
def bfs_margin(table):
    """Nodes within five neighbour links of part 0; loop links cost nothing."""
    g = graph(table)
    start = table("part").filter("p_partkey = 0").select(F.col("p_partkey").alias("origin"), F.col("p_partkey").alias("node"))
    return G.margins(g.sparkSession, g.select("src", "dst", "type"), start, 5)


@query("GRA-07", f"""WITH RECURSIVE {_G}, x AS (SELECT * FROM b WHERE type = 1), r AS (SELECT p_partkey AS node, p_partkey AS root FROM part UNION SELECT x.dst, r.root FROM r JOIN x ON x.src = r.node),
c AS (SELECT node, min(root) AS component FROM r GROUP BY node),
l AS (SELECT least(s.component, d.component) AS lo, greatest(s.component, d.component) AS hi, type, src * 1000000 + dst AS id FROM g JOIN c s ON s.node = g.src JOIN c d ON d.node = g.dst WHERE s.component <> d.component)
SELECT lo, hi, id, type FROM (SELECT *, row_number() OVER (PARTITION BY lo, hi ORDER BY type <> 0, id) AS rn FROM l) WHERE rn = 1""")
def reduced_graph(table):
    """The graph when nodes joined by loop links become one."""
    g = graph(table).withColumn("id", F.col("src") * 1000000 + F.col("dst"))
    labels = G.components(g.sparkSession, g.filter("type = 1"), table("part").select(F.col("p_partkey").alias("node")))
    return G.reduce_by(labels, g)


_PREDICTION = f"""WITH RECURSIVE {_G}, s(origin, node, m) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION SELECT s.origin, b.dst, s.m + CASE WHEN type = 0 THEN 1 ELSE 0 END FROM s JOIN b ON b.src = s.node WHERE s.m + CASE WHEN type = 0 THEN 1 ELSE 0 END <= 3),
r AS (SELECT origin, node, [0.4, 0.24, 0.12, 0.06][min(m) + 1]::DOUBLE AS p FROM s GROUP BY origin, node),
t AS (SELECT origin, greatest(0.82::DOUBLE - sum(p), 0) AS missing, 0.9::DOUBLE / (sum(p) + greatest(0.82::DOUBLE - sum(p), 0) + 0.08::DOUBLE / (SELECT count(*) FROM part) * ((SELECT count(*) FROM part) - count(*))) AS scale FROM r GROUP BY origin),
x AS (SELECT origin, node, (p + CASE WHEN origin = node THEN missing ELSE 0 END) * scale AS p FROM r JOIN t USING (origin) UNION ALL SELECT origin, -1, 0.1 FROM t UNION ALL SELECT origin, -2, scale * 0.08 / (SELECT count(*) FROM part) FROM t)"""
_PROFILE = [0.1, 0.4, 0.24, 0.12, 0.06]


def _prediction(table):
    g = graph(table)
    part = table("part").select(F.col("p_partkey").alias("node"))
    near = G.margins(g.sparkSession, g.select("src", "dst", "type"), part.select(F.col("node").alias("origin"), "node"), 3)
    return G.place_prediction(near, part.count(), _PROFILE, epsilon=0.0)


@query("RET-10", f"{_PREDICTION} SELECT origin, node, round(p, 7) AS p FROM x")
def bayes_prediction(table):
    """The prediction matrix of all places of the graph, sparse, with the virtual place (-1) and the share of all others (-2)."""
    return _prediction(table).select("origin", "node", F.round("p", 7).alias("p"))


@query("RET-12", f"""{_PREDICTION}, w AS (SELECT p_partkey AS node, p_size / (SELECT sum(p_size) FROM part)::DOUBLE AS was FROM part),
l AS (SELECT p_partkey AS node, 1.0::DOUBLE + p_partkey % 5 AS l FROM part),
q AS (SELECT d.node, sum(w.was * coalesce(n.p, o.p)) AS q FROM w CROSS JOIN l d JOIN x o ON o.origin = w.node AND o.node = -2 LEFT JOIN x n ON n.origin = w.node AND n.node = d.node GROUP BY d.node)
SELECT node, round(q * l / (SELECT sum(q * l) FROM q JOIN l USING (node)) * 1000, 6) AS posterior FROM q JOIN l USING (node)""")
def bayes_update(table):
    """Posterior (in thousandths) over all places after one move and one likelihood; the prior grows with the part's size."""
    part = table("part").select(F.col("p_partkey").alias("node"), "p_size")
    whole = F.broadcast(part.agg(F.sum("p_size").alias("total")))  # one row
    prior = part.crossJoin(whole).select("node", (F.col("p_size") / F.col("total")).alias("p"))
    raw = G.predicted(_prediction(table), prior).select("node", (F.col("p") * (F.col("node") % 5 + 1.0)).alias("p"))
    scale = F.broadcast(raw.agg(F.sum("p").alias("sum")))  # one row
    return raw.crossJoin(scale).select("node", F.round(F.col("p") / F.col("sum") * 1000, 6).alias("posterior"))


@query("GRA-02", f"""WITH RECURSIVE {_G}, w AS (SELECT p_partkey AS node, p_size::DOUBLE AS x, (p_partkey % 40)::DOUBLE AS y FROM part),
s(origin, node, level) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_size = 7 UNION SELECT s.origin, b.dst, s.level + 1 FROM s JOIN b ON b.src = s.node JOIN w o ON o.node = s.origin JOIN w d ON d.node = b.dst WHERE s.level < 6 AND (d.x - o.x) * (d.x - o.x) + (d.y - o.y) * (d.y - o.y) < 100),
u AS (SELECT DISTINCT origin, node FROM s) SELECT u.origin, u.node, (d.x - o.x) * (d.x - o.x) + (d.y - o.y) * (d.y - o.y) AS d2 FROM u JOIN w o ON o.node = u.origin JOIN w d ON d.node = u.node""")
def radius_search(table):
    """Nodes that each part of size 7 reaches in six links without leaving a radius of 10."""
    g = graph(table)
    part = table("part")
    poses = part.select(F.col("p_partkey").alias("node"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 40).cast("double").alias("y"))
    return G.within_radius(g.sparkSession, g, poses, part.filter("p_size = 7").select(F.col("p_partkey").alias("node")), 10.0, depth=6)
