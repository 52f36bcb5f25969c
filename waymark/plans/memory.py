"""Memory queries: customers as places, orders as what links to them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.operators import memory as N
from waymark.plans.base import query
from waymark.sources import sinks


@query("TOP-04 RET-14", """WITH o AS (SELECT c_custkey AS node, c_nationkey AS weight, c_acctbal AS stamp FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)),
r AS (SELECT *, row_number() OVER (ORDER BY stamp DESC, node DESC) AS rn FROM o) SELECT node, weight FROM r WHERE rn > floor((SELECT count(*) FROM o) * 0.2) ORDER BY weight, stamp, node LIMIT 50""")
def forget_first(table):
    """Fifty places to forget: light, old, not linked and not among the youngest fifth."""
    nodes = table("customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("weight"), F.col("c_acctbal").alias("stamp"))
    linked = table("orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("node"))
    return N.removable(nodes, linked, n=50, recent_share=0.2).select("node", "weight")


@query("RET-15", "WITH w AS (SELECT o_custkey AS node, count(*) AS priority FROM orders GROUP BY 1), m AS (SELECT * FROM w WHERE node NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ORDER BY priority DESC, node LIMIT 40) SELECT m.node, priority, c_mktsegment FROM m JOIN customer ON c_custkey = node")
def recall_places(table):
    """Forty wanted places that are not in working memory."""
    wanted = table("orders").groupBy(F.col("o_custkey").alias("node")).agg(F.count("*").alias("priority"))
    c = table("customer").select(F.col("c_custkey").alias("node"), "c_acctbal", "c_mktsegment")
    return N.recall(wanted, c.filter("c_acctbal > 0"), c, limit=40).select("node", "priority", "c_mktsegment")


@query("UDF-08", """WITH e AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders WHERE o_orderstatus <> 'P'), u AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus <> 'P') - count(*) FILTER (WHERE o_orderstatus = 'P') AS kept FROM orders GROUP BY 1)
SELECT o_custkey, o_orderkey, o_orderstatus FROM e JOIN u USING (o_custkey) WHERE place = kept""")
def edits_in_force(table):
    """The last edit of each customer's journal that its undos (orders of status P, one edit each) leave in force."""
    w = Window.partitionBy("o_custkey")
    undo = F.col("o_orderstatus") == "P"
    journal = table("orders").select("o_custkey", "o_orderkey", "o_orderstatus", (F.count_if(~undo).over(w) - F.count_if(undo).over(w)).alias("kept"))
    e = journal.filter(~undo).withColumn("place", F.row_number().over(w.orderBy("o_orderkey")))
    e = e.withColumn("cursor", F.max(F.when(F.col("place") <= F.col("kept"), F.col("o_orderkey"))).over(w))
    return N.replay_edits(e, cursor="cursor", key="o_custkey", order="o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("TOP-02", "SELECT image, cell, id FROM (SELECT l_suppkey AS image, CAST(floor(l_quantity / 10) AS BIGINT) AS cell, l_orderkey * 8 + l_linenumber AS id, row_number() OVER (PARTITION BY l_suppkey, floor(l_quantity / 10) ORDER BY l_extendedprice DESC, l_orderkey * 8 + l_linenumber) AS rn FROM lineitem) WHERE rn <= 5")
def strongest_per_cell(table):
    """The five strongest keypoints of each cell of each image."""
    p = table("lineitem").select(F.col("l_suppkey").alias("image"), F.floor(F.col("l_quantity") / 10).alias("cell"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "l_extendedprice")
    return N.strongest(p, 5, by=["image"], response="l_extendedprice", key="id", cells=["cell"]).select("image", "cell", "id")


@query("JOIN-21", "WITH f AS (SELECT user_id, arg_min(value, event_id) AS x, arg_min(event_id % 97, event_id) AS y FROM events GROUP BY 1), r AS (SELECT * FROM f WHERE user_id = (SELECT min(user_id) FROM events)) SELECT f.user_id, round(r.x - f.x, 4) AS dx, r.y - f.y AS dy FROM f CROSS JOIN r")
def common_start(table):
    """Offset of each device's start to the first device's."""
    e = table("events").select("user_id", "event_id", F.col("value").alias("x"), (F.col("event_id") % 97).alias("y"))
    ref = e.agg(F.min("user_id")).first()[0]
    return N.common_start(e, device="user_id", order="event_id", reference=ref).select("user_id", F.round("dx", 4).alias("dx"), "dy")


@query("WIN-15", """WITH s AS (SELECT user_id, event_id // 100 AS seg, arg_min(value, event_id) AS x0, arg_max(value, event_id) AS x1 FROM events GROUP BY 1, 2)
SELECT user_id, seg, round(sum(d) OVER (PARTITION BY user_id ORDER BY seg ROWS UNBOUNDED PRECEDING), 3) AS shift FROM (SELECT *, coalesce(lag(x1) OVER (PARTITION BY user_id ORDER BY seg) - x0, 0) AS d FROM s)""")
def chained_segments(table):
    """Shift of each segment so that it starts where the one before ends."""
    s = table("events").groupBy("user_id", F.floor(F.col("event_id") / 100).alias("seg")).agg(F.min_by("value", "event_id").alias("x0"), F.max_by("value", "event_id").alias("x1")).withColumn("y0", F.lit(0.0)).withColumn("y1", F.lit(0.0))
    return N.chained_shifts(s, by=["user_id"], order="seg").select("user_id", "seg", F.round("sx", 3).alias("shift"))


@query("WIN-18", """WITH p AS (SELECT l_suppkey AS scan, l_orderkey * 8 + l_linenumber AS id, l_quantity AS x, l_extendedprice / 1000 AS y, epoch_us(l_shipdate) / 1e6::DOUBLE / 1e8 AS t FROM lineitem),
s AS (SELECT scan, min(t) AS t0 FROM p GROUP BY scan HAVING max(t) > min(t))
SELECT scan, round(sum(cos(0.3 * (t - t0)) * x - sin(0.3 * (t - t0)) * y + 0.5 * (t - t0)), 2) AS x, round(sum(sin(0.3 * (t - t0)) * x + cos(0.3 * (t - t0)) * y - 0.2 * (t - t0)), 2) AS y FROM p JOIN s USING (scan) GROUP BY scan""")
def deskewed(table):
    """Sums of scans' points after deskewing."""
    p = table("lineitem").select(F.col("l_suppkey").alias("scan"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / F.lit(1e6) / 1e8).alias("t"), F.lit(0.5).alias("vx"), F.lit(-0.2).alias("vy"), F.lit(0.3).alias("wz"))
    return N.deskew(p, by=["scan"], time="t", vx="vx", vy="vy", wz="wz").groupBy("scan").agg(F.round(F.sum("x"), 2).alias("x"), F.round(F.sum("y"), 2).alias("y"))


@query("JOIN-24", "WITH s AS (SELECT p_brand || p_type || p_size AS code, min(p_partkey) AS shelf, min(p_retailprice) AS length FROM part GROUP BY 1 HAVING count(*) = 1), t AS (SELECT p_partkey AS tag, p_brand || p_type || p_size AS code, p_partkey * 0.7::DOUBLE AS o FROM part) SELECT tag, shelf FROM t JOIN s USING (code) WHERE o BETWEEN 0 AND length")
def valid_associations(table):
    """Tags with exactly one shelf of their code and an offset on its edge."""
    code = F.concat("p_brand", "p_type", F.col("p_size").cast("string")).alias("code")
    shelves = table("part").select(code, F.col("p_partkey").alias("shelf"), F.col("p_retailprice").alias("length"))
    tags = table("part").select(code, F.col("p_partkey").alias("tag"), (F.col("p_partkey") * F.lit(0.7)).alias("offset"))
    return N.unique_association(tags, shelves, code="code").select("tag", "shelf")


@query("GEO-17", "WITH p AS (SELECT c_custkey AS node, c_acctbal AS x, c_nationkey AS y FROM customer), m AS (SELECT node, x + 0.001 AS mx, y AS my FROM p WHERE node % 3 > 0) SELECT p.node, false AS rebuild FROM p LEFT JOIN m USING (node) WHERE mx IS NULL")
def map_update(table):
    """Nodes to add to a map whose other poses have hardly moved."""
    p = table("customer").select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").alias("y"))
    mapped = p.filter("node % 3 > 0").withColumn("x", F.col("x") + 0.001)
    return N.new_nodes(p, mapped, tolerance=0.01)


@query("SNK-02 SNK-03 SNK-04", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'moved' ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer UNION ALL SELECT -1, 'moved', NULL")
def upserted(table):
    """Rows with some values replaced and one row new."""
    c = table("customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    changes = c.filter("c_custkey % 5 = 0").select("c_custkey", F.lit("moved").alias("c_mktsegment"))
    new = c.sparkSession.range(1).select(F.lit(-1).cast("long").alias("c_custkey"), F.lit("moved").alias("c_mktsegment"))
    return sinks.upsert(c, changes.unionByName(new), "c_custkey")


@query("SNK-14 SCL-15", "SELECT event_id, sha256('{\"k\":' || CAST(json_extract_string(props, '$.k') AS INTEGER) || '}') AS sha256 FROM events")
def canonical_digests(table):
    """Digests of canonical JSON."""
    return sinks.with_canonical_digest(table("events").select("event_id", "props"), "props").select("event_id", "sha256")


@query("SNK-10", "SELECT count(*) AS n, CAST(sum(length('  \"' || s_suppkey || '\" -> \"' || s_nationkey || '\" [label=\"0\"];')) AS BIGINT) AS chars FROM supplier")
def dot_graph(table):
    """Edges of a drawn graph."""
    lines = sinks.dot_edges(table("supplier").select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").alias("dst"), F.lit(0).alias("type")))
    return lines.agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))
