"""Projections, replay, reason chains, regions, grouping sets, pose lines and gauges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.functions import scalars as X
from waymark.functions.geometry import from_euler, project_on_segment
from waymark.operators.quality import first_reason
from waymark.plans.base import query
from waymark.sources import formats, sinks


@query("SRC-04 SRC-07 SRC-08", "SELECT page_id, length(url) AS url_chars, strlen(html) AS bytes FROM pages")
def blob_headers(table):
    """Sizes of payloads; only the columns asked for are read."""
    return table("pages").select("page_id", F.length("url").cast("long").alias("url_chars"), F.octet_length("html").cast("long").alias("bytes"))


@query("SRC-16", "WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders) SELECT o_orderkey AS node, o_custkey % 5 AS map_id FROM orders, b WHERE o_orderkey BETWEEN lo + (hi - lo) // 10 AND hi - (hi - lo) // 10 AND o_custkey % 5 >= 1 AND o_custkey % 5 <= 3 AND o_orderstatus <> 'P'")
def replay_range(table):
    """Stored nodes of three maps in order, without intermediate ones and the first and last tenth of the range of ids."""
    lo, hi = table("orders").agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    cut = (hi - lo) // 10 if lo is not None else 0
    n = table("orders").select(F.col("o_orderkey").alias("node"), (F.col("o_custkey") % 5).alias("map_id"), F.when(F.col("o_orderstatus") == "P", -1).otherwise(0).alias("weight"))
    return formats.replay(n, start=(lo or 0) + cut, stop=(hi or 0) - cut, start_map=1, stop_map=3).select("node", "map_id")


@query("SRC-14", "SELECT user_id, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY user_id")
def statistics_by_id(table):
    """Statistics parsed from their text and added up."""
    text = F.concat(F.lit("k:"), F.get_json_object("props", "$.k"))
    return table("events").select("user_id", X.statistics_from_text(text)["k"].cast("long").alias("k")).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query("FLT-19 FLT-24", "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_discount * 100 <= 6 AND l_quantity BETWEEN 10 AND 30 AND l_extendedprice / 1000 BETWEEN 20 AND 60 GROUP BY 1")
def region_counts(table):
    """Correspondences of limited depth inside a region."""
    t = table("lineitem").filter((F.col("l_discount") * 100 <= 6) & F.col("l_quantity").between(10, 30) & (F.col("l_extendedprice") / 1000).between(20, 60))
    return t.groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("FLT-23", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'unknown state' WHEN value IS NULL OR NOT isfinite(value) THEN 'not finite' WHEN value < 10 THEN 'too small' ELSE 'valid' END AS reason FROM events) GROUP BY reason")
def validation_reasons(table):
    """Reasons for which records are refused."""
    v = F.col("value")
    reason = first_reason([("unknown state", ~F.col("event_type").isin("view", "click", "purchase")), ("not finite", v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), ("too small", v < 10)], "valid")
    return table("events").select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("AGG-32", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) * 2 + grouping(l_linestatus) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(table):
    """Counts over all groupings of two columns."""
    return table("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("WIN-16", """WITH p AS (SELECT p_partkey, p_size, round(greatest(0, least(1, (p_retailprice * 40 + p_size * 30) / 2500.0::DOUBLE)), 9) AS s FROM part)
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_size ORDER BY s, p_partkey) AS INTEGER) AS place, lead(p_partkey) OVER (PARTITION BY p_size ORDER BY s, p_partkey) AS next_part FROM p""")
def abscissa_order(table):
    """Points in order along a line, each with the next."""
    d = lambda c: F.col(c).cast("double")
    s = F.round(project_on_segment(d("p_retailprice"), d("p_size"), F.lit(0.0), F.lit(0.0), F.lit(40.0), F.lit(30.0))["ratio"], 9)
    w = Window.partitionBy("p_size").orderBy(s, "p_partkey")
    return table("part").select("p_partkey", F.row_number().over(w).alias("place"), F.lead("p_partkey").over(w).alias("next_part"))


@query("SCL-13 SCL-17", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE p_retailprice END AS u, round_even(p_retailprice / 8, 2) + 0.0 AS rounded FROM part WHERE p_partkey % 8 = 0 OR p_partkey > 0")
def axes_and_rounding(table):
    """One of two axes, and half-even rounding."""
    return table("part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")).otherwise(F.col("p_retailprice")).alias("u"), X.rounded(F.col("p_retailprice") / 8, 2).alias("rounded"))


@query("SNK-07", "SELECT p_partkey AS id, printf('VERTEX3 %d %.6f %.6f 0.000000 0.000000 0.000000 %.6f', p_partkey, p_size::DOUBLE, p_retailprice, (p_partkey % 30) / 10.0::DOUBLE) AS line FROM part")
def pose_export(table):
    """Poses as the lines of a graph file."""
    zero = F.lit(0.0)
    pose = from_euler(F.col("p_size").cast("double"), F.col("p_retailprice"), zero, zero, zero, (F.col("p_partkey") % 30) / 10)
    poses = table("part").select(F.col("p_partkey").alias("id"), zero.alias("stamp"), pose.alias("pose"))
    out = sinks.pose_lines(poses, "toro")
    return out.select("id", F.regexp_replace("line", "-0\\.000000", "0.000000").alias("line"))


@query("AGG-08", """WITH p AS (SELECT l_suppkey AS g, radians(l_quantity * 2) AS a, 1.0::DOUBLE AS w FROM lineitem), m AS (SELECT g, count(*) AS n, atan2(sum(w * sin(a)), sum(w * cos(a))) AS mean FROM p GROUP BY g)
SELECT g, n, round(mean, 6) AS mean FROM m WHERE n >= 3""")
def circular_gauge(table):
    """Circular mean of each graph's priors, where there are enough of them."""
    a = F.radians(F.col("l_quantity") * 2)
    out = table("lineitem").groupBy(F.col("l_suppkey").alias("g")).agg(F.count("*").alias("n"), F.atan2(F.sum(F.sin(a)), F.sum(F.cos(a))).alias("mean"))
    return out.filter("n >= 3").select("g", "n", F.round("mean", 6).alias("mean"))


@query("UDF-05", "SELECT n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def plain_sql(table):
    """Any SQL over the tables."""
    c = table("customer")
    return c.sparkSession.sql("SELECT n_name, count(*) AS n FROM {nation} JOIN {customer} ON c_nationkey = n_nationkey GROUP BY n_name", nation=table("nation"), customer=c)
