"""Decisions, curves and percentiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import quality as Q
from waymark.plans.base import query


@query("", """SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN 'no_value' WHEN o_totalprice < 10000 THEN 'too_small' WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'accepted' END AS reason,
array_to_string(list_filter([CASE WHEN NOT o_totalprice >= 10000 THEN 'minimum' END, CASE WHEN NOT o_orderstatus <> 'P' THEN 'status' END, CASE WHEN NOT o_orderpriority <> '5-LOW' THEN 'priority' END], lambda x: x IS NOT NULL), ',') AS blockers FROM orders""")
def quality_gate_case(table):
    """First reason of a decision chain, and all blockers of a gate."""
    p, s = F.col("o_totalprice"), F.col("o_orderstatus")
    reason = Q.first_reason([("no_value", p.isNull()), ("too_small", p < 10000), ("pending", s == "P")], "accepted")
    gate = Q.blockers([("minimum", p >= 10000), ("status", s != "P"), ("priority", F.col("o_orderpriority") != "5-LOW")])
    return table("orders").select("o_orderkey", reason.alias("reason"), F.array_join(gate, ",").alias("blockers"))


@query("AGG-33", """WITH m AS (SELECT l_suppkey AS run, avg(l_quantity) AS mean_q, max(l_discount) AS max_d, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1),
u AS (SELECT run, 'mean_q' AS metric, mean_q AS v FROM m UNION ALL SELECT run, 'max_d', max_d FROM m UNION ALL SELECT run, 'n', n FROM m)
SELECT run, metric, round(v, 7) AS value FROM u WHERE NOT CASE metric WHEN 'mean_q' THEN v <= 25.5 WHEN 'max_d' THEN v < 0.5 ELSE v >= 600 END""")
def field_qualification(table):
    """Metrics of runs that miss their thresholds."""
    m = table("lineitem").groupBy(F.col("l_suppkey").alias("run")).agg(F.avg("l_quantity").alias("mean_q"), F.max("l_discount").alias("max_d"), F.count("*").alias("n"))
    spark = m.sparkSession
    t = spark.createDataFrame([("mean_q", "<=", 25.5), ("max_d", "<", 0.5), ("n", ">=", 600.0)], "metric string, operator string, bound double")
    return Q.failed_thresholds(m, t, ["mean_q", "max_d", "n"], "run").select("run", "metric", F.round("value", 7).alias("value"))


@query("AGG-21", """WITH r AS (SELECT l_suppkey, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey, max(v) FILTER (WHERE i = CAST(round_even((n - 1) * 0.95::DOUBLE, 0) AS BIGINT)) AS rounded, max(v) FILTER (WHERE i = greatest(CAST(ceil(0.95::DOUBLE * n) AS BIGINT) - 1, 0)) AS ceiling,
round(max(v) FILTER (WHERE i = floor((n - 1) * 0.95::DOUBLE)) + (max(v) FILTER (WHERE i = ceil((n - 1) * 0.95::DOUBLE)) - max(v) FILTER (WHERE i = floor((n - 1) * 0.95::DOUBLE))) * (((any_value(n) - 1) * 0.95::DOUBLE) - floor((any_value(n) - 1) * 0.95::DOUBLE)), 3) AS linear FROM r GROUP BY l_suppkey""")
def percentile_conventions(table):
    """The 95th percentile of each supplier's prices by three conventions."""
    out = Q.percentiles(table("lineitem").select("l_suppkey", "l_extendedprice"), "l_extendedprice", 0.95, by=["l_suppkey"])
    return out.select("l_suppkey", "rounded", "ceiling", F.round("linear", 3).alias("linear"))


@query("AGG-30", """WITH s AS (SELECT d.lang, n_chars AS score, toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
g AS (SELECT lang, score, count(*) AS n, sum(toxic) AS t FROM s GROUP BY lang, score),
c AS (SELECT lang, score, sum(n) OVER w AS accepted, sum(t) OVER w AS tp, sum(t) OVER (PARTITION BY lang) AS p FROM g WINDOW w AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT lang, score, CAST(accepted AS BIGINT) AS accepted, round(tp::DOUBLE / accepted, 6) AS precision, round(CASE WHEN p > 0 THEN tp::DOUBLE / p END, 6) AS recall FROM c""")
def pr_curve(table):
    """Precision and recall of a score against labels."""
    s = table("documents").select("doc_id", "lang", F.col("n_chars").alias("score")).join(table("labels").select("doc_id", "toxic"), "doc_id")
    out = Q.precision_recall(s, "score", "toxic", by=["lang"])
    return out.select("lang", "score", "accepted", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("AGG-25", """WITH RECURSIVE o AS (SELECT l_partkey AS k, l_quantity AS x, l_extendedprice / 1000 AS y, greatest(l_discount * 10, 1e-6) AS w FROM lineitem),
c0 AS (SELECT k, sum(w * x) / sum(w) AS fx, sum(w * y) / sum(w) AS fy FROM o GROUP BY k),
c1 AS (SELECT k, sum(r * x) / sum(r) AS fx, sum(r * y) / sum(r) AS fy FROM (SELECT k, x, y, w * CASE WHEN d <= 5 THEN 1 ELSE 5 / d END AS r FROM (SELECT o.*, sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy)) AS d FROM o JOIN c0 USING (k))) GROUP BY k),
c2 AS (SELECT k, sum(r * x) / sum(r) AS fx, sum(r * y) / sum(r) AS fy FROM (SELECT k, x, y, w * CASE WHEN d <= 5 THEN 1 ELSE 5 / d END AS r FROM (SELECT o.*, sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy)) AS d FROM o JOIN c1 USING (k))) GROUP BY k),
c3 AS (SELECT k, sum(r * x) / sum(r) AS fx, sum(r * y) / sum(r) AS fy FROM (SELECT k, x, y, w * CASE WHEN d <= 5 THEN 1 ELSE 5 / d END AS r FROM (SELECT o.*, sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy)) AS d FROM o JOIN c2 USING (k))) GROUP BY k)
SELECT k, round(fx, 4) AS x, round(fy, 4) AS y, n, round(e, 4) AS effective FROM c3 JOIN (SELECT k, count(*) AS n, sum(w) * sum(w) / sum(w * w) AS e FROM o GROUP BY k) USING (k)""")
def robust_fuse(table):
    """Robust weighted centroid of each part's observations."""
    o = table("lineitem").select(F.col("l_partkey").alias("k"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 10).alias("w"))
    out = Q.robust_fuse(o, by=["k"], x="x", y="y", weight="w", spread=10.0)
    return out.select("k", F.round("fx", 4).alias("x"), F.round("fy", 4).alias("y"), "n", F.round("effective", 4).alias("effective"))


@query("AGG-20", """WITH c AS (SELECT CAST(floor(l_quantity / 2) AS BIGINT) AS ix, CAST(floor(l_extendedprice / 2000) AS BIGINT) AS iy, list(CASE WHEN l_returnflag = 'R' THEN 0.85::DOUBLE ELSE -0.4::DOUBLE END ORDER BY l_orderkey * 8 + l_linenumber) AS u FROM lineitem GROUP BY ALL)
SELECT ix, iy, round(list_reduce(list_prepend(0.0::DOUBLE, u), lambda v, d: least(greatest(v + d, -2.0::DOUBLE), 3.5::DOUBLE)), 6) + 0.0 AS log_odds, len(u) AS n FROM c""")
def log_odds_grid(table):
    """Clamped log odds of each grid cell, updates in order."""
    c = table("lineitem").select(F.floor(F.col("l_quantity") / 2).alias("ix"), F.floor(F.col("l_extendedprice") / 2000).alias("iy"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("o"), (F.col("l_returnflag") == "R").alias("hit"))
    out = Q.log_odds(c, by=["ix", "iy"], order="o", hit="hit", gain=0.85, loss=-0.4, low=-2.0, high=3.5)
    return out.select("ix", "iy", F.round("log_odds", 6).alias("log_odds"), "n")


@query("TOP-05 JOIN-15 WIN-05", """WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, lead(l_extendedprice) OVER w AS nxt, row_number() OVER w AS rn FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber))
SELECT l_suppkey, CAST(rn AS INTEGER) AS rank, l_orderkey, l_linenumber, round(nxt - l_extendedprice, 4) AS margin FROM r WHERE rn <= 3""")
def top3_per_group(table):
    """Three best of each group, with the margin to the next."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey").orderBy("l_extendedprice", "l_orderkey", "l_linenumber")
    out = table("lineitem").withColumn("rank", F.row_number().over(w)).withColumn("margin", F.lead("l_extendedprice").over(w) - F.col("l_extendedprice"))
    return out.filter("rank <= 3").select("l_suppkey", "rank", "l_orderkey", "l_linenumber", F.round("margin", 4).alias("margin"))


@query("AGG-22 AGG-23", """WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_id, value FROM events),
s AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id)) AS step, value FROM e)
SELECT user_id, round(sum(step), 2) AS length, round(quantile_cont(step, 0.5), 5) AS median, round(quantile_cont(step, 0.95), 4) AS p95, round(max(step), 4) AS longest, round(max(value) - min(value), 4) AS span FROM s GROUP BY user_id""")
def trajectory_metrics(table):
    """Length, step percentiles and span of each trajectory."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = table("events").select("user_id", "value", F.abs(F.col("value") - F.lag("value").over(w)).alias("step"))
    return s.groupBy("user_id").agg(F.round(F.sum("step"), 2).alias("length"), F.round(F.percentile("step", F.lit(0.5)), 5).alias("median"), F.round(F.percentile("step", F.lit(0.95)), 4).alias("p95"), F.round(F.max("step"), 4).alias("longest"), F.round(F.max("value") - F.min("value"), 4).alias("span"))
