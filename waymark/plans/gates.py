"""Gates and decisions: suppliers as optimised graphs, line items as tags on shelves."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import clouds as C
from waymark.operators import graph as G
from waymark.operators import quality as Q
from waymark.plans.base import query
from waymark.plans.clouds import _CLOUD, cloud
from waymark.plans.graph import _G, graph

#: A policy for the test tables, in the units of their columns.
LIMITS = {
    "relative_translation_p95_max_m": 48.2, "relative_translation_max_m": 49.5, "relative_yaw_p95_max_deg": 9.6, "relative_yaw_max_deg": 9.9,
    "loop_translation_p95_max_m": 7.8, "loop_translation_max_m": 7.9, "loop_yaw_p95_max_deg": 6.9, "loop_yaw_max_deg": 6.95,
    "high_residual_loop_ratio_max": 0.25, "maximum_pose_update_m": 104.9, "maximum_pose_update_yaw_deg": 7.0, "minimum_relative_factor_to_node_ratio": 0.45,
    "minimum_objective_improvement_ratio": 0.5,
}


@query("AGG-27", """WITH r AS (SELECT l_suppkey AS graph, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'N') AS rel, count(*) FILTER (WHERE l_returnflag = 'R') AS loops, count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 40) AS high,
quantile_disc(l_quantity, 0.95) AS q95, max(l_quantity) AS qm, quantile_disc(l_discount * 100, 0.95) AS d95, max(l_discount * 100) AS dm, quantile_disc(l_tax * 100, 0.95) AS t95, max(l_tax * 100) AS tm, CAST(max(l_linenumber) AS DOUBLE) AS lm, max(l_extendedprice) / 1000 AS em, sum(l_quantity) AS a, sum(l_quantity * l_discount * 10) AS b FROM lineitem GROUP BY 1),
c AS (SELECT graph, [CASE WHEN graph % 11 = 0 THEN 'solver_not_converged' END, CASE WHEN n < 20 THEN 'graph_integrity_failed' END, CASE WHEN q95 > 48.2 THEN 'relative_translation_p95_exceeded' END, CASE WHEN qm > 49.5 THEN 'relative_translation_max_exceeded' END,
CASE WHEN d95 > 9.6 THEN 'relative_yaw_p95_exceeded' END, CASE WHEN dm > 9.9 THEN 'relative_yaw_max_exceeded' END, CASE WHEN t95 > 7.8 THEN 'loop_translation_p95_exceeded' END, CASE WHEN tm > 7.9 THEN 'loop_translation_max_exceeded' END, CASE WHEN lm > 6.9 THEN 'loop_yaw_p95_exceeded' END, CASE WHEN lm > 6.95 THEN 'loop_yaw_max_exceeded' END,
CASE WHEN high / greatest(loops, 1) > 0.25 THEN 'high_residual_loop_ratio_exceeded' END, CASE WHEN em > 104.9 THEN 'maximum_pose_update_exceeded' END, CASE WHEN lm > 7 THEN 'maximum_pose_yaw_update_exceeded' END, CASE WHEN rel / n < 0.45 THEN 'relative_factor_coverage_too_low' END,
CASE WHEN (CASE WHEN a > 0 THEN greatest(0, (a - b) / a) WHEN b = 0 THEN 1 ELSE 0 END) < 0.5 THEN 'objective_improvement_too_low' END] AS k FROM r)
SELECT graph, array_to_string(list_filter(k, lambda x: x IS NOT NULL), ',') AS blockers, len(list_filter(k, lambda x: x IS NOT NULL)) = 0 AS passed FROM c""")
def graph_quality_gate(table):
    """All checks that each graph fails under the policy."""
    q, d, t, flag = F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100, F.col("l_returnflag")
    top = F.max("l_linenumber").cast("double")

    def p95(x):
        return F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {x})")

    line = table("lineitem").withColumns({"d100": d, "t100": t})
    reports = line.groupBy(F.col("l_suppkey").alias("graph")).agg(
        F.count("*").alias("n_nodes"), F.count_if(flag == "N").alias("n_relative"), F.count_if(flag == "R").alias("n_loops"), F.count_if((flag == "R") & (q > 40)).alias("n_high_residual"),
        p95("l_quantity").alias("relative_translation_p95_m"), F.max(q).alias("relative_translation_max_m"), p95("d100").alias("relative_yaw_p95_deg"), F.max("d100").alias("relative_yaw_max_deg"),
        p95("t100").alias("loop_translation_p95_m"), F.max("t100").alias("loop_translation_max_m"), top.alias("loop_yaw_p95_deg"), top.alias("loop_yaw_max_deg"),
        (F.max("l_extendedprice") / 1000).alias("pose_update_m"), top.alias("pose_update_deg"), F.sum(q).alias("initial"), F.sum(q * F.col("l_discount") * 10).alias("final"),
    ).withColumns({"converged": F.col("graph") % 11 != 0, "intact": F.col("n_nodes") >= 20})
    return Q.graph_gate(reports, LIMITS, frozen=True).select("graph", F.array_join("blockers", ",").alias("blockers"), "passed")


_FAILS = {
    "map_session_identity_mismatch": "l_orderkey % 23 = 0", "graph_quality_failed": "l_suppkey % 19 = 0", "stale_alignment": "l_orderkey % 29 = 1 AND l_linenumber > 5",
    "insufficient_burst_samples": "l_quantity < 3", "insufficient_effective_samples": "l_quantity < 5", "measurement_needs_review": "l_orderkey % 17 = 0",
    "measurement_method_unavailable": "l_partkey % 31 = 3 AND l_linenumber = 1", "tracking_quality_insufficient": "l_discount = 0.1", "view_quality_insufficient": "l_tax = 0.08",
    "depth_quality_insufficient": "l_extendedprice < 3000", "localization_confidence_insufficient": "l_tax = 0.07 AND l_discount > 0.05", "measurement_confidence_insufficient": "l_orderkey % 13 = 0",
    "node_uncertainty_unavailable": "l_linenumber = 7", "node_uncertainty_exceeded": "l_extendedprice > 90000", "position_spread_exceeded": "l_quantity > 48",
    "shelf_association_distance_exceeded": "l_partkey % 9 = 0", "shelf_association_margin_insufficient": "l_partkey % 8 = 1", "shelf_endpoint_ambiguity": "l_partkey % 7 = 2",
    "shelf_side_ambiguous": "l_returnflag = 'A' AND l_linenumber = 2", "shelf_side_unavailable": "l_returnflag = 'R' AND l_linenumber = 3", "shelf_occluded_by_structure": "l_suppkey % 10 = 4",
}
_REASON = "CASE " + " ".join(f"WHEN {_FAILS[r]} THEN '{r}'" for r in Q.TAG_REASONS) + " ELSE 'accepted' END"


@query("AGG-28", f"""WITH t AS (SELECT l_orderkey, l_linenumber, {_REASON} AS reason FROM lineitem)
SELECT l_orderkey, l_linenumber, reason, CASE WHEN reason = 'accepted' THEN 'accepted' WHEN reason IN ({', '.join(f"'{r}'" for r in sorted(Q.RESCAN))}) THEN 'rescanRequired' ELSE 'lowConfidence' END AS status FROM t""")
def tag_quality(table):
    """Status of each tag and the first reason that decides it."""
    status, reason = Q.tag_decision({r: F.expr(x) for r, x in _FAILS.items()})
    return table("lineitem").select("l_orderkey", "l_linenumber", reason.alias("reason"), status.alias("status"))


@query("AGG-34", """WITH t AS (SELECT o_orderkey, o_orderkey % 4 = 0 AS review, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'rejected' END AS approval, o_totalprice > 50000 AS publishable, o_orderkey % 5 = 1 AS confirmed, CASE WHEN o_orderkey % 3 = 0 THEN 'auto_confirmed' END AS audit FROM orders)
SELECT o_orderkey, review OR NOT publishable OR NOT (confirmed OR coalesce(approval = 'approved', false) OR coalesce(audit = 'auto_confirmed', false)) AS needs_review,
CASE WHEN review THEN CASE WHEN approval IN ('pending', 'rejected') THEN approval ELSE 'pending' END WHEN NOT publishable THEN 'pending' WHEN confirmed THEN 'approved' WHEN approval = 'approved' THEN approval WHEN audit = 'auto_confirmed' THEN 'auto_approved' ELSE 'pending' END AS approval FROM t""")
def tag_invariants(table):
    """Review and approval of each tag, made consistent."""
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    review, approval = Q.tag_approval(k % 4 == 0, F.when(s == "F", "approved").when(s == "P", "rejected"), F.col("o_totalprice") > 50000, k % 5 == 1, F.when(k % 3 == 0, "auto_confirmed"))
    return table("orders").select("o_orderkey", review.alias("needs_review"), approval.alias("approval"))


@query("AGG-29", f"""WITH RECURSIVE {_G}, r AS (SELECT p_partkey AS node, p_partkey AS root FROM part UNION SELECT b.dst, r.root FROM r JOIN b ON b.src = r.node),
c AS (SELECT node, min(root) AS component FROM r GROUP BY node), z AS (SELECT component, count(*) AS n FROM c GROUP BY component)
SELECT (SELECT count(*) FROM part) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT least(src, dst), greatest(src, dst) FROM g)) AS edges, count(*) AS components, count(*) FILTER (WHERE n = 1) AS isolated, max(n) AS largest FROM z""")
def road_graph_statistics(table):
    """Nodes, edges, components, isolated nodes and the largest component of the graph."""
    g = graph(table)
    return G.statistics(g.sparkSession, g, table("part").select(F.col("p_partkey").alias("node")))


@query("GEO-09", f"""{_CLOUD.replace("WITH c", "WITH RECURSIVE c")}, d AS (SELECT * FROM c WHERE flag = 'A' AND x > 35),
p AS (SELECT a.cloud, a.id AS u, b.id AS v FROM d a JOIN d b ON a.cloud = b.cloud AND a.id <> b.id AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 16.0),
r AS (SELECT cloud, id AS node, id AS root FROM d UNION SELECT p.cloud, p.v, r.root FROM r JOIN p ON p.cloud = r.cloud AND p.u = r.node),
l AS (SELECT cloud, node, min(root) AS cluster FROM r GROUP BY cloud, node), s AS (SELECT cloud, cluster, count(*) AS n FROM l GROUP BY cloud, cluster HAVING count(*) BETWEEN 2 AND 50)
SELECT cloud, cluster, n, row_number() OVER (PARTITION BY cloud ORDER BY n DESC, cluster) = 1 AS biggest FROM s""")
def euclidean_clusters(table):
    """Clusters of 2 to 50 points, each within 4 of another of its cluster, and the biggest of each cloud."""
    points = cloud(table).filter("flag = 'A' AND x > 35")
    return C.euclidean_clusters(points, 4.0, 2, 50, by="cloud")
