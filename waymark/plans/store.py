"""Store queries: the tables as nodes, links, features and runs, asked the way a mapping database is."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import links as L
from waymark.plans.base import query


@query("AGG-01 SRC-32", "SELECT count(*) AS nodes, count(o_custkey) AS owned, count(*) FILTER (WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders)) AS last_run FROM orders")
def node_counts(table):
    """All nodes, owned ones, and those of the last run."""
    o = table("orders").select("o_custkey", "o_orderdate")
    last = o.agg(F.max("o_orderdate").alias("last"))
    return o.join(F.broadcast(last), F.lit(True)).agg(F.count("*").alias("nodes"), F.count("o_custkey").alias("owned"), F.count_if(F.col("o_orderdate") >= F.col("last")).alias("last_run"))  # one row


@query("AGG-02", "SELECT source, CAST(sum(strlen(CAST(doc_id AS VARCHAR)) + strlen(lang) + coalesce(strlen(text), 0)) AS BIGINT) AS bytes FROM documents GROUP BY source")
def storage_accounting(table):
    """Bytes of each source's rows; a null in a column without a default makes the row count nothing."""
    row = F.octet_length(F.col("doc_id").cast("string")) + F.octet_length("lang") + F.coalesce(F.octet_length("text"), F.lit(0))
    return table("documents").groupBy("source").agg(F.sum(row).alias("bytes"))


@query("AGG-03", "SELECT coalesce(max(o_orderkey), 0) AS last_id, coalesce(max(o_orderkey) FILTER (WHERE o_totalprice < 0), 0) AS last_negative FROM orders")
def last_ids(table):
    """Largest id, 0 where there is none."""
    key = F.col("o_orderkey")
    return table("orders").agg(F.coalesce(F.max(key), F.lit(0)).alias("last_id"), F.coalesce(F.max(F.when(F.col("o_totalprice") < 0, key)), F.lit(0)).alias("last_negative"))


@query("AGG-05 SRC-28", "SELECT l_returnflag AS type, count(*) AS n FROM lineitem GROUP BY 1")
def link_histogram(table):
    """Links of each type."""
    return L.type_histogram(table("lineitem").select(F.col("l_returnflag").alias("type")))


@query("AGG-06 SET-05", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_keys(table):
    """Keys that occur more than once."""
    return L.duplicate_keys(table("lineitem"), "l_orderkey", "l_linenumber")


_LINKS = "WITH k AS (SELECT l_orderkey * 100 + l_linenumber AS id, l_suppkey AS src, l_partkey % 100 AS dst, l_linenumber % 3 AS type, l_quantity AS q FROM lineitem)"


def links(table):
    return table("lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).alias("dst"), (F.col("l_linenumber") % 3).alias("type"), F.col("l_quantity").alias("q"))


@query("FLT-01", f"{_LINKS} SELECT type, count(*) AS n, count(*) FILTER (WHERE src = dst) AS loops FROM k WHERE type <> 1 GROUP BY type")
def link_filter(table):
    """Links of other types than one, with their loops."""
    return L.filter_links(links(table), 1).groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("src") == F.col("dst")).alias("loops"))


@query("FLT-02 SET-06", f"{_LINKS} SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, type, min(id) AS id FROM k GROUP BY 1, 2, 3")
def link_dedup(table):
    """The first link of each unordered pair and type."""
    return L.deduplicate(links(table)).select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), "type", "id")


@query("FLT-03", f"{_LINKS} SELECT id, src, dst, type FROM k WHERE (src = 7 AND dst = 11) OR (src = 11 AND dst = 7)")
def link_between(table):
    """Links of a pair of nodes, either way."""
    return L.between(links(table), 7, 11).select("id", "src", "dst", "type")


@query("FLT-04 SRC-11 JOIN-20", f"{_LINKS}, t AS (SELECT src AS node, dst AS other, type, false AS turned FROM k UNION ALL SELECT dst, src, type, true FROM k WHERE src <> dst) SELECT node, type, turned, count(*) AS n, count(DISTINCT other) AS others FROM t WHERE node IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) GROUP BY ALL")
def links_of_nodes(table):
    """Links seen from some nodes, incoming ones turned around."""
    nodes = table("supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("node"))
    return L.touching(links(table), nodes).groupBy("node", "type", "turned").agg(F.count("*").alias("n"), F.count_distinct("other").alias("others"))


@query("SRC-12 TOP-01", f"{_LINKS} SELECT src, dst, count(*) AS n FROM k WHERE q IS NOT NULL AND dst >= 0 GROUP BY src, dst")
def all_links(table):
    """Links with a transform and without landmarks, by pair."""
    return links(table).filter("q is not null and dst >= 0").groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("JOIN-03 SRC-02", "SELECT c_custkey AS node FROM customer WHERE c_acctbal > -9")
def exists_semi(table):
    """Nodes under the child test as the store states it, which every node of positive weight passes."""
    nodes = table("customer").select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("weight"))
    out = table("orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    return L.node_ids(nodes, out, ignore_children=True)


@query("JOIN-01 SRC-13", "SELECT DISTINCT o_orderkey, o_totalprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def linked_nodes(table):
    """Nodes that a link starts from."""
    return table("orders").select("o_orderkey", "o_totalprice").join(table("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").distinct()


@query("JOIN-02 SRC-24", "SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(max(o_totalprice), c_acctbal), 2) AS pose FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_acctbal")
def optimised_or_raw(table):
    """Every node with its optimised value where there is one, else the raw one."""
    o = table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("best"))
    return table("customer").select("c_custkey", "c_acctbal").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(F.coalesce("best", "c_acctbal"), 2).alias("pose"))


@query("SRC-03 SRC-05 SRC-34 JOIN-04", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1)")
def lookup_by_ids(table):
    """Rows of a list of ids."""
    ids = table("lineitem").filter("l_quantity = 50 and l_discount = 0.1").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return table("orders").select("o_orderkey", "o_orderstatus", "o_totalprice").join(ids, "o_orderkey", "left_semi")


@query("SRC-09 SRC-10", "SELECT l_partkey AS word, count(*) AS uses FROM lineitem WHERE l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 30 DAY GROUP BY 1")
def last_run_words(table):
    """Words used in the last run."""
    li = table("lineitem").select("l_partkey", "l_shipdate")
    last = li.agg(F.max("l_shipdate").alias("last"))
    return li.join(F.broadcast(last), F.lit(True)).filter(F.col("l_shipdate") >= F.col("last") - F.expr("interval 30 days")).groupBy(F.col("l_partkey").alias("word")).agg(F.count("*").alias("uses"))  # one row


@query("SRC-33", "SELECT p_name, min(p_partkey) AS node, count(*) AS n FROM part GROUP BY p_name")
def label_lookup(table):
    """First node of each label and how many have it."""
    return table("part").groupBy("p_name").agg(F.min("p_partkey").alias("node"), F.count("*").alias("n"))


@query("SRC-35", "SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 100000) AS any_large, EXISTS (SELECT 1 FROM orders WHERE o_totalprice < -1) AS any_negative")
def existence_probe(table):
    """Whether rows exist."""
    return table("orders").agg(F.coalesce(F.max(F.col("o_totalprice") > 100000), F.lit(False)).alias("any_large"), F.coalesce(F.max(F.col("o_totalprice") < -1), F.lit(False)).alias("any_negative"))


@query("SET-01 SET-03 SET-04 AGG-26", "SELECT k, count(*) AS n FROM (SELECT * FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT * FROM (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)) GROUP BY k")
def set_operations(table):
    """Ids in both tables, and ids in one alone."""
    c, s, n = table("customer").select(F.col("c_nationkey").alias("k")), table("supplier").select(F.col("s_nationkey").alias("k")), table("nation").select(F.col("n_nationkey").alias("k"))
    return c.intersect(s).unionByName(n.subtract(s)).groupBy("k").agg(F.count("*").alias("n"))


@query("AGG-14", f"{_LINKS} SELECT max(q) AS xx, max(q * 2) AS yy FROM k WHERE type IN (0, 6)")
def odometry_information(table):
    """Largest information of each axis over neighbour links."""
    return L.max_information(links(table).select("type", F.col("q").alias("xx"), (F.col("q") * 2).alias("yy")), ["xx", "yy"])


@query("FLT-26", "SELECT a.n_name AS key, a.n_regionkey AS own, b.n_regionkey AS other FROM (SELECT * FROM nation WHERE n_nationkey < 20) a FULL JOIN (SELECT n_name, n_nationkey % 5 AS n_regionkey FROM nation WHERE n_nationkey >= 5) b ON a.n_name = b.n_name WHERE a.n_regionkey IS DISTINCT FROM b.n_regionkey AND a.n_name IS NOT NULL")
def parameter_diff(table):
    """Parameters that differ from another store's."""
    n = table("nation")
    a = n.filter("n_nationkey < 20").select(F.col("n_name").alias("key"), F.col("n_regionkey").alias("own"))
    b = n.filter("n_nationkey >= 5").select(F.col("n_name").alias("key"), (F.col("n_nationkey") % 5).alias("other"))
    return a.join(b, "key", "full_outer").filter(~F.col("own").eqNullSafe(F.col("other")) & F.col("own").isNotNull()).select("key", "own", "other")


@query("GRA-09", "WITH t AS (SELECT conv_id, turn, role, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations), c AS (SELECT conv_id, turn, sum(CASE WHEN turn - p = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS chain FROM t) SELECT conv_id, CAST(chain AS BIGINT) AS chain, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM c GROUP BY conv_id, chain")
def chains(table):
    """Chains of consecutive turns."""
    from pyspark.sql import Window

    t = table("conversations").select("conv_id", "turn")
    linked = F.col("turn") - F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")) == 1
    return L.chains(t, "conv_id", "turn", linked).groupBy("conv_id", "chain").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n"))
