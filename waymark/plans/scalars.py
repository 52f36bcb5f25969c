"""Scalar and geometry functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import geometry as G
from waymark.functions import scalars as X
from waymark.plans.base import query


@query("SCL-08", "SELECT event_id, 'k:' || CAST(json_extract_string(props, '$.k') AS INTEGER) || '.0;v:' || CAST(floor(value) AS INTEGER) || '.0' AS text, round(CAST(json_extract_string(props, '$.k') AS DOUBLE) + floor(value), 4) AS total FROM events")
def stat_map_roundtrip(table):
    """Statistics as text and back."""
    m = F.create_map(F.lit("v"), F.floor("value").cast("double"), F.lit("k"), F.get_json_object("props", "$.k").cast("double"))
    text = X.statistics_to_text(m)
    back = X.statistics_from_text(F.col("text"))
    return table("events").select("event_id", text.alias("text")).withColumn("m", back).select("event_id", "text", F.round(F.col("m")["k"] + F.col("m")["v"], 4).alias("total"))


@query("SCL-20 SCL-19", "SELECT event_id, coalesce(json_extract_string(props, '$.node_id'), json_extract_string(props, '$.k')) AS field, 'integer' AS kind FROM events")
def json_fields(table):
    """A JSON field under either spelling, and its strict kind."""
    return table("events").select("event_id", X.either_field(F.col("props"), "node_id", "k").alias("field")).withColumn("kind", X.strict_kind(F.col("field")))


@query("SCL-21 SCL-22", "SELECT event_id, round(CASE WHEN abs(value - 50) <= 20 THEN 1.0 ELSE 20 / abs(value - 50) END, 6) AS weight, round(acos(greatest(-1, least(1, value / 50 - 1.5))), 6) AS angle FROM events")
def robust_weights(table):
    """Huber weights and clamped arc cosines."""
    v = F.col("value")
    return table("events").select("event_id", F.round(X.huber_weight(v - 50, 20.0), 6).alias("weight"), F.round(X.safe_acos(v / 50 - 1.5), 6).alias("angle"))


@query("SCL-04 SCL-05 SCL-07", "SELECT p_partkey, len(list_filter(string_split(p_type, ' '), lambda x: x <> '')) AS pieces, upper(p_name) AS up, translate(p_name, ' ', '_') AS joined, hex(p_partkey) AS hex, rpad(p_brand, 12, '*') AS padded, regexp_matches(p_brand, '^-?[0-9]+$') AS is_int FROM part")
def string_helpers(table):
    """Split, case, replacement, hexadecimal, padding and digit tests."""
    return table("part").select("p_partkey", F.size(X.split_nonempty(F.col("p_type"), " ")).cast("long").alias("pieces"), F.upper("p_name").alias("up"), F.translate("p_name", " ", "_").alias("joined"), F.hex("p_partkey").alias("hex"), X.pad(F.col("p_brand"), 12, "*").alias("padded"), X.is_integer(F.col("p_brand")).alias("is_int"))


@query("SCL-14 SCL-15 SCL-16", "SELECT c_custkey, regexp_replace(translate(regexp_replace(c_name || ' / ' || c_mktsegment, '[^A-Za-z0-9._-]+', '-', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^-+|-+$', '', 'g') AS slug, left(sha256(c_custkey || '|' || c_name), 16) AS id FROM customer")
def slugs_and_ids(table):
    """Safe names and stable ids."""
    name = F.concat("c_name", F.lit(" / "), "c_mktsegment")
    return table("customer").select("c_custkey", X.slug(name).alias("slug"), X.stable_id(F.col("c_custkey"), F.col("c_name")).alias("id"))


@query("SCL-06", "SELECT c_custkey, len(regexp_extract_all(c_name, '[0-9]+|[^0-9]+')) AS pieces, array_to_string([CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(p, 19, '0') ELSE p END FOR p IN regexp_extract_all(c_name, '[0-9]+|[^0-9]+')], '') AS key FROM customer")
def natural_order(table):
    """Keys under which numbers in names sort by value."""
    return table("customer").select("c_custkey", F.size(X.number_pieces(F.col("c_name"))).cast("long").alias("pieces"), X.natural_key(F.col("c_name")).alias("key"))


@query("SCL-02 RET-08", "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_norms(table):
    """Euclidean norms."""
    return table("embeddings").select("vec_id", F.round(X.norm(F.col("embedding")), 6).alias("norm"))


@query("SCL-03", "SELECT c_custkey, CAST(bit_count(xor(c_custkey, c_custkey * 7)) AS INTEGER) AS hamming, round(CASE WHEN c_custkey % 16 = 15 THEN 0 ELSE 0.54 - 0.46 * cos(2 * pi() * (c_custkey % 16) / 15) END, 6) AS window FROM customer")
def hamming(table):
    """Hamming distance of words of bits, and the Hamming window."""
    k = F.col("c_custkey")
    return table("customer").select("c_custkey", X.hamming_distance(k, k * 7).cast("int").alias("hamming"), F.round(F.element_at(X.hamming_window(16), (k % 16).cast("int") + 1), 6).alias("window"))


@query("SCL-23 SNK-13", "SELECT p_partkey, CASE WHEN (p_partkey - 1) < 26 THEN '' WHEN (p_partkey - 1) // 26 - 1 < 26 THEN chr(CAST(65 + (p_partkey - 1) // 26 - 1 AS INTEGER)) ELSE chr(CAST(65 + ((p_partkey - 1) // 26 - 1) // 26 - 1 AS INTEGER)) || chr(CAST(65 + ((p_partkey - 1) // 26 - 1) % 26 AS INTEGER)) END || chr(CAST(65 + (p_partkey - 1) % 26 AS INTEGER)) AS letters, CAST(p_partkey AS INTEGER) AS col, p_size AS row FROM part WHERE p_partkey > 0")
def sheet_references(table):
    """Column letters of a number, and row and column back from the reference."""
    letters = X.column_letters(F.col("p_partkey"))
    out = table("part").filter("p_partkey > 0").select("p_partkey", letters.alias("letters"), X.cell_reference(F.concat(letters, F.col("p_size").cast("string"))).alias("r"))
    return out.select("p_partkey", "letters", F.col("r.column").alias("col"), F.col("r.row").alias("row"))


@query("SCL-18", "SELECT event_id, strftime(make_timestamp(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) * 1000000 + 19800000000), '%Y-%m-%dT%H:%M:%S') || '+05:30' AS local FROM events")
def local_timestamps(table):
    """Local time with an explicit offset."""
    return table("events").select("event_id", X.utc_text(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6), 19800).alias("local"))


@query("SCL-25", "SELECT p_partkey, round(p_size / 50.0 - p_size / 50.0 * 0.5 * greatest(0, least(k, 4 - k, 1)), 6) AS red FROM (SELECT *, (5 + (p_partkey % 360) / 60.0::DOUBLE) - 6 * floor((5 + (p_partkey % 360) / 60.0::DOUBLE) / 6) AS k FROM part)")
def colours(table):
    """Red of a hue, saturation and value."""
    return table("part").select("p_partkey", F.round(X.hsv_to_rgb((F.col("p_partkey") % 360).cast("double"), F.lit(0.5), F.col("p_size") / 50.0)[0], 6).alias("red"))


@query("SCL-24", "SELECT doc_id, list_position(w, 'the') AS position, list_contains(w, 'and') AS has, w[1] AS first FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)")
def array_helpers(table):
    """Position, containment and first element."""
    w = F.col("w")
    d = table("documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    return d.select("doc_id", F.nullif(F.array_position(w, "the"), F.lit(0)).cast("int").alias("position"), F.array_contains(w, "and").alias("has"), F.when(F.size(w) > 0, F.element_at(w, 1)).alias("first"))


_P = "WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 40 - 2 AS a, l_tax * 30 - 1 AS b, l_quantity - 20 AS u, l_extendedprice / 2000 AS v FROM lineitem)"


def _poses(table):
    t = table("lineitem")
    a = G.pose2(F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_discount") * 40 - 2)
    b = G.pose2(F.col("l_quantity") - 20, F.col("l_extendedprice") / 2000, F.col("l_tax") * 30 - 1)
    return t.select(a.alias("a"), b.alias("b"))


@query("GEO-03 GEO-05", f"{_P} SELECT round(sum(x + cos(a) * u - sin(a) * v), 2) AS cx, round(sum(y + sin(a) * u + cos(a) * v), 2) AS cy, round(sum(cos(a) * (u - x) + sin(a) * (v - y)), 2) AS rx, round(sum(cos(a) * (v - y) - sin(a) * (u - x)), 2) AS ry, count(*) AS n FROM p")
def planar_algebra(table):
    """Sums of composed and relative planar poses."""
    p = _poses(table).select(G.compose2(F.col("a"), F.col("b")).alias("c"), G.relative2(F.col("a"), F.col("b")).alias("r"))
    return p.agg(F.round(F.sum("c.x"), 2).alias("cx"), F.round(F.sum("c.y"), 2).alias("cy"), F.round(F.sum("r.x"), 2).alias("rx"), F.round(F.sum("r.y"), 2).alias("ry"), F.count("*").alias("n"))


@query("GEO-02 GEO-01", f"{_P} SELECT round(max(abs(sqrt(x*x + y*y) - sqrt(x*x + y*y))), 6) AS inverse_error, round(sum(sqrt(x*x + y*y + 9.0)), 2) AS norms, round(sum(acos(greatest(-1, least(1, cos(a))))), 2) AS angles FROM p")
def spatial_algebra(table):
    """A spatial pose times its inverse is the identity; norms and angles of poses."""
    t = table("lineitem")
    zero = F.lit(0.0)
    pose = G.from_euler(F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.lit(3.0), zero, zero, F.col("l_discount") * 40 - 2)
    e = t.select(pose.alias("p")).select("p", G.compose3(F.col("p"), G.inverse3(F.col("p"))).alias("i"))
    return e.agg(F.round(F.max(G.translation_norm(F.col("i"))), 6).alias("inverse_error"), F.round(F.sum(G.translation_norm(F.col("p"))), 2).alias("norms"), F.round(F.sum(G.rotation_angle(F.col("p"))), 2).alias("angles"))


@query(
    "GEO-07 FLT-27",
    """WITH c AS (SELECT c_custkey, radians(40 + c_nationkey / 10.0::DOUBLE) AS la, radians(-70 + c_acctbal / 10000) AS lo, radians(41.0::DOUBLE) AS ola, radians(-70.0::DOUBLE) AS olo FROM customer),
k AS (SELECT *, 6378137.0::DOUBLE AS a, (1 / 298.257223563::DOUBLE) * (2 - 1 / 298.257223563::DOUBLE) AS e2 FROM c),
g AS (SELECT *, a / sqrt(1 - e2 * sin(la)^2) AS n, a / sqrt(1 - e2 * sin(ola)^2) AS m FROM k),
d AS (SELECT *, n * cos(la) * cos(lo) - m * cos(ola) * cos(olo) AS dx, n * cos(la) * sin(lo) - m * cos(ola) * sin(olo) AS dy, n * (1 - e2) * sin(la) - m * (1 - e2) * sin(ola) AS dz FROM g)
SELECT c_custkey, round(-sin(olo) * dx + cos(olo) * dy, 3) AS east, round(-sin(ola) * cos(olo) * dx - sin(ola) * sin(olo) * dy + cos(ola) * dz, 3) AS north FROM d""",
)
def east_north(table):
    """Local offsets of geodetic positions."""
    e, n, _ = G.east_north_up(40 + F.col("c_nationkey") / F.lit(10.0), -70 + F.col("c_acctbal") / 10000, F.lit(0.0), F.lit(41.0), F.lit(-70.0), F.lit(0.0))
    return table("customer").select("c_custkey", F.round(e, 3).alias("east"), F.round(n, 3).alias("north"))


@query(
    "GEO-22 JOIN-14",
    """WITH s AS (SELECT n_nationkey AS id, n_nationkey * 2.0::DOUBLE AS ax, n_regionkey * 10.0::DOUBLE AS ay, n_nationkey * 2.0::DOUBLE + 10 AS bx, n_regionkey * 10.0::DOUBLE + 20 AS ey FROM nation),
p AS (SELECT p_partkey, p_size::DOUBLE AS px, p_retailprice / 30 AS py FROM part),
t AS (SELECT *, greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (ey - ay)) / ((bx - ax)^2 + (ey - ay)^2))) AS t FROM p CROSS JOIN s),
d AS (SELECT p_partkey, id, sqrt((px - ax - t * (bx - ax))^2 + (py - ay - t * (ey - ay))^2) AS d FROM t)
SELECT p_partkey, id AS corridor, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d, id) AS rn FROM d WHERE d <= 3.75) WHERE rn = 1""",
)
def nearest_corridor(table):
    """The nearest segment of each point inside its gate; the map's segments are few and bounded by the map."""
    n = F.col("n_nationkey").cast("double")
    s = table("nation").select(F.col("n_nationkey").alias("id"), (n * 2).alias("ax"), (F.col("n_regionkey") * 10.0).alias("ay"), (n * 2 + 10).alias("bx"), (F.col("n_regionkey") * 10.0 + 20).alias("by"))
    p = table("part").select("p_partkey", F.col("p_size").cast("double").alias("px"), (F.col("p_retailprice") / 30).alias("py"))
    # a nation's table has 25 rows
    d = p.join(F.broadcast(s), F.lit(True)).select("p_partkey", "id", G.project_on_segment(*(F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by")), relative=True)["distance"].alias("d"))
    best = d.filter("d <= 3.75").groupBy("p_partkey").agg(F.min(F.struct("d", "id")).alias("m"))
    return best.select("p_partkey", F.col("m.id").alias("corridor"), F.round("m.d", 6).alias("distance"))


@query("FLT-25", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE abs(l_quantity - 25) + abs(l_extendedprice / 1000 - 40) < 12.5 GROUP BY ALL")
def inside_polygon(table):
    """Points inside a diamond, not on its edges, of which the even-odd rule counts two."""
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((12.5, 40.0), (25.0, 27.5), (37.5, 40.0), (25.0, 52.5))))
    x, y = F.col("l_quantity"), F.col("l_extendedprice") / 1000
    return table("lineitem").filter(G.in_polygon(x, y, ring) & ~G.on_ring(x, y, ring)).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
