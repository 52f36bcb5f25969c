"""Files written to the shared folder and read back by the readers of their formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.plans.base import query
from waymark.session import drop_path, fresh_path, materialize
from waymark.sources import containers, formats, sinks


def _written(lines: DataFrame, read, **options) -> DataFrame:
    """What ``read`` makes of a text file with these lines (one column), written with the options; the result is kept, the file is not."""
    spark = lines.sparkSession
    path = fresh_path(spark, "text")
    lines.write.options(**options).text(path)
    out = materialize(spark, read(path), "read-back", path=fresh_path(spark, "read-back"))
    drop_path(spark, path)
    return out


@query("SRC-17", """SELECT f.fmt, p_partkey AS stamp, CAST(p_size AS DOUBLE) AS x, p_partkey % 100 / 4.0::DOUBLE AS y, 0.5::DOUBLE AS z FROM part, (VALUES ('rgbd'), ('rgbd_id'), ('new_college'), ('malaga'), ('st_lucia'), ('karlsruhe'), ('euroc'), ('toro')) f(fmt)""")
def pose_files(table):
    """Poses of every part from a file of each format."""
    part = table("part")
    stamp, x, y, z, pad = F.col("p_partkey").cast("string"), F.format_string("%d.0", F.col("p_size").cast("int")), (F.col("p_partkey") % 100 / 4).cast("string"), F.lit("0.5"), F.lit("0")
    quaternion = [pad, pad, pad, F.lit("1")]
    layout = {
        "rgbd": [stamp, x, y, z, *quaternion],
        "rgbd_id": [stamp, x, y, z, *quaternion, stamp],
        "new_college": [stamp, x, y, z, pad, pad, F.lit("0.25")],
        "malaga": [stamp, *[pad] * 7, x, y, z],
        "st_lucia": [stamp, *[pad] * 3, y, x, z],
        "karlsruhe": [stamp, *[pad] * 5, F.lit("0.25"), pad, x, y, z],
        "euroc": [F.concat(stamp, F.lit("000000000")), x, y, z, F.lit("1"), pad, pad, pad],
        "toro": [F.lit("VERTEX3"), stamp, x, y, z, pad, pad, F.lit("0.25")],
    }
    found = []
    for fmt, fields in layout.items():
        lines = part.select(F.concat_ws("," if fmt == "euroc" else " ", *fields).alias("value")).unionByName(part.limit(1).select(F.lit("# a comment").alias("value")))
        read = _written(lines, lambda path, fmt=fmt: formats.read_poses(part.sparkSession, path, fmt))
        key = F.col("id") if fmt == "toro" else F.col("stamp")
        found.append(read.select(F.lit(fmt).alias("fmt"), F.round(key).cast("long").alias("stamp"), *(F.round(F.col("pose")[i], 6).alias(c) for c, i in (("x", 3), ("y", 7), ("z", 11)))))
    return reduce(DataFrame.unionByName, found)


@query("SRC-19", """SELECT CAST(p_size AS DOUBLE) AS x, CAST(p_partkey AS DOUBLE) AS y, 0.0::DOUBLE AS z, CASE p_partkey % 3 WHEN 0 THEN 'occupied' WHEN 1 THEN 'free' ELSE 'ground' END AS kind, CAST(CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 4 END AS INTEGER) AS segment FROM part WHERE p_partkey % 10 <> 7""")
def csv_points(table):
    """Points of a CSV file: rows without numbers go, kinds are in small letters."""
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 1, " FREE").when(k % 3 == 2, "Ground").otherwise("")
    rows = table("part").select(F.when(k % 10 == 7, "n/a").otherwise(F.col("p_size").cast("string")).alias("X_m"), k.cast("string").alias("y"), kind.alias("Kind"), F.when(k % 4 > 0, (k % 4).cast("string")).otherwise("none").alias("segment_index"))
    spark = rows.sparkSession
    path = fresh_path(spark, "points")
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    out = materialize(spark, formats.read_points(spark, path).select("x", "y", "z", "kind", "segment"), "read-back", path=fresh_path(spark, "read-back"))
    drop_path(spark, path)
    return out


@query("SRC-20", """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'duplicate key id' WHEN 1 THEN 'constant NaN' WHEN 2 THEN 'not JSON' WHEN 3 THEN 'unknown field other' WHEN 4 THEN 'missing field t' WHEN 5 THEN 'field id is not int' END AS reason FROM part""")
def strict_records(table):
    """Why each line of a JSON lines file is no strict record; null where it is one."""
    k = F.col("p_partkey").cast("string")
    line = F.lit(None).cast("string")
    for i, text in enumerate(['{"id":%s,"id":1,"t":1}', '{"id":%s,"t":NaN}', '{"id":%s,', '{"id":%s,"t":1,"other":2}', '{"id":%s}', '{"id":"%s","t":1}', '{"id":%s,"t":1.5}', '{"t":null,"id":%s}']):
        line = F.when(F.col("p_partkey") % 8 == i, F.format_string(text, k)).otherwise(line)
    lines = table("part").select(line.alias("value"))
    found = _written(lines, lambda path: formats.read_strict_jsonl(lines.sparkSession, path, allowed={"id": "int", "t": "number"}, required=("id", "t")))
    number = F.regexp_extract("value", r'"id":"?([0-9]+)', 1).cast("long")
    return found.select(number.alias("p_partkey"), "reason")


@query("SRC-26", """SELECT p_partkey, 'a "quoted" name, ' || p_name || chr(10) || 'second line' AS note FROM part""")
def quoted_fields(table):
    """Fields with quotes, separators and line breaks, from a CSV file."""
    rows = table("part").select("p_partkey", F.concat(F.lit('a "quoted" name, '), "p_name", F.lit("\nsecond line")).alias("note"))
    spark = rows.sparkSession
    path = fresh_path(spark, "quoted")
    rows.write.option("header", True).option("escape", '"').csv(path)
    out = materialize(spark, formats.read_csv_strict(spark, path).select(F.col("p_partkey").cast("long").alias("p_partkey"), "note"), "read-back", path=fresh_path(spark, "read-back"))
    drop_path(spark, path)
    return out


@query("SNK-01", "SELECT CAST(l_linenumber % 3 AS INTEGER) AS map_id, count(*) AS n, round(sum(l_quantity), 2) AS weight FROM lineitem GROUP BY 1")
def appended_nodes(table):
    """Nodes appended in two transactions, read back by map."""
    rows = table("lineitem").select((F.col("l_linenumber") % 3).cast("int").alias("map_id"), "l_orderkey", "l_quantity")
    spark = rows.sparkSession
    path = fresh_path(spark, "store")
    for odd in (0, 1):
        sinks.append_rows(rows.filter(F.col("l_orderkey") % 2 == odd), path, partition="map_id")
    stored = spark.read.schema("l_orderkey long, l_quantity double, map_id int").parquet(path)
    return stored.groupBy("map_id").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("weight"))


@query("SNK-15", "SELECT 'v2' AS version, count(*) AS n, (SELECT count(*) FROM supplier) AS before FROM supplier WHERE s_suppkey % 2 = 0")
def published_version(table):
    """The current one of two versions; a third fails its check and changes nothing."""
    rows = table("supplier")
    spark = rows.sparkSession
    base = fresh_path(spark, "published")
    sinks.publish(spark, rows, base, "v1")
    sinks.publish(spark, rows.filter("s_suppkey % 2 = 0"), base, "v2")
    try:
        sinks.publish(spark, rows.limit(0), base, "v3", check=lambda df: not df.isEmpty())
    except ValueError:
        pass
    version = sinks.current_version(spark, base)
    before = spark.read.parquet(f"{base}/v1").agg(F.count("*").alias("before"))
    return spark.read.parquet(f"{base}/{version}").agg(F.count("*").alias("n")).crossJoin(F.broadcast(before)).select(F.lit(version).alias("version"), "n", "before")  # one row each


@query("SNK-16", "SELECT CAST(sum(strlen(coalesce(html, '')) + 1) AS BIGINT) AS bytes, true AS agreed FROM (SELECT replace(replace(html, chr(10), ' '), chr(13), ' ') AS html FROM pages)")
def page_manifest(table):
    """Bytes of the written pages, by the manifest of their files, and whether a second manifest has the same digests."""
    rows = table("pages").select(F.coalesce(F.translate("html", "\n\r", "  "), F.lit("")).alias("value"))
    spark = rows.sparkSession
    path = fresh_path(spark, "manifest")
    rows.write.option("maxRecordsPerFile", 10_000).text(path)
    first = sinks.manifest(spark, path).filter(F.col("path").endswith(".txt"))
    again = first.select("path", F.col("sha256").alias("then"))
    both = first.join(again, "path", "full_outer")
    return both.agg(F.sum("bytes").alias("bytes"), F.min(F.coalesce(F.col("sha256") == F.col("then"), F.lit(False))).alias("agreed"))


@query("SNK-11", """WITH e AS (SELECT user_id, list({'t': event_id, 'x': round(value, 2), 'y': (event_id % 50)::DOUBLE} ORDER BY event_id) AS p FROM events GROUP BY user_id)
SELECT user_id, '{"type":"Feature","properties":{"user_id":' || user_id || ',"kind":"trajectory","nodes":' || len(p) || '},"geometry":{"type":"LineString","coordinates":[' || array_to_string(list_transform(p, lambda q: '[' || q.x || ',' || q.y || ']'), ',') || ']}}' AS value FROM e WHERE len(p) >= 2""")
def trajectory_features(table):
    """A line-string feature for each user's events."""
    e = table("events").select("user_id", "event_id", F.round("value", 2).alias("x"), (F.col("event_id") % 50).cast("double").alias("y"))
    return sinks.geojson_lines(e, by=["user_id"], order="event_id", x="x", y="y")


@query("SCL-09", """SELECT vec_id, CAST(CASE WHEN vec_id % 10 <> 3 THEN 4 END AS INTEGER) AS n_rows, CAST(CASE WHEN vec_id % 10 <> 3 THEN 16 END AS INTEGER) AS cols, CASE WHEN vec_id % 10 <> 3 THEN embedding[1]::DOUBLE END AS first, CASE WHEN vec_id % 10 <> 3 THEN embedding[64]::DOUBLE END AS last FROM embeddings""")
def matrix_blobs(table):
    """Matrices through their compressed form; of damaged blobs nothing is read."""
    v = table("embeddings").select("vec_id", containers.matrix_blob("embedding", 4, 5).alias("blob"))
    damaged = v.withColumn("blob", F.when(F.col("vec_id") % 10 == 3, F.substring("blob", 5, 1000000)).otherwise(F.col("blob")))
    m = damaged.select("vec_id", containers.matrix_of_blob("blob").alias("m"))
    return m.select("vec_id", F.col("m.rows").alias("n_rows"), F.col("m.cols").alias("cols"), F.col("m.values")[0].alias("first"), F.try_element_at("m.values", F.lit(64)).alias("last"))


@query("SRC-22", "SELECT 'tag' || p_partkey AS tag_id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS payload, CAST(p_partkey % 5 AS INTEGER) AS segment, CAST(CASE WHEN p_partkey % 2 = 0 THEN p_size END AS INTEGER) AS node_count, p_partkey / 4.0::DOUBLE AS x, CASE WHEN p_partkey % 7 = 0 THEN 0.0::DOUBLE ELSE p_size::DOUBLE END AS y FROM part")
def price_tags(table):
    """Price tags of JSON arrays, one array for each brand of parts; fields in both spellings."""
    k, null = F.col("p_partkey"), F.lit(None)
    old = k % 2 == 1
    tag = F.struct(
        F.when(~old, F.concat(F.lit("tag"), k.cast("string"))).alias("tagIdentifier"), F.when(old, F.concat(F.lit("tag"), k.cast("string"))).alias("id"), F.when(k % 3 != 0, F.col("p_name")).alias("payload"),
        F.when(~old, (k % 5).cast("int")).alias("segmentIndex"), F.when(old, (k % 5).cast("int")).alias("segment_index"), F.when(~old, F.col("p_size").cast("int")).alias("nodeCount"), (k / 4).alias("x"), F.when(k % 7 != 0, F.col("p_size").cast("double")).otherwise(null).alias("y"),
    )
    arrays = table("part").groupBy((k % 16).alias("file")).agg(F.to_json(F.collect_list(tag)).alias("value")).select("value").repartition(16, "value")
    found = _written_whole(arrays, lambda path: formats.read_price_tags(arrays.sparkSession, path))
    return found.select("tag_id", "payload", "segment", "node_count", "x", "y")


@query("SRC-21", "SELECT CAST(p_partkey AS INTEGER) AS node, p_size::DOUBLE AS x, p_partkey / 8.0::DOUBLE AS y, kind FROM part, (VALUES ('json'), ('csv')) f(kind) WHERE p_partkey % 9 <> 4")
def trajectory_samples(table):
    """Samples of a JSON array, and of a CSV file where the array is empty; rows without numbers go."""
    k = F.col("p_partkey")
    rows = table("part").select(k.cast("string").alias("nodeCount"), F.when(k % 9 == 4, "?").otherwise(F.col("p_size").cast("string")).alias("x"), (k / 8).cast("string").alias("y"))
    spark = rows.sparkSession
    array = rows.groupBy((F.col("nodeCount") % 4).alias("file")).agg(F.to_json(F.collect_list(F.struct("nodeCount", "x", "y"))).alias("value")).select("value").repartition(4, "value")
    first = _written_whole(array, lambda path: formats.read_trajectory(spark, path, None)).select("node", "x", "y", F.lit("json").alias("kind"))
    path = fresh_path(spark, "samples")
    rows.write.option("header", True).csv(f"{path}/csv")
    spark.range(1).select(F.lit("[]").alias("value")).write.text(f"{path}/json")
    second = formats.read_trajectory(spark, f"{path}/json", f"{path}/csv").select("node", "x", "y", F.lit("csv").alias("kind"))
    return first.unionByName(second)


def _written_whole(arrays: DataFrame, read) -> DataFrame:
    """Like ``_written``, with one file for each row of the text, but not of what is read."""
    return _written(arrays, read, maxRecordsPerFile=1)


@query("SRC-36", "SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations')")
def table_columns(table):
    """Columns of every table, read off their schemas."""
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
    found = [(n, c) for n in names for c in table(n).columns]
    return table("region").sparkSession.createDataFrame(found, "table_name string, column_name string")


@query("SCL-11", "SELECT p_partkey, CASE WHEN p_partkey % 6 <> 5 THEN p_size::DOUBLE END AS x, CASE WHEN p_partkey % 6 <> 5 THEN (p_partkey % 64) / 4.0::DOUBLE END AS y, CASE WHEN p_partkey % 6 <> 5 THEN 0.5::DOUBLE END AS z FROM part")
def pose_blobs(table):
    """Poses through their 48-byte form; blobs of another length are none."""
    k, zero, one = F.col("p_partkey"), F.lit(0.0), F.lit(1.0)
    pose = F.array(one, zero, zero, F.col("p_size").cast("double"), zero, one, zero, k % 64 / 4, zero, zero, one, F.lit(0.5))
    blobs = table("part").select("p_partkey", pose.alias("pose")).select("p_partkey", containers.blob_of_pose("pose").alias("blob"))
    cut = blobs.select("p_partkey", F.when(k % 6 == 5, F.substring("blob", 1, 47)).otherwise(F.col("blob")).alias("blob"))
    read = cut.select("p_partkey", containers.pose_of_blob("blob").alias("p"))
    return read.select("p_partkey", F.col("p")[3].alias("x"), F.col("p")[7].alias("y"), F.col("p")[11].alias("z"))


@query("SNK-08", """WITH e AS (SELECT user_id, event_id, round(value / 2 - 20, 3) AS lon, (event_id % 90)::DOUBLE AS lat FROM events)
SELECT user_id, '<LineString><coordinates>' || string_agg(lon || ',' || lat || ',0.0', ' ' ORDER BY event_id) || '</coordinates></LineString>' AS line FROM e GROUP BY user_id""")
def kml_lines(table):
    """A KML line string of each user's places."""
    e = table("events").select("user_id", "event_id", F.round(F.col("value") / 2 - 20, 3).alias("lon"), (F.col("event_id") % 90).cast("double").alias("lat"), F.lit(0.0).alias("alt"))
    lines = e.groupBy("user_id").agg(F.collect_list(F.struct("event_id", "lon", "lat", "alt")).alias("points"))
    return lines.select("user_id", F.concat(F.lit("<LineString><coordinates>"), sinks.kml(lines), F.lit("</coordinates></LineString>")).alias("line"))
