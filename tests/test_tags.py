"""The tag chain, snapping, truth, aisles and merged links on cases worked out by hand."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import links, maps, sequences, tags

OBS = "id int, session int, stamp double, node_id long, frame_node long, frame_stamp double, frame_agrees boolean, wrong boolean"
NODES = "session int, node long, place int, stamp double, payload struct<v:int>"


def test_binding_names_the_first_failure(spark):
    nodes = [(1, 10, 0, 100.0), (1, 11, 1, 101.0), (1, 12, 2, 103.0), (1, 13, 3, None), (1, 14, 4, 104.0), (1, 14, 5, 104.0), (2, 10, 0, 100.0), (1, 15, 6, 99.0)]
    obs = [
        (1, 1, 100.4, 10, None, None, None, False, None, 10), (2, 1, 100.4, 99, None, None, None, False, "node_id_not_found", None), (3, 1, 104.0, 14, None, None, None, False, "node_id_ambiguous", None),
        (4, 1, 100.5, None, None, None, None, False, None, 10), (5, 1, 106.0, None, None, None, None, False, "node_time_delta_exceeded", None), (6, 1, 102.0, 10, None, None, None, False, "node_time_delta_exceeded", None),
        (7, 1, float("nan"), 10, None, None, None, False, "node_timebase_invalid", None), (8, 1, 100.0, 13, None, None, None, False, "bound_node_stamp_invalid", None), (9, 1, 100.0, 10, None, None, None, True, "identity_mismatch", None),
        (10, 1, 101.2, None, 11, 101.0, True, False, None, 11), (11, 1, 101.2, 10, 11, 101.0, True, False, "verified_burst_node_override", None), (12, 1, 101.2, 11, 11, 101.0, True, False, None, 11),
        (13, 1, 101.2, None, 11, 101.0, None, False, "verified_burst_frame_mismatch", None), (14, 1, 101.2, None, 77, 101.0, True, False, "verified_burst_node_id_not_found", None), (15, 1, 101.2, None, 14, 101.0, True, False, "verified_burst_node_id_ambiguous", None),
        (16, 1, 101.2, None, 11, 102.5, True, False, "verified_burst_node_stamp_mismatch", None), (17, 1, 102.4, None, 11, 101.0, True, False, "node_time_delta_exceeded", None), (18, 3, 100.0, None, None, None, None, False, "node_time_delta_exceeded", None),
        (19, 1, 102.0, None, None, None, None, False, None, 11), (20, 1, 99.5, None, None, None, None, False, None, 10),
    ]
    o = spark.createDataFrame([r[:8] for r in obs], OBS)
    n = spark.createDataFrame([(*r, (r[1],)) for r in nodes], NODES)
    got = {r["id"]: r for r in tags.bind(o, n, prefix="x", checks=[("identity_mismatch", F.col("wrong"))]).collect()}
    for r in obs:
        assert (got[r[0]]["failure"], got[r[0]]["node"]) == (r[8] and f"x_{r[8]}", r[9]), r
    assert got[4]["payload"]["v"] == 10 and got[4]["source"] == "frame_timestamp" and got[10]["source"] == "verified_burst_bound_node_id" and got[1]["delta"] == pytest.approx(0.4)
    assert tags.bind(o.limit(0), n, prefix="x", checks=[]).count() == 0 and tags.bind(o, n.limit(0), prefix="x", checks=[]).filter("failure is null").count() == 0


def test_fusion_and_judgement(spark):
    rows = [("a", 1.0 + 0.01 * (i % 3), 2.0, i, 0.9, 0.9, 0.9, 0.1, "front", "stable", False, "depth") for i in range(9)] + [("a", 1.5, 2.0, 9, 0.9, 0.9, 0.9, 0.1, "front", "stable", False, "depth")]
    rows += [("b", 0.0, 0.0, 1, 0.9, 0.9, 0.9, None, "front", "stable", False, "depth")] * 3 + [("c", 0.0, 0.0, i, 0.9, 0.9, 0.9, 0.1, "side", "stable", False, "depth") for i in range(4)]
    df = spark.createDataFrame(rows, "tag string, x double, y double, frame int, depth double, measurement double, localization double, uncertainty double, view string, tracking string, review boolean, method string")
    got = {r["tag"]: r for r in tags.fuse_tags(df, by=["tag"]).collect()}
    x = np.array([r[1] for r in rows[:10]])
    w0 = np.full(10, 0.9**3 / 0.01)
    c, w = x.mean(), w0
    for _ in range(3):
        w = w0 * np.where(abs(x - c) <= 0.075, 1, 0.075 / abs(x - c))
        c = (w * x).sum() / w.sum()
    a = got["a"]
    assert a["fx"] == pytest.approx(c) and a["effective"] == pytest.approx(w.sum() ** 2 / (w * w).sum()) and a["outliers"] == 1 and a["frames"] == 10 and a["spread"] == pytest.approx(1.5 - c)
    assert got["b"]["uncertainty"] is None and got["b"]["frames"] == 1 and not got["c"]["views"]
    shelf = {"distance": F.lit(0.4), "margin": F.lit(0.9), "along": F.lit(1.0), "length": F.lit(3.0), "side": F.lit("front"), "oriented": F.lit(True), "occluded": F.lit(False)}
    one = tags.fuse_tags(df.filter("tag = 'a' and frame < 9"), by=["tag"])

    def reason(frame=one, **other):
        given = {"identity": F.lit(True), "graph": F.lit(True), "stale": F.lit(False)} | {k: other.pop(k) for k in ("identity", "graph", "stale") if k in other}
        r = tags.judge(frame.withColumns(shelf | other), **given).first()
        return r["status"], r["reason"]

    assert reason() == ("accepted", "accepted")
    assert reason(identity=F.lit(False)) == ("rescanRequired", "map_session_identity_mismatch")
    assert reason(distance=F.lit(None).cast("double"))[1] == "shelf_association_distance_exceeded" and reason(margin=F.lit(0.1))[1] == "shelf_association_margin_insufficient" and reason(margin=F.lit(None).cast("double"))[1] == "accepted"
    assert reason(along=F.lit(0.1))[1] == reason(along=F.lit(2.9))[1] == "shelf_endpoint_ambiguity" and reason(side=F.lit(None).cast("string"))[1] == "shelf_side_ambiguous" and reason(occluded=F.lit(True))[1] == "shelf_occluded_by_structure"
    assert reason(tags.fuse_tags(df.filter("tag = 'a'"), by=["tag"]))[1] == "position_spread_exceeded" and reason(tags.fuse_tags(df.filter("tag = 'b'"), by=["tag"])) == ("rescanRequired", "insufficient_burst_samples") and reason(tags.fuse_tags(df.filter("tag = 'c'"), by=["tag"]))[1] == "view_quality_insufficient"


def test_snapping_against_all_points(spark):
    rng = np.random.default_rng(3)
    t, p = rng.uniform(-5, 5, (60, 2)), rng.uniform(-5, 5, (80, 2)).round(1)
    frame = lambda a: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], "k int, x double, y double")
    for r in tags.snap(frame(t), frame(p), 0.8, key="k", order="k").collect():
        d = np.hypot(*(p - t[r["k"]]).T)
        i = int(np.argmin(d))
        if d[i] < 0.8:
            assert (r["sx"], r["sy"]) == tuple(p[i]) and r["confidence"] == pytest.approx(max(0.5, 1 - d[i] / 0.8)) and r["needs_review"] == (1 - d[i] / 0.8 < 0.7)
        else:
            assert (r["sx"], r["sy"], r["confidence"], r["needs_review"]) == (*t[r["k"]], 0.35, True)


def test_truth_needs_a_later_row_and_short_gaps(spark):
    left = spark.createDataFrame([("a", float(t)) for t in (-1, 0, 1, 4, 10, 10.5, 12, 20, 21)], "k string, t double")
    truth = spark.createDataFrame([("a", 0.0, 0.0), ("a", 2.0, 20.0), ("a", 10.0, 5.0), ("a", 13.0, 8.0), ("a", 20.0, 1.0)], "k string, g double, v double")
    got = {r["t"]: r["truth"] for r in sequences.truth_between(left, truth, by=["k"], time="t", truth_time="g", value="v", limit=3.0).collect()}
    assert got == {0.0: 0.0, 1.0: 10.0, 10.0: 5.0, 10.5: 5.5, 12.0: 7.0}


def test_aisles_swap_their_ends_and_keep_the_heading(spark):
    poses = spark.createDataFrame([("s", i, float(i), float(i), 1.0, yaw) for i, yaw in enumerate([0.1, 3.0, 0.2, -3.1, 1.0, 0.0, 3.1, 0.3, -2.9])], "k string, id int, t double, x double, y double, yaw double")
    events = spark.createDataFrame([("s", 7, 1, 8.0, 1.0), ("s", 8, 9, 0.0, 9.0)], "k string, event int, aisle int, start double, end double")
    segments = spark.createDataFrame([(1, 1, 0.0, 0.0, 5.0, 0.0), (1, 2, 5.0, 0.0, 5.0, 9.0), (1, 3, 2.0, 1.0, 2.0, 1.0)], "aisle int, segment int, ax double, ay double, bx double, by_ double")
    got = sorted((r["event"], r["id"], r["cx"], r["cy"], r["cyaw"], r["distance"]) for r in maps.aisle_constraints(poses, events, segments, by=["k"], event="event", order=["t", "id"], width=5.0).collect())
    assert [g[:4] for g in got] == [(7, 1, 1.0, 0.0), (7, 5, 5.0, 1.0)] and abs(abs(got[0][4]) - math.pi) < 1e-9 and abs(got[1][4]) == pytest.approx(math.pi / 2) and got[1][5] == 0.0


def test_merged_information(spark):
    rng = np.random.default_rng(2)
    spd = lambda: (lambda m: m @ m.T + np.eye(6))(rng.normal(size=(6, 6)))
    a, b, zero = spd(), spd(), np.zeros((6, 6))
    t = [1.0, 0.0, 0.0, 2.0, 0.0, 1.0, 0.0, 3.0, 0.0, 0.0, 1.0, 4.0]
    first = [(1, 1, 2, True, t, a), (2, 1, 2, False, t, a), (3, 1, 3, True, t, zero), (4, 1, 4, True, None, a), (5, 1, 2, True, None, a), (6, 9, 9, True, t, a)]
    second = [(2, 5, t, b), (3, 5, t, b), (4, 6, None, b)]
    one = spark.createDataFrame([(*r[:5], r[5].ravel().tolist()) for r in first], "id int, src int, dst int, merged boolean, t array<double>, info array<double>")
    two = spark.createDataFrame([(*r[:3], r[3].ravel().tolist()) for r in second], "src int, dst int, t array<double>, info array<double>")
    got = {r["id"]: r for r in links.merge_links(one, two).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and got[1]["t"][3::4] == [4.0, 6.0, 8.0] and (got[1]["src"], got[1]["dst"]) == (1, 5)
    assert np.allclose(np.reshape(got[1]["info"], (6, 6)), np.linalg.inv(np.linalg.inv(a) + np.linalg.inv(b)))
    assert np.allclose(np.reshape(got[2]["info"], (6, 6)), a if a[0, 0] < b[0, 0] else b)
    assert got[3]["info"] is None and got[4]["t"] is None and np.allclose(np.reshape(got[4]["info"], (6, 6)), np.eye(6)) and got[5]["t"] is None and got[5]["info"] is None


def test_successors_over_buckets(spark):
    """One key with most of the rows, gaps of several buckets, ties and null keys."""
    rng = np.random.default_rng(5)
    rows = [(k, int(v)) for k, n, top in (("hot", 300, 900), ("few", 5, 900), (None, 40, 60)) for v in rng.integers(-200, top, n)]
    got = sorted(((r["k"], r["v"], r["next"]) for r in sequences.following(spark.createDataFrame(rows, "k string, v long").repartition(3), by=["k"], order="v", width=16).collect()), key=str)
    want = []
    for k in ("hot", "few", None):
        own = sorted(v for x, v in rows if x == k)
        want += zip([k] * len(own), own, [*own[1:], None], strict=True)
    assert got == sorted(want, key=str)
    assert sequences.following(spark.createDataFrame([], "k string, v long"), by=["k"], order="v").count() == 0


def test_frames_are_gated_by_the_samples_received(spark, tmp_path):
    """Micro-batches of one file each: state carries over, frames outside of the samples go, old samples are forgotten."""
    from waymark.plans.streams import drain
    from waymark.streaming.admission import gate_frames

    s, f = True, False
    batches = [
        [("a", 0, 50.0, f, 0.0), ("a", 1, 10.0, s, 1.0), ("a", 2, 20.0, s, 3.0), ("a", 3, 15.0, f, 0.0), ("a", 4, 20.0, f, 0.0), ("b", 5, 1.0, s, 7.0)],
        [("a", 6, 9.0, f, 0.0), ("a", 7, 10.0, f, 0.0), ("a", 8, 30.0, s, 5.0), ("a", 9, 25.0, f, 0.0), ("a", 10, 40.0, s, 9.0), ("a", 11, 35.0, f, 0.0), ("a", 12, 12.0, f, 0.0), ("b", 13, 0.5, f, 0.0)],
    ]
    kinds = "k string, n int, t double, imu boolean, v double"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["n"]: r["sample"] for r in drain(gate_frames(stream, key="k", arrival="n", stamp="t", is_sample="imu", value="v", buffer=2)).collect()}
    assert got == {0: None, 3: 2.0, 7: 1.0, 9: 4.0, 11: 7.0, 12: None}


def test_sights_are_blocked_near_the_shelf_only(spark):
    box = lambda x, y: [{"x": x + a, "y": y + b} for a, b in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))]
    walls = spark.createDataFrame([(1, box(4.0, -0.5)), (1, box(-3.0, 9.0)), (2, box(0.0, 0.0)), (1, box(7.0, 7.0)[:2])], "f int, ring array<struct<x:double,y:double>>")
    sights = [(1, 1, 0.0, 0.0, 6.5, 0.0), (2, 1, 0.0, 0.0, 9.0, 0.0), (3, 1, 0.0, 3.0, 6.5, 3.0), (4, 1, 0.0, 0.0, 4.5, 0.1), (5, 1, 6.0, 0.0, 0.0, 0.0), (6, 2, 6.0, 0.0, 4.0, 0.0), (7, 1, -5.0, 9.5, -1.0, 9.5), (8, 1, 7.5, 6.5, 7.5, 7.5)]
    df = spark.createDataFrame(sights, "s int, f int, ax double, ay double, bx double, by_ double")
    for size in (0.7, 5.0):
        assert sorted(r["s"] for r in tags.occluded(df, walls, by=["f"], key="s", size=size).collect()) == [1, 4, 7]
