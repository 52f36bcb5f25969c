"""Order-dependent and iterative operators on small frames worked out by hand, and invariants."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from waymark.functions import geometry as G
from waymark.functions import scalars as X
from waymark.operators import clouds, geometry, graph, greedy, links, quality, rasters, retrieval, sequences, trajectories


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_radius_poses_keep_ends_and_distance(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate((0.0, 0.4, 1.1, 1.2, 2.5, 2.6))] + [("b", 0, 0.0), ("b", 1, 0.1)], "k string, i int, x double")
    out = rows(greedy.radius_poses(df, by=["k"], order=["i"], axes=["x"], radius=1.0).select("k", "i"), "k", "i")
    assert out == [("a", 0), ("a", 2), ("a", 4), ("a", 5), ("b", 0), ("b", 1)]


def test_seed_clusters_do_not_chain(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate((0.0, 0.9, 1.8, 0.2))], "k string, i int, x double")
    assert rows(greedy.seed_clusters(df, by=["k"], order=["i"], axes=["x"], radius=1.0).select("i", "cluster"), "i") == [(0, 0), (1, 0), (2, 1), (3, 0)]


def test_greedy_pairs_are_one_to_one(spark):
    df = spark.createDataFrame([("k", 1, 1, 0.5), ("k", 1, 2, 0.1), ("k", 2, 2, 0.2), ("k", 2, 1, 0.9), ("k", 3, 3, 5.0)], "k string, a int, b int, d double")
    assert rows(greedy.pair_greedily(df, by=["k"], a="a", b="b", distance="d", limit=2.0).select("a", "b"), "a") == [(1, 2), (2, 1)]


def test_bayes_posterior_sums_to_one_and_follows_evidence(spark):
    df = spark.createDataFrame([("k", s, n, 5.0 if n == 2 else 1.0) for s in range(3) for n in range(4)], "k string, s int, n int, l double")
    out = greedy.bayes_chain(df, by=["k"], step="s", node="n", likelihood="l")
    assert all(abs(t - 1) < 1e-9 for (t,) in rows(out.groupBy("s").agg(F.sum("posterior")).select("sum(posterior)")))
    assert out.filter("s = 2").orderBy(F.desc("posterior")).first()["n"] == 2


def test_correction_field_is_bounded_by_its_targets(spark):
    df = spark.createDataFrame([("k", i, 1.0 if i == 5 else None, 10.0) for i in range(11)], "k string, i int, t double, w double")
    got = [r[1] for r in rows(greedy.smooth_corrections(df, by=["k"], order=["i"], target="t", weight="w").select("i", "correction"), "i")]
    assert max(got) <= 1.0 + 1e-6 and all(abs(g - 1) < 1e-3 for g in got)


def test_planar_optimisation_recovers_a_square(spark):
    truth = [(0.0, 0.0, 0.0), (1.0, 0.0, math.pi / 2), (1.0, 1.0, math.pi), (0.0, 1.0, -math.pi / 2)]
    start = [(x + 0.1 * i, y - 0.05 * i, t + 0.05 * i) for i, (x, y, t) in enumerate(truth)]
    poses = spark.createDataFrame([(7, i, *p) for i, p in enumerate(start)], "g int, node int, x double, y double, yaw double")
    edges = spark.createDataFrame([(7, i, (i + 1) % 4, 1.0, 0.0, math.pi / 2, 100.0, 100.0) for i in range(4)], "g int, src int, dst int, dx double, dy double, dyaw double, w double, wyaw double")
    for r, (x, y, yaw) in zip(rows(trajectories.optimize_planar(poses, edges, by="g"), "node"), truth, strict=True):
        assert r[2] == pytest.approx(x, abs=1e-5) and r[3] == pytest.approx(y, abs=1e-5) and math.cos(r[4] - yaw) == pytest.approx(1, abs=1e-6)


def test_median_of_order_and_true_median(spark):
    df = spark.createDataFrame([("k", i, float(x), 0.0, 0.0, 0.0) for i, x in enumerate((9, 1, 2))], "k string, i int, x double, y double, gx double, gy double")
    compat = trajectories.alignment_errors(df, by=["k"], order="i", compat=True).first()["median"]
    plain = trajectories.alignment_errors(df, by=["k"], order="i").first()["median"]
    assert compat == pytest.approx(3.0) and plain == pytest.approx(3.0)


def test_child_test_is_a_tautology_only_with_compat(spark):
    nodes = spark.createDataFrame([(1, 0), (2, 0), (3, -9)], "node int, weight int")
    edges = spark.createDataFrame([(1, 2)], "src int, dst int")
    assert rows(links.node_ids(nodes, edges, ignore_children=True), "node") == [(1,), (2,)]
    assert rows(links.node_ids(nodes, edges, ignore_children=True, compat=False), "node") == [(1,)]


def test_components_and_paths(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (7, 8, 1.0)], "src int, dst int, cost double")
    nodes = spark.createDataFrame([(n,) for n in (1, 2, 3, 7, 8, 9)], "node int")
    assert rows(graph.components(spark, edges, nodes), "node") == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 9)]
    start = spark.createDataFrame([(1, 1)], "origin int, node int")
    assert rows(graph.relax(spark, graph.both_ways(edges, "cost"), start), "node") == [(1, 1, 0.0), (1, 2, 1.0), (1, 3, 2.0)]


def test_negative_filters_are_complements(spark):
    cloud = spark.createDataFrame([(i, float(i), float(i % 3), float(-i)) for i in range(20)] + [(99, float("nan"), 0.0, 0.0)], "id int, x double, y double, z double")
    for keep in (clouds.crop_box(cloud, (2, 0, -9), (9, 1, 0)), clouds.pass_through(cloud, "x", 3, 8), clouds.frustum(cloud, hfov=1.0, vfov=2.0, near=1, far=15)):
        assert keep.count() < 20
    inside, outside = clouds.crop_box(cloud, (2, 0, -9), (9, 1, 0)), clouds.crop_box(cloud, (2, 0, -9), (9, 1, 0), negative=True)
    assert inside.count() + outside.count() == 20 and inside.join(outside, "id").count() == 0


def test_near_pairs_are_symmetric_and_complete(spark):
    pts = [(i, (i * 37 % 100) / 10, (i * 61 % 100) / 10, (i * 17 % 50) / 10) for i in range(60)]
    cloud = spark.createDataFrame([(0, *p) for p in pts], "c int, id int, x double, y double, z double")
    got = {(a, b) for _, a, b, _ in rows(clouds.near_pairs(cloud, cloud, 2.0, by=["c"]))}
    assert got == {(p[0], q[0]) for p in pts for q in pts if math.dist(p[1:], q[1:]) <= 2.0}


def test_distance_field_from_one_seed(spark):
    out = dict(((x, y), d) for x, y, d in rows(rasters.distance_field(spark, spark.createDataFrame([(0, 0)], "ix int, iy int"), 2.5, by=[])))
    assert out[(2, 0)] == 2 and out[(1, 1)] == pytest.approx(math.sqrt(2)) and out[(2, 1)] == pytest.approx(1 + math.sqrt(2)) and (2, 2) not in out


def test_four_percentiles_differ(spark):
    df = spark.createDataFrame([("k", float(v)) for v in (1, 2, 3, 4)], "k string, v double")
    assert rows(quality.percentiles(df, "v", 0.5, by=["k"])) == [("k", 3.0, 2.0, 2.5, 2.0)]


def test_log_odds_clamp_at_every_step(spark):
    df = spark.createDataFrame([(0, i, h) for i, h in enumerate([True] * 5 + [False] * 2)], "c int, o int, h boolean")
    assert quality.log_odds(df, by=["c"], order="o", hit="h", gain=1.0, loss=-1.0, low=-2.0, high=2.0).first()["log_odds"] == 0.0


def test_likelihood_defaults_to_zero(spark):
    index = spark.createDataFrame([("w", 1, 2), ("v", 1, 2), ("v", 2, 1)], "word string, node int, nwi long")
    asked, nodes = spark.createDataFrame([("w",), ("w",), ("v",)], "word string"), spark.createDataFrame([(1,), (2,), (3,)], "node int")
    got = dict(rows(retrieval.likelihood(index, asked, nodes)))
    assert got[1] == pytest.approx(2 * math.log10(3) / 4 + 2 * math.log10(1.5) / 4) and got[2] == pytest.approx(math.log10(1.5)) and got[3] == 0.0


def test_resample_stops_at_gaps(spark):
    df = spark.createDataFrame([("k", 0.5, 0.0), ("k", 2.5, 2.0), ("k", 9.5, 9.0)], "k string, t double, v double")
    assert rows(sequences.resample(df, "t", "v", 1.0, by=["k"], max_gap=3.0), "t")[:3] == [("k", 1.0, 0.5, "interpolated"), ("k", 2.0, 1.5, "interpolated"), ("k", 3.0, None, "no_reliable_position")]


def test_registration_finds_the_motion(spark):
    pts = [(0, i, (i % 5) * 2.0, (i // 5) * 2.0) for i in range(25)]
    a, t = 0.05, (0.3, -0.2)
    moved = [(0, i, math.cos(a) * x - math.sin(a) * y + t[0], math.sin(a) * x + math.cos(a) * y + t[1]) for _, i, x, y in pts]
    s, d = (spark.createDataFrame(p, "c int, id int, x double, y double") for p in (pts, moved))
    out = geometry.register_planar(s, d, by=["c"], radius=0.95, rounds=3).first()
    assert (out["x"], out["y"], out["yaw"]) == pytest.approx((*t, a), abs=1e-6)


def test_angles_and_columns(spark):
    r = spark.range(1).select(G.normalize_angle(F.lit(3 * math.pi)).alias("a"), G.normalize_angle(F.lit(-math.pi)).alias("b"), X.column_letters(F.lit(703)).alias("c"), X.column_number(F.lit("AAA")).alias("d"), X.slug(F.lit("  İstanbul MAP! ")).alias("e"), X.rounded(F.lit(-0.0)).alias("f")).first()
    assert (r["a"], r["b"]) == pytest.approx((math.pi, math.pi)) and (r["c"], r["d"], r["e"]) == ("AAA", 703, "stanbul-map") and math.copysign(1, r["f"]) == 1


def test_correlation_over_all_lags(spark):
    import numpy as np

    a, b = [1, 0, 4, 2, 0, 3, 5], [2, 1, 0, 0, 6, 1, 3]
    df = spark.createDataFrame([("k", i, x, y) for i, (x, y) in enumerate(zip(a, b, strict=True))], "k string, i int, a long, b long")
    out = rows(sequences.correlate(df, df, by=["k"], index="i", a="a", b="b").select("lag", "n", "xcorr", "xcov"), "lag")
    da, db = np.array(a) - np.mean(a), np.array(b) - np.mean(b)
    assert [r[:3] for r in out] == [(lag, 7 - abs(lag), c) for lag, c in zip(range(-6, 7), np.correlate(b, a, "full").tolist(), strict=True)]
    assert [r[3] for r in out] == pytest.approx(np.correlate(db, da, "full").tolist())


def test_sequence_errors_are_registered_for_every_length(spark):
    from waymark import catalog

    out = catalog.QUERIES["sequence_error_all_lengths"](spark, "/root/testdata/sf0.001")
    assert [r[0] for r in rows(out.select("length").distinct(), "length")] == list(trajectories.SEQUENCE_LENGTHS)


def test_sequence_error_keeps_every_start(spark):
    from waymark import catalog

    out = rows(catalog.QUERIES["sequence_error"](spark, "/root/testdata/sf0.001"), "user_id", "start", "length")
    single = rows(catalog.QUERIES["sequence_error_all_lengths"](spark, "/root/testdata/sf0.001"), "user_id", "start", "length")
    assert [r[:4] for r in out] == single and len({r[:2] for r in out}) > len({r[0] for r in out})
    groups = {}
    for user, _, length, error, *_ in out:
        groups.setdefault((user, length), []).append(error)
    for user, _, length, _, starts, mean, most in out:
        own = groups[user, length]
        assert (starts, most) == (len(own), max(own)) and mean == pytest.approx(sum(own) / len(own), abs=1e-5)


def test_registered_optimisation_has_converged(spark, monkeypatch):
    import numpy as np

    from waymark import catalog

    calls, real = [], trajectories.optimize_planar
    monkeypatch.setattr(trajectories, "optimize_planar", lambda *a, **k: calls.append((a[1], real(*a, **k))) or calls[-1][1])
    catalog.QUERIES["planar_optimisation"](spark, "/root/testdata/sf0.001")
    links, out = calls[0]
    p = {(u, n): (x, y, yaw) for u, n, x, y, yaw in out.collect()}
    g = {k: np.zeros(3) for k in p}
    for e in links.collect():
        u, w = e["user_id"], np.array([e["w"], e["w"], e["wyaw"]])
        (ax, ay, at), (bx, by, bt) = p[u, e["src"]], p[u, e["dst"]]
        c, s = math.cos(at), math.sin(at)
        x, y = c * (bx - ax) + s * (by - ay), c * (by - ay) - s * (bx - ax)
        r = np.array([x - e["dx"], y - e["dy"], math.remainder(bt - at - e["dyaw"], 2 * math.pi)])
        r *= w * min(1, 2 / max(math.sqrt((w * r * r).sum()), 1e-12))  # Huber at 2
        g[u, e["src"]] += r @ [[-c, -s, y], [s, -c, -x], [0, 0, -1]]
        g[u, e["dst"]] += r @ [[c, s, 0], [-s, c, 0], [0, 0, 1]]
    held = {u: min(n for v, n in p if v == u) for u, _ in p}
    worst = max(np.abs(v).max() for (u, n), v in g.items() if n != held[u])
    assert worst < 1e-5  # no pose can move to lower the cost


def test_registered_registration_has_converged(spark):
    import numpy as np

    from waymark import catalog
    from waymark.plans.geometry import ranged

    sf = "/root/testdata/sf0.001"
    got = {r["cloud"]: (r["x"], r["y"], r["yaw"]) for r in catalog.QUERIES["planar_registration"](spark, sf).collect()}
    clouds = {}
    for c, _, x, y, flag in rows(ranged(lambda t: spark.read.parquet(f"{sf}/{t}.parquet")).select("cloud", "id", "x", "y", "flag"), "cloud", "id"):
        clouds.setdefault(c, ([], []))[flag != "R"].append((x, y))
    assert set(got) == {c for c, (a, _) in clouds.items() if a}
    for c, (a, b) in clouds.items():
        p, q, before = np.array(a), np.array(b), None
        for _ in range(1000):
            d2 = ((p[:, None] - q) ** 2).sum(2)
            on = d2.min(1) <= 9
            m = np.where(on, d2.argmin(1), -1)
            if before is not None and (m == before).all():
                break
            before, u, v = m, p[on] @ (1, 1j), q[m[on]] @ (1, 1j)
            turn = np.angle((np.conj(u - u.mean()) * (v - v.mean())).sum())
            z = v.mean() + np.exp(1j * turn) * (p @ (1, 1j) - u.mean())
            p = np.stack([z.real, z.imag], 1)
        else:
            raise AssertionError("no convergence")
        x, y, yaw = got[c]
        z = x + 1j * y + np.exp(1j * yaw) * (np.array(a) @ (1, 1j))
        assert np.abs(z - p @ (1, 1j)).max() < 2e-2, c


def test_covers_claims_no_method_that_is_not_built():
    from waymark import catalog

    claimed = {i for ids in catalog.COVERS.values() for i in ids}
    assert not claimed & {"GEO-12", "GEO-18", "RET-04", "RET-17", "STR-08"}


def test_two_nearest_in_blocks_of_the_dictionary(spark, monkeypatch):
    words = spark.createDataFrame([(i, [float(i), float(i % 3)]) for i in range(20)], "word int, vec array<double>")
    vectors = spark.createDataFrame([(1, [2.2, 0.0]), (2, [19.0, 1.0]), (3, [7.5, 1.5])], "id int, vec array<double>")
    whole = sorted(rows(retrieval.two_nearest(vectors, words)))
    monkeypatch.setattr(retrieval, "DICTIONARY_BYTES", 100)
    assert sorted(rows(retrieval.two_nearest(vectors, words))) == whole
    one = words.filter("word = 4")
    assert [r["word2"] for r in retrieval.two_nearest(vectors, one).collect()] == [None] * 3


@pytest.mark.parametrize("limit", [1 << 20, 20, 0])
def test_components_of_chains_numbered_in_order(spark, monkeypatch, limit):
    monkeypatch.setattr(graph, "TASK_EDGES", limit)
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, i) for i in range(70, 80)] + [(5, 5)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in [*range(61), *range(70, 80), 100, 200]], "node long")
    got = dict(rows(graph.components(spark, edges, nodes)))
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys([*range(70, 80), 100], 70), 200: 200}


def test_a_search_that_is_not_over_is_an_error(spark):
    from waymark.operators import graph

    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(5)], "src long, dst long, cost double")
    start = spark.createDataFrame([(0, 0)], "origin long, node long")
    with pytest.raises(RuntimeError):
        graph.relax(spark, edges, start, max_rounds=2)
    found = {r["node"]: (r["cost"], r["route"]) for r in graph.relax(spark, edges, start, routes=True).collect()}
    assert found[3] == (3.0, [0, 1, 2, 3])


def test_crowded_cells_keep_their_points_without_pairs(spark):
    from waymark.operators import clouds

    points = [("c", i, 0.01 * i, 0.0, 0.0) for i in range(40)] + [("c", 90, 5.0, 5.0, 5.0), ("c", 91, 1.2, 0.0, 0.0), ("c", 92, float("nan"), 0.0, 0.0)]
    cloud = spark.createDataFrame(points, "cloud string, id int, x double, y double, z double")
    kept = sorted(r["id"] for r in clouds.radius_outliers(cloud, 1.0, 3, by=["cloud"]).collect())
    want = [i for _, i, x, y, z in points if sum(j != i and (x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2 <= 1 for _, j, a, b, c in points) >= 3]
    assert kept == want


def test_prediction_rows_sum_to_one(spark):
    from waymark.operators import graph

    near = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 1, 0), (1, 0, 1), (1, 2, 1), (2, 2, 0), (2, 1, 1), (3, 3, 0)], "origin long, node long, margin int")
    rows_ = graph.place_prediction(near, 4, [0.1, 0.4, 0.3, 0.1], epsilon=0.0).collect()
    for origin in range(4):
        own = {r["node"]: r["p"] for r in rows_ if r["origin"] == origin}
        named = [n for n in own if n >= 0]
        assert sum(own[n] for n in named) + own[-1] + own[-2] * (4 - len(named)) == pytest.approx(1)
    prior = spark.createDataFrame([(i, 0.25) for i in range(4)], "node long, p double")
    moved = graph.predicted(graph.place_prediction(near, 4, [0.1, 0.4, 0.3, 0.1], epsilon=0.0), prior)
    assert sum(r["p"] for r in moved.collect()) == pytest.approx(0.9)


def test_damaged_matrix_blobs_are_not_read():
    from waymark.sources import containers

    blob = containers.pack_matrix([1, 2, 3, 4, 5, 6], 2, 5)
    assert containers.unpack_matrix(blob)[:2] == (2, 3) and containers.unpack_matrix(blob)[2].tolist() == [1, 2, 3, 4, 5, 6]
    assert all(containers.unpack_matrix(b) is None for b in (None, b"", blob[:-1], blob[2:], blob[:-4] + b"\x63\0\0\0"))


def test_a_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace

    from waymark.session import shared_dir

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(cluster)
