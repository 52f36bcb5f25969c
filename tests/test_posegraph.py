"""Pose propagation and coarse-to-fine matching on planted cases and plain versions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import geometry as G
from waymark.operators import matching as M
from waymark.operators import propagation as P


def _link(i, src, dst, rank, x, y, a):
    return (i, src, dst, rank, {"x": float(x), "y": float(y), "yaw": float(a)})


LINKS = "id long, src long, dst long, rank int, t struct<x:double,y:double,yaw:double>"
START = "node long, pose struct<x:double,y:double,yaw:double>"


def _compose(a, b):
    c, s = math.cos(a[2]), math.sin(a[2])
    return (a[0] + c * b[0] - s * b[1], a[1] + s * b[0] + c * b[1], a[2] + b[2])


def _inverse(a):
    c, s = math.cos(a[2]), math.sin(a[2])
    return (-(c * a[0] + s * a[1]), s * a[0] - c * a[1], -a[2])


def _plain(links, start):
    """Prim's algorithm from each start in turn, smallest first."""
    unique = {}
    for i, s, d, rank, t in sorted(links, key=lambda r: r[0]):
        if s != d:
            t = tuple(t.values())
            unique.setdefault((rank, min(s, d), max(s, d)), t if s < d else _inverse(t))
    out = {}
    for root, pose in sorted(start):
        if root in out:
            continue
        seen = {root: tuple(pose.values())}
        while True:
            step = min(((w, t) for w, t in unique.items() if (w[1] in seen) != (w[2] in seen)), default=None)
            if step is None:
                break
            (_, lo, hi), t = step
            if lo in seen:
                seen[hi] = _compose(seen[lo], t)
            else:
                seen[lo] = _compose(seen[hi], _inverse(t))
        out |= {n: (root, p) for n, p in seen.items()}
    return out


def _same(got, want):
    assert {r["node"] for r in got} == set(want)
    for r in got:
        root, (x, y, a) = want[r["node"]]
        assert r["root"] == root and r["pose"]["x"] == pytest.approx(x, abs=1e-6) and r["pose"]["y"] == pytest.approx(y, abs=1e-6)
        assert math.cos(r["pose"]["yaw"] - a) == pytest.approx(1, abs=1e-9)


def test_propagation_against_plain_search(spark):
    rng = np.random.default_rng(4)
    links = [_link(i, *map(int, rng.integers(-6, 60, 2)), int(rng.integers(0, 3)), *rng.normal(size=3)) for i in range(70)]
    links += [_link(100, 7, 7, 0, 1, 1, 1), _link(101, links[3][1], links[3][2], links[3][3], 9, 9, 1), _link(102, links[3][2], links[3][1], links[3][3], 9, 9, 1)]
    start = [(int(n), {"x": float(n), "y": 1.0, "yaw": 0.3}) for n in (links[0][1], links[5][2], 999)]
    start = list(dict(start).items())
    _same(P.propagate(spark, spark.createDataFrame(links, LINKS), spark.createDataFrame(start, START)).collect(), _plain(links, start))


def test_propagation_of_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, written = 10_000, []
    order = np.random.default_rng(1).permutation(n).tolist()
    links = [_link(i, order[i], order[i + 1], 0, 1, 0.001 * (i % 7), 0.0005) for i in range(n - 1)]
    keep = P.materialize
    monkeypatch.setattr(P, "materialize", lambda spark, df, name, **k: written.append(name) or keep(spark, df, name, **k))
    got = P.propagate(spark, spark.createDataFrame(links, LINKS), spark.createDataFrame([(order[0], {"x": 0.0, "y": 0.0, "yaw": 0.0})], START)).collect()
    pose, want = (0.0, 0.0, 0.0), {order[0]: (order[0], (0.0, 0.0, 0.0))}
    for link in links:
        pose = _compose(pose, tuple(link[4].values()))
        want[link[2]] = (order[0], pose)
    _same(got, want)
    assert len(written) < 6 * math.log2(n)


def test_propagation_in_space(spark):
    """The same algorithm over poses of three dimensions."""
    turn = [math.cos(0.5), -math.sin(0.5), 0.0, 1.0, math.sin(0.5), math.cos(0.5), 0.0, 2.0, 0.0, 0.0, 1.0, 3.0]
    links = spark.createDataFrame([(1, 1, 2, 0, turn), (2, 3, 2, 1, turn)], "id long, src long, dst long, rank int, t array<double>")
    unit = F.array(*(F.lit(float(v)) for v in (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0)))
    start = spark.createDataFrame([(1, turn)], "node long, pose array<double>")
    got = {r["node"]: np.array(r["pose"]).reshape(3, 4) for r in P.propagate(spark, links, start, compose=G.compose3, inverse=G.inverse3, unit=unit).collect()}
    t = np.vstack([np.array(turn).reshape(3, 4), [0, 0, 0, 1]])
    assert np.allclose(got[2], (t @ t)[:3]) and np.allclose(got[3], t[:3])


def test_empty_graphs(spark):
    none = spark.createDataFrame([], LINKS)
    assert P.propagate(spark, none, spark.createDataFrame([], START)).count() == 0
    (one,) = P.propagate(spark, none, spark.createDataFrame([(5, {"x": 1.0, "y": 2.0, "yaw": 0.0})], START)).collect()
    assert (one["node"], one["root"], one["pose"]["x"]) == (5, 5, 1.0)


def _shelves(rng) -> np.ndarray:
    out = []
    for k in range(12):
        x, y, w = 2.7 * (k % 4) + rng.uniform(0, 0.5), 2.9 * (k // 4) + rng.uniform(0, 0.5), rng.uniform(0.8, 1.8)
        t = np.arange(0, w, 0.08)
        out += [np.stack([x + t, np.full(len(t), y)], 1), np.stack([np.full(9, x), y + np.arange(9) * 0.08], 1)]
    return np.concatenate(out)


def test_planted_placements_are_recovered(spark):
    """Noise and a fifth of foreign points, as in the published run: accepted placements come nearer to the truth."""
    rng = np.random.default_rng(24)
    walls = _shelves(rng)
    scans, truth = [], {}
    for k in range(12):
        true = (rng.uniform(3, 7), rng.uniform(2, 6), rng.uniform(-3, 3))
        c, s = math.cos(true[2]), math.sin(true[2])
        d = walls[np.hypot(*(walls - true[:2]).T) <= 6.0] - true[:2]
        seen = np.stack([c * d[:, 0] + s * d[:, 1], c * d[:, 1] - s * d[:, 0]], 1) + rng.normal(0, 0.015, d.shape)
        seen = np.concatenate([seen, rng.uniform(-4, 4, (len(seen) // 5, 2))])
        truth[k] = true
        start = (true[0] + rng.uniform(-0.2, 0.2), true[1] + rng.uniform(-0.2, 0.2), true[2] + rng.uniform(-0.05, 0.05))
        scans.append((k, "a", *map(float, start), [{"x": float(p[0]), "y": float(p[1])} for p in seen]))
    scans += [(100, "a", 5.0, 4.0, 0.0, None), (101, "a", 5.0, 4.0, 0.0, [{"x": 1e7, "y": 0.0}] * 40), (102, "none", 5.0, 4.0, 0.0, scans[0][5])]
    df = spark.createDataFrame(scans, "scan int, floor string, x double, y double, yaw double, points array<struct<x:double,y:double>>")
    size = (0.4, 0.2, 0.1)
    map_ = spark.createDataFrame([("a", float(x), float(y)) for x, y in walls], "floor string, x double, y double")
    tiles = M.field_tiles(M.field_pyramid(spark, map_, size, by=["floor"]), by=["floor"])
    got = {r["scan"]: r for r in M.match_scans(df, tiles, size, key="scan", by=["floor"]).collect()}
    good = [k for k in truth if got[k]["accepted"]]
    assert len(good) >= 9
    error = [math.hypot(got[k]["x"] - truth[k][0], got[k]["y"] - truth[k][1]) for k in good]
    assert max(error) < 0.18 and np.median(error) < 0.06
    assert got[100]["reason"] == "insufficient_structure_points" and got[101]["reason"] == got[102]["reason"] == "map_mismatch" and not got[102]["accepted"]


def test_even_walls_are_ambiguous():
    """A straight wall fits as well when shifted along itself."""
    wall = np.stack([np.arange(-60, 60) * 0.1, np.zeros(120)], 1)
    cells: dict = {}
    for x, y in ((v * 0.05, 0.0) for v in range(-400, 400)):
        for a in range(-5, 6):
            ix, iy = math.floor(x / 0.1), math.floor(y / 0.1) + a
            cells.setdefault((ix // 64, iy // 64), {})[ix % 64 * 64 + iy % 64] = abs(a) * 10
    field = M.Field(0.1, [(*k, np.array(list(v)), np.array(list(v.values()))) for k, v in cells.items()], 45)
    got = M.match_scan((0.05, 0.1, 0.0), wall, [field] * 3)
    assert got["reason"] == "ambiguous_structure_match" and not got["accepted"] and abs(got["y"]) < 0.1


def test_independent_placements_keep_their_distance():
    rng = np.random.default_rng(3)
    places, cost = np.stack([rng.uniform(0, 1, 300), rng.uniform(0, 1, 300), rng.uniform(-3, 3, 300)], 1), rng.integers(0, 50, 300)
    kept = M.independent(cost, places, 300, 0.25)
    want: list[int] = []
    for i in sorted(range(300), key=lambda i: (cost[i], *places[i])):
        if all(math.hypot(*(places[i, :2] - places[j, :2])) >= 0.25 or abs(math.remainder(places[i, 2] - places[j, 2], 2 * math.pi)) >= math.radians(4) for j in want):
            want.append(i)
    assert kept.tolist() == want


def _candidates(rows):
    return [(k, i, float(x), float(y), float(a), 1.0 + i % 3, float(rx), 0.0) for k, i, x, y, a, rx in rows]


GAUGE = "g string, id long, x double, y double, yaw double, weight double, raw_x double, raw_y double"


def test_gauge_gates_and_consensus(spark):
    from waymark.operators import gauge as Q

    rng = np.random.default_rng(8)
    near = lambda k, x, n, at=0: [(k, at + i, x + rng.normal(0, 0.05), 1 + rng.normal(0, 0.05), math.pi - 0.02 + 0.04 * (i % 2), i) for i in range(n)]
    rows = _candidates([
        *near("good", 3.0, 400), *((("good"), 1000 + i, rng.uniform(-50, 50), rng.uniform(-50, 50), 0.0, i) for i in range(100)),
        *near("split", 0.0, 30), *near("split", 9.0, 28, 100), *near("one", 0.0, 1), ("close", 1, 0, 0, 0, 0), ("close", 2, 0, 0, 0, 1), ("apart", 1, 0, 0, 0, 0), ("apart", 2, 0, 0, 0, 9),
        *near("low", 1.0, 30), *(("low", 500 + i, rng.uniform(-500, 500), rng.uniform(-500, 500), 0.0, i) for i in range(45)),
    ])
    got = {r["g"]: r for r in Q.robust_gauge(spark.createDataFrame(rows, GAUGE).repartition(4), by=["g"]).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {"good": None, "split": "ambiguous_clusters", "one": "insufficient_candidates", "close": "trajectory_span_too_small", "apart": "insufficient_consensus", "low": "low_consensus_ratio"}
    good = got["good"]
    assert good["inliers"] == 400 and good["x"] == pytest.approx(3.0, abs=0.02) and good["y"] == pytest.approx(1.0, abs=0.02) and math.cos(good["yaw"] - math.pi) > 0.9999
    assert all(got[k]["x"] is None for k in got if k != "good")
    kept = [r for r in rows if r[0] == "good" and r[1] < 1000]
    mean = [sum(r[5] * f(r) for r in kept) / sum(r[5] for r in kept) for f in (lambda r: r[2], lambda r: r[3])]
    for _ in range(4):
        turn = math.atan2(sum(r[5] * math.sin(r[4]) for r in kept), sum(r[5] * math.cos(r[4]) for r in kept))
        w = [r[5] * min(1, 2 / max(1e-12, math.hypot(r[2] - mean[0], r[3] - mean[1]) / 0.5 + abs(math.remainder(r[4] - turn, 2 * math.pi)) / 0.2)) for r in kept]
        mean = [sum(a * r[j] for a, r in zip(w, kept, strict=True)) / sum(w) for j in (2, 3)]
    assert (good["x"], good["y"]) == pytest.approx(mean, abs=1e-6)
    assert Q.robust_gauge(spark.createDataFrame([], GAUGE), by=["g"]).count() == 0
