"""Order-dependent operators as grouped Arrow functions.

Each works on one key at a time in an explicit order; the key bounds the group (one trajectory, one barcode, one image),
so choose it such that a group fits in a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _grouped(df: DataFrame, by: list[str], order: list[str], columns: list[str], flag, schema_tail: str) -> DataFrame:
    """Run ``flag(columns as arrays) -> dict of new columns`` on each group in order, and append the result."""
    kinds = dict(df.dtypes)
    names = list(dict.fromkeys([*by, *order, *columns]))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(o, "ascending") for o in order])
        arrays = [table.column(c).to_numpy(zero_copy_only=False) for c in columns]
        out = table.select(names)
        for name, values in flag(*arrays).items():
            out = out.append_column(name, pa.array(values))
        return out

    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", " + schema_tail
    return df.select(*names).groupBy(*by).applyInArrow(run, schema)


def radius_poses(df: DataFrame, *, by: list[str], order: list[str], axes: list[str], radius: float) -> DataFrame:
    """Keep a pose if it lies outside the radius of all kept ones; the first and last stay, and two or fewer are untouched."""

    def flag(*xs):
        p = np.stack([x.astype(float) for x in xs], 1)
        keep = np.zeros(len(p), bool)
        if len(p) <= 2:
            return {"kept": np.ones(len(p), bool)}
        cells: dict[tuple, list[int]] = {}
        for i, q in enumerate(p):
            c = tuple(np.floor(q / radius).astype(int))
            near = (j for d in np.ndindex(*(3,) * len(c)) for j in cells.get(tuple(a + b - 1 for a, b in zip(c, d, strict=True)), ()))
            if all(((p[j] - q) ** 2).sum() > radius * radius for j in near):
                keep[i] = True
                cells.setdefault(c, []).append(i)
        keep[0] = keep[-1] = True
        return {"kept": keep}

    return _grouped(df, by, order, axes, flag, "kept boolean").filter("kept").drop("kept")


def seed_clusters(df: DataFrame, *, by: list[str], order: list[str], axes: list[str], radius: float) -> DataFrame:
    """Cluster number of each row: the nearest seed within the radius, else a seed of its own; seeds do not move or chain."""

    def flag(*xs):
        p = np.stack([x.astype(float) for x in xs], 1)
        label, seeds = np.zeros(len(p), np.int32), []
        cells: dict[tuple, list[int]] = {}
        for i, q in enumerate(p):
            c = tuple(np.floor(q / radius).astype(int))
            near = [s for d in np.ndindex(*(3,) * len(c)) for s in cells.get(tuple(a + b - 1 for a, b in zip(c, d, strict=True)), ())]
            found = min(((((seeds[s] - q) ** 2).sum(), s) for s in near), default=(np.inf, -1))
            if found[0] <= radius * radius:
                label[i] = found[1]
            else:
                label[i] = len(seeds)
                cells.setdefault(c, []).append(len(seeds))
                seeds.append(q)
        return {"cluster": label}

    return _grouped(df, by, order, axes, flag, "cluster int")


def since_last_kept(df: DataFrame, *, by: list[str], order: list[str], value: str, limit: float) -> DataFrame:
    """Admission by rate: a row is kept if its value is at least ``limit`` above the last kept one's, or below it."""

    def flag(v):
        keep, last = np.zeros(len(v), bool), None
        for i, x in enumerate(v.astype(float)):
            if last is None or not 0 < x - last < limit:
                keep[i], last = True, x
        return {"kept": keep}

    return _grouped(df, by, order, [value], flag, "kept boolean").filter("kept").drop("kept")


def diverse_best(df: DataFrame, *, by: list[str], cost: str, key: str, axes: list[str], separation: float, limit: int) -> DataFrame:
    """Rows in order of cost, each accepted if it is far enough from all accepted ones, up to ``limit``; also non-maximum suppression."""

    def flag(_c, *xs):
        p = np.stack([x.astype(float) for x in xs], 1)
        keep, taken = np.zeros(len(p), bool), []
        for i, q in enumerate(p):
            if len(taken) < limit and all(((q - t) ** 2).sum() >= separation * separation for t in taken):
                keep[i] = True
                taken.append(q)
        return {"kept": keep}

    return _grouped(df, by, [cost, key], [cost, *axes], flag, "kept boolean").filter("kept").drop("kept")


def pair_greedily(pairs: DataFrame, *, by: list[str], a: str, b: str, distance: str, limit: float) -> DataFrame:
    """One-to-one pairs by rising distance up to the limit; used ends are skipped, ties by ids."""

    def flag(d, left, right):
        keep, used_a, used_b = np.zeros(len(d), bool), set(), set()
        for i, (x, u, v) in enumerate(zip(d, left, right, strict=True)):
            if x <= limit and u not in used_a and v not in used_b:
                keep[i] = True
                used_a.add(u)
                used_b.add(v)
        return {"kept": keep}

    return _grouped(pairs, by, [distance, a, b], [distance, a, b], flag, "kept boolean").filter("kept").drop("kept")


def bayes_chain(df: DataFrame, *, by: list[str], step: str, node: str, likelihood: str, stay: float = 0.6) -> DataFrame:
    """Recursive Bayes over the nodes of a key: predict (stay, or move to the neighbours in id order), multiply, normalise.

    Rows are (by..., step, node, likelihood), every step having every node of the key.
    """
    kinds = dict(df.dtypes)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(step, "ascending"), (node, "ascending")])
        steps, nodes = np.unique(table.column(step).to_numpy()), np.unique(table.column(node).to_numpy())
        n = len(nodes)
        like = table.column(likelihood).to_numpy().astype(float).reshape(len(steps), n)
        out, p = np.empty_like(like), np.full(n, 1 / n)
        for i, row in enumerate(like):
            move = (1 - stay) / 2
            q = stay * p + move * np.concatenate([[p[0]], p[:-1]]) + move * np.concatenate([p[1:], [p[-1]]])
            p = row * q
            p = p / p.sum() if p.sum() > 0 else np.full(n, 1 / n)
            out[i] = p
        return table.select([*by, step, node]).append_column("posterior", pa.array(out.ravel()))

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, step, node]) + ", posterior double"
    return df.select(*by, step, node, likelihood).groupBy(*by).applyInArrow(run, schema)


def smooth_corrections(df: DataFrame, *, by: list[str], order: list[str], target: str, weight: str, smoothness: float = 24.0, huber: float = 1.0, rounds: int = 8, sweeps: int = 120) -> DataFrame:
    """A bounded correction field: soft targets (null: none) are met as far as neighbouring corrections stay alike.

    Each outer round reweights the targets by Huber and solves the tridiagonal system exactly.
    """

    def flag(t, w):
        t, w = t.astype(float), w.astype(float)
        n = len(t)
        has = np.isfinite(t) & np.isfinite(w) & (w > 0)
        x = np.zeros(n)
        for _ in range(rounds):
            r = np.abs(np.where(has, t - x, 0))
            ww = np.where(has, w * np.where(r <= huber, 1.0, huber / np.maximum(r, 1e-12)), 0.0)
            diag = ww + smoothness * ((np.arange(n) > 0).astype(float) + (np.arange(n) < n - 1)) + 1e-9
            rhs = ww * np.where(has, t, 0)
            c, d = np.zeros(n), np.zeros(n)
            for i in range(n):  # Thomas algorithm, off-diagonals -smoothness
                m = diag[i] + (smoothness * c[i - 1] if i else 0.0)
                c[i] = -smoothness / m if i < n - 1 else 0.0
                d[i] = (rhs[i] + (smoothness * d[i - 1] if i else 0.0)) / m
            new = np.zeros(n)
            for i in range(n - 1, -1, -1):
                new[i] = d[i] - (c[i] * new[i + 1] if i < n - 1 else 0.0)
            if np.abs(new - x).max(initial=0) < 1e-9:
                x = new
                break
            x = new
        return {"correction": x}

    return _grouped(df, by, order, [target, weight], flag, "correction double")


def localisation_states(df: DataFrame, *, by: list[str], order: list[str], time: str) -> DataFrame:
    """(by..., order, applied, trusted, rejected, state): a localiser's state after each frame, with two-frame gating and hysteresis.

    A frame has normal, accepted, cx, cy, cyaw (the proposed correction; cx null without one), points and uniqueness. A correction is
    applied from the second consecutive frame on that proposes nearly the same one. Trust ages: after 4 s without an applied
    correction, or three frames, the state is weak, after 10 s lost; three applied ones in a row on enough structure make it
    stable.
    """

    def flag(t, normal, accepted, cx, cy, cyaw, points, uniqueness):
        n = len(t)
        has = normal.astype(bool) & np.isfinite(cx.astype(float))
        c = np.stack([cx.astype(float), cy.astype(float), cyaw.astype(float)], 1)
        step = np.diff(c, axis=0, prepend=c[:1])
        turn = np.abs(np.pi - (np.pi - step[:, 2]) % (2 * np.pi))
        near = (np.hypot(step[:, 0], step[:, 1]) <= 0.12) & (turn <= np.radians(3))
        near[1:] &= has[1:] & has[:-1]
        near[:1] = False
        applied, trusts, rejects, states = np.zeros(n, bool), np.zeros(n, np.int32), np.zeros(n, np.int32), []
        run = trusted = rejected = 0
        last = None
        for i in range(n):
            run = (run + 1 if near[i] else 1) if has[i] else 0
            applied[i] = has[i] and bool(accepted[i]) and run >= 2
            trusted, rejected = (trusted + 1, 0) if applied[i] else (0, rejected + 1)
            if applied[i]:
                last = t[i]
            trusts[i], rejects[i] = trusted, rejected
            stale = np.inf if last is None else t[i] - last
            if not normal[i]:
                states.append("lost")
            elif last is None:
                states.append("weak" if rejected >= 3 else "initializing")
            elif stale > 10:
                states.append("lost")
            elif stale > 4 or rejected >= 3:
                states.append("weak")
            else:
                states.append("stable" if applied[i] and trusted >= 3 and points[i] >= 80 and uniqueness[i] >= 0.22 else "usable")
        return {"applied": applied, "trusted": trusts, "rejected": rejects, "state": states}

    out = _grouped(df, by, order, [time, "normal", "accepted", "cx", "cy", "cyaw", "points", "uniqueness"], flag, "applied boolean, trusted int, rejected int, state string")
    return out.select(*dict.fromkeys([*by, *order]), "applied", "trusted", "rejected", "state")


def skeleton(df: DataFrame, *, by: list[str], order: list[str], x: str, y: str, time: str, must: str, straight: float = 0.75, tight: float = 0.3, angle: float = 4.0, seconds: float = 2.0, turn: float = 20.0, still: float = 0.05) -> DataFrame:
    """Rows of each trajectory that its pose graph is optimised on: both ends, rows that ``must`` stay, turns, and enough between them.

    A row between is kept when it is ``straight`` away from the last kept one (``tight`` in a turn), when the heading changed by
    ``angle`` degrees since, or after ``seconds``. Headings are taken from moves of at least ``still``, as shorter ones are noise.
    """

    def wrapped(a):
        return np.abs(np.pi - (np.pi - a) % (2 * np.pi))

    def flag(xs, ys, t, fixed):
        xs, ys, t = xs.astype(float), ys.astype(float), t.astype(float)
        n = len(xs)
        keep = fixed.astype(bool).copy()
        keep[[0, -1]] = True
        dx, dy = np.diff(xs), np.diff(ys)
        far, heading = np.hypot(dx, dy) >= still, np.arctan2(dy, dx)
        keep[1:-1] |= far[:-1] & far[1:] & (wrapped(heading[1:] - heading[:-1]) >= np.radians(turn))
        anchor = 0
        for i in range(1, n):
            if not keep[i]:
                distance = np.hypot(xs[i] - xs[anchor], ys[i] - ys[anchor])
                change = 0.0
                if distance >= still and far[i - 1]:
                    change = wrapped(heading[i - 1] - np.arctan2(ys[i - 1] - ys[anchor], xs[i - 1] - xs[anchor]))
                limit = tight if change >= np.radians(turn) / 2 else straight
                keep[i] = distance >= limit or change >= np.radians(angle) or t[i] - t[anchor] >= seconds
            if keep[i]:
                anchor = i
        return {"kept": keep}

    return _grouped(df, by, order, [x, y, time, must], flag, "kept boolean").filter("kept").drop("kept")
