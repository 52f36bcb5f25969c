"""The pipeline's stages against plain versions of their decisions."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline as P

SMALL = "/root/testdata/sf0.001"


def _keyed(df) -> dict:
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").cache()
    before = _keyed(docs)

    good = P.quality(spark, docs, SMALL)
    assert good.columns == docs.columns
    kept = _keyed(good)
    assert all(kept[i] == before[i] for i in kept)
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SMALL}/labels.parquet").to_pylist()}
    right = [(i in kept) == bool(q) for i, q in labels.items() if i in before]
    assert np.mean(right) > 0.9

    lines = P.line_dedup(spark, docs, SMALL)
    assert lines.columns == docs.columns
    holders = defaultdict(set)
    key = lambda x: x.strip(b" \t\n\x0b\x0c\r").lower()
    for i, r in before.items():
        for x in (r["text"] or "").encode().split(b"\n"):
            holders[key(x)].add(i)
    for i, r in _keyed(lines).items():
        want = b"\n".join(x for x in (before[i]["text"] or "").encode().split(b"\n") if not key(x) or len(holders[key(x)]) < 10)
        assert r["text"].encode() == want and r["n_chars"] == len(r["text"])

    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(r["text"] or "") for i, r in before.items()}
    parent = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and parent[i] != parent[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                lo, hi = sorted((parent[i], parent[j]))
                parent = {k: lo if v == hi else v for k, v in parent.items()}
    assert set(_keyed(P.near_dedup(spark, docs, SMALL))) == {i for i, v in parent.items() if i == v}

    ok = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    words = lambda t: bytes(c if c in ok else 0x20 for c in t.encode().lower()).split()
    windows = set()
    for r in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist():
        w = words(r["text"])
        windows |= {tuple(w[s : s + min(10, len(w))]) for s in range(max(1, len(w) - 9))}
    clean = {i for i, r in before.items() if not any(tuple(w[s : s + 10]) in windows for w in [words(r["text"] or "")] for s in range(len(w)))}
    assert set(_keyed(P.decontamination(spark, docs, SMALL))) == clean


def test_run_packs_what_the_stages_keep(spark):
    rows = P.run(spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    total = defaultdict(int)
    for r in rows:
        total[r["doc_id"]] += r["length"]
        assert len(r["ids"]) == 4 * r["length"]
    assert all(total[r["doc_id"]] == r["doc_tokens"] for r in rows)


@pytest.fixture(scope="module")
def odd(tmp_path_factory) -> str:
    """Documents with null keys and texts, repeated rows, a very long text and columns named like those of the operators."""
    d = tmp_path_factory.mktemp("odd")
    words = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    texts = [words("a", 80), words("a", 80), words("a", 80), None, "", "one two", words("long", 60_000), "common line\n" + words("b", 60), *(f"common line\nown {i}" for i in range(11)), "x q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 y"]
    ids = [1, 1, 2, 3, None, None, 6, 7, *range(20, 31), 40]
    n = len(texts)
    extra = {c: pa.array([f"{c}{i}" for i in range(n)]) for c in ("score", "kept", "doc", "key", "h1", "n_hit", "component_id", "c0")}
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts), "lang": pa.array([None] * n, pa.string()), "source": pa.array(["s"] * n), "n_chars": pa.array([len(t or "") for t in texts], pa.int64()), **extra}), d / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([1, 2, 6, 7, None], pa.int64()), "quality": pa.array([1, 1, 0, None, 1], pa.int32()), "toxic": pa.array([0] * 5, pa.int32())}), d / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1, None], pa.int64()), "text": pa.array(["q1 q2 q3 q4 q5 q6 q7 q8 q9 q10", None])}), d / "benchmark.parquet")
    return str(d)


def test_stages_take_odd_tables(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    rows = lambda df: sorted((str((r["doc_id"], r["text"], r["score"], r["c0"])) for r in df.collect()))
    everything = rows(docs)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, odd)
        assert out.columns == docs.columns, name
        if name != "line_dedup":
            assert set(rows(out)) <= set(everything), name
    lines = {r["c0"]: r for r in P.line_dedup(spark, docs, odd).collect()}
    assert len(lines) == docs.count() and all("common" not in (r["text"] or "") and r["n_chars"] == len(r["text"]) for r in lines.values())
    kept = [r["doc_id"] for r in P.near_dedup(spark, docs, odd).collect()]
    assert 2 not in kept and kept.count(1) == 2 and kept.count(None) == 2 and {3, 6, 7, 40} <= set(kept)
    clean = [r["doc_id"] for r in P.decontamination(spark, docs, odd).collect()]
    assert len(clean) == docs.count() - 1 and 40 not in clean
    packed = P.packing(spark, docs, odd).collect()
    assert sum(r["start"] == 0 for r in packed) == docs.count()


def test_stages_take_empty_tables(spark, odd, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        pq.write_table(pq.read_table(f"{odd}/{name}.parquet").slice(0, 0), tmp_path / f"{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name
    assert P.run(spark, str(tmp_path)).count() == 0
