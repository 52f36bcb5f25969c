"""Periodic runs against a plain search over all periods."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from waymark.llm import periods as P

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_runs(words: list, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period): islands of equality with the word q further on, each stretch with its smallest q."""
    best: dict = {}
    for q in range(1, len(words) // 2 + 1):
        at = 0
        while at + q < len(words):
            end = at
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end > at and end + q - at >= max(least, 2 * q):
                best.setdefault((at, end + q - at), q)
            at = max(end, at + 1) if end > at else at + 1
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text) -> tuple:
    words = WORD.findall((text or "").encode())
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
    return (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, digest, hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def _numbers(docs: list[list]) -> tuple[np.ndarray, np.ndarray]:
    known: dict = {}
    return np.array([known.setdefault(w, len(known)) for d in docs for w in d], np.int64), np.array([len(d) for d in docs])


@pytest.mark.parametrize("least", [2, 5, 12])
@pytest.mark.parametrize("grid", [3, 1 << 20])
def test_runs_of_random_words(monkeypatch, least, grid):
    monkeypatch.setattr(P, "GRID", grid)
    rng = np.random.default_rng(least)
    docs = [list(map(int, rng.integers(0, k, n))) for k in (1, 2, 3, 5) for n in (0, 1, 2, 3, 11, 12, 13, 40, 90)]
    for _ in range(30):  # periodic stretches with a few changed words, beside and inside each other
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            cycle = list(map(int, rng.integers(0, 4, int(rng.integers(1, 9)))))
            parts += (cycle * 12)[: int(rng.integers(1, 60))] * int(rng.integers(1, 3))
        if len(parts) > 20:
            parts[int(rng.integers(0, len(parts)))] = 9
        docs.append(parts)
    words, count = _numbers(docs)
    got = [tuple(map(int, r)) for r in zip(*P.find_runs(words, count, least), strict=True)]
    assert got == [(d, *r) for d, w in enumerate(docs) for r in plain_runs(w, least)]


def test_fibonacci_word_and_one_long_cycle():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    cycle = list(range(3000))
    docs = [b, cycle * 2, cycle + cycle[:-1], ["z"] * 5000]
    words, count = _numbers(docs)
    got = [tuple(map(int, r)) for r in zip(*P.find_runs(words, count), strict=True)]
    assert [r for r in got if r[0] == 0] == [(0, *r) for r in plain_runs(b)]
    assert [r for r in got if r[0]] == [(1, 0, 6000, 3000), (3, 0, 5000, 1)]


def test_query_against_plain_search(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    small = [r for r in t if len(r["text"] or "") < 20_000]
    got = {r["doc_id"]: tuple(r) for r in P.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(t) and sum(r[1] > 0 for r in got.values()) >= 10
    for r in small:
        assert got[r["doc_id"]] == plain_row(r["doc_id"], r["text"])


def test_edge_cases(spark, tmp_path):
    texts = [None, "", " \t\n", "a", "x " * 30, "\nx " * 30 + "é", "a b c " * 5 + "d " + "a b c " * 5, "Ü\x1cy " * 12, "no run here at all", *[f"w{i} " * (i % 20) for i in range(60)]]
    ids = [*range(len(texts) - 1), None]
    table = pa.table({"doc_id": pa.array([*ids, 4, None], pa.int64()), "text": [*texts, texts[4], texts[5]], **{k: ["s"] * (len(texts) + 2) for k in ("words", "g", "p", "a", "runs", "n_words", "top")}})
    pq.write_table(table, tmp_path / "documents.parquet")
    got = [tuple(r) for r in P.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((plain_row(i, t) for i, t in zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True)), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in ids if i is not None and i < 9)


def test_operator_gives_runs_and_text(spark):
    docs = spark.createDataFrame([(1, "start " + "a  b " * 8 + "end"), (2, None)], "k long, body string")
    one, two = P.collapse_runs(spark, docs, key="k", text="body").orderBy("k").collect()
    assert one["runs"] == [(1, 16, 2)] and one["collapsed_text"] == "start a b end" and one["n_words"] == 18
    assert (two["n_words"], two["runs"], two["collapsed_text"]) == (0, [], "")
