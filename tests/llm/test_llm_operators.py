"""The corpus operators against plain versions, on tables full of edge cases, and on held-out labels."""

from __future__ import annotations

import base64
import hashlib
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from parity import assert_same  # noqa: E402

from waymark.llm import registry  # noqa: E402

SMALL = "/root/testdata/sf0.001"
SPACE = b" \t\n\x0b\x0c\r"


def _words(prefix: str, n: int, at: int = 0) -> str:
    return " ".join(f"{prefix}{i}" for i in range(at, at + n))


def _texts() -> list[str | None]:
    base = _words("w", 300)
    near = base.split()
    near[150] = "changed"
    long = " ".join(_words(f"q{j}x", 997) for j in range(30))
    shared = _words("common", 60)
    return [
        base, base, " ".join(near), None, "", "   \n\t ", "one two three", "ONE two  three", "one two three", "x",
        "header line\n" + _words("a", 70) + "\nHEADER LINE  ", "header line\n" + shared + "\n" + _words("b", 80), _words("c", 30) + "\n" + shared + " tail",
        long, long + " more", "same " * 400, "same " * 401, "Ünïcode ÉTÉ straße joined " + _words("u", 60), " line\x1cseparators\x85kept " + _words("v", 60),
        "the quick brown fox jumps over the lazy dog again and again until it is tired", "prefix the quick brown fox jumps over the lazy dog again suffix", "it's <|endoftext|> 12,5%!! don't",
        *(f"header line\nfooter\n\n{_words(f'd{i}_', 55)}" for i in range(12)),
    ]


@pytest.fixture(scope="module")
def edge(tmp_path_factory) -> str:
    """Edge-case tables: nulls in any column, repeated rows, clashing column names."""
    d = tmp_path_factory.mktemp("edge")
    texts = _texts()
    ids: list[int | None] = list(range(100, 100 + len(texts)))
    texts, ids = [*texts, texts[0], texts[2]], [*ids, 100, 102]  # repeated rows
    n = len(texts)
    extra = {k: pa.array([f"{k}{i}" for i in range(n)]) for k in ("score", "held_out", "rank", "key", "grp", "doc", "id", "n_words", "kept", "runs", "w")}
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(["en" if i % 3 else None for i in range(n)]), "source": pa.array([None if i % 5 == 0 else "s" for i in range(n)]), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64()), **extra}), d / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([*ids, None], pa.int64()), "quality": pa.array([*(None if i % 7 == 0 else i % 2 for i in range(n)), 1], pa.int32()), "toxic": pa.array([*(None if i % 6 == 0 else int(i % 4 == 0) for i in range(n)), 0], pa.int32())}), d / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1, 2, 3, 10, 10, None], pa.int64()), "text": pa.array(["The quick brown fox jumps over the lazy dog AGAIN and again", "one two three", None, "", "w10 w11 w12 w13 w14 w15 w16 w17 w18 w19 w20", "zz"], pa.string()), "doc": pa.array(["x"] * 6)}), d / "benchmark.parquet")
    pages = ["<p>a</p>", "<p>a</p>", None, "", "é" * 200_000, "é" * 200_000, "x" * 700_001, "<p>b</p>"]
    pq.write_table(pa.table({"page_id": pa.array([5, 3, 8, 9, 20, 21, 30, 2**40], pa.int64()), "url": pa.array([None, "http://a b", "u\r\nX: y", *["http://x"] * 5]), "html": pa.array(pages, pa.string()), "sha1": pa.array(["z"] * 8)}), d / "pages.parquet")
    rng = np.random.default_rng(3)
    vectors: list = [list(map(float, rng.normal(size=8))) for _ in range(60)]
    vectors[5], vectors[7], vectors[9], vectors[11], vectors[13] = None, [0.0] * 8, [float("nan")] + [1.0] * 7, [1.0] * 3, [None] + [1.0] * 7
    vectors[20] = vectors[21] = vectors[22] = vectors[40]
    pq.write_table(pa.table({"vec_id": pa.array(range(60), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([None] * 60, pa.int32()), "score": pa.array(["s"] * 60)}), d / "embeddings.parquet")
    return str(d)


@pytest.fixture(scope="module")
def empty(edge, tmp_path_factory) -> str:
    d = tmp_path_factory.mktemp("empty")
    for p in Path(edge).glob("*.parquet"):
        pq.write_table(pq.read_table(p).slice(0, 0), d / p.name)
    return str(d)


def _docs(d: str) -> list[tuple[int, str | None]]:
    t = pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


def _rows(spark, name: str, d: str) -> list[dict]:
    return [r.asDict() for r in registry.QUERIES[name](spark, d).collect()]


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables_give_empty_results(spark, empty, name):
    assert _rows(spark, name, empty) == []


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert_same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], SMALL)


def test_language_of_edge_cases(spark, edge):
    rows = _rows(spark, "op1_language_id", edge)
    texts = _docs(edge)
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in texts)
    for r in rows:
        text = next(t for i, t in texts if i == r["doc_id"])
        letters = bool(text) and any(c.isalpha() for c in text)
        assert (r["lang_pred"] == "und") == (not letters)
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_language_held_out(spark):
    rows = {r["doc_id"]: r for r in _rows(spark, "op1_language_id", "/root/testdata/sf0.01")}
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "lang"]).to_pylist()
    held = [rows[x["doc_id"]]["lang_pred"] == x["lang"] for x in t if rows[x["doc_id"]]["held_out"]]
    assert np.mean(held) > 0.97


@pytest.mark.parametrize(("name", "label"), [("op2_quality", "quality"), ("op9_toxicity", "toxic")])
def test_labels_held_out(spark, name, label):
    rows = {r["doc_id"]: r for r in _rows(spark, name, "/root/testdata/sf0.01")}
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())
    t = pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()
    held = [rows[x["doc_id"]]["predicted"] == x[label] for x in t if rows[x["doc_id"]]["held_out"]]
    assert np.mean(held) > 0.93


@pytest.mark.parametrize("name", ["op2_quality", "op9_toxicity"])
def test_classifiers_take_edge_cases(spark, edge, name):
    rows = _rows(spark, name, edge)
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in _docs(edge))
    same = defaultdict(set)
    for r in rows:
        same[r["doc_id"]].add(r["score"])
    assert all(len(s) == 1 for s in same.values())


def test_severity_of_binary_labels_is_their_probability(spark):
    for r in _rows(spark, "op9_toxicity", SMALL):
        assert r["expected_severity"] == r["score"] and r["severity"] == r["predicted"]


def test_severity_of_four_grades(spark):
    """Grades as labels give them: more bad words, a higher grade; held-out texts come out in order."""
    from waymark.llm.toxicity import severity, train

    rng = np.random.default_rng(8)
    texts, grades = [], []
    for i in range(900):
        g = int(rng.integers(0, 4))
        bad = [f"bad{x}" for x in rng.choice(6, g, replace=False)]
        texts.append(" ".join(rng.permutation([*bad, *(f"plain{x}" for x in rng.integers(0, 200, 20))])))
        grades.append(g)
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    labels = spark.createDataFrame([(i, g) for i, g in enumerate(grades) if i % 3] + [(0, None), (1, -5)], "key long, grade int")
    model = train(spark, docs, labels)
    assert len(model.thresholds) == 3 and np.all(np.diff(model.thresholds) > 0)
    got = {r["key"]: r for r in severity(spark, docs, model, key="key").collect()}
    held = range(0, 900, 3)
    assert all(0 <= got[i]["score"] <= got[i]["expected_severity"] <= 3 for i in held)
    means = [np.mean([got[i]["expected_severity"] for i in held if grades[i] == g]) for g in range(4)]
    assert np.all(np.diff(means) > 0.4)
    assert np.mean([got[i]["severity"] == grades[i] for i in held]) > 0.8
    with pytest.raises(ValueError, match="classes"):
        train(spark, docs, spark.range(100).selectExpr("id AS key", "cast(id AS int) AS grade"))


def test_repeated_keys_are_one_example(spark):
    """A labelled key in many rows goes to the driver once, and what goes there is bounded in bytes."""
    from waymark.llm.sampling import gather

    rows = spark.createDataFrame([(i % 7, i % 7 % 2, bytes([i % 250]) * 40) for i in range(4000)], "key long, label int, idx binary").repartition(4)
    found = gather(spark, rows, "key")
    assert len(found) == 7
    assert {(r["label"], bytes(r["idx"])) for r in found} == {(k % 2, min(bytes([i % 250]) * 40 for i in range(4000) if i % 7 == k)) for k in range(7)}
    many = spark.range(2000).selectExpr("id AS key", "1 AS label", "cast(repeat('x', 84) AS binary) AS idx")
    assert 300 < len(gather(spark, many, "key", limit=50_000)) < 700


def test_language_of_many_classes_and_repeated_keys(spark):
    """A hundred languages whose words differ, and a key that stands in a thousand rows."""
    from waymark.llm.language import identify, train

    rng = np.random.default_rng(4)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(12)] for _ in range(100)]
    rows = [(f"{g}-{i}", " ".join(rng.choice(words[g], 30)), f"l{g:02d}") for g in range(100) for i in range(8)]
    labelled = spark.createDataFrame([*rows, *[("0-0", rows[0][1], "l00")] * 1000], "key string, text string, lang string")
    model = train(spark, labelled, per_language=6)
    test = spark.createDataFrame([(g, " ".join(rng.choice(words[g], 30))) for g in range(100)], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in identify(spark, test, model).collect()}
    assert np.mean([got[g] == f"l{g:02d}" for g in range(100)]) > 0.9


def test_ordinal_gradient_matches_differences():
    """One small step of the fit lowers the plain negative log-likelihood, and many come near its least value."""
    from waymark.llm.toxicity import fit_ordinal

    rng = np.random.default_rng(3)
    x = (rng.random((300, 5)) < 0.4).astype(float)
    s = x @ np.array([2.0, 1.0, 0.0, -1.0, 0.5])
    grade = (s + rng.logistic(size=300) > 0.5).astype(int) + (s + rng.logistic(size=300) > 2).astype(int)

    def loss(w, theta):
        cut = np.concatenate([[-50], theta, [50]])
        cdf = 1 / (1 + np.exp(-(cut[None] - (x @ w)[:, None])))
        return -np.log(np.maximum(cdf[np.arange(300), grade + 1] - cdf[np.arange(300), grade], 1e-12)).mean()

    rows, cols = np.nonzero(x)
    w, theta = fit_ordinal(rows, cols, grade, 5, steps=1500, rate=0.02, sparsity=0.0, ridge=0.0)
    best = loss(w, theta)
    for d in range(7):
        for step in (-0.15, 0.15):
            v, t = w.copy(), theta.copy()
            (v if d < 5 else t)[d if d < 5 else d - 5] += step
            assert loss(v, t) > best - 1e-3


def test_line_dedup_brute_force(spark, edge):
    docs = _docs(edge)
    holders = defaultdict(set)
    key = lambda x: x.strip(SPACE).lower()  # noqa: E731  bytes fold ASCII only
    for i, t in docs:
        for x in (t or "").encode().split(b"\n"):
            if key(x):
                holders[key(x)].add(i)
    bad = {k for k, s in holders.items() if len(s) >= 10}
    assert bad
    want = []
    for i, t in docs:
        lines = (t or "").encode().split(b"\n")
        kept = [x for x in lines if key(x) not in bad]
        want.append((i, len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in _rows(spark, "op3_line_dedup", edge)]
    assert sorted(got) == sorted(want)


def test_line_index_levels(spark):
    """Nine batches against plain counts; a batch is shuffled once, and the runs it meets are neither shuffled nor sorted again."""
    from waymark.llm.lines import LineIndex
    from waymark.session import fresh_path

    rng = np.random.default_rng(5)
    index = LineIndex(spark, fresh_path(spark, "test-index"), min_documents=6, files=3)
    total: dict = defaultdict(int)
    for _ in range(9):
        batch = {int(k): int(rng.integers(1, 3)) for k in rng.choice(40, 12, replace=False)}
        known = {k for k, n in total.items() if n >= 6}
        counts = spark.createDataFrame([(k, -k, n) for k, n in batch.items()], "h1 long, h2 long, n long")
        index.add(counts)
        for k, n in batch.items():
            total[k] += n
        assert all(len(level) < 2 for level in [*index.levels, *index.closed])
        assert known <= {k for k, n in total.items() if n >= 6}
    assert any(index.closed)
    with index._in_order():
        plan = index.rest(counts)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") >= 1 and plan.count("Exchange") == 1 and plan.count("Sort [") == 1, plan
        open_ = [n for level in index.levels for n in level]
        if len(open_) > 1:
            plan = index._merge(open_)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan, plan
    assert {tuple(r) for r in index.frequent().collect()} == {(k, -k) for k, n in total.items() if n >= 6}


def test_neighbours_exact_on_few_rows(spark, edge):
    t = pq.read_table(f"{edge}/embeddings.parquet")
    vectors = {i: np.array(v, float) for i, v in zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True) if v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    got = defaultdict(list)
    for r in _rows(spark, "op4_nearest_neighbours", edge):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in vectors if i % 20 == 0}
    for q, found in got.items():
        best = sorted(((-(vectors[q] * v).sum(), i) for i, v in vectors.items() if i != q))[:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert [f[1] for f in found] == [i for _, i in best]
        assert np.allclose([f[2] for f in found], [-s for s, _ in best])


def test_neighbours_recall(spark):
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    x, ids = np.array(t["embedding"].to_pylist(), float), np.array(t["vec_id"].to_pylist())
    got = defaultdict(set)
    for r in _rows(spark, "op4_nearest_neighbours", "/root/testdata/sf0.1"):
        got[r["query_id"]].add(r["vec_id"])
    hit = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(1)
        s[i] = -np.inf
        hit.append(len(got[ids[i]] & set(ids[np.lexsort((ids, -s))[:20]].tolist())) / 20)
    assert np.mean(hit) >= 0.95


def test_packing_round_trip(spark, edge):
    import public_tokenizers
    from tokenizers import Tokenizer

    from waymark.llm.packing import pack_documents

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = defaultdict(list)
    for i, t in _docs(edge):
        want[i].append([*tok.encode(t or "", add_special_tokens=False).ids, 2])
    rows = [r.asDict() for r in pack_documents(spark, spark.read.parquet(f"{edge}/documents.parquet"), with_ids=True).collect()]
    sequences = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        assert any(w[r["start"] : r["start"] + r["length"]] == ids.tolist() and len(w) == r["doc_tokens"] for w in want[r["doc_id"]])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(len(w) for ws in want.values() for w in ws)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 4096 or at & (at - 1) == 0


def test_packing_in_several_groups(spark, edge):
    """Every id in one piece, sequences gapless and full but for powers of two, whatever the number of groups."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from waymark.llm.packing import pack_documents

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [r.asDict() for r in pack_documents(spark, spark.read.parquet(f"{edge}/documents.parquet"), with_ids=True, group_bytes=20_000).collect()]
    assert len({r["sequence_id"] >> 32 for r in rows}) >= 4
    whole = defaultdict(list)
    sequences = defaultdict(list)
    for r in rows:
        whole[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for i, t in _docs(edge):
        want[i] += [*tok.encode(t or "", add_special_tokens=False).ids, 2]
    assert {k: sorted(v) for k, v in whole.items()} == {k: sorted(v) for k, v in want.items()}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 4096 or at & (at - 1) == 0


def test_neighbours_of_repeated_ids_and_equal_vectors(spark):
    """The query's own id, repeated rows, null ids and ids beyond 2^53 among equal vectors, against a plain version."""
    from pyspark.sql import functions as F

    from waymark.llm.neighbours import search

    big = 2**60
    one, two = [1.0, 0.0], [0.6, 0.8]
    table = [(big, one), (big, one), (big, two), (2, one), (2, one), (3, one), (None, one), (4, two), (big + 1, two), (6, [-1.0, 0.5]), (7, None)]
    rows = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    for k in (1, 3, 4, 20):
        got = [(r["vec_id"], round(r["score"], 9)) for r in search(spark, rows, F.col("vec_id") == big, k=k).orderBy("rank").collect()]
        able = [(i, v) for i, v in table if i not in (None, big) and v]
        best = sorted((-max(v[0] * q[0] + v[1] * q[1] for q in (one, two)), i) for i, v in able)[:k]
        assert got == [(i, round(-s, 9)) for s, i in best]


def test_scan_keeps_the_best_of_all_tiles(monkeypatch):
    from waymark.llm import neighbours as N

    monkeypatch.setattr(N, "TILE", 16)
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(100, 8)), rng.normal(size=(70, 8))
    model = N.Quantizer.fit(x, cells=8)
    codes = model.encode(x)
    qi, row, score = N.scan_codes(model, q, codes, 10)
    full = model.scan(q, codes)
    for i in range(70):
        assert np.allclose(np.sort(score[qi == i]), np.sort(full[i])[-10:], atol=1e-5)
        assert np.allclose(full[i, row[qi == i]], score[qi == i], atol=1e-5)


def test_refit_solves_each_centroid():
    """A round of running sums gives what the whole least squares of one subspace after the other gives."""
    from waymark.llm import neighbours as N

    rng = np.random.default_rng(9)
    parts, dirs, eta = rng.normal(size=(300, 5, 2)), rng.normal(size=(300, 5, 2)) / 4, 3.5
    books = rng.normal(size=(5, 16, 2))
    codes = N.assign(books, parts, dirs, eta)
    want = books.copy()
    for s in range(5):
        for c in range(16):
            own = codes[:, s] == c
            if own.any():
                others = sum(((parts[own, t] - want[t, codes[own, t]]) * dirs[own, t]).sum(1) for t in range(5) if t != s)
                rows = np.concatenate([np.tile(np.eye(2), (own.sum(), 1)), np.sqrt(eta - 1) * dirs[own, s]])
                aim = np.concatenate([parts[own, s].ravel(), np.sqrt(eta - 1) * (others + (parts[own, s] * dirs[own, s]).sum(1))])
                want[s, c] = np.linalg.lstsq(rows, aim, rcond=None)[0]
    N.refit(books, parts, dirs, codes, eta)
    assert np.allclose(books, want)


def test_assignment_in_pieces_is_the_same(monkeypatch):
    from waymark.llm import neighbours as N

    rng = np.random.default_rng(2)
    books, parts, dirs = rng.normal(size=(6, 16, 2)), rng.normal(size=(50, 6, 2)), rng.normal(size=(50, 6, 2))
    whole = N.assign(books, parts, dirs, 4.0)
    monkeypatch.setattr(N, "ASSIGN_BYTES", 1)
    assert (N.assign(books, parts, dirs, 4.0) == whole).all()


def test_neighbours_of_384_dimensions_over_several_blocks(spark):
    """Row and query blocks of some kilobytes: every block pair is scanned, and recall holds."""
    from pyspark.sql import functions as F

    from waymark.llm.neighbours import search

    rng = np.random.default_rng(12)
    x = rng.normal(size=(1500, 384)) * rng.lognormal(0, 0.2, size=(1500, 1))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in search(spark, rows, F.col("vec_id") % 20 == 0, row_bytes=60_000, query_bytes=20_000).collect():
        got[r["query_id"]].append(r["vec_id"])
    x = x.astype(np.float32).astype(float)
    hit = []
    for i in range(0, 1500, 20):
        s = x @ x[i]
        s[i] = -np.inf
        hit.append(len(set(got[i]) & set(np.argsort(-s)[:20].tolist())) / 20)
    assert len(got) == 75 and np.mean(hit) >= 0.95


def test_packing_keeps_capitals_with_combining_marks():
    import public_tokenizers
    from tokenizers import Tokenizer

    from waymark.llm.packing import WordEncoder

    tok, enc = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), WordEncoder()
    for t in ("J\u030coy", "H\u0331at.", "T\u0308al and Tal", "W\u030aal", "Y\u030aal", "j\u030coy J\u030coy JOY", "plain JOY", "E\u0301te\u0301 STRA\u00dfE"):
        for _ in range(2):  # learnt, then remembered
            assert np.frombuffer(enc.encode(t.encode()), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_packing_learns_words_of_many_texts_in_few_calls(monkeypatch):
    """Ids are those of the tokenizer, capitals, signs and letters that fold into several included, and words aren't encoded one by one."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from waymark.llm import packing
    from waymark.llm.packing import WordEncoder

    tok, enc = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), WordEncoder()
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    texts = [t or "" for t in texts] + ["\u0130stanbul \u0130. STRA\u00dfE a\u00aa. it's IT'S. 's' can't! caf\u00e9*** Tal TAL, tal&&& \u03a3\u03a3. \u1e9e \u01c5x <|endoftext|> x", "a' a'. a_ a_b a@b.c 12ab ab12! \u0301x e\u0301. \ufb01n \u1100\u1161 \u2126hm \u00a0x\u00a0y. \u3000z x\u2028y", "\x1fa b\x1c c", ""]
    calls, real = [], enc.tokenizer

    class Counting:
        def __getattr__(self, name):
            return getattr(real, name)

        def encode_batch_fast(self, words, **kw):
            calls.append(len(words))
            return real.encode_batch_fast(words, **kw)

    enc.tokenizer = Counting()
    monkeypatch.setattr(packing, "CACHE_WORDS", 3000)
    for _ in range(2):
        for at in range(0, len(texts), 40):
            got = enc.encode_all([t.encode() for t in texts[at : at + 40]])
            assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts[at : at + 40]]
        if len(calls) and _ == 0:
            assert sum(calls) < len({w for t in texts for w in t.split()}) / 4


def test_first_fit_decreasing_is_first_fit():
    from waymark.llm.packing import first_fit_decreasing

    rng = np.random.default_rng(0)
    for _ in range(30):
        sizes = rng.integers(1, 50, rng.integers(1, 80))
        bins: list[list[int]] = []
        free: list[int] = []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            b = next((b for b, f in enumerate(free) if f >= sizes[i]), len(free))
            if b == len(free):
                bins.append([])
                free.append(64)
            bins[b].append(i)
            free[b] -= sizes[i]
        assert first_fit_decreasing(sizes, 64) == bins


def test_warc_brute_force(spark, edge):
    t = pq.read_table(f"{edge}/pages.parquet").to_pylist()
    first: dict[bytes, int] = {}
    for r in t:
        body = (r["html"] or "").encode()
        first[body] = min(first.get(body, r["page_id"]), r["page_id"])
    want = []
    for r in t:
        body = (r["html"] or "").encode()
        again = r["page_id"] > first[body]
        want.append((r["page_id"], len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first[body] if again else None))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in _rows(spark, "op6_warc", edge)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_warc_payloads_come_back_in_chunks(spark, edge, tmp_path):
    from waymark.llm.warc import read_archives, write_archives

    pages = spark.read.parquet(f"{edge}/pages.parquet")
    manifest = write_archives(spark, pages, f"file://{tmp_path}/warc", chunk_bytes=100_000)
    rows = read_archives(spark, manifest, chunk_bytes=65_536).collect()
    whole = defaultdict(bytes)
    for r in sorted(rows, key=lambda r: (r["record_id"], r["chunk_no"])):
        assert len(r["chunk"]) <= 65_536
        whole[r["page_id"]] += r["chunk"]
    assert whole[30] == b"x" * 700_001 and whole[20] == ("é" * 200_000).encode()


def _sets(text: str | None) -> set:
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_brute_force(spark, edge):
    docs = _docs(edge)
    sets = [(i, _sets(t)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    want = [(i, len(s), root(i), root(i) == i) for i, s in sets]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in _rows(spark, "op7_near_duplicates", edge)]
    assert sorted(got) == sorted(want)


def _labels(sets: list[set]) -> list[int]:
    label = np.arange(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                lo, hi = sorted((label[i], label[j]))
                label[label == hi] = lo
    return label.tolist()


def _loose_group(rng, n: int, words: int, edits: int) -> list[str]:
    """Near copies beside documents that share half of them, and chains of edits around the threshold."""
    base = [f"t{i}" for i in range(words)]
    texts = []
    for i in range(n):
        own = list(base)
        for p in rng.choice(words, rng.integers(0, edits), replace=False):
            own[p] = f"e{i}_{p}"
        if i % 3 == 0:
            own[words // 2 :] = [f"o{i % 7}_{p}" for p in range(words // 2)]
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize(("node_rows", "chunk"), [(2048, 64), (12, 4)])
def test_near_duplicates_in_a_large_group(spark, tmp_path, monkeypatch, node_rows, chunk):
    """Nodes that branch give the links of exhaustive ones."""
    from waymark.llm import near_duplicates

    monkeypatch.setattr(near_duplicates, "NODE_ROWS", node_rows)
    monkeypatch.setattr(near_duplicates, "CHUNK", chunk)
    texts = _loose_group(np.random.default_rng(2), 120, 220, 9)
    pq.write_table(pa.table({"doc_id": pa.array(range(120), pa.int64()), "text": texts}), tmp_path / "documents.parquet")
    got = {r["doc_id"]: r["component_id"] for r in _rows(spark, "op7_near_duplicates", str(tmp_path))}
    assert [got[i] for i in range(120)] == _labels([_sets(t) for t in texts])


def test_branching_keeps_links_at_the_threshold(spark, tmp_path, monkeypatch):
    """Pairs of similarity 0.75 to 0.8 among many documents that share two thirds of them: nearly all links survive the branching."""
    from waymark.llm import near_duplicates

    monkeypatch.setattr(near_duplicates, "NODE_ROWS", 16)
    monkeypatch.setattr(near_duplicates, "CHUNK", 4)
    common = [f"t{i}" for i in range(200)]
    texts = []
    for i in range(120):
        own = [f"x{i // 2}_{p}" for p in range(100)]
        for p in range(i % 2, 60 * (i % 2), 8):
            own[p] = f"y{i}_{p}"
        texts.append(" ".join(common + own))
    sets = [_sets(t) for t in texts]
    similar = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 120, 2)]
    assert 0.75 <= min(similar) and max(similar) < 0.8
    pq.write_table(pa.table({"doc_id": pa.array(range(120), pa.int64()), "text": texts}), tmp_path / "documents.parquet")
    got = {r["doc_id"]: r["component_id"] for r in _rows(spark, "op7_near_duplicates", str(tmp_path))}
    assert all(got[i] in (i, i - i % 2) for i in range(120))
    assert np.mean([got[i + 1] == i for i in range(0, 120, 2)]) >= 0.99


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_components_of_chains_stars_and_rings(spark, monkeypatch, limit):
    from waymark.llm import components

    monkeypatch.setattr(components, "TASK_EDGES", limit)
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, i) for i in range(50, 60)] + [(201, 202), (202, 203), (203, 201), (7, 7)]
    got = {r["id"]: r["component"] for r in components.connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, **{i: 50 for i in [*range(50, 60), 100]}, **{i: 201 for i in (201, 202, 203)}, 7: 7}


def test_groups_and_forests_brute_force(monkeypatch):
    from waymark.llm import near_duplicates as N
    from waymark.operators.graph import roots

    rng = np.random.default_rng(4)
    texts = _loose_group(rng, 90, 120, 12) + [_words(f"z{i}", 80) for i in range(10)]
    data = pa.array([t.encode() for t in texts], pa.binary())
    batch = next(N._sketch(iter([pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), data], names=["id", "text"])])))
    n, s1 = batch.column("n").to_numpy(), batch.column("s1").to_numpy()
    bits = np.frombuffer(batch.column("bits").buffers()[2], np.uint8).reshape(-1, N.SKETCH)
    ids, cell = np.arange(100), np.sort(rng.integers(0, 3, 100))
    sets = [_sets(t) for t in texts]
    pairs = {(i, j) for i in range(100) for j in range(i + 1, 100) if cell[i] == cell[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    for limit in (N.GROUP_SHINGLES, 1000):  # the second splits groups into blocks
        monkeypatch.setattr(N, "GROUP_SHINGLES", limit)
        place, number = N.cell_groups(cell, ids, s1, ids, n, bits)
        members = defaultdict(set)
        for i, g in zip(place.tolist(), number.tolist(), strict=True):
            members[g].add(i)
        assert all(any({i, j} <= m for m in members.values()) for i, j in pairs)
        if limit == 1000:
            assert max(sum(n[list(m)]) for m in members.values()) < 1000 + 4 * max(n)
    hashed = [np.sort(np.array([hash(x) for x in s], np.int64)) for s in sets]
    both = N.shared(hashed)
    assert all(both[i, j] == len(sets[i] & sets[j]) for i in range(100) for j in range(100) if i != j)
    links = N.forest(ids, hashed)
    x, y = (np.array(c) for c in zip(*links, strict=True))
    assert len(links) < 100 and roots(100, x, y).tolist() == _labels(sets)


def _alnum_words(text: str | None) -> list[bytes]:
    ok = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    return bytes(c if c in ok else 0x20 for c in (text or "").encode().lower()).split()


def test_decontamination_brute_force(spark, edge):
    items = pq.read_table(f"{edge}/benchmark.parquet").to_pylist()
    windows = defaultdict(set)
    for x in items:
        w = _alnum_words(x["text"])
        n = min(len(w), 10)
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s : s + n])].add(x["item_id"])
    want = []
    for i, t in _docs(edge):
        w = _alnum_words(t)
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[k]
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    got = [tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in _rows(spark, "op8_decontamination", edge)]
    assert sorted(got) == sorted(want)


def _repeats(docs: list[tuple[int, str | None]], k: int = 50) -> list[tuple]:
    owner: dict = {}
    split = [(i, (t or "").encode().split()) for i, t in docs]
    for i, w in split:
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            owner[key] = min(owner.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - k + 1):
            if owner[tuple(w[s : s + k])] < i:
                gone |= set(range(s, s + k))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_passages_brute_force(spark, edge):
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in _rows(spark, "op10_repeated_passages", edge)]
    assert sorted(got) == sorted(_repeats(_docs(edge)))


@pytest.mark.parametrize("limit", [3000, 1])
def test_crowded_buckets_give_the_same(spark, edge, monkeypatch, tmp_path, limit):
    """Buckets beyond the bound are split by longer minimisers, with a bound of one byte down to single windows."""
    from waymark.llm import passages

    monkeypatch.setattr(passages, "BUCKET_BYTES", limit)
    shared = _words("common", 80)
    texts = [f"{_words(f'l{i % 9}_', 40 + i % 3)} {shared} {_words(f'r{i % 7}_', 40)}" for i in range(30)]
    pq.write_table(pa.table({"doc_id": pa.array(range(30), pa.int64()), "text": texts}), tmp_path / "documents.parquet")
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in _rows(spark, "op10_repeated_passages", str(tmp_path))]
    assert sorted(got) == sorted(_repeats(list(enumerate(texts))))


def test_null_ids_do_not_break_operators(spark, edge, tmp_path):
    t = pq.read_table(f"{edge}/documents.parquet")
    ids = pa.array([None if i % 4 == 0 else v for i, v in enumerate(t["doc_id"].to_pylist())], pa.int64())
    for p in Path(edge).glob("*.parquet"):
        pq.write_table(pq.read_table(p) if p.name != "documents.parquet" else t.set_column(0, "doc_id", ids), tmp_path / p.name)
    for name in registry.QUERIES:
        if name not in ("op4_nearest_neighbours", "op5_packing", "op6_warc", "op13_embedding_whitening"):
            assert len(_rows(spark, name, str(tmp_path))) == t.num_rows, name
    rows = _rows(spark, "op5_packing", str(tmp_path))
    for missing in (True, False):  # every row is packed, those without an id too
        want = sum(1 for i in ids.to_pylist() if (i is None) == missing)
        assert sum(r["start"] == 0 for r in rows if (r["doc_id"] is None) == missing) == want


def test_null_ids_of_vectors_and_pages(spark, edge, tmp_path):
    v = pq.read_table(f"{edge}/embeddings.parquet")
    gone = {3, 17, 40, 41}
    ids = pa.array([None if i in gone else i for i in range(60)], pa.int64())
    pq.write_table(v.set_column(0, "vec_id", ids), tmp_path / "embeddings.parquet")
    rows = _rows(spark, "op4_nearest_neighbours", str(tmp_path))
    assert {r["query_id"] for r in rows} == {0, 20} and not {r["vec_id"] for r in rows} & {None, *gone}
    white = _rows(spark, "op13_embedding_whitening", str(tmp_path))
    assert len(white) == 8 * 56 and sum(r["vec_id"] is None for r in white) == 8 * len(gone)
    p = pq.read_table(f"{edge}/pages.parquet")
    pages = pa.array([None if i in (0, 3) else x for i, x in enumerate(p["page_id"].to_pylist())], pa.int64())
    pq.write_table(p.set_column(0, "page_id", pages), tmp_path / "pages.parquet")
    got = _rows(spark, "op6_warc", str(tmp_path))
    assert sorted(str(r["page_id"]) for r in got) == sorted(str(x) for x in pages.to_pylist())


def test_factorisation_identity_is_the_sum_over_pairs():
    from waymark.llm.quality import FactorisationMachine, dimension, features

    texts = pa.array(["some words, some WORDS and 12 more!", "", "line\nline\nother " * 5, None], pa.string())
    from waymark.llm.text import column_bytes

    offsets, data = column_bytes(texts)
    first, idx, val = features(offsets, data, 0, 4, [np.array([3.0, np.nan, 90.0, np.nan])])
    rng = np.random.default_rng(2)
    dim = dimension(1)
    machine = FactorisationMachine(0.3, rng.normal(0, 0.3, dim).astype(np.float32), rng.normal(0, 0.3, (dim, 4)).astype(np.float32))
    for r, p in enumerate(machine.score(first, idx, val)):
        i, x = idx[first[r] : first[r + 1]], val[first[r] : first[r + 1]].astype(float)
        z = machine.bias + (machine.linear[i] * x).sum()
        for a in range(len(i)):
            for b in range(a + 1, len(i)):
                z += machine.factors[i[a]].astype(float) @ machine.factors[i[b]].astype(float) * x[a] * x[b]
        assert abs(p - 1 / (1 + np.exp(-z))) < 1e-4


def test_votes_are_those_of_plain_machines(spark):
    """Families first, then every pair of the family's languages: predictions against margins taken one row at a time."""
    from waymark.llm import language as L
    from waymark.llm.text import column_bytes

    t = pq.read_table(f"{SMALL}/documents.parquet", columns=["text", "lang"]).to_pylist()
    t = [r for r in t if r["text"] and r["lang"]][:120]
    offsets, data = column_bytes(pa.array([r["text"] for r in t]))
    index, first = L.ngram_index(offsets, data, 0, len(t))
    examples = []
    for r, x in enumerate(t):
        i, c = np.unique(index[first[r] : first[r + 1]], return_counts=True)
        examples.append((x["lang"], i.astype(np.int32), (c * (L.SCALE / c.sum())).astype(np.float32)))
    model = L.fit(examples)
    names, score = model.predict(index, first)
    for r, (_, i, v) in enumerate(examples):
        f = int(np.argmax([v @ model.family_weights[i, c] + model.family_bias[c] for c in range(len(model.families))])) if len(model.families) > 1 else 0
        votes = dict.fromkeys(model.languages[f], 0)
        for c, (a, b) in enumerate(model.pairs[f]):
            votes[model.languages[f][a if v @ model.pair_weights[f][i, c] + model.pair_bias[f][c] >= 0 else b]] += 1
        assert votes[names[r]] == max(votes.values()) and 0 <= score[r] <= 1
    # one language only: it is the answer to every text
    alone = L.fit([e for e in examples if e[0] == examples[0][0]])
    assert set(alone.predict(index, first)[0]) == {examples[0][0]}


def test_language_of_letters_beyond_ascii(spark, tmp_path):
    texts = ["привет мир как дела", "hello world how are you", "λόγος καὶ ἔργον", "12 34 !?", "\u4e2d\u6587", "", None]
    langs = ["ru", "en", None, "en", None, None, None]
    n = len(texts)
    pq.write_table(pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string())}), tmp_path / "documents.parquet")
    got = {r["doc_id"]: r["lang_pred"] for r in _rows(spark, "op1_language_id", str(tmp_path))}
    assert all((got[i] == "und") == (i in (3, 5, 6)) for i in range(n))
