"""Approximate maximum-inner-product search with score-aware anisotropic quantisation.

A vector is a coarse centroid plus a residual whose direction is product-quantised: two layers of four-bit codes for each
subspace of two dimensions, the second one for what the first leaves. Codes and codebooks minimise a loss that weighs the
error parallel to the vector ``eta`` times as much as the orthogonal one, since only the parallel part moves large inner
products; what error is left along the centroid is kept as one number. A query scans tables of its inner products with the centroids (two codes to a byte, so one lookup of
256 entries serves two subspaces), and the best of each block are reranked exactly, in double precision.

Equal vectors are one row of the index, with the smallest ids that have it, so ties and hot copies cost and lose nothing.
Each is encoded once. Queries meet all codes block by block (some 85 bytes a row at 64 dimensions; blocks are bounded in
bytes, so that a pair of blocks is minutes of scanning for megabytes shuffled), the best of all blocks by approximate
score are joined with their vectors, and ranked by exact scores. Blocks are dealt by hash, so a task that runs again gets
the same rows. There is no pruning by coarse cells: on vectors without clusters it loses neighbours (of 64 cells, half
must be probed for a recall of 0.9).

Defined edge cases: null, zero and wrongly sized vectors and those with null or non-finite components take no part, as
query or candidate, nor do rows with a null id; the size is the most frequent one, the smaller at ties; rows that share the
query's id are not its candidates, and repeated rows of another id are candidates each; rows that repeat a query's id
with the same vector are one query, with others they share one answer, each candidate with its largest score; with
fewer candidates than k all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm.text import column_bytes
from waymark.session import fresh_path, materialize, prepare

#: Vectors a quantiser is fitted on at most (those with the smallest hash of their number).
FIT_ROWS = 8192
#: Bytes of codes and of query vectors of one task at most, rows of codes scanned at once, and bytes of the tables of an assignment.
ROW_BYTES, QUERY_BYTES, TILE, ASSIGN_BYTES = 64 << 20, 4 << 20, 8192, 64 << 20
#: Vectors reranked for each query.
RERANK = 128
#: Coarse centroids; what is quantised is the direction from the nearest one, so tight clusters keep their detail.
CELLS = 64
#: Share of its norm that an inner product must reach to count in the loss.
THRESHOLD = 0.2
#: Dimensions of a subspace, and codes of each.
_SUB, LAYERS = 2, 2


@dataclass
class Codes:
    """Packed codes, and of each vector its coarse centroid, residual length and correction along the centroid."""

    packed: np.ndarray
    cell: np.ndarray
    length: np.ndarray
    along: np.ndarray


@dataclass
class Quantizer:
    """``coarse`` centroids, and for unit residuals ``books[l][s, c]``, centroid c of subspace s in layer l."""

    eta: float
    coarse: np.ndarray
    books: list[np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, *, threshold: float = THRESHOLD, cells: int = CELLS, rounds: int = 4, seed: int = 5) -> Quantizer:
        rng = np.random.default_rng(seed)
        eta = max(1.0, (x.shape[1] - 1) * threshold**2 / (1 - threshold**2))
        coarse = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
        for _ in range(10):
            coarse = _means(x, _nearest(x, coarse), coarse)
        residual, _ = _unit(x - coarse[_nearest(x, coarse)])
        parts, dirs = _split(residual), _split(_unit(x)[0])
        model = cls(eta, coarse, [])
        for _ in range(LAYERS):
            books = np.stack([p[rng.choice(len(p), 16, replace=len(p) < 16)] for p in parts.transpose(1, 0, 2)])
            for s in range(len(books)):  # plain k-means to start from
                for _ in range(4):
                    books[s] = _means(parts[:, s], _nearest(parts[:, s], books[s]), books[s])
            for _ in range(rounds):
                refit(books, parts, dirs, assign(books, parts, dirs, eta), eta)
            model.books.append(books)
            parts = parts - _shown(books, assign(books, parts, dirs, eta))
        return model

    def encode(self, x: np.ndarray) -> Codes:
        found = [self._encode(x[i : i + 2048].astype(np.float64)) for i in range(0, len(x), 2048)]
        return Codes(*(np.concatenate(f) for f in zip(*found, strict=True)))

    def _encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        cell = _nearest(x, self.coarse)
        centre = self.coarse[cell]
        residual, length = _unit(x - centre)
        left, dirs, packed = _split(residual), _split(_unit(x)[0]), []
        for books in self.books:
            codes = assign(books, left, dirs, self.eta)
            left = left - _shown(books, codes)
            packed.append(codes[:, 0::2] | (codes[:, 1::2] << 4))
        error = length[:, None] * left.reshape(len(x), -1)[:, : x.shape[1]]
        along = (error * centre).sum(1) / np.maximum((centre**2).sum(1), 1e-30)
        return np.concatenate(packed, 1).astype(np.uint8), cell, length.astype(np.float32), along.astype(np.float32)

    def scan(self, q: np.ndarray, codes: Codes) -> np.ndarray:
        """Approximate inner products: tables of 256 entries for each byte of codes, the residual's length, the centroid's part."""
        own = _split(q)
        t = np.concatenate([np.einsum("qsd,scd->qsc", own, books) for books in self.books], 1).astype(np.float32)
        table = (t[:, 1::2, :, None] + t[:, 0::2, None, :]).reshape(len(q), -1, 256)
        total = np.zeros((len(q), len(codes.cell)), np.float32)
        for b in range(codes.packed.shape[1]):
            total += table[:, b][:, codes.packed[:, b]]
        total *= codes.length
        total += (q @ self.coarse.T).astype(np.float32)[:, codes.cell] * (1 + codes.along)
        return total


def assign(books: np.ndarray, parts: np.ndarray, dirs: np.ndarray, eta: float, sweeps: int = 2) -> np.ndarray:
    """Codes by coordinate descent on the squared residual plus eta - 1 times its part along the vector, squared."""
    n, m, _ = parts.shape
    step = max(1, ASSIGN_BYTES // (m * 16 * 16))
    return np.concatenate([_assign(books, parts[i : i + step], dirs[i : i + step], eta, sweeps) for i in range(0, n, step)]) if n else np.zeros((0, m), np.int64)


def _assign(books: np.ndarray, parts: np.ndarray, dirs: np.ndarray, eta: float, sweeps: int) -> np.ndarray:
    n, m, d = parts.shape
    books, parts, dirs = (v.astype(np.float32) for v in (books, parts, dirs))
    gap, along = np.zeros((m, n, 16), np.float32), np.zeros((m, n, 16), np.float32)  # a subspace's table lies together
    for j in range(d):
        r = parts[:, :, j].T[:, :, None] - books[:, None, :, j]
        gap += r * r
        along += r * dirs[:, :, j].T[:, :, None]
    codes, rows = gap.argmin(2), np.arange(n)
    parallel = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0]
    total = parallel.sum(0)
    for _ in range(sweeps):
        for s in range(m):
            other = total - parallel[s]
            codes[s] = (gap[s] + np.float32(eta - 1) * (other[:, None] + along[s]) ** 2).argmin(1)
            parallel[s] = along[s][rows, codes[s]]
            total = other + parallel[s]
    return codes.T


def _shown(books: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return books[np.arange(len(books))[None], codes]


def refit(books: np.ndarray, parts: np.ndarray, dirs: np.ndarray, codes: np.ndarray, eta: float) -> None:
    """Each centroid in turn solves the weighted least squares of its members, the other subspaces being held.

    The residuals' parts along the vectors are kept as running sums, so a round takes rows times dimensions.
    """
    inner = ((parts - _shown(books, codes)) * dirs).sum(2)
    total = inner.sum(1)
    d = parts.shape[2]
    for s in range(len(books)):
        x, u, code = parts[:, s], dirs[:, s], codes[:, s]
        want = total - inner[:, s] + (x * u).sum(1)
        sums = lambda v: np.bincount(code, weights=v, minlength=16)  # noqa: B023, E731
        n = np.bincount(code, minlength=16)
        left = n[:, None, None] * np.eye(d) + (eta - 1) * np.stack([sums(u[:, i] * u[:, j]) for i in range(d) for j in range(d)], 1).reshape(16, d, d)
        right = np.stack([sums(x[:, i] + (eta - 1) * u[:, i] * want) for i in range(d)], 1)
        own = n > 0
        books[s, own] = np.linalg.solve(left[own], right[own][:, :, None])[:, :, 0]
        new = ((x - books[s, code]) * u).sum(1)
        total += new - inner[:, s]
        inner[:, s] = new


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None] - 2 * (x @ centres.T)).argmin(1)


def _means(x: np.ndarray, near: np.ndarray, old: np.ndarray) -> np.ndarray:
    n = np.bincount(near, minlength=len(old))
    total = np.stack([np.bincount(near, weights=x[:, j], minlength=len(old)) for j in range(x.shape[1])], 1)
    return np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], old)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.sqrt((x**2).sum(1))
    return x / np.maximum(length, 1e-30)[:, None], length


def _split(x: np.ndarray) -> np.ndarray:
    """(rows, subspaces, _SUB), padded with zeros to an even number of subspaces."""
    pad = -x.shape[1] % (2 * _SUB)
    x = np.pad(x.astype(np.float64), ((0, 0), (0, pad))) if pad else x.astype(np.float64)
    return x.reshape(len(x), -1, _SUB)


def scan_codes(model: Quantizer, q: np.ndarray, codes: Codes, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, approximate score) of the ``keep`` best rows of each query, by table scans over tiles of rows."""
    out = ([], [], [])
    for at in range(0, len(q), 64):
        own = q[at : at + 64].astype(np.float64)
        rows, score = np.zeros((len(own), 0), np.int64), np.zeros((len(own), 0), np.float32)
        for tile in range(0, len(codes.cell), TILE):
            cut = slice(tile, tile + TILE)
            found = model.scan(own, Codes(codes.packed[cut], codes.cell[cut], codes.length[cut], codes.along[cut]))
            rows = np.concatenate([rows, np.broadcast_to(np.arange(tile, tile + found.shape[1]), found.shape)], 1)
            score = np.concatenate([score, found], 1)
            if score.shape[1] > keep:
                best = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
                rows, score = np.take_along_axis(rows, best, 1), np.take_along_axis(score, best, 1)
        out[0].append(np.repeat(np.arange(at, at + len(own)), rows.shape[1]))
        out[1].append(rows.ravel())
        out[2].append(score.ravel())
    return tuple(np.concatenate(o) if o else np.zeros(0, int) for o in out)


def _vectors(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in (col.chunks if isinstance(col, pa.ChunkedArray) else [col])]
    return (np.concatenate(parts) if parts else np.zeros(0, np.float32)).reshape(-1, dim)


def usable(vector: Column, dim: int) -> Column:
    """The vector has the size and is finite and not zero."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) == dim) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids) of (id, v): each vector once, with its k + 1 smallest ids as (id, n), n being the number of its rows, k at most.

    A query needs k rows of other ids than its own, and every id has a row, so these are enough. They are combined
    before the shuffle, so any number of copies of a vector is a bounded row.
    """
    counted = rows.groupBy("v", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1)
    return ranked.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("ids"))


def search(spark: SparkSession, rows: DataFrame, is_query: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = 20, fit_rows: int = FIT_ROWS, row_bytes: int = ROW_BYTES, query_bytes: int = QUERY_BYTES, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k rows with the largest inner product, by the index."""
    prepare(spark)
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = rows.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return nothing
    dim = sizes["n"]
    whole = rows.filter(usable(F.col(vector), dim) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))

    def keep(df: DataFrame, name: str) -> DataFrame:
        return materialize(spark, df, name, path=fresh_path(spark, name))

    # numbers given once and written, so that a task that runs again finds the same ones
    classes = keep(distinct_vectors(whole, k).withColumn("c", F.monotonically_increasing_id()), "vectors")
    asked = keep(whole.filter("is_query").select("id", "v").distinct().withColumn("u", F.monotonically_increasing_id()), "queries")
    n, q = classes.count(), asked.count()
    if not q:
        return nothing
    sample = classes.select("c", "v").orderBy(F.xxhash64(F.lit("fit"), "c"), "c").limit(fit_rows).collect()
    model = spark.sparkContext.broadcast(Quantizer.fit(np.array([r["v"] for r in sample], np.float64)))  # centroids and books: a fixed number

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = model.value.encode(_vectors(batch.column("v"), dim))
                ends = np.arange(batch.num_rows + 1, dtype=np.int32) * found.packed.shape[1]
                packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(found.packed))])
                yield pa.RecordBatch.from_arrays([batch.column("c"), packed, pa.array(found.cell.astype(np.int32)), pa.array(found.length), pa.array(found.along)], names=["c", "packed", "cell", "length", "along"])

    codes = keep(classes.select("c", "v").mapInArrow(encode, "c long, packed binary, cell int, length float, along float"), "codes")
    tasks = 2 * spark.sparkContext.defaultParallelism
    code_bytes = LAYERS * (-(-dim // (2 * _SUB))) + 20  # of one row
    n_rows = -(-n * code_bytes // row_bytes)
    n_queries = max(-(-q * 4 * dim // query_bytes), min(-(-q // 64), -(-tasks // n_rows)))

    def block(name: str, many: int) -> Column:
        return F.pmod(F.xxhash64(name, F.lit("block")), F.lit(many)).cast("int")

    def all_of(many: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(many - 1)))

    left = codes.withColumn("b", block("c", n_rows)).withColumn("q", all_of(n_queries))
    right = asked.select("u", "v").withColumn("q", block("u", n_queries)).withColumn("b", all_of(n_rows))

    def scan(a: pa.Table, asked_: pa.Table) -> pa.Table:
        if not a.num_rows or not asked_.num_rows:
            return pa.table({"u": pa.array([], pa.int64()), "c": pa.array([], pa.int64()), "near": pa.array([], pa.float32())})
        flat = [np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] for offsets, data in map(column_bytes, a.column("packed").chunks)]
        own = Codes(np.concatenate(flat).reshape(a.num_rows, -1), *(a.column(c).to_numpy() for c in ("cell", "length", "along")))
        found = scan_codes(model.value, _vectors(asked_.column("v"), dim), own, rerank)
        return pa.table({"u": asked_.column("u").to_numpy()[found[0]], "c": a.column("c").to_numpy()[found[1]], "near": found[2].astype(np.float32)})

    near = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInArrow(scan, "u long, c long, near float")
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("near"), "c"))).filter(F.col("r") <= rerank).select("u", "c")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_vectors(batch.column(c), dim).astype(np.float64) for c in ("qv", "v"))
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("c"), pa.array((a * b).sum(1))], names=["query_id", "c", "score"])

    pairs = best.join(asked.select("u", F.col("id").alias("query_id"), F.col("v").alias("qv")), "u").join(classes.select("c", "v"), "c")
    scored = pairs.select("query_id", "c", "qv", "v").mapInArrow(exact, "query_id long, c long, score double").groupBy("query_id", "c").agg(F.max("score").alias("score"))
    named = scored.join(classes.select("c", "ids"), "c").withColumn("ids", F.filter("ids", lambda x: x["id"] != F.col("query_id"))).filter(F.size("ids") > 0)
    # every class has a row for the query: those behind k others can't be among the k nearest
    named = named.withColumn("r", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).filter(F.col("r") <= k)
    rows_ = named.select("query_id", "score", F.explode("ids").alias("m")).select("query_id", "score", F.col("m.id").alias("vec_id"), F.explode(F.sequence(F.lit(1), F.col("m.n"))).alias("copy"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "copy"))
    return rows_.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose vec_id is divisible by 20, by inner product."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(spark, rows, F.col("vec_id") % 20 == 0)
