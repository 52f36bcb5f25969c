"""Removal of repeated passages by super-k-mer partitioning.

A window of k words belongs to the bucket of its minimiser, the smallest hash of the m-grams in it. Consecutive windows
with the same minimiser travel as one packed string, a super-k-mer. Equal windows have equal minimisers, so whether a
window occurs in another document is settled inside its bucket, where the windows are sorted and compared byte by byte.

Minimisers that occur in one document only cannot hold a repeated window; they are found first, from the minimisers
alone, and their super-k-mers are never packed. Equal super-k-mers are combined on the map side before they are
shuffled, so exact copies cost one string. A bucket with more than ``BUCKET_BYTES`` of different strings is split in the same
way: its strings are cut again by minimisers twice as long, and so on up to k words, where a minimiser is the window
itself and a bucket holds copies only. Windows are compared byte by byte at every level, and nothing is left out.

Defined edge cases: null texts have no words; texts of fewer words than a window keep all; a window repeated inside one
document alone stays; rows that repeat a doc_id are one document; rows with a null doc_id neither lose words nor take
words from others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.text import Words, blocks, column_bytes, grams, sliding_min
from waymark.session import drop_path, fresh_path, materialize, prepare

WINDOW = 50
MINIMISER = 8
#: Bytes of different strings that one bucket may gather in a task; its windows take some forty times that.
BUCKET_BYTES = 1 << 17
#: Windows of one super-k-mer at most; longer runs (of a repeated word) are cut.
RUN = 256


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hash128(b: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(b)
    return _signed(x >> 64), _signed(x & ((1 << 64) - 1))


def window_minimisers(w: Words, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, minimiser) of every window of k words inside one row."""
    h = w.hashes()
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(w.row[: len(h) - k + 1] == w.row[k - 1 :])
    return start, sliding_min(grams(h, m), k - m + 1)[start].view(np.int64)


def _cuts(w: Words, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, number of windows, minimiser) of each run of windows that share a minimiser."""
    start, mz = window_minimisers(w, k, m)
    row = w.row[start]
    change = np.ones(len(mz), bool)
    change[1:] = (mz[1:] != mz[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(change)
    return row[head], start[head], np.diff(np.append(head, len(mz))), mz[head]


def _minimisers(k: int, m: int):
    """Rows (u1, u2, owner, text) give (u1, u2, owner, mz), the distinct minimisers of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = column_bytes(batch.column("text"))
            for at, end in blocks(offsets):
                row, _, _, mz = _cuts(Words(offsets, data, at, end), k, m)
                order = np.lexsort((mz, row))
                row, mz = row[order], mz[order]
                new = np.ones(len(mz), bool)
                new[1:] = (mz[1:] != mz[:-1]) | (row[1:] != row[:-1])
                where = pa.array(row[new] + at)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(where) for c in ("u1", "u2", "owner")), pa.array(mz[new])], names=["u1", "u2", "owner", "mz"])

    return run


def _super_kmers(k: int, m: int):
    """Rows (u1, u2, owner, text, mzs) give the super-k-mers of the minimisers ``mzs``, with their first window and number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = column_bytes(batch.column("text"))
            shared = batch.column("mzs")
            for at, end in blocks(offsets):
                w = Words(offsets, data, at, end)
                row, start, length, mz = _cuts(w, k, m)
                out: tuple[list, ...] = ([], [], [], [], [], [], [])
                bound = np.searchsorted(row, np.arange(end - at + 1))
                for r in range(end - at):
                    lo, hi = bound[r], bound[r + 1]
                    if lo == hi:
                        continue
                    known = np.isin(mz[lo:hi], np.array(shared[at + r].as_py(), np.int64))
                    text = w.raw[w.edge[r] : w.edge[r + 1]].tobytes().split()
                    first = int(w.first[r])
                    for s, n, z in zip((start[lo:hi][known] - first).tolist(), length[lo:hi][known].tolist(), mz[lo:hi][known].tolist(), strict=True):
                        for cut in range(0, n, RUN):
                            many = min(RUN, n - cut)
                            packed = b" ".join(text[s + cut : s + cut + many + k - 1])
                            a, b = _hash128(packed)
                            for column, value in zip(out, (r + at, z, a, b, packed, s + cut, many), strict=True):
                                column.append(value)
                where = pa.array(out[0], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(where) for c in ("u1", "u2", "owner")), *(pa.array(c, pa.int64()) for c in out[1:4]), pa.array(out[4], pa.binary()), *(pa.array(c, pa.int32()) for c in out[5:])],
                    names=["u1", "u2", "owner", "mz", "h1", "h2", "packed", "start", "n"],
                )

    return run


def windows_of(packed: bytes, k: int) -> list[bytes]:
    gaps = np.flatnonzero(np.frombuffer(packed, np.uint8) == 0x20)
    begin = [0, *(gaps + 1).tolist()]
    finish = [*gaps.tolist(), len(packed)]
    return [packed[begin[i] : finish[i + k - 1]] for i in range(len(begin) - k + 1)]


def smallest_owner(strings: list[tuple[bytes, int]], k: int) -> list[np.ndarray]:
    """For each string of a bucket, the smallest document that has each of its windows; equal windows meet by sorting."""
    lists = [windows_of(s, k) for s, _ in strings]
    flat = [x for one in lists for x in one]
    owner = np.repeat(np.array([d for _, d in strings], np.int64), [len(x) for x in lists])
    order = sorted(range(len(flat)), key=flat.__getitem__)
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and flat[order[end]] == flat[order[at]]:
            end += 1
        if end - at > 1:
            same = order[at:end]
            owner[same] = owner[same].min()
        at = end
    return np.split(owner, np.cumsum([len(x) for x in lists])[:-1])


def _buckets(k: int):
    """Rows (mz, h1, h2, packed, md), sorted by mz: gives (h1, h2, lower), the windows that a document below md has too."""

    def flush(rows: list[tuple]) -> list[tuple]:
        if len(rows) < 2:
            return []
        found = smallest_owner([(r[2], r[3]) for r in rows], k)
        return [(r[0], r[1], np.flatnonzero(o < r[3]).tolist()) for r, o in zip(rows, found, strict=True) if (o < r[3]).any()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], names=["h1", "h2", "lower"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, out = None, [], []
        for batch in batches:
            for mz, h1, h2, packed, md in zip(*(batch.column(c).to_pylist() for c in ("mz", "h1", "h2", "packed", "md")), strict=True):
                if mz != bucket:
                    out += flush(held)
                    bucket, held = mz, []
                    if len(out) > 4096:
                        yield batch_of(out)
                        out = []
                held.append((h1, h2, packed, md))
        out += flush(held)
        if out:
            yield batch_of(out)

    return run


class _Windows:
    """Which windows of which texts a smaller owner has too, level by level; written tables are dropped in the end."""

    def __init__(self, spark: SparkSession, k: int, m: int):
        self.spark, self.k, self.paths = spark, k, []
        self.lengths = [m]
        while self.lengths[-1] < k:
            self.lengths.append(min(k, 2 * self.lengths[-1]))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(fresh_path(self.spark, name))
        return materialize(self.spark, df, name, path=self.paths[-1])

    def drop(self) -> None:
        for path in self.paths:
            drop_path(self.spark, path)

    def runs(self, units: DataFrame, level: int = 0) -> DataFrame:
        """Of texts (u1, u2, owner, text): (u1, u2, owner, start, n, md, lower), the super-k-mers with windows that others have.

        ``md`` is the smallest owner of the super-k-mer, ``lower`` lists which of its windows a still smaller one has.
        """
        k, m = self.k, self.lengths[level]
        mini = self.keep(units.mapInArrow(_minimisers(k, m), "u1 long, u2 long, owner long, mz long"), "minimisers")
        shared = mini.groupBy("mz").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi")).filter("lo < hi").select("mz")
        lists = mini.join(shared, "mz", "left_semi").groupBy("u1", "u2").agg(F.collect_set("mz").alias("mzs"))
        texts = units.join(lists, ["u1", "u2"]).select("u1", "u2", "owner", "text", "mzs")
        rows = self.keep(texts.mapInArrow(_super_kmers(k, m), "u1 long, u2 long, owner long, mz long, h1 long, h2 long, packed binary, start int, n int"), "super-kmers")
        own = self.keep(rows.groupBy("mz", "h1", "h2", "packed").agg(F.min("owner").alias("md"), F.max("owner").alias("last")), "strings")
        crowd = self.keep(own.groupBy("mz").agg(F.count("*").alias("c"), F.sum(F.octet_length("packed")).alias("bytes")).filter("c > 1").select("mz", "bytes"), "buckets")
        fits = F.lit(True) if m == k else F.col("bytes") <= BUCKET_BYTES  # a gram of k words is the window itself
        dealt = own.join(crowd.filter(fits), "mz", "left_semi").repartition("mz").sortWithinPartitions("mz")
        lower = dealt.select("mz", "h1", "h2", "packed", "md").mapInArrow(_buckets(k), "h1 long, h2 long, lower array<int>")
        large = crowd.filter(~fits)
        if not large.isEmpty():
            strings = self.keep(own.join(large, "mz", "left_semi").select(F.col("h1").alias("u1"), F.col("h2").alias("u2"), F.col("md").alias("owner"), F.col("packed").alias("text")), "large-buckets")
            deeper = self.runs(strings, level + 1)
            hit = F.when(F.col("md") < F.col("owner"), F.sequence("start", F.expr("start + n - 1"))).otherwise(F.transform("lower", lambda i: i + F.col("start")))
            lower = lower.unionByName(deeper.groupBy("u1", "u2").agg(F.array_distinct(F.flatten(F.collect_list(hit))).alias("lower")).withColumnsRenamed({"u1": "h1", "u2": "h2"}))
        # written, so that the engine can split the join where a string is in very many texts
        owners = self.keep(own.select("h1", "h2", "md", "last").join(lower, ["h1", "h2"], "left").filter("md < last or lower is not null").select("h1", "h2", "md", "lower"), "owners")
        return rows.select("u1", "u2", "owner", "start", "n", "h1", "h2").join(owners, ["h1", "h2"]).filter("lower is not null or md < owner").drop("h1", "h2")


def _removed(n_words: int, id_: int, runs: list[dict], k: int) -> np.ndarray:
    gone = np.zeros(n_words + 1, np.int64)
    for r in runs:
        if r["md"] < id_:
            gone[r["start"]] += 1
            gone[r["start"] + r["n"] + k - 1] -= 1
        else:
            hit = r["start"] + np.array(r["lower"], np.int64)
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + k, -1)
    return np.cumsum(gone)[:-1] > 0


def _rewrite(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                kept, total, gone = [], [], []
                for id_, text, runs in zip(part.column("id"), part.column("text"), part.column("runs"), strict=True):
                    words = text.as_py().encode().split() if text.is_valid else []
                    total.append(len(words))
                    if runs.is_valid:
                        out = _removed(len(words), id_.as_py(), runs.as_py(), k)
                        words = [w for w, x in zip(words, out.tolist(), strict=True) if not x]
                    gone.append(total[-1] - len(words))
                    kept.append(b" ".join(words).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=["id", "kept_text", "n_words", "n_removed"])

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, minimiser: int = MINIMISER) -> DataFrame:
    """(key, kept_text, n_words, n_removed) of every row: words inside windows that start in a smaller document are gone."""
    prepare(spark)
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    work = _Windows(spark, window, minimiser)
    units = source.filter(F.col("id").isNotNull()).select(F.col("id").alias("u1"), F.xxhash64("text").alias("u2"), F.col("id").alias("owner"), "text")
    found = work.runs(units).groupBy(F.col("u1").alias("id"), F.col("u2").alias("th")).agg(F.collect_list(F.struct("start", "n", "md", "lower")).alias("runs"))
    runs = materialize(spark, found, "runs", path=fresh_path(spark, "runs"))
    work.drop()
    final = source.withColumn("th", F.xxhash64("text")).join(runs, ["id", "th"], "left").select("id", "text", "runs")
    return final.mapInArrow(_rewrite(window), "id long, kept_text string, n_words long, n_removed long").withColumnRenamed("id", key)


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove words of 50-word windows that also start in a document with a smaller doc_id; one row per document."""
    out = remove_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT doc_id, i, array_to_string(a[i:i + 49], ' ') AS k FROM (SELECT doc_id, a, unnest(range(1, len(a) - 48)) AS i FROM w WHERE len(a) >= 50)),
m AS (SELECT k, min(doc_id) AS lo FROM s GROUP BY k HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM s JOIN m ON s.k = m.k AND m.lo < s.doc_id)),
t AS (SELECT doc_id, unnest(a) AS word, unnest(range(1, len(a) + 1)) AS p FROM w),
r AS (SELECT t.doc_id, count(g.p) AS n_removed, string_agg(CASE WHEN g.p IS NULL THEN word END, ' ' ORDER BY t.p) AS kept FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.p = t.p GROUP BY t.doc_id)
SELECT w.doc_id, CAST(len(a) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r ON r.doc_id = w.doc_id
"""
