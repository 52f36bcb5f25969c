"""Corpus-wide line deduplication over levelled sorted runs of line hashes.

The index is a set of runs in the shared folder: tables of line hashes in a fixed number of files, one for each range of a
hash of the key, each file sorted by key. Closed runs hold lines known to be frequent; open runs hold one row per other
line with the number of documents that have it so far. A batch of documents is counted, dealt to the files' ranges, merged
against the closed runs, whose lines it loses, and added as an open run of level 0. When a level has two runs they are
merged into one of the next level, and lines that reach the threshold move to a closed run; a line is thus rewritten
at most once per level. File i of one run only ever meets file i of another, in one task that reads both in order: the runs
are not shuffled or sorted again.

A line's hash is two 64-bit hashes of its key, and its key is the line without ASCII white space at both ends and with
A-Z lower-cased. Only hashes are shuffled for counting, combined on the map side, so a line found everywhere is no hot key.

Defined edge cases: a null or empty text is one empty line; a document's repeated lines count once; rows that repeat a
doc_id are one document for counting, and each is returned; rows with a null doc_id are together one document; an
empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.session import drop_path, fresh_path, materialize, prepare

MIN_DOCUMENTS = 10
MIN_CODE_POINTS = 1
BATCHES = 4
#: Documents of one batch; a larger table makes more batches.
BATCH_DOCUMENTS = 50_000_000
_BIT = 1 << 63


def line_key(line: bytes) -> bytes:
    """The methods of bytes know ASCII only: space, \\t, \\n, \\v, \\f and \\r are stripped, A-Z folded."""
    return line.strip().lower()


def _two(key: bytes) -> tuple[int, int]:
    a = xxhash.xxh3_128_intdigest(key)
    high, low = a >> 64, a & (2 * _BIT - 1)
    return high - 2 * _BIT if high & _BIT else high, low - 2 * _BIT if low & _BIT else low


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def line_hashes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_code_points: int = MIN_CODE_POINTS) -> DataFrame:
    """(doc, h1, h2): each distinct line of each row, of at least so many code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                place: list[int] = []
                high: list[int] = []
                low: list[int] = []
                for i, t in enumerate(part.column(1)):
                    if t.is_valid:
                        for k in {line_key(x) for x in t.as_py().encode().split(b"\n")}:
                            if _long_enough(k, min_code_points):
                                a, b = _two(k)
                                place.append(i)
                                high.append(a)
                                low.append(b)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(place, pa.int64())), pa.array(high, pa.int64()), pa.array(low, pa.int64())], names=["doc", "h1", "h2"])

    return docs.select(F.col(key).alias("doc"), F.col(text)).mapInArrow(run, f"doc {docs.schema[key].dataType.simpleString()}, h1 long, h2 long")


class LineIndex:
    """Levelled sorted runs below one folder: open ones of (h1, h2, n), closed ones of (h1, h2, n), n being at the threshold or above."""

    def __init__(self, spark: SparkSession, path: str, min_documents: int = MIN_DOCUMENTS, files: int | None = None):
        self.spark, self.path, self.min_documents = spark, path, min_documents
        self.files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.closed: list[list[str]] = []
        self._name = f"waymark_lines_{uuid.uuid4().hex}"
        self._written = 0

    @contextmanager
    def _in_order(self) -> Iterator[None]:
        """While plans are made here, a run's files count as sorted (each range is one file)."""
        keys = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.enabled": "true"}
        before = {k: self.spark.conf.get(k) for k in keys}
        for k, v in keys.items():
            self.spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)

    def _write(self, rows: DataFrame) -> str:
        name = f"{self._name}_{self._written}"
        self._written += 1
        with self._in_order():
            rows.select("h1", "h2", "n").write.format("parquet").option("compression", "zstd").option("path", f"{self.path}/{name}").bucketBy(self.files, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        return name

    def _run(self, name: str) -> DataFrame:
        return self.spark.table(name).hint("merge")

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        drop_path(self.spark, f"{self.path}/{name}")

    def _merge(self, names: list[str]) -> DataFrame:
        """One row per line of the runs, counts added up, file by file."""
        out = self._run(names[0])
        for name in names[1:]:
            other = self._run(name).withColumnRenamed("n", "m")
            out = out.join(other, ["h1", "h2"], "full_outer").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return out

    def rest(self, counts: DataFrame) -> DataFrame:
        """A batch's (h1, h2, n), one row per line, dealt and sorted like a run, without the lines of closed runs."""
        out = counts.select("h1", "h2", "n").repartition(self.files, "h1", "h2").sortWithinPartitions("h1", "h2")
        for name in (n for level in self.closed for n in level):
            out = out.join(self._run(name).select("h1", "h2"), ["h1", "h2"], "left_anti")
        return out

    def add(self, counts: DataFrame) -> None:
        """Merge-anti-join a batch with the closed runs, add what is left as a run, and merge levels that have two."""
        with self._in_order():
            rest = self.rest(counts)
        self._put(self.levels, rest, 0)
        level = 0
        while len(self.levels[level]) > 1:
            old, self.levels[level] = self.levels[level], []
            with self._in_order():
                merged = self._merge(old)
            self._put(self.levels, merged.filter(F.col("n") < self.min_documents), level + 1)
            self._put(self.closed, merged.filter(F.col("n") >= self.min_documents), 0)
            for name in old:
                self._drop(name)
            level += 1
        level = 0
        while level < len(self.closed) and len(self.closed[level]) > 1:
            old, self.closed[level] = self.closed[level], []
            with self._in_order():
                merged = self._merge(old)
            self._put(self.closed, merged, level + 1)
            for name in old:
                self._drop(name)
            level += 1

    def _put(self, levels: list[list[str]], rows: DataFrame, level: int) -> None:
        while len(levels) <= level:
            levels.append([])
        levels[level].append(self._write(rows))

    def frequent(self) -> DataFrame:
        """(h1, h2) of all lines at or above the threshold; written, and the runs are dropped."""
        known = [n for level in self.closed for n in level]
        open_ = [n for level in self.levels for n in level]
        if not open_:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        with self._in_order():
            out = self._merge(open_).filter(F.col("n") >= self.min_documents).select("h1", "h2")
            for name in known:
                out = out.unionByName(self._run(name).select("h1", "h2"))
            out = materialize(self.spark, out, "frequent-lines", path=fresh_path(self.spark, "frequent-lines"))
        for name in [*known, *open_]:
            self._drop(name)
        self.levels, self.closed = [], []
        return out


def frequent_lines(spark: SparkSession, hashes: DataFrame, *, min_documents: int = MIN_DOCUMENTS, batches: int = BATCHES) -> DataFrame:
    """(h1, h2) of lines found in at least ``min_documents`` documents; ``hashes`` enters the index batch by batch.

    Batches are dealt by document, so that a document's lines are counted in one batch. A batch's line that is open in
    an earlier run is a row of its own there, and merging adds the two up.
    """
    staged_path = fresh_path(spark, "line-batches")
    batch = F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int")
    counted = hashes.groupBy(batch.alias("batch"), "h1", "h2").agg(F.count("*").alias("n"))
    staged = materialize(spark, counted, "line-batches", path=staged_path)
    index = LineIndex(spark, fresh_path(spark, "line-index"), min_documents)
    for b in range(batches):
        index.add(staged.filter(F.col("batch") == b))
    drop_path(spark, staged_path)
    return index.frequent()


def drop_lines(spark: SparkSession, docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, min_documents: int = MIN_DOCUMENTS, min_code_points: int = MIN_CODE_POINTS, batches: int = BATCHES) -> DataFrame:
    """Every row with (key, columns of ``keep``, kept_text, n_lines, n_dropped): lines found in many documents are gone everywhere."""
    prepare(spark)
    source = docs.select(key, text)
    hashes = line_hashes(source, key=key, text=text, min_code_points=min_code_points)
    if source.groupBy(key).count().filter("count > 1").limit(1).count():
        hashes = hashes.distinct()  # rows that share a doc_id are one document
    batches = max(batches, -(-source.count() // BATCH_DOCUMENTS))
    frequent = frequent_lines(spark, hashes, min_documents=min_documents, batches=batches)
    found = hashes.join(frequent, ["h1", "h2"], "left_semi").groupBy("doc").agg(F.collect_set(F.struct("h1", "h2")).alias("drop"))
    found = found.select("doc", F.col("drop.h1").alias("__h1"), F.col("drop.h2").alias("__h2"))
    names = [f"__keep{i}" for i in range(len(keep or []))]
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"), *(F.col(c).alias(n) for c, n in zip(keep or [], names, strict=True)))
    joined = rows.join(found, F.col("__key").eqNullSafe(F.col("doc")), "left").drop("doc")
    kinds = dict(rows.dtypes)

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                kept, total, gone = [], [], []
                for t, h1, h2 in zip(part.column("__text"), part.column("__h1"), part.column("__h2"), strict=True):
                    lines = (t.as_py() or "").encode().split(b"\n") if t.is_valid else [b""]
                    total.append(len(lines))
                    if h1.is_valid:
                        drop = set(zip(h1.as_py(), h2.as_py(), strict=True))
                        lines = [x for x in lines if not (_long_enough(k := line_key(x), min_code_points) and _two(k) in drop)]
                    gone.append(total[-1] - len(lines))
                    kept.append(b"\n".join(lines).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([part.column("__key"), *(part.column(n) for n in names), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=["__key", *names, "__kept", "__n", "__gone"])

    schema = ", ".join([f"__key {kinds['__key']}", *(f"{n} {kinds[n]}" for n in names), "__kept string, __n long, __gone long"])
    out = joined.mapInArrow(run, schema)
    return out.select(F.col("__key").alias(key), *(F.col(n).alias(c) for c, n in zip(keep or [], names, strict=True)), F.col("__kept").alias("kept_text"), F.col("__n").alias("n_lines"), F.col("__gone").alias("n_dropped"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop every line found in at least 10 documents; one row per document with the digest of what is kept."""
    out = drop_lines(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = """
WITH l AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))
),
f AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN f.k IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k
GROUP BY doc_id
"""
