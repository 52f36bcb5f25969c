"""WARC archives written and read as a chunked record table.

A payload travels as rows of record, chunk number and at most ``chunk_bytes`` bytes, never as one allocation in
Python: the writer compresses chunk after chunk into a gzip member per record, the reader yields chunk rows that carry
the byte count and the SHA-1 of the payload so far, and the row flagged ``last`` closes the record. Equal payloads are
stored once: the record with the smallest page id is the response, the others are revisits that refer to it.

Each task writes a file of its own; only files of committed tasks are in the manifest, so a lost executor or a second
attempt leaves at most an unlisted file.

Defined edge cases: a null payload is an empty one; repeated rows are records of their own, and all rows with the
smallest id of their payload are responses; a null page id makes a response whose id reads back as null; a null url is
written as the record's own identifier; an empty table gives no record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.session import fresh_path, materialize, prepare

CHUNK_BYTES = 256 << 10
READ_BYTES = 128 << 10
GZIP_LEVEL = 3
#: Upper halves of record identifiers with and without a page id in the lower half.
_WITH_ID, _WITHOUT_ID = 0x77617970_61676540, 0x77617970_61676541
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, serial: int = 0) -> str:
    high, low = (_WITHOUT_ID, serial) if page_id is None else (_WITH_ID, page_id)
    return f"<urn:uuid:{uuid.UUID(int=(high << 64) | (low & (1 << 64) - 1))}>"


def page_of(identifier: str | None) -> int | None:
    if not identifier:
        return None
    value = uuid.UUID(identifier.strip("<>").removeprefix("urn:uuid:")).int
    low = value & (1 << 64) - 1
    return (low - (1 << 64) if low >> 63 else low) if value >> 64 == _WITH_ID else None


def _open_fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_archives(spark: SparkSession, pages: DataFrame, dest: str, *, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, date: str | None = None) -> DataFrame:
    """Write every row as a record below ``dest`` (a URI all executors reach) and return the manifest (path, records, bytes)."""
    prepare(spark)
    when = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    source = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("body")).withColumn("sha1", F.unhex(F.sha1("body"))).withColumn("total", F.octet_length("body").cast("long"))
    facts = source.select("page_id", "sha1", "total").filter(F.col("page_id").isNotNull() & (F.col("total") >= min_bytes))
    firsts = facts.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id")).filter("first_id < last_id").drop("last_id")
    revisits = facts.select("page_id", "sha1").join(firsts, "sha1").filter("page_id > first_id").groupBy("page_id", "sha1").agg(F.min("first_id").alias("refers_to"))
    joined = source.join(revisits, ["page_id", "sha1"], "left")
    last = F.when(F.col("refers_to").isNotNull(), F.lit(0)).otherwise(F.expr(f"cast(greatest(total - 1, 0) div {chunk_bytes} as int)"))
    chunks = joined.select(
        "page_id", "url", "sha1", "total", "refers_to", last.alias("last_no"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"), "body"
    ).withColumn("chunk", F.when(F.col("refers_to").isNotNull(), F.lit(b"")).otherwise(F.expr(f"substring(body, chunk_no * {chunk_bytes} + 1, {chunk_bytes})"))).drop("body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{dest}/part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        filesystem, inner = _open_fs(name)
        out = None
        records, digest, packer = 0, hashlib.sha1(), None
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "sha1", "total", "refers_to", "last_no", "chunk_no", "chunk")]
            for page_id, target, sha1, total, refers, last_no, chunk_no, chunk in zip(*columns, strict=True):
                if out is None:
                    filesystem.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    out = filesystem.open_output_stream(inner, compression=None)
                    out.write(_info(when))
                if not chunk_no.as_py():
                    records += 1
                    digest, packer = hashlib.sha1(), zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
                    rid = record_id(page_id.as_py(), (context.partitionId() << 32) | records)
                    out.write(packer.compress(_head(rid, target.as_py(), sha1.as_py(), total.as_py(), refers.as_py(), when)))
                piece = chunk.as_buffer()
                digest.update(piece)
                out.write(packer.compress(piece))
                if chunk_no.as_py() == last_no.as_py():
                    if refers.as_py() is None and digest.digest() != sha1.as_py():
                        raise ValueError(f"payload of page {page_id} changed while it was written")
                    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "records": pa.array([records], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return materialize(spark, chunks.mapInArrow(run, "path string, records long, bytes long"), "manifest", path=f"{dest}/manifest.parquet")


def _info(when: str) -> bytes:
    block = b"software: waymark\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {when}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _head(rid: str, target: str | None, sha1: bytes, total: int, refers: int | None, when: str) -> bytes:
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in target) if target else rid.strip("<>")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {total}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {rid}", f"WARC-Target-URI: {uri}", f"WARC-Date: {when}", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}"]
    if refers is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (total if refers is None else 0)}", "", ""]
    return "\r\n".join(lines).encode() + http


class _Inflated:
    """Bytes of concatenated gzip members, a bounded piece at a time."""

    def __init__(self, raw):
        self.raw, self.held, self.packed = raw, b"", b""
        self.inflater = zlib.decompressobj(31)

    def _more(self) -> bool:
        while True:
            if not self.packed:
                self.packed = self.raw.read(READ_BYTES)
                if not self.packed:
                    return False
            if self.inflater.eof:
                self.inflater = zlib.decompressobj(31)
            out = self.inflater.decompress(self.packed, READ_BYTES)
            self.packed = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
            if out:
                self.held += out
                return True

    def take(self, n: int) -> bytes:
        """Up to n bytes, at least one unless the stream has ended."""
        if not self.held and not self._more():
            return b""
        out, self.held = self.held[:n], self.held[n:]
        return out

    def next_record(self) -> bytes | None:
        """The head of the next record, past the blank lines that end the one before; None at the end."""
        while True:
            self.held = self.held.lstrip(b"\r\n")
            if self.held:
                return self.head()
            if not self._more():
                return None

    def head(self) -> bytes | None:
        """Bytes up to a blank line, which is dropped; None at the end."""
        while (cut := self.held.find(b"\r\n\r\n")) < 0:
            if not self._more():
                return None
        out, self.held = self.held[:cut], self.held[cut + 4 :]
        return out


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _records(raw, chunk_bytes: int, with_payload: bool) -> Iterator[tuple]:
    stream = _Inflated(raw)
    while (head := stream.next_record()) is not None:
        warc = _fields(head)
        left = int(warc["content-length"])
        kind = warc["warc-type"]
        http: dict[str, str] = {}
        if kind in ("response", "revisit"):
            block = stream.head()
            left -= len(block) + 4
            http = _fields(block)
        digest, done, number = hashlib.sha1(), 0, 0
        while True:
            piece = bytearray()
            while left and len(piece) < chunk_bytes:
                part = stream.take(min(left, chunk_bytes - len(piece)))
                if not part:
                    raise ValueError("the archive ends inside a record")
                piece += part
                left -= len(part)
            digest.update(piece)
            done += len(piece)
            if kind in ("response", "revisit"):
                declared = warc["warc-payload-digest"].removeprefix("sha1:")
                so_far = base64.b32encode(digest.copy().digest()).decode()
                if kind == "response" and not left and so_far != declared:
                    raise ValueError(f"{warc['warc-record-id']}: the payload doesn't have the digest {declared}")
                revisit = kind == "revisit"
                yield (warc["warc-record-id"], number, page_of(warc["warc-record-id"]), kind, page_of(warc.get("warc-refers-to")), warc["warc-target-uri"], int(http["content-length"]) if revisit else done, declared if revisit else so_far, not left, bytes(piece) if with_payload else None)
            number += 1
            if not left:
                break


_COLUMNS = pa.schema([("record_id", pa.string()), ("chunk_no", pa.int32()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_()), ("chunk", pa.binary())])


def read_archives(spark: SparkSession, manifest: DataFrame, *, chunk_bytes: int = CHUNK_BYTES, with_payload: bool = True) -> DataFrame:
    """Chunk rows of every record of the listed files: record_id, chunk_no, page_id, record_type, refers_to, url, bytes_so_far, digest_so_far, last, chunk.

    A revisit has one row, with the size and digest of the payload it refers to. Responses are checked against their digest.
    """
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                filesystem, inner = _open_fs(path)
                with filesystem.open_input_stream(inner, compression=None) as raw:
                    rows, held = [], 0
                    for row in _records(raw, chunk_bytes, with_payload):
                        rows.append(row)
                        held += 200 + len(row[-1] or b"")
                        if held > 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    files = manifest.select("path").repartition(max(1, manifest.count()))
    return files.mapInArrow(run, "record_id string, chunk_no int, page_id long, record_type string, refers_to long, url string, bytes_so_far long, digest_so_far string, last boolean, chunk binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _COLUMNS, strict=True)], schema=_COLUMNS)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page as a record, read the archives back, and return what each record says."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    manifest = write_archives(spark, pages, fresh_path(spark, "warc"))
    chunks = read_archives(spark, manifest, with_payload=False)
    return chunks.filter("last").select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")


#: DuckDB has no base-32 encoder: the digest's 160 bits are cut into 32 groups of five and looked up.
OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: (['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'])[CAST(strpos('0123456789abcdef', hex[i]) AS INTEGER)]), '') AS bits FROM h),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * CAST(bits[5*i+1] AS INTEGER) + 8 * CAST(bits[5*i+2] AS INTEGER) + 4 * CAST(bits[5*i+3] AS INTEGER) + 2 * CAST(bits[5*i+4] AS INTEGER) + CAST(bits[5*i+5] AS INTEGER)]), '') AS payload_digest FROM b),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM f
"""
