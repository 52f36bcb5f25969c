"""Binary containers: point files, pose blobs and workbooks."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds on a workbook: bytes when unpacked, members, rows and columns.
BOOK_BYTES, BOOK_MEMBERS, BOOK_ROWS, BOOK_COLUMNS = 256 << 20, 512, 200_000, 512
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def parse_pose_blob(blob: bytes | None) -> list[float] | None:
    """Twelve little-endian floats of 48 bytes; null for anything else."""
    return list(struct.unpack("<12f", blob)) if blob is not None and len(blob) == 48 else None


def pose_of_blob(column: str) -> Column:
    """Twelve numbers of a pose blob, null where it hasn't 48 bytes; a batch is read as one buffer."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def parse(blobs: pd.Series) -> pd.Series:
        good = blobs.map(lambda b: b is not None and len(b) == 48).to_numpy(bool)
        out = np.full(len(blobs), None, object)
        for i, pose in zip(np.flatnonzero(good), np.frombuffer(b"".join(blobs[good]), "<f4").reshape(-1, 12).astype(float), strict=True):
            out[i] = pose
        return pd.Series(out)

    return parse(column)


def blob_of_pose(column: str) -> Column:
    @F.pandas_udf(T.BinaryType())
    def pack(poses: pd.Series) -> pd.Series:
        good = poses.notna().to_numpy()
        out = np.full(len(poses), None, object)
        if good.any():
            data = np.stack(poses[good].to_list()).astype("<f4").tobytes()
            out[good] = [data[i : i + 48] for i in range(0, len(data), 48)]
        return pd.Series(out)

    return pack(column)


#: Type numbers of matrices in a blob's trailer, with the kind of their elements.
MATRIX_KINDS = {0: "<u1", 2: "<u2", 4: "<i4", 5: "<f4", 6: "<f8"}


def pack_matrix(values: np.ndarray, rows: int, kind: int) -> bytes:
    """zlib data of a matrix, then rows, columns and type number as three 32-bit integers."""
    data = np.asarray(values).astype(MATRIX_KINDS[kind])
    return zlib.compress(data.tobytes()) + struct.pack("<3i", rows, len(data) // max(rows, 1), kind)


def unpack_matrix(blob: bytes | None) -> tuple[int, int, np.ndarray] | None:
    """(rows, columns, values) of a matrix blob; None for null, short, damaged or unknown ones."""
    if blob is None or len(blob) < 12:
        return None
    rows, cols, kind = struct.unpack("<3i", blob[-12:])
    try:
        data = np.frombuffer(zlib.decompress(blob[:-12]), MATRIX_KINDS[kind])
    except (zlib.error, KeyError, ValueError):
        return None
    return (rows, cols, data.astype(float)) if len(data) == rows * cols else None


def matrix_blob(column: str, rows: int, kind: int) -> Column:
    @F.pandas_udf(T.BinaryType())
    def pack(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else pack_matrix(v, rows, kind) for v in values])

    return pack(column)


def matrix_of_blob(column: str) -> Column:
    """Struct (rows, cols, values) of a matrix blob, null fields where it can't be read."""

    @F.pandas_udf("rows int, cols int, values array<double>")
    def unpack(blobs: pd.Series) -> pd.DataFrame:
        found = [unpack_matrix(b) or (None, None, None) for b in blobs]
        return pd.DataFrame({"rows": pd.array([f[0] for f in found], "Int32"), "cols": pd.array([f[1] for f in found], "Int32"), "values": [f[2] for f in found]})

    return unpack(column)


def parse_points(content: bytes) -> np.ndarray:
    """Points (x, y, z) of a PCD or ASCII PLY file, or of a bare file of 32-bit floats (x, y, z, intensity)."""
    head = content[:16]
    if head.startswith(b"ply"):
        end = content.index(b"end_header") + len(b"end_header")
        header = content[:end].decode("ascii", "replace")
        if "format ascii" not in header:
            raise ValueError("only ASCII PLY is read")
        count = int(re.search(r"element vertex (\d+)", header)[1])
        names = re.findall(r"property \w+ (\w+)", header.split("element vertex", 1)[1].split("element ", 1)[0])
        rows = content[end:].decode().split("\n", 1)[1].splitlines()[:count]
        table = np.array([r.split() for r in rows], float).reshape(count, -1)
        return table[:, [names.index(a) for a in "xyz"]]
    if b"FIELDS" in content[:512]:
        end = re.search(rb"DATA (\w+)\r?\n", content)
        header = dict(x.split(None, 1) for x in content[: end.start()].decode().splitlines() if x and not x.startswith("#"))
        names, count = header["FIELDS"].split(), int(header["POINTS"])
        if end[1] == b"ascii":
            table = np.array([r.split() for r in content[end.end() :].decode().splitlines()[:count]], float).reshape(count, -1)
            return table[:, [names.index(a) for a in "xyz"]]
        if end[1] != b"binary":
            raise ValueError("compressed PCD isn't read")
        kinds = [f"<{ {'F': 'f', 'I': 'i', 'U': 'u'}[t]}{s}" for t, s in zip(header["TYPE"].split(), header["SIZE"].split(), strict=True)]
        table = np.frombuffer(content, np.dtype(list(zip(names, kinds, strict=True))), count, end.end())
        return np.stack([table[a].astype(float) for a in "xyz"], 1)
    return np.frombuffer(content, "<f4").reshape(-1, 4)[:, :3].astype(float)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, x, y, z) of point files; points that are not finite stay and read as NaN."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                p = parse_points(bytes(content))
                for at in range(0, len(p), 100_000):
                    own = p[at : at + 100_000]
                    yield pd.DataFrame({"path": name, "idx": np.arange(at, at + len(own)), "x": own[:, 0], "y": own[:, 1], "z": own[:, 2]})

    return files.mapInPandas(run, "path string, idx long, x double, y double, z double")


def parse_workbook(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of every cell that has a value, within the bounds."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if len(z.infolist()) > BOOK_MEMBERS or sum(i.file_size for i in z.infolist()) > BOOK_BYTES:
            raise ValueError("the workbook is larger than allowed")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_NS}t")))
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in book.iter(f"{_NS}sheet"):
            target = rels[sheet.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")].lstrip("/")
            for cell in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_NS}c"):
                letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r")).groups()
                column = 0
                for c in letters:
                    column = column * 26 + ord(c) - 64
                if int(digits) > BOOK_ROWS or column > BOOK_COLUMNS:
                    raise ValueError("the sheet is larger than allowed")
                value, inline = cell.find(f"{_NS}v"), cell.find(f"{_NS}is")
                if cell.get("t") == "s" and value is not None:
                    yield sheet.get("name"), int(digits), column, shared[int(value.text)]
                elif inline is not None:
                    yield sheet.get("name"), int(digits), column, "".join(t.text or "" for t in inline.iter(f"{_NS}t"))
                elif value is not None and value.text is not None:
                    yield sheet.get("name"), int(digits), column, value.text


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, column, value) of the cells of workbooks; files in parallel, one file in one task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                cells = list(parse_workbook(bytes(content)))
                if cells:
                    out = pd.DataFrame(cells, columns=["sheet", "row", "column", "value"])
                    out.insert(0, "path", name)
                    yield out

    return files.mapInPandas(run, "path string, sheet string, row int, column int, value string")
