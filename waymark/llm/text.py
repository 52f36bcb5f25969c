"""Vectorised text primitives over Arrow string columns: blocks, word spans and 64-bit word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once by the NumPy kernels (a longer document makes a block of its own).
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Word bytes of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~_SPACE
#: Word bytes of ``[0-9A-Za-z]`` and everything from 0x80 on.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        with np.errstate(over="ignore"):
            _powers = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (_BASE, _INVERSE))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string or binary Arrow column; null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, data


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``limit`` bytes together; every row is in exactly one."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


class Words:
    """Words of a block of texts: byte spans, row of each word, first word of each row, and 64-bit hashes."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, at: int, end: int, table: np.ndarray = NOT_SPACE, fold: bool = False):
        lo, hi = int(offsets[at]), int(offsets[end])
        raw = data[lo:hi]
        self.raw = raw
        self.bytes = LOWER[raw] if fold else raw
        edge = offsets[at : end + 1] - lo
        self.edge = edge
        inside = np.zeros(len(raw) + 1, bool)
        inside[:-1] = table[raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cut = edge[1:-1]
        cut = cut[cut < len(raw)]
        first[cut] = inside[cut]
        self.start = np.flatnonzero(first)
        last = inside[:-1] & ~inside[1:]
        if len(cut):
            before = cut[cut > 0] - 1
            last[before] = inside[:-1][before]
        self.stop = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, edge)  # n rows + 1
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(end - at), self.count)
        self._sums: np.ndarray | None = None

    def span_hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Mixed polynomial hashes of byte spans; equal bytes give equal hashes wherever they stand."""
        up, down = _power_tables(len(self.bytes) + 1)
        with np.errstate(over="ignore"):
            if self._sums is None:
                self._sums = np.zeros(len(self.bytes) + 1, np.uint64)
                np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * up[: len(self.bytes)], out=self._sums[1:])
            return mix((self._sums[stop] - self._sums[start]) * down[start])

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.stop)


def grams(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Order-sensitive hash of each run of k consecutive word hashes (the caller drops runs that cross rows)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, seed + 0x632BE59BD9B4E019, np.uint64)
        for j in range(k):
            out = (out ^ hashes[j : j + n]) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
        return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w consecutive values, by doubling."""
    done = 1
    while done < w:
        step = min(done, w - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x
