"""Secret scanning: fixed rules, and a character convolutional network over every other candidate and what surrounds it.

Rules find assignments to names such as ``token``, access keys and long hexadecimal runs; what they find always stays. A
candidate is any run of the characters of secrets, 8 or longer, with a digit, after an assignment sign, or with letter case changing at least
three times in 16 characters or more. The network sees the candidate with 16 bytes on either side: bytes are embedded with
a mark of what is inside the candidate, convolved over five bytes, and pooled (largest and mean inside, largest
outside) however long the candidate is; a hidden layer gives the logit. All of it is NumPy.

It is trained on labelled findings: all candidates of the corpus, labelled by whether a rule found them, or labelled windows
given by the caller. Half of the positive ones are shown with their value redrawn from other alphabets of secrets, or in the
surroundings of a negative one, so that neither one alphabet nor one wording is what is learnt. A quarter of the findings calibrates: a
logistic fit of logits to labels gives probabilities, and for each range of lengths the threshold is the highest one
that still keeps ``recall`` of the calibration's positives.

Every finding takes part in training, windows of any length included; equal windows of one label are one finding. Findings are dealt by
hash into groups of bounded size; in each epoch every group goes on from the same weights, and the weights it ends with are averaged
by Spark, each group counting by its findings. The fit of the logits is Newton's method on sums over all calibrating findings, the
thresholds are exact order statistics of all of them, so only weights and sums reach the driver. Scanning has no shuffle.

Defined edge cases: null texts are empty and have no span; repeated rows are scanned each; text of any length is scanned whole;
where fewer than 8 positive or negative findings are known there is no network, and only the rules find; an empty table gives
an empty result. Spans are in code points, the end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.text import Words, blocks, column_bytes
from waymark.session import fresh_path, materialize, prepare

#: The rules, on bytes; the first one on texts with A-Z lower-cased. Kinds in the order of output.
ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "model")
ASSIGN_VALUE, ACCESS_LENGTH = 8, 16

LEAST, CONTEXT, WIDTH = 8, 16, 5
#: Size of a group of findings that one task trains on, and what each counts beside its bytes.
GROUP_BYTES, FINDING_BYTES = 4 << 20, 1000
#: Bytes of windows after which a batch of findings ends.
BATCH_BYTES = 1 << 20
EMBED, FILTERS, HIDDEN = 8, 24, 16
#: Positions convolved together when scanning.
SLAB = 1 << 16
#: Lengths at which ranges with thresholds of their own begin.
RANGES = (0, 16, 32)
RECALL = 0.98
ALPHABETS = (b"0123456789abcdef", b"0123456789ABCDEF", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)), bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + b"+/_-")

_ALPHABET = np.zeros(256, bool)
_ALPHABET[list(ALPHABETS[-1] + b".=")] = True
_DIGIT = np.zeros(256, np.int32)
_DIGIT[0x30:0x3A] = 1
_UPPER, _LOWER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LOWER[0x61:0x7B] = True
_PAD, _SYMBOLS = 129, 130
SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"


def rule_spans(text: bytes) -> list[tuple[int, int, int, int, int]]:
    """(kind, start, end, value start, value end) in bytes of what the rules find, leftmost and non-overlapping for each kind."""
    out = [(0, m.start(), m.end(), m.start(1), m.end(1)) for m in ASSIGN.finditer(text.lower()) if m.end(1) - m.start(1) >= ASSIGN_VALUE]
    out += [(1, *m.span(), *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    return out + [(2, *m.span(), *m.span()) for m in HEX.finditer(text)]


def candidates(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) in bytes of the block of the candidates of all rows, full stops at their ends left out."""
    start, stop = w.start, w.stop
    long = stop - start >= LEAST
    start, stop = start[long], stop[long]
    dots = w.raw == 0x2E
    at = np.arange(len(w.raw))
    last = np.maximum.accumulate(np.where(dots, -1, at)) if len(at) else at
    stop = np.maximum(last[stop - 1] + 1, start) if len(stop) else stop
    ahead = np.minimum.accumulate(np.where(dots, len(at), at)[::-1])[::-1] if len(at) else at
    start = np.minimum(ahead[start], stop) if len(start) else start
    digits = np.concatenate([[0], np.cumsum(_DIGIT[w.raw])])
    turn = np.zeros(len(w.raw) + 1, np.int64)
    upper, lower = _UPPER[w.raw], _LOWER[w.raw]
    turn[1:-1] = np.cumsum((upper[1:] & lower[:-1]) | (lower[1:] & upper[:-1])) if len(w.raw) > 1 else 0
    turn[-1] = turn[-2] if len(turn) > 1 else 0
    size = stop - start
    able = digits[stop] > digits[start]
    able |= (size >= 16) & (turn[np.maximum(stop - 1, 0)] - turn[start] >= 3)
    edge = w.edge[np.searchsorted(w.edge, start, side="right") - 1]
    before = np.maximum(start - 1, edge)
    for _ in range(2):  # a quote and a space may stand between the sign and the candidate
        before = np.where(np.isin(w.raw[before], [0x20, 0x22, 0x27]), np.maximum(before - 1, edge), before)
    able |= np.isin(w.raw[before], [0x3A, 0x3D]) & (start > edge)
    able &= size >= LEAST
    return start[able], stop[able]


@dataclass
class Windows:
    """Bytes of windows one after another, where each begins, and of each its candidate's place."""

    data: np.ndarray
    first: np.ndarray
    lead: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple[bytes, int, int]]) -> Windows:
        """From (window, bytes before the candidate, bytes of the candidate)."""
        ends = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])]).astype(np.int64)
        return cls(np.frombuffer(b"".join(p[0] for p in parts), np.uint8), ends, np.array([p[1] for p in parts], np.int64), np.array([p[2] for p in parts], np.int64))

    @classmethod
    def cut(cls, raw: np.ndarray, edge: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Windows:
        """Around the candidates of a block, within their rows."""
        row = np.searchsorted(edge, start, side="right") - 1
        lo, hi = np.maximum(start - CONTEXT, edge[row]), np.minimum(stop + CONTEXT, edge[row + 1])
        ends = np.concatenate([[0], np.cumsum(hi - lo)])
        return cls(raw[np.repeat(lo - ends[:-1], hi - lo) + np.arange(ends[-1])], ends, start - lo, stop - start)

    def take(self, ids: np.ndarray) -> Windows:
        size = np.diff(self.first)[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        return Windows(self.data[np.repeat(self.first[ids] - ends[:-1], size) + np.arange(ends[-1])], ends, self.lead[ids], self.size[ids])

    def padded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, inside, window) of each position, two pads at either end of each window (window -1)."""
        n, half = len(self.lead), WIDTH // 2
        size = np.diff(self.first)
        symbol = np.full(len(self.data) + 2 * half * n, _PAD)
        at = np.arange(len(self.data)) + half * (2 * np.repeat(np.arange(n), size) + 1)
        symbol[at] = np.minimum(self.data, 128)
        owner = np.full(len(symbol), -1)
        owner[at] = np.repeat(np.arange(n), size)
        place = np.arange(len(self.data)) - np.repeat(self.first[:-1] + self.lead, size)
        inside = np.zeros(len(symbol), bool)
        inside[at] = (place >= 0) & (place < np.repeat(self.size, size))
        return symbol, inside, owner


def _pooled(y: np.ndarray, rows: np.ndarray, ufunc: np.ufunc, into: np.ndarray) -> np.ndarray:
    """Positions of ``y`` gathered into their windows, whose numbers stand in order."""
    if len(rows):
        cut = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        into[rows[cut]] = ufunc(into[rows[cut]], ufunc.reduceat(y, cut, axis=0))
    return into


class Network:
    """Embedding, one convolution, pooling, one hidden layer."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(size=shape).astype(np.float32) / np.float32(np.sqrt(shape[-1] if len(shape) == 1 else np.prod(shape[:-1])))
        self.p = {"e": rng.normal(size=(_SYMBOLS, EMBED)).astype(np.float32) * np.float32(0.3), "k": draw(WIDTH, EMBED + 1, FILTERS), "b": np.zeros(FILTERS, np.float32), "w": draw(3 * FILTERS, HIDDEN), "c": np.zeros(HIDDEN, np.float32), "v": draw(HIDDEN), "d": np.zeros(1, np.float32)}
        self.m, self.s = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        self.step = 0.0

    def state(self) -> np.ndarray:
        """Weights, moments and number of steps as one vector."""
        return np.concatenate([*(v.ravel() for part in (self.p, self.m, self.s) for v in part.values()), [self.step]]).astype(np.float64)

    def resume(self, state: np.ndarray) -> Network:
        at = 0
        for part in (self.p, self.m, self.s):
            for k, v in part.items():
                part[k] = state[at : at + v.size].reshape(v.shape).astype(np.float32)
                at += v.size
        self.step = float(state[at])
        return self

    def _embedded(self, symbol: np.ndarray, inside: np.ndarray) -> np.ndarray:
        return np.concatenate([self.p["e"][symbol], inside[:, None].astype(np.float32)], 1)

    def _convolved(self, x: np.ndarray) -> np.ndarray:
        n = len(x) - WIDTH + 1
        return np.maximum(sum(x[o : o + n] @ self.p["k"][o] for o in range(WIDTH)) + self.p["b"], 0)

    def logits(self, windows: Windows) -> np.ndarray:
        """Of any number of windows of any length, a slab of positions at a time."""
        n, half = len(windows.lead), WIDTH // 2
        symbol, inside, owner = windows.padded()
        best, total, around = (np.zeros((n, FILTERS), np.float32) for _ in range(3))
        for at in range(half, len(symbol) - half, SLAB):
            end = min(at + SLAB, len(symbol) - half)
            y = self._convolved(self._embedded(symbol[at - half : end + half], inside[at - half : end + half]))
            own, within = owner[at:end], inside[at:end]
            for mask, into, ufunc in ((within, best, np.maximum), (within, total, np.add), (~within & (own >= 0), around, np.maximum)):
                _pooled(y[mask], own[mask], ufunc, into)
        feats = np.concatenate([best, total / np.maximum(windows.size, 1)[:, None].astype(np.float32), around], 1)
        return (np.maximum(feats @ self.p["w"] + self.p["c"], 0) @ self.p["v"] + self.p["d"]).astype(np.float64)

    def gradient(self, windows: Windows, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean logistic loss and its gradient; the largest of a window passes its share on to every position that has it.

        Like logits it takes a slab of positions at a time, so a window may have any length; what one slab holds is kept, otherwise it is computed again.
        """
        n, half, p = len(label), WIDTH // 2, self.p
        symbol, inside, owner = windows.padded()

        def slab(at: int) -> tuple:
            end = min(at + SLAB, len(symbol) - half)
            x = self._embedded(symbol[at - half : end + half], inside[at - half : end + half])
            own, within = owner[at:end], inside[at:end]
            return symbol[at - half : end + half], x, self._convolved(x), own, (within, ~within & (own >= 0))

        starts = range(half, len(symbol) - half, SLAB)
        kept = [slab(at) for at in starts] if len(starts) == 1 else None

        def slabs() -> Iterator[tuple]:
            return iter(kept) if kept is not None else map(slab, starts)

        top, count = ([np.zeros((n, FILTERS), p["k"].dtype) for _ in range(2)] for _ in range(2))
        mean = np.zeros((n, FILTERS), p["k"].dtype)
        for _, _, y, own, masks in slabs():
            for k, mask in enumerate(masks):
                _pooled(y[mask], own[mask], np.maximum, top[k])
            _pooled(y[masks[0]], own[masks[0]], np.add, mean)
        for _, _, y, own, masks in slabs():
            for k, mask in enumerate(masks):
                _pooled((y[mask] == top[k][own[mask]]).astype(y.dtype), own[mask], np.add, count[k])
        size = np.maximum(windows.size, 1)[:, None].astype(np.float32)
        z = np.concatenate([top[0], mean / size, top[1]], 1)
        h = np.maximum(z @ p["w"] + p["c"], 0)
        logit = h @ p["v"] + p["d"]
        prob = 1 / (1 + np.exp(-logit))
        loss = float(np.mean(np.logaddexp(0, np.where(label == 1, -logit, logit))))
        g = ((prob - label) / n).astype(np.float32)
        gh = g[:, None] * p["v"] * (h > 0)
        gz = gh @ p["w"].T
        shares = [part / np.maximum(c, 1) for part, c in zip((gz[:, :FILTERS], gz[:, 2 * FILTERS :]), count, strict=True)]
        even = gz[:, FILTERS : 2 * FILTERS] / size
        gk, gb = np.zeros_like(p["k"]), np.zeros_like(p["b"])
        ge = np.zeros((_SYMBOLS, EMBED))
        for symbols, x, y, own, masks in slabs():
            gy = masks[0][:, None] * even[own]
            for k, mask in enumerate(masks):
                gy += ((y == top[k][own]) & mask[:, None]) * shares[k][own]
            gy *= y > 0
            gx = np.zeros_like(x)
            for o in range(WIDTH):
                gk[o] += x[o : o + len(y)].T @ gy
                gx[o : o + len(y)] += gy @ p["k"][o].T
            gb += gy.sum(0)
            for j in range(EMBED):
                ge[:, j] += np.bincount(symbols, weights=gx[:, j], minlength=_SYMBOLS)
        return loss, {"e": ge.astype(np.float32), "k": gk, "b": gb, "w": z.T @ gh, "c": gh.sum(0), "v": h.T @ g, "d": g.sum(keepdims=True)}

    def fit(self, windows: Windows, label: np.ndarray, *, epochs: int = 10, batch: int = 64, rate: float = 0.01, seed: int = 4) -> Network:
        """Adam over shuffled batches, from the moments that the network has."""
        rng, m, s = np.random.default_rng(seed), self.m, self.s
        for _ in range(epochs):
            order = rng.permutation(len(label))
            filled = np.cumsum(np.diff(windows.first)[order]) // BATCH_BYTES
            cuts = np.flatnonzero((np.arange(len(order)) % batch == 0) | (np.diff(filled, prepend=0) > 0))
            for at, end in zip(cuts, [*cuts[1:], len(order)], strict=True):
                ids = order[at:end]
                _, g = self.gradient(windows.take(ids), label[ids])
                self.step += 1
                for k, v in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.99 * s[k] + 0.01 * v * v
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**self.step)) / (np.sqrt(s[k] / (1 - 0.99**self.step)) + 1e-6)).astype(np.float32)
        return self


@dataclass
class Model:
    """A network, the calibration of its logits, and the least probability of a secret for each range of lengths."""

    network: Network
    slope: float
    offset: float
    thresholds: tuple[float, ...]

    def probability(self, windows: Windows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.network.logits(windows) + self.offset, -50, 50)))

    def accepts(self, windows: Windows, probability: np.ndarray) -> np.ndarray:
        return probability >= np.array(self.thresholds)[np.searchsorted(RANGES, windows.size, side="right") - 1]


def platt(sums: Callable[[np.ndarray, float, tuple[float, float]], np.ndarray], pos: int, neg: int, scale: float, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic fit, with targets a little inside 0 and 1 (Platt), by Newton's method.

    ``sums`` gives, for weights of x = logit / scale and 1 and for the targets of both labels, the sums of vxx, vx, v, rx and r over
    all findings, v = p (1 - p) and r = target - p.
    """
    scale = max(scale, 1e-9)
    w = np.zeros(2)
    for _ in range(rounds):
        vxx, vx, v, rx, r = sums(w, scale, (1 / (neg + 2), (pos + 1) / (pos + 2)))
        step = np.linalg.solve(np.array([[vxx, vx], [vx, v]]) + 1e-4 * np.eye(2), np.array([rx, r]) - 1e-4 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def calibrate(logit: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """:func:`platt` of logits and labels at hand."""

    def sums(w: np.ndarray, scale: float, targets: tuple[float, float]) -> np.ndarray:
        x = logit / scale
        p = 1 / (1 + np.exp(-np.clip(x * w[0] + w[1], -50, 50)))
        v, r = p * (1 - p), np.array(targets)[label] - p
        return np.array([(v * x * x).sum(), (v * x).sum(), v.sum(), (r * x).sum(), r.sum()])

    return platt(sums, int((label == 1).sum()), int((label == 0).sum()), float(np.abs(logit).max()), rounds)


def recall_thresholds(probability: np.ndarray, size: np.ndarray, label: np.ndarray, recall: float, least: int = 20) -> tuple[float, ...]:
    """For each range of lengths the highest threshold that keeps the recall; of a range with few positives that of all, and 0.5 at least."""
    part = np.searchsorted(RANGES, size, side="right") - 1

    def highest(p: np.ndarray) -> float:
        return float(np.sort(p)[int(np.floor((1 - recall) * len(p)))])

    whole = highest(probability[label == 1])
    own = [probability[(label == 1) & (part == k)] for k in range(len(RANGES))]
    return tuple(max(0.5, highest(p) if len(p) >= least else whole) for p in own)


def varied(parts: list[tuple[bytes, int, int]], label: np.ndarray, seed: int = 6) -> list[tuple[bytes, int, int]]:
    """For each positive window one whose value is redrawn from an alphabet of secrets; every other one also gets the surroundings of a negative one."""
    rng = np.random.default_rng(seed)
    plain = [p for p, y in zip(parts, label, strict=True) if y == 0]
    out = []
    for i, (window, lead, size) in enumerate(p for p, y in zip(parts, label, strict=True) if y == 1):
        letters = np.frombuffer(ALPHABETS[int(rng.integers(len(ALPHABETS)))], np.uint8)
        length = size if i % 3 else int(rng.integers(16, 65))
        value = letters[rng.integers(0, len(letters), length)].tobytes()
        around, before, inner = plain[int(rng.integers(len(plain)))] if i % 2 and plain else (window, lead, size)
        out.append((around[:before] + value + around[before + inner :], before, length))
    return out


def train(parts: list[tuple[bytes, int, int]], label: np.ndarray, *, recall: float = RECALL, epochs: int = 10) -> Model | None:
    """From labelled windows (bytes, bytes before the candidate, bytes of the candidate); every fourth, by its bytes' hash, calibrates."""
    if min((label == 1).sum(), (label == 0).sum()) < 8:
        return None
    held = np.array([xxhash.xxh3_64_intdigest(p[0], 9) % 4 == 0 for p in parts])
    if len(set(label[held])) < 2 or len(set(label[~held])) < 2:
        held = np.arange(len(parts)) % 4 == 0
        held[[int(np.flatnonzero(label == y)[0]) for y in (0, 1)]] = True
        held[[int(np.flatnonzero(label == y)[-1]) for y in (0, 1)]] = False

    def with_varied(keep: np.ndarray) -> tuple[Windows, np.ndarray]:
        own = [p for p, k in zip(parts, keep, strict=True) if k]
        more = varied(own, label[keep])
        return Windows.of(own + more), np.concatenate([label[keep], np.ones(len(more), label.dtype)])

    network = Network().fit(*with_varied(~held), epochs=epochs)
    windows, y = with_varied(held)
    logit = network.logits(windows)
    model = Model(network, *calibrate(logit, y), ())
    model.thresholds = recall_thresholds(model.probability(windows), windows.size, y, recall)
    return model


def _scan(texts: pa.Array) -> Iterator[tuple[int, int, Words, list[tuple], np.ndarray, np.ndarray]]:
    """(first row, end, block, rule spans as (row, kind, start, end, value start, value end) in the block's bytes, other candidates)."""
    offsets, data = column_bytes(texts)
    for at, end in blocks(offsets):
        w = Words(offsets, data, at, end, table=_ALPHABET)
        found = []
        for row in range(end - at):
            lo, hi = int(w.edge[row]), int(w.edge[row + 1])
            if hi - lo >= LEAST:
                found += [(row, k, *(lo + x for x in span)) for k, *span in rule_spans(w.raw[lo:hi].tobytes())]
        covered = np.zeros(len(w.raw) + 1, np.int64)
        for f in found:
            covered[f[2]] += 1
            covered[f[3]] -= 1
        covered = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
        start, stop = candidates(w)
        free = covered[stop] == covered[start]
        yield at, end, w, found, start[free], stop[free]


def labelled_windows(docs: DataFrame, *, text: str = "text", per_class: int | None = None) -> DataFrame:
    """(label, h, held, lead, size, window): candidates of all rows, labelled by the rules; ``held`` ones calibrate.

    For callers that want a few only, ``per_class`` takes of each task those of smallest hash of each label.
    """
    names = ["label", "h", "held", "lead", "size", "window"]
    kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()]

    def batch_of(rows: Iterable[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[set] = [set(), set()]
        for batch in batches:
            for _, _, w, found, start, stop in _scan(batch.column(0)):
                value = np.array([f[4:] for f in found], np.int64).reshape(-1, 2)
                for y, (a, b) in enumerate(((start, stop), (value[:, 0], value[:, 1]))):
                    windows = Windows.cut(w.raw, w.edge, a, b)
                    for i in range(len(a)):
                        part = windows.data[windows.first[i] : windows.first[i + 1]].tobytes()
                        kept[y].add((y, xxhash.xxh3_64_intdigest(part) >> 1, xxhash.xxh3_64_intdigest(part, 9) % 4 == 0, int(windows.lead[i]), int(windows.size[i]), part))
                    if per_class is None:
                        if kept[y]:
                            yield batch_of(kept[y])
                        kept[y] = set()
                    elif len(kept[y]) > 4 * per_class:
                        kept[y] = set(sorted(kept[y])[:per_class])
        for own in kept:
            if own:
                yield batch_of(sorted(own)[:per_class])

    return docs.select(text).mapInArrow(run, "label int, h long, held boolean, lead int, size int, window binary")


def _parts(table: pa.Table) -> tuple[list[tuple[bytes, int, int]], np.ndarray]:
    """Windows and labels of a group of findings and of what :func:`varied` adds, in an order of their own."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("h", "window", "lead", "size", "label")), strict=True))
    label = np.array([r[4] for r in rows], np.int64)
    own = [r[1:4] for r in rows]
    more = varied(own, label, seed=6 + table.column("part")[0].as_py())
    return own + more, np.concatenate([label, np.ones(len(more), np.int64)])


def _epoch(sent: Broadcast, epoch: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        parts, label = _parts(table)
        part = table.column("part")[0].as_py()
        own = Network().resume(sent.value).fit(Windows.of(parts), label, epochs=1, seed=4 + epoch + 1000 * part)
        return pa.table({"part": pa.array([part], pa.int64()), "n": pa.array([len(parts)], pa.int64()), "state": pa.array([own.state()], pa.list_(pa.float64()))})

    return run


def _fit(spark: SparkSession, findings: DataFrame, *, epochs: int) -> Network:
    """A network of all ``findings`` (part, h, lead, size, window, label): an epoch in each part, then the mean of their weights."""
    network = Network()
    for epoch in range(epochs):
        sent = spark.sparkContext.broadcast(network.state())  # a fixed number of weights
        ends = findings.groupBy("part").applyInArrow(_epoch(sent, epoch), "part long, n long, state array<double>")
        # summed in the order of the parts, so that another run gives the same weights
        each = ends.select("part", "n", F.posexplode("state").alias("i", "x")).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("part", "n", "x"))).alias("g"))
        mean = F.aggregate("g", F.lit(0.0), lambda a, r: a + r["n"] * r["x"]) / F.aggregate("g", F.lit(0).cast("long"), lambda a, r: a + r["n"])
        network.resume(np.array([r["x"] for r in each.select("i", mean.alias("x")).orderBy("i").collect()]))
        sent.destroy()
    return network


def _probability(slope: float, offset: float) -> Column:
    z = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.col("logit") * slope + offset))
    return 1 / (1 + F.exp(-z))


def kth_smallest(values: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The value with exactly ``k`` before it in order: bins are counted, and the one it lies in is cut again."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    while low < high:
        place = F.least(F.floor((F.col(column) - low) / F.lit(high - low) * bins), F.lit(bins - 1))
        found = values.filter(F.col(column).between(low, high)).groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy("b").collect()
        for r in found:
            if k < r["n"]:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
    return float(low)


def _thresholds(scores: DataFrame, recall: float, least: int = 20) -> tuple[float, ...]:
    """:func:`recall_thresholds` of all positive rows of (size, label, p), by exact order statistics."""
    pos = scores.filter("label = 1").select("p", sum((F.col("size") >= r).cast("int") for r in RANGES[1:]).alias("range"))
    count = {r["range"]: r["n"] for r in pos.groupBy("range").agg(F.count("*").alias("n")).collect()}

    def highest(rows: DataFrame, n: int) -> float:
        return kth_smallest(rows, "p", int(np.floor((1 - recall) * n)))

    whole = highest(pos, sum(count.values()))
    return tuple(max(0.5, highest(pos.filter(F.col("range") == k), count[k]) if count.get(k, 0) >= least else whole) for k in range(len(RANGES)))


def train_on_rules(spark: SparkSession, docs: DataFrame, *, text: str = "text", recall: float = RECALL, epochs: int = 10, group_bytes: int = GROUP_BYTES) -> Model | None:
    """A model of all candidates of ``docs``, labelled by the rules: every finding is fitted or, every fourth by its hash, calibrates."""
    prepare(spark)
    found = materialize(spark, labelled_windows(docs, text=text).distinct(), "findings", path=fresh_path(spark, "findings"))
    facts = found.groupBy("label").agg(F.count("*").alias("n"), F.count_if("held").alias("held"), F.min("h").alias("h"), F.sum(F.octet_length("window") + F.lit(FINDING_BYTES)).alias("size")).collect()
    if len(facts) < 2 or min(r["n"] for r in facts) < 8:
        return None
    # a label whose findings all stand on one side has one moved to the other
    moved = [(F.col("label") == r["label"]) & (F.col("h") == r["h"]) for r in facts if r["held"] in (0, r["n"])]
    for m in moved:
        found = found.withColumn("held", F.col("held") != m)
    groups = -(-sum(r["size"] for r in facts) // group_bytes)
    found = found.withColumn("part", F.pmod("h", F.lit(groups)))
    network = _fit(spark, found.filter("not held").drop("held"), epochs=epochs)
    sent = spark.sparkContext.broadcast(network)

    def score(table: pa.Table) -> pa.Table:
        parts, label = _parts(table)
        windows = Windows.of(parts)
        return pa.table({"label": pa.array(label, pa.int32()), "size": pa.array(windows.size), "logit": pa.array(sent.value.logits(windows))})

    scores = found.filter("held").drop("held").groupBy("part").applyInArrow(score, "label int, size long, logit double")
    scores = materialize(spark, scores, "scores", path=fresh_path(spark, "scores"))
    pos, neg, scale = scores.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0), F.max(F.abs("logit"))).first()

    def sums(w: np.ndarray, scale: float, targets: tuple[float, float]) -> np.ndarray:
        x = F.col("logit") / scale
        p = _probability(float(w[0] / scale), float(w[1]))
        t = F.when(F.col("label") == 1, targets[1]).otherwise(targets[0])
        rows = scores.select(x.alias("x"), (p * (1 - p)).alias("v"), (t - p).alias("r"))
        return np.array(rows.agg(*map(F.sum, (F.col("v") * F.col("x") * F.col("x"), F.col("v") * F.col("x"), F.col("v"), F.col("r") * F.col("x"), F.col("r")))).first())

    slope, offset = platt(sums, pos, neg, scale)
    return Model(network, slope, offset, _thresholds(scores.withColumn("p", _probability(slope, offset)), recall))


def scan_secrets(spark: SparkSession, docs: DataFrame, model: Model | None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans): what rules and network find, by start, then kind; rule spans have score 1."""
    prepare(spark)
    kind = docs.schema[key].dataType.simpleString()
    sent = spark.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, w, found, start, stop in _scan(batch.column(1)):
                points = np.concatenate([[0], np.cumsum((w.raw & 0xC0) != 0x80)])
                spans = [(row, a, k, b, 1.0) for row, k, a, b, _, _ in found]
                if sent.value and len(start):
                    windows = Windows.cut(w.raw, w.edge, start, stop)
                    p = sent.value.probability(windows)
                    yes = np.flatnonzero(sent.value.accepts(windows, p))
                    row = np.searchsorted(w.edge, start[yes], side="right") - 1
                    spans += zip(row.tolist(), start[yes].tolist(), [3] * len(yes), stop[yes].tolist(), p[yes].tolist(), strict=True)
                spans.sort()
                base = points[w.edge]
                rows = np.array([s[0] for s in spans], np.int64)
                fields = [pa.array([KINDS[s[2]] for s in spans], pa.string()), *(pa.array(points[np.array([s[j] for s in spans], np.int64)] - base[rows]) for j in (1, 3)), pa.array([s[4] for s in spans], pa.float64())]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(end - at + 1)), pa.int32()), pa.StructArray.from_arrays(fields, names=["kind", "start", "end", "score"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), lists], names=[key, "spans"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, spans {SPANS}")


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document of ``documents``, with counts and a digest of what the rules find."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan_secrets(spark, docs, train_on_rules(spark, docs))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(_text_of(base).cast("binary"), 256).alias("base_sha256"), _text_of(F.col("spans")).alias("spans"))
