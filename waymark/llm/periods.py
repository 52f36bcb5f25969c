"""Periodic runs of words: maximal repetitions of each document, by names of power-of-two windows.

A run is a stretch of words with smallest period q and at least max(least, 2q) words that no neighbouring word extends. Windows
of 1, 2, 4, ... words of a document get names (Karp, Miller, Rosenberg): equal windows, and only those, have equal ones,
a window's name being the rank of the names of its halves. The longest common extension of two positions is found by
descending the levels: where names are equal, both move on by the level's width. No hashes of windows and no suffix sorting.

Candidates lie on a grid. A run of period q has at least m = max(q, least - q) consecutive words that equal the word q
further on, so of every m - w + 1 positions one starts a window of w words, the largest power of two up to (m + 1) / 2, that lies within
them and has the name of the window q further on. Such candidates are extended both ways to the whole run. A stretch found
with several periods is the run of its smallest. A document needs no level above the first at which no name occurs twice in it,
and no period whose windows are of such a level, so plain prose costs two or three levels and a handful of periods.

Rows are worked on in blocks of texts; the grids of n words have n log n positions, taken a million at a time. No shuffle.

Defined edge cases: null texts have no words, no run and an empty collapsed text; repeated rows are judged each by itself;
a text of any length is one document; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.text import Words, blocks, column_bytes
from waymark.session import prepare

LEAST = 12
#: Grid positions looked at together.
GRID = 1 << 20
RUNS = "array<struct<start:long,length:long,period:long>>"


def _names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rank of each pair: equal pairs, and only those, get the same number."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].reshape(-1)


class Named:
    """Words of some documents, each between two marks that equal nothing, and the names of their windows by level."""

    def __init__(self, first: np.ndarray, levels: list[np.ndarray]):
        self.first, self.levels = first, levels  # where each document's words begin, and the end of all; a mark stands before each

    @classmethod
    def of(cls, words: np.ndarray, count: np.ndarray) -> Named:
        """``words``: a number for each word of documents of ``count`` words, one after another."""
        first = np.concatenate([[0], np.cumsum(count + 1)]) + 1
        at = np.full(int(first[-1]), -1)
        inside = np.ones(len(at), bool)
        inside[first - 1] = False
        at[inside] = words
        doc = np.cumsum(~inside) - 1
        name = _names(doc, np.where(inside, at, 0))
        name[~inside] = len(at) + np.arange(len(first))
        return cls(first, [name])

    def double(self) -> np.ndarray:
        """Names of windows twice as wide; those that would leave the array are marked by -1 in their second half."""
        name = self.levels[-1]
        width = 1 << (len(self.levels) - 1)
        after = np.concatenate([name[width:], np.full(min(width, len(name)), -1)])
        return _names(name, after + 1)

    def repeating(self, name: np.ndarray) -> np.ndarray:
        """For each document, whether a name occurs twice in it."""
        again = np.bincount(name)[name] > 1
        return np.add.reduceat(np.concatenate([again, [False]]), self.first[:-1] - 1) > 0

    def take(self, docs: np.ndarray) -> Named:
        """Only the documents marked in ``docs``."""
        size = np.diff(self.first)
        keep = np.concatenate([np.repeat(docs, size), [True]])
        first = np.concatenate([[0], np.cumsum(size[docs])]) + 1
        return Named(first, [x[keep] for x in self.levels])

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b, name = i + out, j + out, self.levels[k]
            out += np.where(name[a] == name[b], 1 << k, 0)
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b, name = i - out - (1 << k), j - out - (1 << k), self.levels[k]
            out += np.where((a >= 0) & (name[np.maximum(a, 0)] == name[np.maximum(b, 0)]), 1 << k, 0)
        return out


def _window_level(period: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each period the level of its windows and the step of its grid."""
    same = np.maximum(period, least - period)
    level = np.frexp((same + 1) // 2)[1] - 1
    return level, same - (1 << level) + 1


def _grid_runs(names: Named, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the stretches found from the grids of all periods, as positions of ``names``."""
    n = np.diff(names.first) - 1
    n[n < least] = 0
    periods = np.arange(1, int(n.max(initial=0)) // 2 + 1)
    level, step = _window_level(periods, least)
    periods, level, step = (x[level < len(names.levels)] for x in (periods, level, step))
    out = [np.zeros((0, 3), np.int64)]
    if not len(periods):
        return tuple(out[0].T)
    # documents by length, so that those long enough for a period are a tail of the order
    order = np.argsort(n, kind="stable")
    from_ = np.searchsorted(n[order], 2 * periods)
    fits = len(order) - from_
    at = 0
    while at < len(periods):  # periods whose grids make about GRID positions together
        total = np.cumsum(_grid_size(n[order], from_, periods, level, step, at))
        end = at + max(1, int(np.searchsorted(total, GRID)))
        pick = np.repeat(np.arange(at, min(end, len(periods))), fits[at:end])
        doc = order[np.arange(len(pick)) - np.repeat(np.cumsum(fits[at:end]) - fits[at:end], fits[at:end]) + from_[pick]]
        many = np.maximum((n[doc] - periods[pick] - (1 << level[pick])) // step[pick] + 1, 0)
        for lo, hi in _pieces(many):
            own = np.repeat(np.arange(lo, hi), many[lo:hi])
            k = np.arange(len(own)) - np.repeat(np.cumsum(many[lo:hi]) - many[lo:hi], many[lo:hi])
            q = pick[own]
            i = names.first[doc[own]] + k * step[q]
            out.append(_extend(names, i, periods[q], level[q], least))
            if sum(map(len, out)) > GRID:
                out = [_smallest_period(np.concatenate(out))]
        at = end
    return tuple(_smallest_period(np.concatenate(out)).T)


def _smallest_period(found: np.ndarray) -> np.ndarray:
    """Of the rows (start, end, period) of each stretch the one with the smallest period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    return found[first]


def _grid_size(sorted_n: np.ndarray, from_: np.ndarray, periods: np.ndarray, level: np.ndarray, step: np.ndarray, at: int) -> np.ndarray:
    """Upper bounds of the positions of the grids of periods from ``at`` on, as far as they are needed."""
    end = min(len(periods), at + 4096)
    words = np.concatenate([np.cumsum(sorted_n[::-1])[::-1], [0]])
    return words[from_[at:end]] // step[at:end] + len(sorted_n) - from_[at:end]


def _pieces(many: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of grids of about GRID positions (a larger grid makes a range of its own)."""
    total = np.concatenate([[0], np.cumsum(many)])
    at = 0
    while at < len(many):
        end = max(at + 1, int(np.searchsorted(total, total[at] + GRID, side="right")) - 1)
        yield at, end
        at = end


def _extend(names: Named, i: np.ndarray, period: np.ndarray, level: np.ndarray, least: int) -> np.ndarray:
    """Stretches through the grid positions whose windows have equal names, each with one period."""
    hit = np.zeros(len(i), bool)
    for k in np.unique(level):
        at = np.flatnonzero(level == k)
        hit[at] = names.levels[k][i[at]] == names.levels[k][i[at] + period[at]]
    i, q = i[hit], period[hit]
    start = i - names.backward(i, i + q)
    end = i + q + names.forward(i, i + q)
    long = end - start >= np.maximum(least, 2 * q)
    return _smallest_period(np.stack([start, end, q], 1)[long])


def find_runs(words: np.ndarray, count: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs, by document, start and period; equal numbers are equal words."""
    names = Named.of(words, count)
    ids = np.arange(len(count))
    found = [np.zeros((0, 4), np.int64)]
    live = names.repeating(names.levels[0])
    names, ids = names.take(live), ids[live]
    while len(ids):
        name = names.double()
        live = names.repeating(name)
        if not live.all():  # these documents have all the levels that they need
            done = names.take(~live)
            start, end, period = _grid_runs(done, least)
            doc = np.searchsorted(done.first, start, side="right") - 1
            found.append(np.stack([ids[~live][doc], start - done.first[doc], end - start, period], 1))
        keep = np.concatenate([np.repeat(live, np.diff(names.first)), [True]])
        names, ids = names.take(live), ids[live]
        names.levels.append(name[keep])
    out = np.concatenate(found)
    return tuple(out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))].T)


def _word_numbers(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each word of a block, by its bytes, and the words' bytes one after another with their ends."""
    size = w.stop - w.start
    ends = np.concatenate([[0], np.cumsum(size)])
    source = np.repeat(w.start - ends[:-1], size) + np.arange(ends[-1])
    packed = w.raw[source]
    column = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(packed)])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64), packed, ends


def _joined(packed: np.ndarray, ends: np.ndarray, kept: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """For each row its kept words (positions in ``ends``), joined by one space."""
    size = np.diff(ends)[kept] + 1
    to = np.concatenate([[0], np.cumsum(size)])
    out = np.full(to[-1], 0x20, np.uint8)
    inside = np.ones(to[-1], bool)
    inside[to[1:] - 1] = False
    out[inside] = packed[np.repeat(ends[kept] - to[:-1], size - 1) + np.flatnonzero(inside)]
    last = np.ones(len(kept), bool)
    last[:-1] = row[1:] != row[:-1]
    mask = np.ones(to[-1], bool)
    mask[to[1:][last] - 1] = False  # no space after a row's last word
    length = np.bincount(row, weights=size, minlength=rows).astype(np.int64)
    length -= length > 0
    return pa.Array.from_buffers(pa.large_string(), rows, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(length)])), pa.py_buffer(out[mask])])


def _collapse(texts: pa.Array, least: int) -> Iterator[tuple[int, int, pa.Array, pa.Array, pa.Array]]:
    offsets, data = column_bytes(texts)
    for at, end in blocks(offsets):
        w = Words(offsets, data, at, end)
        numbers, packed, ends = _word_numbers(w)
        doc, start, length, period = find_runs(numbers, w.count, least)
        edge = np.zeros(len(numbers) + 1, np.int64)
        base = w.first[doc] + start
        np.add.at(edge, base + period, 1)
        np.add.at(edge, base + length, -1)
        kept = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
        fields = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], names=["start", "length", "period"])
        runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(end - at + 1)), pa.int32()), fields)
        yield at, end, pa.array(w.count.astype(np.int64)), runs, _joined(packed, ends, kept, w.row[kept], end - at)


def collapse_runs(spark: SparkSession, docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, n_words, runs, collapsed_text): the runs by start and period, and the words left where each run keeps its first period."""
    prepare(spark)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, count, runs, collapsed in _collapse(batch.column(1), least):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), count, runs, collapsed.cast(pa.string())], names=[key, "n_words", "runs", "collapsed_text"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words long, runs {RUNS}, collapsed_text string")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of one text in ten, by crc32 of its doc_id, the tail repeats its own words; rows with a null doc_id are left."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    dealt = docs.select("doc_id", "text", F.when(h % 10 == 0, F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).alias("words"), F.floor(h / 10).alias("g"))
    n = F.greatest(F.size("words"), F.lit(1))
    sized = dealt.withColumn("a", (F.col("g") % n).cast("int")).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    cycle = F.slice("words", F.col("a") + 1, F.col("p"))
    left = F.size("words") - F.col("a")
    tail = F.slice(F.flatten(F.array_repeat(cycle, F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return sized.select("doc_id", F.when(F.size("words") > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document of ``documents``, a tenth of which get periodic tails, with digests of runs and collapsed text."""
    runs = collapse_runs(spark, with_periodic_tails(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    # runs are in order of start and period, so the first of the longest ones
    top = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, r: F.when(best.isNull() | (r["length"] > best["length"]), r).otherwise(best))
    line = lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))
    return runs.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"),
    )
