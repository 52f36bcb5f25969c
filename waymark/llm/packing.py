"""Packing of tokenised documents into fixed-length sequences by first-fit decreasing.

Documents are dealt into random groups of bounded size, and each group is packed on its own: documents of a full length
or more are cut into full sequences and a rest; the rests go, longest first, to the first open bin that holds them,
found in a tournament tree of the bins' free capacities. The gaps that remain are filled by cutting the emptiest bins
up, and the one bin left over at the end of a group is split at powers of two, so that no sequence needs padding.

Defined edge cases: a null text is an empty one, and an empty text is the end token alone; repeated rows and repeated
or null document ids are packed row by row; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.text import blocks, column_bytes
from waymark.session import fresh_path, materialize, prepare

LENGTH = 4096
END_ID = 2
#: Text bytes of a group, about.
GROUP_BYTES = 8 << 20
#: Words whose ids a worker remembers; the older half is forgotten beyond it.
CACHE_WORDS = 500_000
#: Words of letters that are encoded as one text.
JOINED_WORDS = 256
#: Bytes of texts whose new chunks are learnt together.
LEARN_BYTES = 1 << 18


class WordEncoder:
    """Ids of texts, by remembering the ids of their whitespace-separated chunks.

    Valid for tokenizers that split at white space, drop it and fold case, as ``word_bpe_49k`` does: no token spans two
    chunks. Only texts and chunks all in ASCII are lower-cased beforehand: elsewhere the tokenizer composes before it folds, and a
    capital and its combining mark may compose differently from the small letter. A text that may hold the name of a
    special token is encoded as a whole.

    New chunks are learnt for many texts at once. Signs behind a last letter are split off, as letters and signs share no
    token. Words of letters are encoded as one text and cut where tokens end a word; that holds if there are as many ends
    as words, since each word has one at least, and otherwise they are encoded one by one.
    """

    #: Signs that stand in tokens of their own behind a letter; an apostrophe may belong to one with it.
    _TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    _END = "</w>"

    def __init__(self, path: str | None = None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        vocab = self.tokenizer.get_vocab()
        self.ends[[i for t, i in vocab.items() if t.endswith(self._END)]] = True
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _single(self, words: list[bytes]) -> Iterator[bytes]:
        for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False):
            yield self._pack(e.ids)

    def _joined(self, words: list[bytes]) -> Iterator[bytes]:
        """Of words that hold letters only."""
        for at in range(0, len(words), JOINED_WORDS):
            part = words[at : at + JOINED_WORDS]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            cut = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cut) != len(part) or cut[-1] != 4 * len(ids):
                yield from self._single(part)
                continue
            raw, before = ids.tobytes(), 0
            for c in cut:
                yield raw[before:c]
                before = c

    def _learn(self, chunks: Iterable[bytes]) -> None:
        """Ids of chunks that ``new`` doesn't hold."""
        new, old = self.new, self.old
        parts, letters, others = [], {}, {}
        for c in chunks:
            if c in old:
                new[c] = old[c]
                continue
            if c.isalpha():  # bytes.isalpha is ASCII only
                word = c.lower()
                if word not in new:
                    letters[word] = None
                if word != c:
                    parts.append((c, word, b""))
                continue
            core = c.rstrip(self._TAIL)
            tail = c[len(core) :]
            if tail and not core[-1:].isalpha():
                last = core[-2:].decode("utf-8", "ignore")[-1:]
                if not (last.isalpha() and last < "\u0250"):
                    core, tail = c, b""
            word = core.lower() if core.isascii() else core
            if word not in new:
                (letters if word.isalpha() or word.decode("utf-8", "replace").isalpha() else others)[word] = None
            if tail and tail not in new:
                others[tail] = None
            if tail or word != c:
                parts.append((c, word, tail))
        new.update(zip(letters, self._joined(list(letters)), strict=True))
        new.update(zip(others, self._single(list(others)), strict=True))
        for c, word, tail in parts:
            new[c] = new[word] + new[tail] if tail else new[word]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.new) > CACHE_WORDS:
            self.old, self.new = self.new, {}
        new = self.new
        out: list[bytes] = []
        later, missing = [], set()
        for i, t in enumerate(texts):
            if b"<|" in t:
                out.append(self._pack(self.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids))
                continue
            chunks = (t.lower() if t.isascii() else t).split()  # ASCII white space
            try:
                out.append(b"".join([new[c] for c in chunks]))
            except KeyError:
                out.append(b"")
                later.append((i, chunks))
                missing.update([c for c in chunks if c not in new])
        if missing:
            self._learn(missing)
        for i, chunks in later:
            out[i] = b"".join([new[c] for c in chunks])
        return out

    def encode(self, text: bytes) -> bytes:
        return self.encode_all([text])[0]


_ENCODERS: dict[str | None, WordEncoder] = {}


def encoder(path: str | None) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item positions; every size is between 1 and the capacity. Ties keep their order."""
    order = np.argsort(-sizes, kind="stable").tolist()
    size = sizes.tolist()
    width = 1
    while width < max(1, len(order)):
        width *= 2
    free = [capacity] * (2 * width)  # a winner's tree: each node has the larger capacity below it
    bins: list[list[int]] = []
    for i in order:
        need, node = size[i], 1
        while node < width:
            node *= 2
            if free[node] < need:
                node += 1
        if node - width == len(bins):
            bins.append([])
        bins[node - width].append(i)
        free[node] -= need
        node //= 2
        while node:
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
            node //= 2
    return bins


def pack(lengths: np.ndarray, capacity: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) pieces without padding: each is full or has a power of two of tokens."""
    sequences: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for d, n in enumerate(lengths.tolist()):
        full = n // capacity
        sequences += [[(d, k * capacity, capacity)] for k in range(full)]
        if n % capacity:
            rest.append((d, full * capacity, n % capacity))
    bins = [[rest[i] for i in b] for b in first_fit_decreasing(np.array([r[2] for r in rest], np.int64), capacity)]
    gap = [capacity - sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (gap[b], b))
    i, j = 0, len(order) - 1
    while i < j:
        taker, giver = order[i], order[j]
        if not gap[taker]:
            i += 1
            continue
        d, start, n = bins[giver].pop()
        moved = min(n, gap[taker])
        bins[taker].append((d, start, moved))
        gap[taker] -= moved
        gap[giver] += moved
        if moved < n:
            bins[giver].append((d, start + moved, n - moved))
        if not bins[giver]:
            j -= 1
    sequences += [bins[b] for b in order[:i]]
    if i == j:
        sequences += _powers_of_two(bins[order[i]])
    return sequences


def _powers_of_two(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    left = sum(p[2] for p in pieces)
    queue = pieces[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out = []
        while room:
            d, start, n = queue.pop()
            used = min(n, room)
            out.append((d, start, used))
            room -= used
            if used < n:
                queue.append((d, start + used, n - used))
        yield out


def tokenize(spark: SparkSession, docs: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID, group_bytes: int = GROUP_BYTES, seed: int = 17) -> DataFrame:
    """(key, grp, ids): ids as little-endian 16-bit integers where the vocabulary allows it, with the end token.

    The group is drawn at random for each row, so repeated rows spread like any others.
    """
    prepare(spark)
    total = docs.select(F.sum(F.octet_length(text) + 16).alias("n")).first()["n"] or 0
    groups = max(1, -(-int(total) // group_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        kind = id_type(enc)
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            offsets, data = column_bytes(batch.column(1))
            for at, stop in blocks(offsets, LEARN_BYTES):
                part = batch.slice(at, stop - at)
                found = enc.encode_all([data[offsets[i] : offsets[i + 1]].tobytes() for i in range(at, stop)])
                ids = [np.frombuffer(x, "<u4").astype(kind).tobytes() + end for x in found]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(ids, pa.binary())], names=["key", "grp", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    taken = docs.select(F.col(key).alias("key"), F.col(text), F.floor(F.rand(seed) * groups).cast("long").alias("grp"))
    return taken.mapInArrow(run, f"key {kind}, grp long, ids binary")


def id_type(enc: WordEncoder) -> str:
    return "<u2" if enc.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def pack_documents(spark: SparkSession, docs: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, group_bytes: int = GROUP_BYTES, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for.

    A group's number fills the upper bits of its sequences' ids, so groups need no counting of each other.
    """
    tokens = tokenize(spark, docs, key=key, text=text, tokenizer=tokenizer, end_id=end_id, group_bytes=group_bytes)
    # the draw of the groups is written, so that a task that runs again finds every row in the group it was dealt to
    tokens = materialize(spark, tokens, "tokens", path=fresh_path(spark, "tokens"))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")

    def run(table: pa.Table) -> pa.Table:
        width = id_type(encoder(tokenizer))
        grp = table.column("grp")[0].as_py()
        ids = [np.frombuffer(x.as_buffer(), width) for x in table.column("ids")]
        rows: list[tuple[int, int, int, int, int, int]] = []
        kept = []
        for s, pieces in enumerate(pack(np.array([len(x) for x in ids], np.int64), length)):
            at = 0
            for d, start, n in pieces:
                own = ids[d][start : start + n].astype("<u4").tobytes()
                rows.append((d, start, n, zlib.crc32(own), (grp << 32) | s, at))
                if with_ids:
                    kept.append(own)
                at += n
        cols = np.array(rows, np.int64).reshape(-1, 6)
        sizes = np.array([len(x) for x in ids], np.int64)
        out = [table.column("key").take(pa.array(cols[:, 0])), *(pa.array(cols[:, c]) for c in (1, 2, 3)), pa.array(sizes[cols[:, 0]]), pa.array(cols[:, 4]), pa.array(cols[:, 5])]
        names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            out.append(pa.array(kept, pa.binary()))
            names.append("ids")
        return pa.Table.from_arrays(out, names=names)

    return tokens.groupBy("grp").applyInArrow(run, schema).withColumnRenamed("key", key)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every document into sequences of at most 4096 tokens; one row per piece."""
    return pack_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
