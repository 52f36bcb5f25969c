"""Near-duplicate documents by a chosen-path set similarity join on word shingles.

A document's set is that of its five-word shingles. Documents with equal sets are one class, and one document of each
class takes part. Each of several independent trees puts a class into the node of its minwise token at the tree's first
coordinate. Nodes whose members are all in one component are done. Nodes of up to NODE_ROWS members, and those with so few
outside their largest component, are compared exhaustively, block by block, and are done then. Others are compared in
chunks, each with the node's pivot; if too many components are still left they branch: every member goes on to the nodes
of its minwise tokens at two further coordinates chosen by the path. No path uses a coordinate twice, so the levels end;
members that agree on all coordinates are compared block by block, over as many tasks as that takes. Nothing is capped.

Exhaustive comparison takes only pairs across components. Sizes, and minwise agreement that a pair at the threshold
fails less than once in 100,000, leave groups of members that may be linked. The groups' full sets, made from the texts,
meet in one task (or, where they are too long for it, two blocks of them do), and only a forest of links comes out, so
that the rows grow with the members and not with their pairs. Later trees start from the components of the first two.

Recall: with ten trees, a pair of similarity 0.75 shares no first node once in 4^10, about one in a million; in nodes
that branch it is lost in one tree with probability 1/3 at most, so once in 60,000 in ten.

Defined edge cases: fewer words than five make one shingle; null and wordless texts have no shingle and no link; rows
that repeat a doc_id are each returned, with the links of any of them; rows with a null doc_id are never linked, have
a null component and are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.components import connected_components
from waymark.llm.text import Words, blocks, column_bytes, grams, mix
from waymark.operators.graph import roots
from waymark.session import drop_path, fresh_path, materialize, prepare

SHINGLE = 5
PERCENT = 75
TREES = 10
#: Trees whose links are found before the others begin.
FIRST_TREES = 2
COORDINATES = 32
BRANCHES = 2
#: Members of a node that is compared exhaustively in one task (some 600 bytes each).
NODE_ROWS = 2048
#: Members of a larger node that are compared with its pivot and each other before it branches.
CHUNK = 64
#: Low bytes of so many further minwise hashes make a fine sketch; a candidate pair must agree on SKETCH_AGREE of them.
SKETCH = 512
SKETCH_AGREE = 342
#: The same for the first bytes of the sketch, which are compared first; a pair at the threshold fails once in a million.
COARSE = 64
COARSE_AGREE = 30
#: Shingles that a task gathers for one group, and pairs of rows that it compares at once.
GROUP_SHINGLES = 1 << 21
PAIRS = 1 << 16
#: Members of a group that are each held against all others, before all are held against all in slices of so many shingles.
ROWS, SLICE = 4, 4096

_ODD = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_FINE = mix(np.arange(7001, SKETCH + 7001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SHIFT = mix(np.arange(101, COORDINATES + 101, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(offsets: np.ndarray, data: np.ndarray, at: int, end: int, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """First position of each row (n + 1), and the rows' distinct shingle hashes in ascending order."""
    w = Words(offsets, data, at, end, fold=True)
    h = w.hashes()
    if len(h) >= k:
        start = np.flatnonzero(w.row[: len(h) - k + 1] == w.row[k - 1 :])
        row, sh = w.row[start], grams(h, k, k)[start]
    else:
        row, sh = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for c in range(1, k):
        few = np.flatnonzero(w.count == c)
        if len(few):
            row, sh = np.concatenate([row, few]), np.concatenate([sh, grams(h, c, c)[w.first[few]]])
    order = np.lexsort((sh, row))
    row, sh = row[order], sh[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])
    return np.searchsorted(row[new], np.arange(end - at + 1)), sh[new]


def set_hashes(first: np.ndarray, sh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free hashes of each set."""
    with np.errstate(over="ignore"):
        sums = []
        for seed in (0x1234567, 0x89ABCDEF):
            c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sh ^ np.uint64(seed)), dtype=np.uint64)])
            sums.append((c[first[1:]] - c[first[:-1]]).view(np.int64))
    return sums[0], sums[1]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = column_bytes(batch.column(1))
        for at, end in blocks(offsets):
            first, sh = shingle_sets(offsets, data, at, end)
            n = np.diff(first)
            full = np.flatnonzero(n)
            mins = np.empty((len(full), COORDINATES), np.uint64)
            with np.errstate(over="ignore"):
                for c in range(COORDINATES):
                    if len(full):
                        mins[:, c] = np.minimum.reduceat((sh ^ _SHIFT[c]) * _ODD[c], first[full])
            s1, s2 = set_hashes(first, sh)
            where = np.zeros(end - at + 1, np.int32)
            where[1:] = np.cumsum(n > 0) * COORDINATES
            sig = pa.ListArray.from_arrays(pa.array(where), pa.array(mins.view(np.int64).ravel()))
            fine = np.zeros((len(full), SKETCH), np.uint8)
            short = (sh >> np.uint64(32)).astype(np.uint32)
            with np.errstate(over="ignore"):
                for c in range(SKETCH):
                    if len(full):
                        fine[:, c] = np.minimum.reduceat((short ^ np.uint32(_FINE[c] & np.uint64(0xFFFFFFFF))) * np.uint32((_FINE[c] >> np.uint64(32)) | np.uint64(1)), first[full]) & np.uint32(0xFF)
            ends = np.concatenate([[0], np.cumsum(n > 0) * SKETCH]).astype(np.int32)
            bits = pa.Array.from_buffers(pa.binary(), end - at, [None, pa.py_buffer(ends), pa.py_buffer(fine)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(n), pa.array(s1), pa.array(s2), sig, bits], names=["id", "n", "s1", "s2", "sig", "bits"])


def row_pairs(end: np.ndarray, limit: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with i < j < end[i], some ``limit`` at a time; rows of one cell stand together and share its end."""
    many = end - np.arange(len(end)) - 1
    total = np.concatenate([[0], np.cumsum(many)])
    at = 0
    while at < len(end):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        left = np.repeat(np.arange(at, stop), many[at:stop])
        yield left, left + 1 + np.arange(len(left)) - np.repeat(total[at:stop] - total[at], many[at:stop])
        at = stop


def cell_groups(cell: np.ndarray, rep: np.ndarray, s1: np.ndarray, label: np.ndarray, n: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, group) of the rows of cells that may have a partner in another component; a group is closed under such pairs.

    Equal groups of different cells get the same number.
    """
    found: tuple[list, list] = ([], [])
    for x, y in row_pairs(np.searchsorted(cell, cell, side="right")):
        maybe = (label[x] != label[y]) & (100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y]))
        x, y = x[maybe], y[maybe]
        for part, least in ((slice(0, COARSE), COARSE_AGREE), (slice(0, SKETCH), SKETCH_AGREE)):
            good = np.zeros(len(x), bool)
            for at in range(0, len(x), 8192):
                good[at : at + 8192] = (bits[x[at : at + 8192], part] == bits[y[at : at + 8192], part]).sum(1) >= least
            x, y = x[good], y[good]
        found[0].append(x)
        found[1].append(y)
    x, y = (np.concatenate(f) if f else np.zeros(0, int) for f in found)
    root = roots(len(cell), x, y)
    own = np.unique(np.concatenate([x, y]))
    order = own[np.lexsort((s1[own], rep[own], root[own]))]
    same = np.zeros(len(order), bool)  # the pivot of a large node may be there twice
    same[1:] = (root[order[1:]] == root[order[:-1]]) & (rep[order[1:]] == rep[order[:-1]]) & (s1[order[1:]] == s1[order[:-1]])
    order = order[~same]
    if not len(order):
        return order, order
    head = np.flatnonzero(np.diff(root[order], prepend=-1))
    with np.errstate(over="ignore"):
        name = np.add.reduceat(mix(mix(rep[order].view(np.uint64)) ^ s1[order].view(np.uint64)), head)
    place, number = [order], [np.repeat(name, np.diff(np.append(head, len(order))))]
    weight = np.add.reduceat(n[order], head)
    for g in np.flatnonzero(weight > GROUP_SHINGLES).tolist():  # too much for one task's memory: every two blocks of it become a group
        lo = head[g]
        hi = head[g + 1] if g + 1 < len(head) else len(order)
        number[0][lo:hi] = 0
        block = (np.cumsum(n[order[lo:hi]]) - n[order[lo:hi]]) // (GROUP_SHINGLES // 2)
        names = np.unique(block)
        for i, a in enumerate(names):
            for b in names[i + 1 :] if len(names) > 1 else names:
                own = order[lo:hi][(block == a) | (block == b)]
                place.append(own)
                with np.errstate(over="ignore"):
                    number.append(np.full(len(own), mix(name[g : g + 1] + np.uint64(a * 1_000_003 + b + 1))[0]))
    place, number = np.concatenate(place), np.concatenate(number)
    return place[number != 0], number[number != 0]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, rep, s1, label, n, bits), sorted by cell, give (grp, rep, s1, label) of those that may have a partner."""

    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        cell, rep, s1, label, n = (t.column(c).to_numpy() for c in ("cell", "rep", "s1", "label", "n"))
        bits = np.concatenate([np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if len(data) else np.zeros(0, np.uint8) for offsets, data in map(column_bytes, t.column("bits").chunks)])
        place, number = cell_groups(cell, rep, s1, label, n, bits.reshape(-1, SKETCH))
        return pa.RecordBatch.from_arrays([pa.array(number.view(np.int64)), pa.array(rep[place]), pa.array(s1[place]), pa.array(label[place])], names=["grp", "rep", "s1", "label"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column("cell").to_numpy()
        whole = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
        if whole:
            yield flush([*held, batch.slice(0, whole)])
            held = []
        elif held and held[-1].column("cell")[0].as_py() != cell[0]:
            yield flush(held)
            held = []
        held.append(batch.slice(whole))
    if held:
        yield flush(held)


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every two sets, by products of their incidence in slices of the elements."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    code = np.where(many > 1, np.cumsum(many > 1) - 1, -1)[code]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(code[-1]) + 1, SLICE):
        lo, hi = np.searchsorted(code, [at, at + SLICE])
        part = np.zeros((len(sets), SLICE), np.float32)
        part[owner[lo:hi], code[lo:hi] - at] = 1
        both += part @ part.T
    return both.astype(np.int64)


def forest(label: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between members of a group, as few as join every two members that links between them join; labels are joined already."""
    _, root = np.unique(label, return_inverse=True)
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    out: list[tuple[int, int]] = []

    def join(i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            if root[j] != root[i]:
                out.append((i, j))
                root[root == root[j]] = root[i]

    for i in range(min(len(sets) - 1, ROWS)):  # most groups are one component after the first rows
        other = root != root[i]
        if other.any():
            spot = np.searchsorted(sets[i], flat)
            spot[spot == size[i]] = 0
            both = np.bincount(owner[sets[i][spot] == flat], minlength=len(sets))
            join(i, np.flatnonzero(other & (100 * both >= PERCENT * (size + size[i] - both))))
    if (root != root[0]).any() and len(sets) > ROWS + 1:
        both = shared(sets)
        linked = (root[:, None] != root[None]) & (100 * both >= PERCENT * (size[:, None] + size[None] - both))
        for i in np.flatnonzero(linked.any(1)).tolist():
            join(i, np.flatnonzero(linked[i]))
    return out


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, rep, s1, label, text), sorted by group: gives links (a, b) that hold on the full sets, a forest for each group."""
    group, ids, marks, labels, sets = None, [], [], [], []

    def links() -> list[tuple[int, int]]:
        return [(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in forest(np.array(labels), sets)] if len(sets) > 1 else []

    for batch in batches:
        offsets, data = column_bytes(batch.column("text"))
        names, reps, want, known = (batch.column(c).to_numpy() for c in ("grp", "rep", "s1", "label"))
        out: list[tuple[int, int]] = []
        for at, end in blocks(offsets):
            first, sh = shingle_sets(offsets, data, at, end)
            s1, _ = set_hashes(first, sh)
            for r in np.flatnonzero(s1 == want[at:end]).tolist():  # rows that repeat a doc_id have other sets
                i = at + r
                if names[i] != group:
                    out += links()
                    group, ids, marks, labels, sets = names[i], [], [], [], []
                if (reps[i], want[i]) not in marks[-1:]:
                    ids.append(int(reps[i]))
                    marks.append((reps[i], want[i]))
                    labels.append(known[i])
                    sets.append(sh[first[r] : first[r + 1]].copy())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
    if out := links():
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])


class _Join:
    """State of one join: the classes of equal sets, and the labels that the links found so far give to ids."""

    def __init__(self, spark: SparkSession, docs: DataFrame, key: str, text: str):
        self.spark = spark
        self.paths: list[str] = []
        self.source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
        self.sketches = self._keep(self.source.mapInArrow(_sketch, "id long, n long, s1 long, s2 long, sig array<long>, bits binary"), "sketches", stay=True)
        known = self.sketches.filter(F.col("id").isNotNull() & (F.col("n") > 0))
        self.reps = self._keep(known.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.min(F.struct("sig", "bits")).alias("m")).select("n", "s1", "s2", "rep", "m.sig", "m.bits"), "classes", stay=True)
        self.labels: DataFrame | None = None
        # rows that repeat a doc_id with different sets join the classes of these sets
        several = known.groupBy("id").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).filter("lo < hi").select("id")
        joined = known.join(several, "id", "left_semi").join(self.reps, ["n", "s1", "s2"]).filter("rep != id").select(F.col("rep").alias("a"), F.col("id").alias("b"))
        self._relabel(self._keep(joined.distinct(), "repeated"))

    def _keep(self, df: DataFrame, name: str, stay: bool = False) -> DataFrame:
        path = fresh_path(self.spark, name)
        if not stay:
            self.paths.append(path)
        return materialize(self.spark, df, name, path=path)

    def with_labels(self, rows: DataFrame) -> DataFrame:
        if self.labels is None:
            return rows.withColumn("label", F.col("rep"))
        own = self.labels.select(F.col("id").alias("rep"), "component")
        return rows.join(own, "rep", "left").select(*rows.columns, F.coalesce("component", "rep").alias("label"))

    def first_nodes(self, trees: range) -> DataFrame:
        """(node, used, rep, s1, label) of the classes in the trees' nodes of their minwise token; ``used`` has a bit for each coordinate of the path."""
        rows = self.with_labels(self.reps.select("rep", "s1", F.slice("sig", trees.start + 1, len(trees)).alias("sig")))
        one = F.posexplode("sig").alias("t", "token")
        tree = F.col("t") + trees.start
        return rows.select("rep", "s1", "label", one).select(F.xxhash64(tree, "token").alias("node"), F.expr(f"shiftleft(1L, t + {trees.start})").alias("used"), "rep", "s1", "label")

    def facts(self, rows: DataFrame) -> DataFrame:
        """Of nodes with more than one component: size, pivot, largest component and its size.

        ``open``: that the node has more than NODE_ROWS members outside its largest component. Written, so that both sides
        of a join are plain shuffles, which the engine splits where a node is large.
        """
        by_label = rows.groupBy("node", "label").agg(F.count("*").alias("n"), F.min(F.struct("rep", "s1")).alias("first"))
        facts = by_label.groupBy("node").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("main"), F.min("first").alias("pivot")).filter("size > main.n")
        return self._keep(facts.select("node", "size", "pivot", F.col("main.label").alias("main"), F.col("main.n").alias("most"), (F.col("size") - F.col("main.n") > NODE_ROWS).alias("open")), "nodes")

    def cells(self, members: DataFrame) -> DataFrame:
        """(cell, rep, s1, label): what one task compares.

        A node of up to NODE_ROWS members is one cell. One with so few members outside its largest component has these in
        a cell with each block of that component. Any other is dealt into cells of CHUNK members, each with the node's
        pivot, or where the path has used up all coordinates, has a cell for every two blocks.
        """
        mark = F.xxhash64("rep", "s1", "node")
        blocks_, chunks, parts = F.ceil(F.col("most") / NODE_ROWS), F.ceil(F.col("size") / CHUNK), F.ceil(2 * F.col("size") / NODE_ROWS)
        part, zero = F.pmod(mark, parts), F.lit(0).cast("long")
        pivot = (F.col("rep") == F.col("pivot.rep")) & (F.col("s1") == F.col("pivot.s1"))
        number = (
            F.when(F.col("size") <= NODE_ROWS, F.array(zero))
            .when(~F.col("open"), F.when(F.col("label") == F.col("main"), F.array(F.pmod(mark, blocks_))).otherwise(F.sequence(zero, blocks_ - 1)))
            .when(F.bit_count("used") >= COORDINATES, F.transform(F.sequence(zero, parts - 1), lambda j: F.least(part, j) * parts + F.greatest(part, j)))
            .otherwise(F.when(pivot, F.sequence(zero, chunks - 1)).otherwise(F.array(F.pmod(mark, chunks))))
        )
        return members.select("node", "rep", "s1", "label", F.explode(number).alias("c")).select(F.xxhash64("node", "c").alias("cell"), "rep", "s1", "label")

    def links(self, cells: DataFrame) -> DataFrame:
        """New links (a, b): of every cell, a forest that joins what links join."""
        own = self.reps.select("rep", "s1", "n", "bits")
        dealt = cells.join(own, ["rep", "s1"]).select("cell", "rep", "s1", "label", "n", "bits").repartition("cell").sortWithinPartitions("cell")
        groups = self._keep(dealt.mapInArrow(_groups, "grp long, rep long, s1 long, label long").distinct(), "groups")
        needed = self._keep(groups.select(F.col("rep").alias("id")).distinct(), "needed")
        texts = self.source.join(needed, "id", "left_semi").withColumnRenamed("id", "rep")
        rows = groups.join(texts, "rep").select("grp", "rep", "s1", "label", "text").repartition("grp").sortWithinPartitions("grp", "rep", "s1")
        return self._keep(rows.mapInArrow(_confirm, "a long, b long").distinct(), "links")

    def further(self, members: DataFrame) -> DataFrame | None:
        """Rows of the next level, from the nodes that were open, by the labels known now.

        Members of a node that isn't open any more stay in it; else each goes on to the nodes of its tokens at coordinates that the path picks.
        """
        rows = members.filter(F.col("open") & (F.bit_count("used") < COORDINATES)).select("node", "used", "rep", "s1")
        if rows.isEmpty():
            return None
        rows = self.with_labels(rows)
        now = rows.join(self.facts(rows).select("node", "open"), "node").join(self.reps.select("rep", "s1", "sig"), ["rep", "s1"])
        left = F.filter(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), lambda c: F.col("used").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), c)) == 0)
        picks = F.slice(F.array_sort(F.transform(left, lambda c: F.struct(F.xxhash64("node", c).alias("h"), c.alias("c")))), 1, BRANCHES)
        picks = F.when(F.col("open"), F.transform(picks, lambda p: p["c"])).otherwise(F.array(F.lit(-1)))
        now = now.select("node", "used", "rep", "s1", "label", "sig", F.explode(picks).alias("c"))
        stays = F.col("c") < 0
        node = F.when(stays, F.col("node")).otherwise(F.xxhash64("node", "c", F.try_element_at("sig", F.col("c") + 1)))
        used = F.when(stays, F.col("used")).otherwise(F.expr("used | shiftleft(1L, c)"))
        return self._keep(now.select(node.alias("node"), used.alias("used"), "rep", "s1", "label"), "level")

    def run(self) -> DataFrame:
        for trees in (range(FIRST_TREES), range(FIRST_TREES, TREES)):
            rows: DataFrame | None = self.first_nodes(trees)
            while rows is not None:
                members = self._keep(rows.join(self.facts(rows), "node"), "members")
                self._relabel(self.links(self.cells(members)))
                rows = self.further(members)
        for path in self.paths:
            drop_path(self.spark, path)
        return self.result()

    def _relabel(self, links: DataFrame) -> None:
        """Take new links (a, b) into the labels. Links inside a component, and repeated ones between two, are dropped first."""
        if links.isEmpty():
            return
        own = self.labels
        if own is not None:
            ends = links.join(own.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(own.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
            links = self._keep(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a <> b").distinct(), "between")
        found = self._keep(connected_components(self.spark, links), "components", stay=True)
        if own is not None:
            merged = found.select(F.col("id").alias("component"), F.col("component").alias("root"))
            ids = own.unionByName(found.select("id").join(own, "id", "left_anti").select("id", F.col("id").alias("component")))
            found = self._keep(ids.join(merged, "component", "left").select("id", F.coalesce("root", "component").alias("component")), "labels", stay=True)
        self.labels = found

    def result(self) -> DataFrame:
        classes = self.reps.select("n", "s1", "s2", "rep")
        rows = self.sketches.select("id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"], "left")
        if self.labels is not None:
            rows = rows.join(self.labels.select(F.col("id").alias("rep"), "component"), "rep", "left")
        else:
            rows = rows.withColumn("component", F.lit(None).cast("long"))
        component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
        return rows.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row; the component is the smallest id reachable by links."""
    prepare(spark)
    out = _Join(spark, docs, key, text).run()
    return out.select(F.col("id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of shingle similarity 0.75 or more."""
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(a[i:i + 4], ' ') AS k FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 4, 1) + 1)) AS i FROM w WHERE len(a) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= 75 * (na.n + nb.n - p.c)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS root, doc_id AS id FROM documents UNION SELECT r.root, e.v FROM r JOIN e ON e.u = r.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(root) AS component_id FROM r GROUP BY id) m ON m.id = d.doc_id
"""
