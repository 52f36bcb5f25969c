"""Language identification by hierarchical discrimination.

A linear support vector machine per language family (one against the rest) picks the family; inside a family,
one-versus-one linear machines vote for the language. Features are hashed byte n-grams of 2 to 4 bytes over the
whole text, letters folded to lower case and everything else that is ASCII read as a space. A text's score is the mean
weight of its n-grams, so scoring is linear in the text and needs no per-document vector.

Defined edge cases: null, empty and letterless texts give ``und`` with score 0; repeated rows are scored alike; an
unknown language code is a family of its own; with no labelled row at all every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.sampling import fold_of, gather
from waymark.llm.text import blocks, column_bytes
from waymark.session import prepare

#: Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "an ast ca co es fr gl it la oc pt rm ro sc",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu se",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "indo-aryan": "as bn gu hi mr ne or pa si sd ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt ti",
    "malayic": "id jv ms su tl",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

BITS = 16
ORDERS = (2, 3, 4)
#: Feature values are counts over the number of n-grams, times this.
SCALE = 60.0
UNDETERMINED = "und"

_FOLD = np.full(256, 0x20, np.uint8)
for _c in (*range(0x41, 0x5B), *range(0x61, 0x7B)):
    _FOLD[_c] = _c | 0x20
_FOLD[0x80:] = np.arange(0x80, 0x100)


def ngram_index(offsets: np.ndarray, data: np.ndarray, at: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram of every position of rows at..end, row after row, and the first position of each row.

    Each row is padded with spaces, so that even one letter has n-grams.
    """
    lengths = np.diff(offsets[at : end + 1])
    pad = max(ORDERS)
    first = np.concatenate([[0], np.cumsum(lengths + pad)])
    raw = np.full(int(first[-1]) + pad, 0x20, np.uint8)
    where = np.arange(int(lengths.sum())) + np.repeat(first[:-1] + 1 - (offsets[at:end] - offsets[at]), lengths)
    raw[where] = _FOLD[data[int(offsets[at]) : int(offsets[end])]]
    n = int(first[-1])
    wide = raw.astype(np.uint32)
    key = wide[:n].copy()
    out = np.empty((n, len(ORDERS)), np.int32)
    with np.errstate(over="ignore"):
        for j, order in enumerate(ORDERS):
            for i in range(ORDERS[j - 1] if j else 1, order):
                key |= wide[i : i + n] << np.uint32(8 * i)
            out[:, j] = ((key + np.uint32(order)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    return out.reshape(-1), first * len(ORDERS)


@dataclass
class Model:
    """Weights by hashed n-gram. ``pairs[f]`` has (i, j) language positions of family f, one column each."""

    families: list[str] = field(default_factory=list)
    languages: list[list[str]] = field(default_factory=list)
    family_weights: np.ndarray | None = None
    family_bias: np.ndarray | None = None
    pairs: list[list[tuple[int, int]]] = field(default_factory=list)
    pair_weights: list[np.ndarray] = field(default_factory=list)
    pair_bias: list[np.ndarray] = field(default_factory=list)

    def predict(self, index: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(first) - 1
        if not self.families:
            return np.full(n, UNDETERMINED, object), np.zeros(n)
        if len(self.families) > 1:
            margin = _means(self.family_weights, index, first) + self.family_bias
            best = margin.argmax(1)
            sure = _sigmoid(margin[np.arange(n), best])
        else:
            best, sure = np.zeros(n, int), np.ones(n)
        names, score = np.empty(n, object), np.zeros(n)
        for f, languages in enumerate(self.languages):
            rows = np.flatnonzero(best == f)
            if not len(rows):
                continue
            if len(languages) == 1:
                names[rows], score[rows] = languages[0], sure[rows]
                continue
            lengths = first[rows + 1] - first[rows]
            start = np.concatenate([[0], np.cumsum(lengths)])
            own = index if len(rows) == n else index[np.arange(start[-1]) + np.repeat(first[rows] - start[:-1], lengths)]
            margin = _means(self.pair_weights[f], own, start) + self.pair_bias[f]
            votes, total, worst = np.zeros((len(rows), len(languages))), np.zeros((len(rows), len(languages))), np.ones((len(rows), len(languages)))
            for c, (i, j) in enumerate(self.pairs[f]):
                p = _sigmoid(margin[:, c])
                votes[:, i] += margin[:, c] >= 0
                votes[:, j] += margin[:, c] < 0
                total[:, i] += margin[:, c]
                total[:, j] -= margin[:, c]
                worst[:, i] = np.minimum(worst[:, i], p)
                worst[:, j] = np.minimum(worst[:, j], 1 - p)
            pick = (votes + 1e-3 * np.tanh(total)).argmax(1)  # ties in votes go to the larger summed margin
            names[rows] = np.array(languages, object)[pick]
            score[rows] = sure[rows] * worst[np.arange(len(rows)), pick]
        return names, score


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(2 * x, -30, 30)))


def _means(weights: np.ndarray, index: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SCALE times the mean weight row of each row's n-grams, column by column: no (n-grams x columns) array is made."""
    out = np.empty((len(first) - 1, weights.shape[1]))
    for c in range(weights.shape[1]):
        out[:, c] = np.add.reduceat(weights[:, c][index], first[:-1], dtype=np.float64)
    return out * (SCALE / np.diff(first))[:, None]


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], positive: np.ndarray, *, cost: float = 4.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by dual coordinate descent; the bias is a feature of value 1."""
    w, bias = np.zeros(1 << BITS), 0.0
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(seed)
    n_pos = max(1, int(positive.sum()))
    n_neg = max(1, len(rows) - n_pos)
    balance = np.where(positive, len(rows) / (2 * n_pos), len(rows) / (2 * n_neg))
    y = np.where(positive, 1.0, -1.0)
    square = np.array([v @ v for _, v in rows]) + 1.0
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            idx, val = rows[i]
            slack = 1 / (2 * cost * balance[i])
            gradient = y[i] * (w[idx] @ val + bias) - 1 + slack * alpha[i]
            new = max(0.0, alpha[i] - gradient / (square[i] + slack))
            step = (new - alpha[i]) * y[i]
            if step:
                w[idx] += step * val
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w.astype(np.float32), bias


def fit(examples: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """Fit the families' and the pairs' machines on (language, n-gram indices, values)."""
    examples = sorted(examples, key=lambda e: (e[0], len(e[1]), e[1].tobytes()))
    if not examples:
        return Model()
    grouped: dict[str, list[str]] = {}
    for lang in sorted({e[0] for e in examples}):
        grouped.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
    names = sorted(grouped)
    model = Model(families=names, languages=[grouped[f] for f in names])
    rows = [(i, v.astype(np.float64)) for _, i, v in examples]
    langs = np.array([e[0] for e in examples], object)
    family = np.array([FAMILY_OF.get(x, x) for x in langs], object)
    if len(names) > 1:
        fitted = [fit_svm(rows, family == f) for f in names[: 1 if len(names) == 2 else None]]
        if len(names) == 2:
            fitted.append((-fitted[0][0], -fitted[0][1]))
        model.family_weights = np.stack([w for w, _ in fitted], 1)
        model.family_bias = np.array([b for _, b in fitted])
    for f in names:
        pairs = [(i, j) for i in range(len(grouped[f])) for j in range(i + 1, len(grouped[f]))]
        fitted = []
        for i, j in pairs:
            use = np.flatnonzero((langs == grouped[f][i]) | (langs == grouped[f][j]))
            fitted.append(fit_svm([rows[k] for k in use], langs[use] == grouped[f][i]))
        model.pairs.append(pairs)
        model.pair_weights.append(np.stack([w for w, _ in fitted], 1) if fitted else np.zeros((1, 0), np.float32))
        model.pair_bias.append(np.array([b for _, b in fitted]))
    return model


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = column_bytes(batch.column("text"))
        for at, end in blocks(offsets):
            index, first = ngram_index(offsets, data, at, end)
            idx, val = [], []
            for r in range(end - at):
                i, c = np.unique(index[first[r] : first[r + 1]], return_counts=True)
                idx.append(i.astype(np.int32).tobytes())
                val.append((c * (SCALE / c.sum())).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("key").slice(at, end - at), batch.column("lang").slice(at, end - at), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], names=["key", "lang", "idx", "val"])


def train(spark: SparkSession, labelled: DataFrame, *, per_language: int = 600, most: int = 512) -> Model:
    """Fit on a bounded sample of rows (text, lang, key): about ``per_language`` texts of each language, cut there at most.

    Rows are taken by a hash of ``key``, at a rate read off the language counts, so no language is gathered in one task.
    An example has at most 2^16 features, whatever the length of its text, a key is one example, and all that are sent to
    the driver are bounded in bytes. More than ``most`` languages
    are an error, as every two of a family get a machine.
    """
    prepare(spark)
    usable = labelled.filter(F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r[0]: r[1] for r in usable.groupBy("lang").count().limit(most + 1).collect()}
    if len(counts) > most:
        raise ValueError(f"more than {most} languages")
    rate = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(rate)
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col("key").cast("string")), F.lit(1 << 20)) / float(1 << 20)
    kind = labelled.schema["key"].dataType.simpleString()
    found = gather(spark, usable.filter(draw < rate).select("key", "text", "lang").mapInArrow(_examples, f"key {kind}, lang string, idx binary, val binary"), "key")
    taken: dict[str, int] = {}
    examples = []
    for r in sorted(found, key=lambda r: (r[0], bytes(r[1]), bytes(r[2]))):
        taken[r[0]] = taken.get(r[0], 0) + 1
        if taken[r[0]] <= 2 * per_language:
            examples.append((r[0], np.frombuffer(r[1], np.int32), np.frombuffer(r[2], np.float32)))
    return fit(examples)


def identify(spark: SparkSession, docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row; whole texts, no shuffle. The model is broadcast: its size is set by the number of languages."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            texts = batch.column(1)
            offsets, data = column_bytes(texts)
            for at, end in blocks(offsets):
                index, first = ngram_index(offsets, data, at, end)
                names, score = fitted.predict(index, first)
                for r, t in enumerate(texts.slice(at, end - at)):
                    if not _has_letter(t.as_py()):
                        names[r], score[r] = UNDETERMINED, 0.0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[key, "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def _has_letter(t: str | None) -> bool:
    return bool(t) and any(map(str.isalpha, t))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of every document; learned from fold remainders other than 2 of crc32(doc_id) mod 4."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    fold = fold_of("doc_id", 4)
    model = train(spark, docs.filter(fold != 2).select("text", "lang", F.col("doc_id").alias("key")))
    out = identify(spark, docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(True)).alias("held_out"), "lang_pred", "score")
