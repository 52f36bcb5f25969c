"""Benchmark decontamination by winnowing, in DataFrame operations only.

Each text is reduced to the minimum k-gram hash of every sliding window of w k-grams, with its position; documents
and benchmark items are joined on these fingerprints and every hit is extended word by word. With window = w + k - 1
words, equal windows have equal fingerprints, so every shared span of at least ``window`` words is found. Items of
fewer words are one window of their own length, whose only k-gram is the whole item.

The benchmark's fingerprints are broadcast only if they hold at most ``BROADCAST_BYTES``; beyond that the join
shuffles both sides. A fingerprint that many items share is one row with the list of those items.

Defined edge cases: null and wordless texts have no words and are not contaminated; wordless items are ignored; rows
that repeat an item_id are one item; rows with a null item_id are together one item, whose windows hit, but which is not
named or counted; repeated rows of documents and those with a null doc_id are each judged and returned by their own text; an
empty benchmark contaminates nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.session import fresh_path, materialize, prepare

WINDOW = 10
GRAM = 5
#: Bytes of benchmark fingerprints, their words and lists of items that are broadcast at most.
BROADCAST_BYTES = 32 << 20
#: Bits of a fingerprint that hold the position; the others hold the hash.
_PLACE = 30
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text after A-Z are lower-cased; null gives none. ASCII texts take the fast path of lower()."""
    text = F.coalesce(text, F.lit(""))
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(folded, _BETWEEN), "")


def _up_to(last: Column) -> Column:
    """1..last, empty below 1."""
    return F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def _gram_hashes(w: Column, k: int) -> Column:
    mask = (1 << 64) - (1 << _PLACE) - (1 << 64)
    return F.transform(_up_to(F.size(w) - (k - 1)), lambda i: F.xxhash64(F.lit(k), F.slice(w, i, F.lit(k))).bitwiseAND(F.lit(mask)).bitwiseOR(i.cast("long")))


def fingerprints(w: Column, window: int = WINDOW, k: int = GRAM) -> Column:
    """Distinct winnowed fingerprints (hash and position in one long) of an array of words."""
    span = window - k + 1
    if span == 1:
        return _gram_hashes(w, k)
    return let(_gram_hashes(w, k), lambda h: F.array_distinct(F.transform(_up_to(F.size(h) - (span - 1)), lambda s: F.array_min(F.slice(h, s, F.lit(span))))))


def _hash(fp: Column) -> Column:
    return F.shiftright(fp, _PLACE)


def _place(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit((1 << _PLACE) - 1)).cast("int")


def benchmark_index(items: DataFrame, *, key: str = "item_id", text: str = "text", window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """(h, win, k, off, context, items): fingerprints with the item words around them and the items that have both."""
    base = items.select(F.col(key).alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    long = base.filter(F.size("w") >= window).select("item", "w", F.lit(window).alias("win"), F.lit(k).alias("k"), F.explode(fingerprints(F.col("w"), window, k)).alias("fp"))
    parts = [long]
    for n in range(1, window):
        parts.append(base.filter(F.size("w") == n).select("item", "w", F.lit(n).alias("win"), F.lit(n).alias("k"), F.explode(fingerprints(F.col("w"), n, n)).alias("fp")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    at = _place(F.col("fp"))
    start = F.greatest(at - (F.col("win") - F.col("k")), F.lit(1))
    out = out.select(_hash(F.col("fp")).alias("h"), "win", "k", (at - start + 1).alias("off"), F.slice("w", start, at - start + F.col("win")).alias("context"), "item")
    return out.groupBy("h", "win", "k", "off", "context").agg(F.collect_set("item").alias("items"))


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = GRAM, keep: list[str] | None = None) -> DataFrame:
    """Every row with (key, columns of ``keep``, n_words, hits, n_hit, hit_items): the windows found, the words inside them, the items they are of."""
    prepare(spark)
    index = materialize(spark, benchmark_index(items, key=item_key, text=item_text, window=window, k=k), "benchmark-index", path=fresh_path(spark, "benchmark-index"))
    taken = F.sum(F.octet_length(F.array_join("context", " ")) + 16 * F.size("context") + 32 * F.size("items") + 64)  # 32: an id, a longer one by its text
    sizes = {(r["win"], r["k"]): r["bytes"] for r in index.groupBy("win", "k").agg(taken.alias("bytes")).collect()}  # one row for each length up to the window
    kinds = sorted(sizes) or [(window, k)]
    w = F.col("w")
    prints = F.concat(*(fingerprints(w, win, kk) for win, kk in kinds))
    found = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("th"), words(F.col(text)).alias("w")).select("doc", "th", F.explode(prints).alias("fp")).select("doc", "th", _hash(F.col("fp")).alias("h"), _place(F.col("fp")).alias("p"))
    small = sum(sizes.values()) <= BROADCAST_BYTES
    hit = found.join(F.broadcast(index) if small else index, "h")
    per_doc = hit.groupBy("doc", "th").agg(F.collect_list(F.struct("p", "win", "k", "off", "context", "items")).alias("m"))

    names = [f"__keep{i}" for i in range(len(keep or []))]
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"), *(F.col(c).alias(n) for c, n in zip(keep or [], names, strict=True)))
    joined = rows.join(per_doc, F.col("__key").eqNullSafe(F.col("doc")) & (F.xxhash64("__text") == F.col("th")), "left").withColumn("__w", words(F.col("__text")))

    def windows_of(doc_words: Column, m: Column) -> Column:
        """Windows (s, n, items) of the document that hold the fingerprint and equal the item's window there."""
        shifts = F.sequence(F.lit(0), m["win"] - m["k"])
        spots = F.transform(shifts, lambda j: F.struct((m["p"] - j).alias("s"), (m["off"] - j).alias("o")))
        real = F.filter(spots, lambda x: (x["s"] >= 1) & (x["o"] >= 1) & (x["o"] + m["win"] - 1 <= F.size(m["context"])) & (x["s"] + m["win"] - 1 <= F.size(doc_words)))
        same = F.filter(real, lambda x: F.slice(doc_words, x["s"], m["win"]) == F.slice(m["context"], x["o"], m["win"]))
        return F.transform(same, lambda x: F.struct(x["s"].alias("start"), m["win"].alias("length"), m["items"].alias("items")))

    kind = dict(items.dtypes)[item_key]
    none = F.array().cast(f"array<struct<start:int,length:int,items:array<{kind}>>>")
    hits = F.when(F.col("m").isNull(), none).otherwise(F.flatten(F.transform("m", lambda m: windows_of(F.col("__w"), m))))
    out = joined.select("__key", *names, F.size("__w").cast("long").alias("n_words"), hits.alias("hits"))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1))))
    return out.select(
        F.col("__key").alias(key), *(F.col(n).alias(c) for c, n in zip(keep or [], names, strict=True)), "n_words", "hits",
        F.size(covered).cast("long").alias("n_hit"), F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"]))).alias("hit_items"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a 10-word window of a benchmark item, and the items."""
    out = contamination(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.array_sort(F.transform("hit_items", lambda x: x.cast("string")))
    return out.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, w, CAST(least(len(w), 10) AS INTEGER) AS n FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d CROSS JOIN (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
h AS (SELECT doc_id, dw.n, s, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.k = iw.k),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN g ON d.doc_id = g.doc_id
"""
