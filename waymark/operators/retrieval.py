"""Appearance retrieval: inverted index, TF-IDF likelihood, its normalisation, similarity and word assignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of words in one broadcast row or one block of a dictionary.
DICTIONARY_BYTES = 16 << 20


def term_counts(words: DataFrame, node: str = "node", word: str = "word") -> DataFrame:
    """Inverted index (word, node, nwi): how often each word occurs in each node."""
    return words.groupBy(word, node).agg(F.count("*").alias("nwi"))


def words_per_node(words: DataFrame, node: str = "node") -> DataFrame:
    return words.groupBy(node).agg(F.count("*").alias("ni"))


def likelihood(words: DataFrame, query_words: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, likelihood) of every node: the sum over the query's unique words of nwi * log10(N / nw) / ni.

    ``words`` is (node, word), one row per occurrence, or (node, word, nwi) with their number, ``query_words`` (word), ``nodes``
    (node). Words that all nodes hold weigh nothing. Words that the query has not are counted together before anything is
    shuffled.
    """
    times = F.sum("nwi") if "nwi" in words.columns else F.count("*")
    n = nodes.agg(F.count("*").alias("n"))
    asked = query_words.select("word").distinct().withColumn("asked", F.lit(True))
    index = words.join(asked, "word", "left").groupBy("node", F.when(F.col("asked"), F.col("word")).alias("word")).agg(times.alias("nwi"))
    hits = index.filter("word is not null")
    nw = hits.groupBy("word").agg(F.count("*").alias("nw"))
    idf = nw.crossJoin(F.broadcast(n)).select("word", F.log10(F.col("n") / F.col("nw")).alias("idf")).filter("idf > 0")  # n is one row
    scored = hits.join(idf, "word").groupBy("node").agg(F.sum(F.col("nwi") * F.col("idf")).alias("score"))
    ni = index.groupBy("node").agg(F.sum("nwi").alias("ni"))
    return nodes.join(scored, "node", "left").join(ni, "node", "left").select("node", F.coalesce(F.col("score") / F.col("ni"), F.lit(0.0)).alias("likelihood"))


def adjust(scores: DataFrame, value: str = "likelihood", *, ratio: bool = False, epsilon: float = 1e-4) -> DataFrame:
    """Normalise likelihoods by the mean and deviation of the positive ones; what isn't above mean + deviation is 1.

    Adds ``adjusted`` and ``virtual``, the value of the place that stands for none of the nodes.
    """
    v = F.col(value)
    positive = scores.filter(v > 0).agg(F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"), F.max(v).alias("top"))
    scale = (v - F.col("mean")) / F.col("sd") if ratio else (v - (F.col("sd") - epsilon)) / F.col("mean")
    adjusted = F.when(v > F.col("mean") + F.col("sd"), scale).otherwise(F.lit(1.0))
    other = F.col("sd") / (F.col("top") - F.col("mean")) + 1 if ratio else F.col("mean") / F.col("sd") + 1
    usable = (F.col("sd") > 0) & (F.col("mean") > 0) & ((F.col("top") > F.col("mean")) if ratio else F.lit(True))
    virtual = F.when(usable, other).otherwise(F.lit(2.0))
    return scores.crossJoin(F.broadcast(positive)).withColumn("adjusted", adjusted).withColumn("virtual", virtual).drop("mean", "sd", "top")  # one row


def pair_similarity(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, common, similarity): words paired one to one, over the larger of the two word totals; 0 without words."""
    totals = index.groupBy("node").agg(F.sum("nwi").alias("total"))
    left = pairs.join(index.select(F.col("node").alias("a"), "word", F.col("nwi").alias("ca")), "a")
    both = left.join(index.select(F.col("node").alias("b"), "word", F.col("nwi").alias("cb")), ["b", "word"])
    common = both.groupBy("a", "b").agg(F.sum(F.least("ca", "cb")).alias("common"))
    sized = pairs.join(totals.select(F.col("node").alias("a"), F.col("total").alias("ta")), "a", "left").join(totals.select(F.col("node").alias("b"), F.col("total").alias("tb")), "b", "left")
    most = F.greatest(F.coalesce("ta", F.lit(0)), F.coalesce("tb", F.lit(0)))
    out = sized.join(common, ["a", "b"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    return out.select("a", "b", "common", F.when(most > 0, F.col("common") / most).otherwise(F.lit(0.0)).alias("similarity"))


def unique_pairs(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, unique_pairs, counted): words found once on both sides, and the one-to-one count over all words."""
    left = pairs.join(index.select(F.col("node").alias("a"), "word", F.col("nwi").alias("ca")), "a")
    both = left.join(index.select(F.col("node").alias("b"), "word", F.col("nwi").alias("cb")), ["b", "word"])
    return both.groupBy("a", "b").agg(F.count_if((F.col("ca") == 1) & (F.col("cb") == 1)).alias("unique_pairs"), F.sum(F.least("ca", "cb")).alias("counted"), F.sum(F.col("ca") * F.col("cb")).alias("all_pairs"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def two_nearest(descriptors: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id, word1, d1, word2, d2): the two nearest words of each descriptor by squared distance; ties to the smaller word.

    The dictionary is (word, vec). Up to DICTIONARY_BYTES it is one broadcast row, over which each descriptor keeps its two
    best without a shuffle; a larger one is joined in blocks of such rows, and the blocks' best two are merged.
    """
    taken = dictionary.agg(F.sum(8 * F.size("vec") + 16).alias("bytes")).first()["bytes"] or 0
    blocks = -(-taken // DICTIONARY_BYTES) or 1
    block = F.pmod(F.xxhash64("word"), F.lit(blocks)).cast("int")
    words = dictionary.groupBy(block.alias("block")).agg(F.collect_list(F.struct("word", "vec")).alias("words"))
    if blocks == 1:
        pairs = descriptors.join(F.broadcast(words), F.lit(True), "left")
    else:
        pairs = descriptors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(words, "block")
    near = F.transform("words", lambda w: F.struct(squared_distance(F.col("vec"), w["vec"]).alias("d"), w["word"].alias("word")))
    best = pairs.select("id", F.slice(F.array_sort(near), 1, 2).alias("best"))
    if blocks > 1:
        best = best.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, 2).alias("best"))
    first, second = F.try_element_at("best", F.lit(1)), F.try_element_at("best", F.lit(2))
    return best.select("id", first["word"].alias("word1"), first["d"].alias("d1"), second["word"].alias("word2"), second["d"].alias("d2"))


def incremental_words(descriptors: DataFrame, *, by: list[str], order: str, ratio: float = 0.8) -> DataFrame:
    """(by..., order, word, is_new) of descriptors ``vec`` that make their dictionary as they come.

    In order, a descriptor is compared with all words made before it: with fewer than two words, or where the nearest is
    farther than ``ratio`` times the second (squared distances), it becomes a new word, numbered from 1; else it is the
    nearest one, the smaller at ties. The order matters, so a key (a session with its own dictionary) is one task's work,
    held as a matrix; distances of a descriptor to all words are one vector operation.
    """
    kinds = dict(descriptors.dtypes)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(order, "ascending")])
        x = np.array(table.column("vec").to_pylist(), dtype=float)
        made, word, new = np.empty((len(x), x.shape[1])), np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        n = 0
        for i, v in enumerate(x):
            if n >= 2:
                d = ((made[:n] - v) ** 2).sum(1)
                near = int(d.argmin())
                second = np.partition(d, 1)[1]
            if n < 2 or d[near] > ratio * second:
                made[n] = v
                n += 1
                word[i], new[i] = n, True
            else:
                word[i] = near + 1
        return table.select([*by, order]).append_column("word", pa.array(word)).append_column("is_new", pa.array(new))

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, order]) + ", word long, is_new boolean"
    return descriptors.select(*by, order, "vec").groupBy(*by).applyInArrow(run, schema)


def assign_words(descriptors: DataFrame, dictionary: DataFrame, *, ratio: float = 0.8, fixed: bool = False) -> DataFrame:
    """(id, word): the nearest word; without ``fixed`` 0 where there is no second one or the first is not clearly nearer."""
    near = two_nearest(descriptors, dictionary)
    if fixed:
        return near.select("id", F.col("word1").alias("word"))
    keep = F.col("d2").isNotNull() & (F.col("d1") <= ratio * F.col("d2"))
    return near.select("id", F.when(keep, F.col("word1")).otherwise(F.lit(0)).alias("word"))


def unused_words(dictionary: DataFrame, index: DataFrame) -> DataFrame:
    return dictionary.join(index, "word", "left_anti")


def accept_hypothesis(posterior: DataFrame, *, threshold: float, ratio: float = 0.0, previous: float = 0.0) -> DataFrame:
    """The most probable node (node, p, accepted, reason); ties to the smaller node. Gates are tried in this order."""
    best = posterior.orderBy(F.desc("p"), "node").limit(1)
    reason = (
        F.when(F.col("node").isNull(), "none").when(F.col("p") < threshold, "below_threshold").when((F.lit(ratio) > 0) & (F.col("p") < ratio * previous), "below_ratio").otherwise("accepted")
    )
    return best.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "accepted")


def nearest_rank(partition: list[str], order: list[Column], k: int, df: DataFrame) -> DataFrame:
    """The first k rows of each partition, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).filter(F.col("rank") <= k)
