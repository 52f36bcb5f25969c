"""Retrieval queries over the documents' words and the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators import retrieval as R
from waymark.operators import sequences as S
from waymark.plans.base import query


def tokens(documents: DataFrame) -> DataFrame:
    """(node, word): the documents as a bag-of-words fact table."""
    return documents.select(F.col("doc_id").alias("node"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))


_INDEX = """
t AS (SELECT doc_id AS node, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
ix AS (SELECT word, node, count(*) AS nwi FROM t GROUP BY word, node),
ni AS (SELECT node, sum(nwi) AS ni FROM ix GROUP BY node)"""
_LIKELIHOOD = f"""WITH {_INDEX},
q AS (SELECT DISTINCT word FROM ix WHERE node = (SELECT max(doc_id) FROM documents)),
c AS (SELECT doc_id AS node FROM documents WHERE doc_id <> (SELECT max(doc_id) FROM documents)),
cx AS (SELECT * FROM ix WHERE node IN (SELECT node FROM c)),
nw AS (SELECT word, count(*) AS nw FROM cx WHERE word IN (SELECT word FROM q) GROUP BY word),
s AS (SELECT cx.node, sum(nwi * log10((SELECT count(*) FROM c)::DOUBLE / nw) / ni) AS score FROM cx JOIN nw USING (word) JOIN ni USING (node) GROUP BY cx.node),
l AS (SELECT c.node, coalesce(score, 0.0) AS likelihood FROM c LEFT JOIN s ON s.node = c.node)"""


def _newest_against_rest(table) -> DataFrame:
    docs = table("documents").select("doc_id", "text")
    last = docs.agg(F.max("doc_id").alias("last"))
    newest = docs.join(F.broadcast(last), F.col("doc_id") == F.col("last")).select("doc_id", "text")  # one row
    rest = docs.join(F.broadcast(last), F.lit(True)).filter("doc_id <> last").select("doc_id", "text")
    return R.likelihood(tokens(rest), tokens(newest).select("word"), rest.select(F.col("doc_id").alias("node")))


@query("RET-07 AGG-04 JOIN-05 TOP-10 SCL-22", f"{_LIKELIHOOD} SELECT node, round(likelihood, 6) AS likelihood FROM l ORDER BY l.likelihood DESC, node LIMIT 20")
def tfidf_topk(table):
    """The 20 documents most like the newest one, by TF-IDF over the inverted index."""
    return _newest_against_rest(table).orderBy(F.desc("likelihood"), "node").limit(20).select("node", F.round("likelihood", 6).alias("likelihood"))


@query(
    "RET-09",
    f"""{_LIKELIHOOD},
p AS (SELECT avg(likelihood) AS mean, coalesce(stddev_samp(likelihood), 0) AS sd FROM l WHERE likelihood > 0)
SELECT node, round(CASE WHEN likelihood > mean + sd THEN (likelihood - (sd - 1e-4)) / mean ELSE 1.0 END, 4) AS adjusted,
round(CASE WHEN sd > 0 AND mean > 0 THEN mean / sd + 1 ELSE 2.0 END, 4) AS virtual FROM l CROSS JOIN p""",
)
def likelihood_adjust(table):
    """Normalised likelihood of every document, and that of the virtual place."""
    return R.adjust(_newest_against_rest(table)).select("node", F.round("adjusted", 4).alias("adjusted"), F.round("virtual", 4).alias("virtual"))


_PAIRS = f"""WITH {_INDEX},
p AS (SELECT a, b FROM (SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents) WHERE b IS NOT NULL)"""


def _neighbours(table) -> DataFrame:
    out = S.following(table("documents").select("doc_id", "source"), by=["source"], order="doc_id")
    return out.select(F.col("doc_id").alias("a"), F.col("next").alias("b")).filter("b is not null")


@query(
    "JOIN-06 RET-08 RET-13",
    f"""{_PAIRS},
c AS (SELECT a, b, sum(least(x.nwi, y.nwi)) AS common FROM p JOIN ix x ON x.node = a JOIN ix y ON y.node = b AND y.word = x.word GROUP BY a, b)
SELECT p.a, p.b, CAST(coalesce(common, 0) AS BIGINT) AS common, round(CASE WHEN greatest(coalesce(m.ni, 0), coalesce(n.ni, 0)) > 0 THEN coalesce(common, 0) / greatest(coalesce(m.ni, 0), coalesce(n.ni, 0)) ELSE 0 END, 6) AS similarity
FROM p LEFT JOIN ni m ON m.node = p.a LEFT JOIN ni n ON n.node = p.b LEFT JOIN c ON c.a = p.a AND c.b = p.b""",
)
def bow_pair_similarity(table):
    """Similarity of each document and the next of its source: words paired one to one over the larger total."""
    out = R.pair_similarity(R.term_counts(tokens(table("documents"))), _neighbours(table))
    return out.select("a", "b", "common", F.round("similarity", 6).alias("similarity"))


@query(
    "JOIN-06b JOIN-06c",
    f"""{_PAIRS}
SELECT a, b, count(*) FILTER (WHERE x.nwi = 1 AND y.nwi = 1) AS unique_pairs, CAST(sum(least(x.nwi, y.nwi)) AS BIGINT) AS counted, CAST(sum(x.nwi * y.nwi) AS BIGINT) AS all_pairs
FROM p JOIN ix x ON x.node = a JOIN ix y ON y.node = b AND y.word = x.word GROUP BY a, b""",
)
def unique_word_pairs(table):
    """Words that neighbours hold once each, their one-to-one count and their number of all pairs."""
    return R.unique_pairs(R.term_counts(tokens(table("documents"))), _neighbours(table))


@query(
    "RET-08 JOIN-07",
    """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = (SELECT max(vec_id) FROM embeddings))
SELECT vec_id, round((list_dot_product(embedding::DOUBLE[], q.v) + 1) / 2, 6) AS similarity FROM embeddings CROSS JOIN q
WHERE vec_id <> (SELECT max(vec_id) FROM embeddings) ORDER BY list_dot_product(embedding::DOUBLE[], q.v) DESC, vec_id LIMIT 20""",
)
def global_descriptor_topk(table):
    """The 20 vectors most like the newest, as (dot + 1) / 2 of normalised descriptors."""
    vectors = table("embeddings").select("vec_id", "embedding")
    newest = vectors.orderBy(F.desc("vec_id")).limit(1).select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    scored = vectors.join(F.broadcast(newest), F.col("vec_id") != F.col("q")).select("vec_id", R.dot(F.col("embedding"), F.col("v")).alias("d"))  # one row
    return scored.orderBy(F.desc("d"), "vec_id").limit(20).select("vec_id", F.round((F.col("d") + 1) / 2, 6).alias("similarity"))


_NEAR = """WITH dict AS (SELECT label + 1 AS word, arg_min(embedding, vec_id)::DOUBLE[] AS vec FROM embeddings GROUP BY label),
d AS (SELECT vec_id AS id, word, list_sum([(x - y) * (x - y) FOR x, y IN embedding::DOUBLE[]]) AS d FROM embeddings, dict WHERE false),
n AS (SELECT vec_id AS id, word, power(list_distance(embedding::DOUBLE[], vec), 2) AS d FROM embeddings CROSS JOIN dict),
r AS (SELECT id, word, d, row_number() OVER (PARTITION BY id ORDER BY d, word) AS rn, lead(d) OVER (PARTITION BY id ORDER BY d, word) AS d2 FROM n)"""
_NEAR = _NEAR.replace("d AS (SELECT vec_id AS id, word, list_sum([(x - y) * (x - y) FOR x, y IN embedding::DOUBLE[]]) AS d FROM embeddings, dict WHERE false),\n", "")


def _dictionary(table) -> DataFrame:
    return table("embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vec")).select((F.col("label") + 1).alias("word"), "vec")


@query("RET-03", f"{_NEAR} SELECT id, CASE WHEN d2 IS NOT NULL AND d <= 0.8 * d2 THEN word ELSE 0 END AS word FROM r WHERE rn = 1")
def nndr_quantize_batch(table):
    """Each vector's nearest word of a fixed dictionary, 0 where the nearest is not clearly nearer than the second."""
    return R.assign_words(table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), _dictionary(table))


@query("RET-01", """WITH RECURSIVE v AS (SELECT vec_id % 16 AS session, vec_id, [embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE] AS vec FROM embeddings),
n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY vec_id) AS rn FROM v),
k AS (SELECT session, rn, vec_id, [vec] AS made, CAST(1 AS BIGINT) AS word, true AS is_new FROM n WHERE rn = 1
UNION ALL SELECT session, rn, vec_id, CASE WHEN fresh THEN list_append(made, vec) ELSE made END, CASE WHEN fresh THEN len(made) + 1 ELSE list_position(d, list_min(d)) END, fresh
FROM (SELECT *, len(made) < 2 OR list_min(d) > 0.8 * list_sort(d)[2] AS fresh FROM (
SELECT n.session, n.rn, n.vec_id, n.vec, k.made, list_transform(k.made, lambda m: (m[1] - n.vec[1]) * (m[1] - n.vec[1]) + (m[2] - n.vec[2]) * (m[2] - n.vec[2]) + (m[3] - n.vec[3]) * (m[3] - n.vec[3])) AS d FROM k JOIN n ON n.session = k.session AND n.rn = k.rn + 1)))
SELECT session, vec_id, word, is_new FROM k""")
def nndr_incremental(table):
    """Words that sixteen sessions make as their vectors (three components) come: new ones where no word is clearly nearest."""
    v = table("embeddings").select((F.col("vec_id") % 16).alias("session"), "vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("vec"))
    return R.incremental_words(v, by=["session"], order="vec_id")


@query("RET-02", f"{_NEAR} SELECT id, word, round(d, 6) AS d1 FROM r WHERE rn = 1")
def fixed_dictionary_assign(table):
    """Each vector's nearest word and squared distance."""
    near = R.two_nearest(table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), _dictionary(table))
    return near.select("id", F.col("word1").alias("word"), F.round("d1", 6).alias("d1"))


@query("RET-06 SET-02 JOIN-03", "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def anti_unused(table):
    """Words (parts) that no reference (large line) uses."""
    used = table("lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("word"))
    return R.unused_words(table("part").select(F.col("p_partkey").alias("word"), "p_name"), used).withColumnRenamed("word", "p_partkey")


@query(
    "RET-16 TOP-10",
    f"""{_LIKELIHOOD}, z AS (SELECT sum(likelihood) AS z FROM l)
SELECT node, round(likelihood / z, 6) AS p, CASE WHEN likelihood / z < 0.01 THEN 'below_threshold' ELSE 'accepted' END AS reason, likelihood / z >= 0.01 AS accepted
FROM l CROSS JOIN z ORDER BY likelihood DESC, node LIMIT 1""",
)
def hypothesis_acceptance(table):
    """The most probable place of the normalised likelihood and whether the gates accept it."""
    scores = _newest_against_rest(table)
    total = scores.agg(F.sum("likelihood").alias("z"))
    posterior = scores.join(F.broadcast(total), F.lit(True)).select("node", (F.col("likelihood") / F.col("z")).alias("p"))  # one row
    return R.accept_hypothesis(posterior, threshold=0.01).select("node", F.round("p", 6).alias("p"), "reason", "accepted")
