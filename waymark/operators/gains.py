"""Gain compensation between overlapping clouds: normal equations as rows of a sparse matrix, solved by conjugate gradients.

The matrix never leaves its rows: a round joins them with the direction, adds up by cloud, and writes the vectors to the shared
folder; only two sums per round reach the driver. Clouds that no overlap connects are solved together, as blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.session import drop_path, fresh_path, materialize

#: Weights of differences in overlaps and of gains that are not 1.
ALPHA, BETA = 0.01, 100.0


def overlap_means(correspondences: DataFrame) -> DataFrame:
    """(i, j, n, mi, mj), i < j: pairs of points of two clouds and the mean intensities on either side, from (a, b, va, vb)."""
    flip = F.col("a") > F.col("b")
    rows = correspondences.filter("a <> b").select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), F.when(flip, F.col("vb")).otherwise(F.col("va")).alias("vi"), F.when(flip, F.col("va")).otherwise(F.col("vb")).alias("vj"))
    return rows.groupBy("i", "j").agg(F.count("*").alias("n"), F.avg("vi").alias("mi"), F.avg("vj").alias("mj"))


def normal_equations(sizes: DataFrame, overlaps: DataFrame, *, alpha: float = ALPHA, beta: float = BETA) -> tuple[DataFrame, DataFrame]:
    """((node, diagonal, right), (i, j, a)): the symmetric system of clouds (node, n) and their overlaps; off-diagonal entries both ways."""
    two = overlaps.select(F.col("i").alias("node"), F.col("j").alias("other"), "n", F.col("mi").alias("own"), F.col("mj").alias("its"))
    two = two.unionByName(overlaps.select(F.col("j").alias("node"), F.col("i").alias("other"), "n", F.col("mj").alias("own"), F.col("mi").alias("its")))
    off = two.select(F.col("node").alias("i"), F.col("other").alias("j"), (-2 * alpha * F.col("own") * F.col("its") * F.col("n")).alias("a"))
    sums = two.groupBy("node").agg(F.sum("n").alias("met"), F.sum(2 * alpha * F.col("own") * F.col("own") * F.col("n")).alias("square"))
    weight = beta * (F.col("n") + F.coalesce("met", F.lit(0)))
    return sizes.join(sums, "node", "left").select("node", (weight + F.coalesce("square", F.lit(0.0))).alias("diagonal"), weight.alias("right")), off


def solve(spark: SparkSession, diagonal: DataFrame, off: DataFrame, *, tolerance: float = 1e-10, most: int = 1000) -> DataFrame:
    """(node, x) of the symmetric positive definite system (node, diagonal, right) and (i, j, a), by conjugate gradients scaled by the diagonal.

    Ends when the scaled residual is ``tolerance`` of the first one; a solve that is not over after ``most`` rounds is an error.
    """
    matrix_path, path = fresh_path(spark, "matrix"), fresh_path(spark, "vectors")
    matrix = materialize(spark, off, "matrix", path=matrix_path)
    d = F.col("diagonal")
    state = materialize(spark, diagonal.select("node", "diagonal", F.lit(0.0).alias("x"), F.col("right").cast("double").alias("r"), F.lit(0.0).alias("p")), "vectors", path=path)
    first = rest = state.agg(F.sum(F.col("r") * F.col("r") / d)).first()[0]
    turn = 0.0
    for _ in range(most):
        if not rest or rest <= first * tolerance**2:
            drop_path(spark, matrix_path)
            return state.select("node", "x")
        ahead = state.withColumn("p", F.col("r") / d + turn * F.col("p"))
        product = matrix.join(ahead.select(F.col("node").alias("j"), "p"), "j").groupBy(F.col("i").alias("node")).agg(F.sum(F.col("a") * F.col("p")).alias("ap"))
        old, path = path, fresh_path(spark, "vectors")
        step = materialize(spark, ahead.join(product, "node", "left").withColumn("ap", F.coalesce("ap", F.lit(0.0)) + d * F.col("p")), "vectors", path=path)
        drop_path(spark, old)
        length = rest / step.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
        state = step.select("node", "diagonal", (F.col("x") + length * F.col("p")).alias("x"), (F.col("r") - length * F.col("ap")).alias("r"), "p")
        before, rest = rest, state.agg(F.sum(F.col("r") * F.col("r") / d)).first()[0]
        turn = rest / before
    raise RuntimeError(f"the system was not solved after {most} rounds")


def gains(spark: SparkSession, sizes: DataFrame, overlaps: DataFrame, *, alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """(node, gain) of every cloud of ``sizes`` (node, n); 1 for a cloud without overlaps."""
    return solve(spark, *normal_equations(sizes, overlaps, alpha=alpha, beta=beta)).withColumnRenamed("x", "gain")
