"""Bounded, deterministic samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from waymark.session import fresh_path, materialize

#: Bytes of examples that a fit takes to the driver at most.
FIT_BYTES = 256 << 20


def fold_of(key: str | Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null for a null key."""
    col = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(folds))


def bounded_per_class(df: DataFrame, label: str, key: str, per_class: int, *, most: int = 64) -> DataFrame:
    """At most ``per_class`` rows of each class, those with the smallest hash of the key.

    The result holds at most ``per_class`` times the number of classes rows, which is what makes it fit to broadcast.
    More than ``most`` classes are an error: each is taken by a sort of its own.
    """
    classes = sorted(r[0] for r in df.filter(F.col(label).isNotNull()).select(label).distinct().limit(most + 1).collect())
    if len(classes) > most:
        raise ValueError(f"more than {most} classes of {label}")
    parts = [df.filter(F.col(label) == F.lit(c)).orderBy(F.xxhash64(F.lit("sample"), F.col(key).cast("string")), F.col(key)).limit(per_class) for c in classes]
    if not parts:
        return df.limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gather(spark: SparkSession, examples: DataFrame, key: str, *, limit: int = FIT_BYTES) -> list[Row]:
    """Examples for a fit on the driver: of each key the least row of the other columns, and no more than about ``limit`` bytes of them.

    A key that stands in many rows is one example. Beyond the limit, examples are taken by a hash of their key.
    """
    others = [c for c in examples.columns if c != key]
    one = examples.groupBy(key).agg(F.min(F.struct(*others)).alias("m")).select(key, "m.*")
    one = materialize(spark, one, "examples", path=fresh_path(spark, "examples"))
    size = sum((F.octet_length(c) for c, kind in one.dtypes if kind in ("binary", "string")), F.lit(16))
    total = one.agg(F.sum(size)).first()[0] or 0
    if total > limit:
        one = one.filter(F.pmod(F.xxhash64(F.lit("gather"), F.col(key)), F.lit(1 << 20)) < int((1 << 20) * limit / total))
    return one.select(*others).collect()
