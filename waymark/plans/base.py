"""Registration of queries: a name, the operators of the inventory that it covers, and its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def query(ids: str, sql: str | None = None):
    """Register the function under its own name; it gets a loader of tables."""

    def add(fn: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        COVERS[fn.__name__] = tuple(ids.split())
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add
