"""Every query with SQL gives the rows of that SQL."""

from __future__ import annotations

import pytest
from parity import assert_same

from waymark import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert_same(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF)


def test_entry_point_lists_every_query():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["node", "likelihood"]
