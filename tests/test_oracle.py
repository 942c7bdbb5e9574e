"""Every query against its SQL on the small tables."""

from __future__ import annotations

import pytest
from oracle import SF, assert_same

from quern.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_its_sql(spark, name):
    assert_same(spark, catalogue.QUERIES[name], catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(spark, name):
    out = catalogue.QUERIES[name](spark, SF)
    assert out.columns and out.count() >= 0


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalogue.QUERIES) <= set(e.queries())
