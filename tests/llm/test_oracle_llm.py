"""The operators' queries against their SQL on the small tables."""

from __future__ import annotations

import pytest
from oracle import assert_same

from quern.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_its_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.SQL[name])
