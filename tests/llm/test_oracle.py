"""Corpus queries against their SQL twins."""

from __future__ import annotations

import pytest
from compare import difference

from tideline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert difference(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], "/root/testdata/sf0.001") == ""
