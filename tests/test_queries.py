"""Every registered query against its SQL twin, and the shape of the entry module."""

from __future__ import annotations

import pytest
from compare import difference

import __spark_entry__ as entry
from tideline import registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert difference(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], SMALL) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
