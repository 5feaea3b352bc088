"""Every registered query against its SQL; those without SQL run and give rows."""

from __future__ import annotations

import pytest
from compare import assert_same, connect

from robolake.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, sf, name):
    assert_same(registry.QUERIES[name](spark, sf), connect(sf), registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
