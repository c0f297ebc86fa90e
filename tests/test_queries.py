"""Every query of the core against its SQL on the smallest tables, and the contract of the entry module."""

import pytest
from compare import connect, difference

from tapeloom import registry

SLOW = {"assembled_shows", "notes_fields"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, sf, con, name):
    assert difference(spark, sf, con, registry.QUERIES[name], registry.SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert len(e.entry(spark).columns) == 6
    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
