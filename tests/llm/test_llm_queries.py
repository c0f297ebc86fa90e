"""The training-data queries that SQL can state, or bound, against that SQL."""

import pytest
from compare import connect, difference

from tapeloom.llm import queries


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, sf, con, name):
    assert difference(spark, sf, con, queries.QUERIES[name], queries.SQL[name]) is None


def test_every_problem_has_its_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"p{k}" for k in range(1, 9)} and set(queries.SQL) <= set(queries.QUERIES)
