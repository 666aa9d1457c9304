import pytest
from conftest import SF
from parity import assert_same

from recordspine.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_duckdb(spark, name):
    assert_same(QUERIES[name](spark, SF), SQL[name], SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
