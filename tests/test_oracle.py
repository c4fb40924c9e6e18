"""Every query with SQL equals it; every query without makes rows."""

import pytest
from oracle import assert_equal, connected

from sluice.operators import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def duck(small):
    return connected(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, small, duck, name):
    assert_equal(QUERIES[name](spark, small), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_makes_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark, small):
    import __spark_entry__

    assert {r["split"] for r in __spark_entry__.entry(spark).collect()} == {"train", "validation", "test"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
