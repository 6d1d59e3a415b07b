"""Every registered query with SQL equals it, over whole tables."""

import pytest
from tree_cases import SF

import __spark_entry__ as entry
from oracle import compare, connect

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert compare(entry.queries()[name](spark, SF), duck, ORACLES[name]) is None


def test_entry_is_the_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 20
    assert rows == sorted(rows, key=lambda r: (-r.score, -r.fan_in, -r.churn, r.id))
