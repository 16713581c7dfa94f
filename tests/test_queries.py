"""Every registered query with checking SQL agrees with an embedded SQL engine."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import connect, difference


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, sf, name):
    assert difference(spark, con, queries()[name], oracle_sql()[name], sf) is None


def test_entry(spark):
    assert entry(spark).columns[0] == "year"


def test_sql_names_are_registered():
    assert set(oracle_sql()) <= set(queries())
