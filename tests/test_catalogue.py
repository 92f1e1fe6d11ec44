"""Every registered query of the keyspace operators against its SQL on the smallest tables."""

import pytest

from keelson.plans import catalogue
from tests.oracle import SF, same

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    same(QUERIES[name](spark, SF), SQL[name])


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()
