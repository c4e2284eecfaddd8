"""Every core query against its SQL on the smallest data."""

import pytest
from compare import differences, views

from siftline.plans import queries

NAMES = sorted(queries.queries())


@pytest.fixture(scope="module")
def con(small):
    return views(small)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, con, name):
    sql = queries.oracle_sql().get(name)
    query = queries.queries()[name]
    if sql is None:
        assert query(spark, small).count() >= 0
        return
    _, mine, theirs = differences(query, sql, spark, con, small)
    assert not mine and not theirs


def test_sql_has_queries():
    assert set(queries.oracle_sql()) <= set(NAMES)
