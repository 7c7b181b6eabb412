"""Every query of the core with SQL gives the SQL's rows on the smallest tables."""

import pytest

from tests.oracle import assert_same, connect
from tidelog import queries as registry

SQL = registry.sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, con, name):
    assert_same(registry.queries()[name](spark, data), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_gives_rows(spark, data, name):
    assert registry.queries()[name](spark, data).count() > 0
