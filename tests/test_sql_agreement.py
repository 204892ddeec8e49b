"""Every registered query gives the rows of its SQL."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from catalog import CATALOG
from tests.conftest import SMALL
from tools.compare_with_sql import connect, difference

SQL = oracle_sql()


@pytest.fixture(scope="module")
def tables():
    return connect(SMALL)


def test_everything_has_sql():
    assert set(CATALOG) <= set(SQL) and set(SQL) <= set(queries())


@pytest.mark.parametrize("name", list(CATALOG))
def test_query(spark, tables, name):
    df = queries()[name](spark, SMALL)
    result = tables.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert difference(df.collect(), result.fetchall(), df.columns, columns) is None


def test_flagship(spark):
    assert entry(spark).count() > 0
