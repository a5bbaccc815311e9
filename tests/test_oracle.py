"""Every query with SQL against DuckDB on the smallest tables."""

import pytest

from klangwerk.plans import ORACLE_SQL, QUERIES
from tests.oracle import connection, rows


@pytest.fixture(scope="module")
def duck(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_match(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
