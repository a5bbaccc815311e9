"""Queries of the subpackage that SQL can express, against DuckDB on the smallest tables."""

import pytest

from klangwerk.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import connection, rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_match(spark, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), connection(sf).execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
