"""Every query with SQL gives the rows that DuckDB gives; the others run and give rows."""

from __future__ import annotations

import pytest
from oracle import SF, connect, rows

from tessella.plans.catalogue import ORACLE, QUERIES

WITHOUT_SQL = sorted(set(QUERIES) - set(ORACLE))


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = con.execute(ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_has_both():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
