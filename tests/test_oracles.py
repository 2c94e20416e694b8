"""Every registered query against its SQL in DuckDB; the others give rows of a stable schema."""

import pytest

import __spark_entry__ as entry
from recallgrid.plans import catalog
from tests.conftest import DATA
from tests.duck import connect, rows_of, sql_rows

SF = f"{DATA}/sf0.001"
NAMES = sorted(catalog.queries())
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in NAMES if n in SQL])
def test_same_rows_as_sql(spark, con, name):
    names, got = rows_of(catalog.queries()[name](spark, SF))
    want_names, want = sql_rows(con, SQL[name])
    assert names == want_names
    assert got == want


@pytest.mark.parametrize("name", [n for n in NAMES if n not in SQL])
def test_gives_rows(spark, name):
    df = catalog.queries()[name](spark, SF)
    assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 2


def test_each_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
