"""The training-data queries against their SQL in DuckDB."""

import pytest

from recallgrid.llm.queries import ORACLES, QUERIES
from tests.duck import connect, rows_of, sql_rows

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, name):
    names, got = rows_of(QUERIES[name](spark, SF))
    want_names, want = sql_rows(con, ORACLES[name])
    assert names == want_names and got == want
