"""Every registered query with an SQL form gives the same rows as DuckDB on the smallest tables."""

import os

import pytest

from strandline.plans.catalog import ORACLES, QUERIES
from tests.oracle_check import compare, duck

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    got = QUERIES[name](spark, SF_DIR).toArrow()
    want = con.execute(ORACLES[name]).to_arrow_table()
    assert want.num_rows, "a check of nothing against nothing"
    assert compare(got, want) == ""


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
