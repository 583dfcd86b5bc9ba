"""Every query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_points
from tests import oracle

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert oracle.differences(spark, con, QUERIES[name], SQL[name], SF_DIR) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_sql_only_for_known_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    row = entry_points.entry(spark).collect()[0]
    assert round(row["map50"], 6) == 0.681499
    assert round(row["map50_95"], 6) == 0.431292
