"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from lakemill.plans import catalogue

SMALL = "/root/testdata/sf0.001"
QUERIES = catalogue.queries()
ORACLES = catalogue.oracles()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("key", list(QUERIES))
def test_matches_sql(spark, con, key):
    ok, message = compare(spark, con, key, QUERIES[key], ORACLES.get(key), SMALL)
    assert ok, message


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["category", "total_sales"]
