"""Queries that SQL can state, against their SQL; the others for their rows."""

import pytest
from compare import compare, connect

from lakemill.llm.queries import ORACLES, QUERIES

ROWS = {"op1_url_templates": "pages"}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("key", list(ORACLES))
def test_matches_sql(spark, con, key, small):
    ok, message = compare(spark, con, key, QUERIES[key], ORACLES[key], small)
    assert ok, message


@pytest.mark.parametrize("key", [k for k in QUERIES if k not in ORACLES and k[:4] != "op6_"])
def test_one_row_per_input_row(spark, con, key, small):
    table = ROWS.get(key, "documents")
    want = con.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
    assert QUERIES[key](spark, small).count() == want
