"""Queries over tables split into several files, where one key holds a third of the rows."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()
FAMILIES = ("join_", "agg_", "win_", "udf_", "udtf_", "view_", "dim_", "rpt_", "dq_", "dml_", "stm_",
            "src_project", "snk_range")


def hot(column, value, *seed):
    """Replace a column by one value in a third of the rows."""
    return f"CASE WHEN hash({', '.join(seed)}) % 3 = 0 THEN {value} ELSE {column} END AS {column}"


LINE = ("l_extendedprice", "l_partkey", "l_tax")
HOT = {
    "lineitem": [
        hot("l_orderkey", 11, *LINE, "1"),
        hot("l_partkey", 7, *LINE, "2"),
        hot("l_suppkey", 3, *LINE, "3"),
        hot("l_shipdate", "TIMESTAMP '1998-04-05'", *LINE, "4"),
    ],
    "orders": [hot("o_custkey", 5, "o_orderkey")],
    "customer": [hot("c_nationkey", 4, "c_custkey")],
    "part": [hot("p_brand", "'Brand#1'", "p_partkey")],
    "events": [hot("user_id", 8, "event_id")],
}
FILES = {"lineitem": 5, "orders": 4, "customer": 3, "part": 3, "events": 3, "documents": 3}


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = connect(SMALL)
    for (table,) in con.execute("SELECT view_name FROM duckdb_views() WHERE NOT internal").fetchall():
        (folder / f"{table}.parquet").mkdir()
        replaced = f" REPLACE ({', '.join(HOT[table])})" if table in HOT else ""
        con.execute(f"CREATE OR REPLACE TEMP TABLE rows_ AS SELECT *{replaced} FROM {table}")
        total = con.execute("SELECT COUNT(*) FROM rows_").fetchone()[0]
        parts = FILES.get(table, 1)
        for i in range(parts):
            con.execute(
                f"COPY (SELECT * FROM rows_ WHERE rowid >= {total * i // parts}"
                f" AND rowid < {total * (i + 1) // parts})"
                f" TO '{folder}/{table}.parquet/part-{i}.parquet'"
            )
    return str(folder)


@pytest.fixture(scope="module")
def con(skewed):
    return connect(skewed)


@pytest.mark.parametrize("key", [k for k in QUERIES if k.startswith(FAMILIES)])
def test_matches_sql_on_hot_keys(spark, con, skewed, key):
    ok, message = compare(spark, con, key, QUERIES[key], ORACLES.get(key), skewed)
    assert ok, message
