"""Runs a Spark query and its SQL twin and compares rows, column names and value types."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lakemill.session import SCHEMAS  # noqa: E402


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in SCHEMAS:
        path = Path(sf_dir) / f"{name}.parquet"
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
    return con


def norm(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, Decimal):
        return ("dec", value.normalize())
    if isinstance(value, dt.datetime):
        return ("ts", value.replace(tzinfo=None).isoformat())
    if isinstance(value, dt.date):
        return ("date", value.isoformat())
    if isinstance(value, dict):
        return tuple(sorted((str(k), norm(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return norm(value.asDict())
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, key, run, sql, sf_dir):
    """Returns (ok, message)."""
    start = time.time()
    df = run(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return True, f"{sum(got.values())} rows, no SQL twin, {took:.1f}s"
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if got != want:
        more, less = got - want, want - got
        return False, (
            f"{sum(got.values())} vs {sum(want.values())} rows; cols {got_cols}\n"
            f"   only spark {sum(more.values())}: {list(more)[:2]}\n"
            f"   only sql   {sum(less.values())}: {list(less)[:2]}"
        )
    return True, f"{sum(got.values())} rows, {took:.1f}s"


def main(argv):
    import traceback

    import __spark_entry__ as entry
    from lakemill.session import build_session

    sf_dir = os.environ.get("COMPARE_DIR", "/root/testdata/sf0.01")
    spark = build_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    keys = [k for k in queries if not argv or any(k.startswith(a) for a in argv)]
    bad = 0
    for key in keys:
        try:
            ok, message = compare(spark, con, key, queries[key], oracles.get(key), sf_dir)
        except Exception as error:  # report and go on with the next query
            ok, message = False, f"{type(error).__name__}: {str(error)[:700]}"
            if "-v" in argv:
                traceback.print_exc()
        bad += not ok
        print("ok  " if ok else "FAIL", key, message, flush=True)
    print(f"{len(keys) - bad}/{len(keys)} match")


if __name__ == "__main__":
    main(sys.argv[1:])
