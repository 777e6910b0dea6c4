"""Open periods, keyed periods, vectors without direction, and change order across batches."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakemill.functions.vectors import top_k
from lakemill.operators.periods import LEVELS, day_probes, join_periods, period_ranges


def day(text):
    return dt.date.fromisoformat(text)


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame(
        [(1, day("2020-01-31")), (1, day("2020-02-01")), (2, day("2021-05-05")), (3, None)],
        "emp long, day date",
    )


@pytest.fixture(scope="module")
def periods(spark):
    return spark.createDataFrame(
        [
            (1, day("2019-01-01"), day("2020-02-01"), "a"),
            (1, day("2020-02-01"), day("9999-01-01"), "b"),
            (2, day("1985-01-01"), None, "c"),
            (3, day("2020-01-01"), day("2020-01-01"), "empty"),
        ],
        "id long, from_date date, to_date date, title string",
    )


def test_keyed_periods(facts, periods):
    got = join_periods(facts, F.col("day"), periods, keys={"emp": "id"})
    assert sorted((str(r.day), r.title) for r in got.collect()) == [
        ("2020-01-31", "a"), ("2020-02-01", "b"), ("2021-05-05", "c"),
    ]


def test_open_periods_without_keys(facts, periods):
    got = join_periods(facts, F.col("day"), periods)
    assert sorted((str(r.day), r.title) for r in got.collect()) == [
        ("2020-01-31", "a"), ("2020-01-31", "c"), ("2020-02-01", "b"), ("2020-02-01", "c"),
        ("2021-05-05", "b"), ("2021-05-05", "c"),
    ]
    assert join_periods(facts.where("emp = 3"), F.col("day"), periods).count() == 0


def test_ranges_tile_a_period(spark):
    """Every day of a period lies in exactly one of its ranges, no day outside lies in any."""
    rows = [(i, day("2020-01-01") + dt.timedelta(a), day("2020-01-01") + dt.timedelta(b))
            for i, (a, b) in enumerate([(0, 1), (3, 3), (5, 4), (0, 64), (1, 63), (7, 200), (13, 14), (6, 9)])]
    rows.append((8, day("2020-01-05"), day("9999-01-01")))
    df = spark.createDataFrame(rows, "id long, a date, b date")
    cut = period_ranges(df, F.col("a"), F.col("b")).collect()
    start = day("2020-01-01")
    held = {i: [r for r in cut if r.id == i] for i in range(9)}
    for i, a, b in rows:
        for n in range(-3, 260):
            d = start + dt.timedelta(n)
            number = (d - day("0001-01-01")).days
            hits = sum(number >> r._level == r._at for r in held[i])
            assert hits == (a <= d < b), (i, d)
    assert len(held[8]) <= 2 * LEVELS and not held[1] and not held[2]


def test_no_range_meets_more_days_than_it_has(spark):
    days = spark.range(3000).selectExpr("date_add(DATE '1999-12-31', CAST(id AS INT)) AS d")
    worst = day_probes(days, "d").groupBy("_level", "_at").count().collect()
    assert all(r["count"] <= 2 ** r._level for r in worst)


def test_hot_days_and_long_periods_need_no_listing(spark, periods):
    facts = spark.range(20_000).selectExpr("id", "date_add(DATE '2021-05-05', CAST(id / 20000 AS INT)) AS d")
    joined = join_periods(facts, F.col("d"), periods)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert joined.count() == 40_000


def test_vectors_without_direction(spark):
    rng = np.random.default_rng(1)
    given = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(40)]
    odd = [(100, [0.0] * 4), (101, [0.0] * 4), (102, [float("nan"), 1.0, 1.0, 1.0]),
           (103, [None, 1.0, 1.0, 1.0]), (104, None), (105, [1.0])]
    vectors = spark.createDataFrame(given + odd, "id long, v array<double>").coalesce(1)
    queries = spark.createDataFrame([(1, given[0][1]), (2, [0.0] * 4)], "query_id long, q array<double>")
    got = top_k(vectors, "id", "v", queries, 4, 3).orderBy(F.desc("score")).collect()
    q = np.array(given[0][1])
    score = {i: float(np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q)) for i, v in given}
    best = sorted(score, key=lambda i: (-score[i], i))[:3]
    assert [(r.query_id, r.id) for r in got] == [(1, i) for i in best]
