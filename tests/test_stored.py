"""Structures stored beside tables: sketches per file and the text index."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lakemill.functions.text import inverted_index, postings, search, search_stored, write_index
from lakemill.operators import quality as Q
from lakemill.session import load, work_folder

SCHEMA = "i bigint, d double, m decimal(10,2), s string, t date, b boolean, a array<int>, big double, none int"


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(2)
    rows = [
        (i, rnd.choice([None, rnd.uniform(-5, 5)]), None, rnd.choice(["x", "y", None, f"s{i % 700}"]),
         dt.date(2024, 1, 1) + dt.timedelta(i % 90), i % 3 == 0, [i % 7], 10.0 ** (i % 40), None)
        for i in range(4000)
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("m", (F.col("i") / 8).cast("decimal(10,2)"))
    path = work_folder(spark, "profiled")
    df.repartition(5).write.parquet(path)
    return path


def read(spark, path):
    return spark.read.schema(SCHEMA).parquet(path)


def by_column(df):
    return {r.column_name: r for r in df.collect()}


def test_halves_merge_to_the_whole(spark, table):
    """Files read on different days give the profile of all of them; each file is read once."""
    files = sorted(read(spark, table).inputFiles())
    whole = by_column(Q.merged_profile(Q.file_sketches(read(spark, table)), [0.25, 0.5]))
    growing, stored = work_folder(spark, "growing"), work_folder(spark, "sketches")
    for part in (files[:2], files[2:]):
        spark.read.schema(SCHEMA).parquet(*part).coalesce(len(part)).write.mode("append").parquet(growing)
        sketches = Q.add_sketches(spark, growing, SCHEMA, stored)
    assert sketches.count() == len(read(spark, growing).inputFiles())
    before = sketches.count()
    assert Q.add_sketches(spark, growing, SCHEMA, stored).count() == before  # nothing new
    merged = by_column(Q.merged_profile(sketches, [0.25, 0.5]))
    direct = by_column(Q.profile(read(spark, table)))
    for name, want in whole.items():
        got = merged[name]
        for field in ("n", "nulls", "lowest", "highest", "mean", "distinct_values"):
            if (name, field) == ("big", "mean"):  # beyond 32 digits sums are double
                assert abs(got.mean / want.mean - 1) < 1e-9
            elif field == "distinct_values":  # a sketch's estimate depends on what it has merged
                for one in (got, direct[name]):
                    assert abs(one[field] - want[field]) <= 0.03 * want[field]
            else:
                assert got[field] == want[field], (name, field)
                assert direct[name][field] == want[field], (name, field)
    assert set(whole) == set(read(spark, table).columns)


def test_profile_is_near_the_truth(spark, table):
    df = read(spark, table)
    got = by_column(Q.merged_profile(Q.file_sketches(df), [0.25, 0.5]))
    exact = by_column(Q.profile(df, exact=True))
    want = df.agg(*[F.countDistinct(c).alias(c) for c in df.columns]).first()
    for c in df.columns:
        assert exact[c].distinct_values == want[c]
        assert abs(got[c].distinct_values - want[c]) <= 0.05 * want[c] + 1
    assert (got["i"].lowest, got["i"].highest, got["i"].mean) == ("0", "3999", 1999.5)
    assert abs(got["i"].quantiles[1] - 2000) < 100 and abs(got["i"].quantiles[0] - 1000) < 100
    assert got["s"].quantiles is None and got["none"].nulls == 4000
    assert (got["none"].mean, got["none"].distinct_values) == (None, 0)


def test_values_from_1e18_on_have_a_mean(spark):
    df = spark.createDataFrame([(1e18, 2**62), (3e18, 2**62), (1e300, None)], "x double, y bigint")
    got = by_column(Q.profile(df, exact=True))
    assert got["x"].mean == pytest.approx(1e300 / 3) and got["y"].mean == 2.0**62


def test_empty_table(spark, table):
    got = by_column(Q.profile(read(spark, table).limit(0), exact=True))
    assert all((r.n, r.nulls, r.distinct_values, r.mean) == (0, 0, 0, None) for r in got.values())


def test_statistics_leave_nothing_behind(spark, table):
    before = [r.name for r in spark.catalog.listTables()]
    stats = {(r.column_name, r.info_name): r.info_value for r in Q.gather_stats(read(spark, table)).collect()}
    assert stats["none", "num_nulls"] == "4000" and stats["i", "distinct_count"] == "4000"
    assert len(stats) == 2 * len(read(spark, table).columns)
    assert [r.name for r in spark.catalog.listTables()] == before


@pytest.fixture(scope="module")
def index(spark):
    docs = load(spark, "/root/testdata/sf0.001", "documents")
    path = work_folder(spark, "index")
    write_index(inverted_index(docs, "doc_id", "text"), path, 16)
    return path


@pytest.mark.parametrize("query", [["from", "tion", "ing"], ["Tion"], ["no such word", "ing"], ["ing", "ing"]])
def test_stored_search_equals_the_scan(spark, index, query):
    docs = load(spark, "/root/testdata/sf0.001", "documents")
    want = search(docs, "doc_id", "text", query).collect()
    assert search_stored(spark, index, "doc_id", query).collect() == want


def test_search_reads_the_buckets_of_its_words(spark, index):
    found = search_stored(spark, index, "doc_id", ["tion", "ing"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and plan.count("FileScan") == 2
    assert plan.count("PartitionFilters: [isnotnull(bucket") == 2
    assert "EqualTo(token,tion)" in plan and "EqualTo(token,ing)" in plan


def test_postings_of_a_frequent_word_span_files(spark):
    rows = spark.range(60_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('w', id) END AS token", "id AS doc_id", "1L AS hits"
    )
    path = work_folder(spark, "index")
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        write_index(rows.repartition(8), path, 4)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    files = spark.read.parquet(f"{path}/postings").where("token = 'hot'").select(
        F.col("_metadata.file_path")
    )
    assert files.distinct().count() > 1
    bucket = spark.read.parquet(f"{path}/tokens").where("token = 'hot'").first().bucket
    assert postings(spark, path, "doc_id", "hot", bucket).count() == 20_000
