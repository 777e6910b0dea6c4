"""The vector index: exact answers, measured recall of few probes, and folders that are not read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakemill.functions import vectors as V
from lakemill.session import load, work_folder

SIZE = 16


@pytest.fixture(scope="module")
def points():
    """Sixty directions with noise around them, one direction with a third of all vectors."""
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(60, SIZE))
    which = np.where(rng.random(6000) < 1 / 3, 0, rng.integers(0, 60, 6000))
    return middles[which] + rng.normal(scale=0.35, size=(6000, SIZE))


@pytest.fixture(scope="module")
def table(spark, points):
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    odd = [(9000, [0.0] * SIZE), (9001, None), (9002, [1.0]), (9003, [float("nan")] + [1.0] * 15),
           (9004, [None] + [1.0] * 15)]
    return spark.createDataFrame(rows + odd, "id long, v array<double>").repartition(6)


@pytest.fixture(scope="module")
def index(spark, table):
    return V.build_index(table, "id", "v", SIZE, work_folder(spark, "index"), 60)


@pytest.fixture(scope="module")
def queries(spark, points):
    rng = np.random.default_rng(8)
    rows = [(i, (points[i * 29] + rng.normal(scale=0.1, size=SIZE)).tolist()) for i in range(200)]
    odd = [(500, [0.0] * SIZE), (501, None), (502, [1.0])]
    return spark.createDataFrame(rows + odd, "query_id long, q array<double>")


@pytest.fixture(scope="module")
def truth(points, queries):
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    out = {}
    for r in queries.collect():
        if r.query_id < 500:
            scores = unit @ np.array(r.q)
            out[r.query_id] = set(np.argsort(-scores, kind="stable")[:10].tolist())
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, set()).add(r.id)
    return out


def test_every_vector_with_a_direction_is_indexed(index, points):
    assert index.rows().count() == len(points)
    centres, widest = index.centres()
    for r in index.rows().where("id % 97 = 0").collect():
        p = points[r.id] / np.linalg.norm(points[r.id])
        cosine = centres @ p
        assert r.bucket == np.argmax(cosine)
        assert abs(np.cos(r.angle) - cosine[r.bucket]) < 1e-6 and r.angle <= widest[r.bucket]


@pytest.mark.parametrize("probes", [1, 6])
def test_exact_search_is_exact(index, queries, truth, probes):
    assert found(V.search_index(index, queries, 10, probes)) == truth


def test_few_probes_reach_the_recall(index, queries, truth):
    """The probes chosen on fifty queries find 95 % of the answers of the others."""
    sample = queries.where("query_id < 50")
    probes = V.probes_for(index, sample, 10)
    assert probes <= 15
    got = found(V.search_index(index, queries.where("query_id >= 50"), 10, probes, exact=False))
    hits = [len(got[q] & truth[q]) for q in truth if q >= 50]
    assert np.mean(hits) >= 9.5


def test_recall_on_vectors_without_groups(spark):
    """Random directions are the worst case: recall is reached by reading more buckets."""
    table = load(spark, "/root/testdata/sf0.01", "embeddings")
    index = V.build_index(table, "vec_id", "embedding", 64, work_folder(spark, "index"))
    ask = table.where("vec_id % 5 = 0").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")
    )
    probes = V.probes_for(index, ask.where("query_id % 10 = 0"), 10)
    got = V.search_index(index, ask, 10, probes, exact=False).withColumn("g", F.lit(1))
    want = V.top_k(table, "vec_id", "embedding", ask, 64, 10)
    same = want.join(got.select("query_id", "vec_id", "g"), ["query_id", "vec_id"], "left")
    assert same.agg(F.sum("g") / F.count(F.lit(1))).first()[0] >= 0.93


def test_other_buckets_are_not_read(index, queries):
    one = queries.where("query_id = 3")
    probes = V._probes(index, V._asked(one), V._nearest(2))
    touched = {r.bucket for r in probes.collect()}
    rows = index.rows().where(F.col("bucket").isin(list(touched)))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert len(touched) == 2 and "PartitionFilters: [bucket" in plan


def test_queries_that_are_not_few_are_dealt_over_salts(spark, table, queries, truth, monkeypatch):
    monkeypatch.setattr(V, "LEAST_BROADCAST", 0)
    assert found(V.top_k(table, "id", "v", queries, SIZE, 10)) == truth


def test_empty_tables(spark, table, index, queries):
    none = table.limit(0)
    empty = V.build_index(none, "id", "v", SIZE, work_folder(spark, "index"))
    assert V.search_index(empty, queries, 10).count() == 0
    assert V.search_index(index, queries.limit(0), 10).count() == 0
    assert V.top_k(none, "id", "v", queries, SIZE, 10).count() == 0
    assert V.top_k(table, "id", "v", queries.limit(0), SIZE, 10).count() == 0
    few = V.build_index(table.where("id < 5"), "id", "v", SIZE, work_folder(spark, "index"), 60)
    assert found(V.search_index(few, queries.where("query_id = 0"), 10, 2)) == {0: set(range(5))}
