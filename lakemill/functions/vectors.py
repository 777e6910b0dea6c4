"""Vector search by cosine: exact over a table, and over an index of buckets.

Vectors and queries meet as packed blocks, joined on a bucket: one matrix product per pair of
blocks, of which only rows that can still be among the k best go on. Queries are a table like any
other; none is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakemill.session import materialise

BLOCK_ROWS = 1000  # vectors of a block
BLOCK_QUERIES = 250
MOST_BUCKETS = 4096  # folders of an index, and centroids a task holds
SAMPLE_PER_BUCKET = 16  # rows the centroids are fitted on: at most 65,536
LEAST_BROADCAST = 2_000_000  # bytes of queries that are sent to every task instead of shuffled
MARGIN = 1e-6  # of a cosine, for rounding in bounds

_BLOCK = "bucket int, ids binary, points binary"
_BLOCK_ARROW = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("points", pa.binary())])


# --- blocks --------------------------------------------------------------------------------------


def _usable(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a list column that have a direction, those as a matrix, and their lengths."""
    fits = np.array([v is not None and len(v) == size for v in column.to_pylist()], dtype=bool)
    at = np.flatnonzero(fits)
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    points = flat.reshape(-1, size)
    length = np.linalg.norm(points, axis=1)
    good = np.isfinite(length) & (length > 0)
    return at[good], points[good], length[good]


def _pack(size: int, rows: int, unit: bool, salts: int = 0):
    """(id, list, bucket) rows packed by bucket; with `salts` the buckets are dealt in turn."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for whole in batches:
            for first in range(0, len(whole), rows):
                b = whole.slice(first, rows)
                at, points, length = _usable(b.column(1), size)
                if not len(at):
                    continue
                if unit:
                    points = points / length[:, None]
                ids = b.column(0).to_numpy(zero_copy_only=False)[at].astype(np.int64)
                if salts:
                    bucket = np.full(len(at), turn % salts)
                    turn += 1
                else:
                    bucket = b.column(2).to_numpy(zero_copy_only=False)[at]
                made = [
                    (int(k), ids[bucket == k].tobytes(), points[bucket == k].tobytes())
                    for k in np.unique(bucket)
                ]
                columns = [pa.array(c, f.type) for c, f in zip(zip(*made), _BLOCK_ARROW)]
                yield pa.RecordBatch.from_arrays(columns, schema=_BLOCK_ARROW)

    return pack


def _score(size: int, k: int, key: str):
    """Per pair of blocks the rows that can be among the k best of a query, ties included."""
    schema = pa.schema(
        [("query_id", pa.int64()), (key, pa.int64()), ("score", pa.float64()), ("bucket", pa.int32())]
    )

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b[c] for c in ("bucket", "ids", "points", "q_ids", "q_points")]
            for i in range(len(b)):
                bucket, ids, points, q_ids, q_points = (c[i].as_py() for c in columns)
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                points = np.frombuffer(points).reshape(-1, size)
                queries = np.frombuffer(q_points).reshape(-1, size)
                scores = (points @ queries.T) / np.linalg.norm(points, axis=1)[:, None]
                if len(ids) > k:
                    least = np.partition(scores, len(ids) - k, axis=0)[len(ids) - k]
                    at, which = np.nonzero(scores >= least)
                else:
                    at, which = np.nonzero(np.ones_like(scores, dtype=bool))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(q_ids[which]),
                        pa.array(ids[at]),
                        pa.array(scores[at, which]),
                        pa.array(np.full(len(at), bucket, np.int32)),
                    ],
                    schema=schema,
                )

    return score


def _meet(points: DataFrame, queries: DataFrame, size: int, k: int, key: str, small: bool):
    """Join blocks on their bucket and score the pairs."""
    asked = queries.select(
        "bucket", F.col("ids").alias("q_ids"), F.col("points").alias("q_points")
    )
    pairs = points.join(F.broadcast(asked) if small else asked, "bucket")
    return pairs.mapInArrow(
        _score(size, k, key), f"query_id bigint, {key} bigint, score double, bucket int"
    )


def _best(scored: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    ranked = scored.withColumn("_r", F.row_number().over(order))
    return ranked.filter(F.col("_r") <= k).drop("_r")


def _few(queries: DataFrame, size: int) -> bool:
    return queries.count() * size * 8 <= LEAST_BROADCAST


def top_k(
    vectors: DataFrame, key: str, vector: str, queries: DataFrame, size: int, k: int
) -> DataFrame:
    """(query_id, key, score): the k nearest vectors by cosine to each query, exact.

    `queries` is (query_id bigint, q). Vectors are scored where they lie if the queries are few
    enough to be sent to every task, a size that is counted first; otherwise vector blocks are
    dealt over as many salts as there are shuffle partitions, and each salt gets every query
    block. Vectors of another size, of length zero, or with an element that is NULL or no number
    have no angle: they are no answer, and as queries have none.
    """
    asked = materialise(queries.select(F.col("query_id").cast("bigint"), "q"), "queries")
    small = _few(asked, size)
    salts = 1 if small else int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = vectors.select(F.col(key).cast("bigint"), vector).mapInArrow(
        _pack(size, BLOCK_ROWS, unit=False, salts=salts), _BLOCK
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("bucket")
    blocks = asked.mapInArrow(_pack(size, BLOCK_QUERIES, unit=True, salts=1), _BLOCK)
    dealt = blocks.select(every, "ids", "points")
    return _best(_meet(points, dealt, size, k, key, small).drop("bucket"), key, k)


# --- an index of buckets -------------------------------------------------------------------------


@dataclass(frozen=True)
class VectorIndex:
    """Vectors in one folder per bucket of near directions, with each bucket's centre and the
    widest angle of its vectors to it."""

    spark: SparkSession
    path: str
    key: str
    size: int

    def rows(self) -> DataFrame:
        schema = f"{self.key} bigint, vector array<double>, angle double, bucket int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    def centres(self) -> tuple[np.ndarray, np.ndarray]:
        """At most MOST_BUCKETS unit vectors, and their angles (-1 for an empty bucket)."""
        held = self.spark.read.parquet(f"{self.path}/buckets").orderBy("bucket").collect()
        points = np.array([r.centre for r in held]).reshape(-1, self.size)
        return points, np.array([-1.0 if r.angle is None else r.angle for r in held])


def _fit_centres(points: np.ndarray, buckets: int, rounds: int = 12) -> np.ndarray:
    """k-means on unit vectors; a bucket that loses all its points keeps its centre."""
    points = points / np.linalg.norm(points, axis=1)[:, None]
    centres = points[np.linspace(0, len(points) - 1, buckets).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.argmax(points @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        length = np.linalg.norm(sums, axis=1)
        moved = length > 0
        centres[moved] = sums[moved] / length[moved, None]
    return centres


def build_index(
    vectors: DataFrame, key: str, vector: str, size: int, path: str, buckets: int | None = None
) -> VectorIndex:
    """Write an index of every vector that has a direction (see `top_k`).

    Centres are fitted on at most SAMPLE_PER_BUCKET rows a bucket, those of least key hash; all
    rows are indexed. Without `buckets` there are as many as the square root of the rows, up to
    MOST_BUCKETS. A bucket that holds very many rows is written by several tasks.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(key).cast("bigint").alias(key), F.col(vector).alias("vector")).where(
        F.size("vector") == size
    )
    if buckets is None:
        buckets = int(given.count() ** 0.5)
    buckets = min(max(buckets, 1), MOST_BUCKETS)
    no_hole = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x))
    drawn = (
        given.where(no_hole & F.exists("vector", lambda x: x != 0))
        .orderBy(F.xxhash64(key), key)
        .limit(buckets * SAMPLE_PER_BUCKET)
        .collect()
    )
    if drawn:
        sample = np.array([r.vector for r in drawn], dtype=np.float64)
        centres = _fit_centres(sample, min(buckets, len(sample)))
    else:
        centres = np.eye(1, size)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, points, length = _usable(b.column(1), size)
            cosine = (points / length[:, None]) @ centres.T
            bucket = np.argmax(cosine, axis=1) if len(at) else np.zeros(0, np.int64)
            angle = np.arccos(np.clip(cosine[np.arange(len(at)), bucket], -1, 1))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(at)),
                    b.column(1).take(pa.array(at)).cast(pa.list_(pa.float64())),
                    pa.array(angle),
                    pa.array(bucket.astype(np.int32)),
                ],
                names=[key, "vector", "angle", "bucket"],
            )

    placed = given.mapInArrow(place, f"{key} bigint, vector array<double>, angle double, bucket int")
    # splits a bucket that is too large for one task, and joins small ones
    placed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/rows")
    index = VectorIndex(spark, path, key, size)
    listed = spark.createDataFrame(
        [(i, c.tolist()) for i, c in enumerate(centres)], "bucket int, centre array<double>"
    )
    widest = index.rows().groupBy("bucket").agg(
        F.max("angle").alias("angle"), F.count(F.lit(1)).alias("n")
    )
    listed.join(widest, "bucket", "left").coalesce(1).write.parquet(f"{path}/buckets")
    return index


def _probes(
    index: VectorIndex, queries: DataFrame, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]
) -> DataFrame:
    """(query_id, q, bucket) of the buckets that `wanted` marks, given the cosines of a batch of
    queries with all centres and the scores that they have to reach."""
    centres, _ = index.centres()
    size = index.size

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), BLOCK_QUERIES):
                b = whole.slice(first, BLOCK_QUERIES)
                at, points, length = _usable(b.column(1), size)
                if not len(at):
                    continue
                reach = b.column(2).to_numpy(zero_copy_only=False)[at]
                marked = wanted((points / length[:, None]) @ centres.T, reach)
                which, bucket = np.nonzero(marked)
                taken = pa.array(at[which])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(taken), b.column(1).take(taken), pa.array(bucket.astype(np.int32))],
                    names=["query_id", "q", "bucket"],
                )

    return materialise(
        queries.select("query_id", "q", "reach").mapInArrow(
            probe, "query_id bigint, q array<double>, bucket int"
        ),
        "probes",
    )


def _answers(index: VectorIndex, probes: DataFrame, k: int) -> DataFrame:
    """The k best of each query in the buckets it probes; other buckets' folders are not read."""
    touched = [r.bucket for r in probes.select("bucket").distinct().collect()]  # at most all buckets
    rows = index.rows().where(F.col("bucket").isin(touched))
    points = rows.select(index.key, "vector", "bucket").mapInArrow(
        _pack(index.size, BLOCK_ROWS, unit=False), _BLOCK
    )
    # ranges of (bucket, query): a bucket that a third of the queries probe spans several tasks
    ordered = probes.repartitionByRange("bucket", "query_id").sortWithinPartitions("bucket")
    blocks = materialise(
        ordered.select("query_id", "q", "bucket").mapInArrow(
            _pack(index.size, BLOCK_QUERIES, unit=True), _BLOCK
        ),
        "probe_blocks",
    )
    scored = _meet(points, blocks, index.size, k, index.key, _few(probes, index.size))
    return materialise(_best(scored, index.key, k), "answers")


def _nearest(probes: int):
    def wanted(cosine: np.ndarray, reach: np.ndarray) -> np.ndarray:
        if probes >= cosine.shape[1]:
            return np.ones_like(cosine, dtype=bool)
        order = np.argsort(-cosine, axis=1, kind="stable")[:, :probes]
        marked = np.zeros_like(cosine, dtype=bool)
        np.put_along_axis(marked, order, True, axis=1)
        return marked

    return wanted


def _within_reach(probes: int, widest: np.ndarray):
    """Buckets behind the nearest ones that may hold a vector as near as `reach`: no vector is
    nearer to a query than the angle to its centre less the bucket's widest angle."""
    first = _nearest(probes)

    def wanted(cosine: np.ndarray, reach: np.ndarray) -> np.ndarray:
        gap = np.maximum(np.arccos(np.clip(cosine, -1, 1)) - widest, 0)
        return ~first(cosine, reach) & (widest >= 0) & (np.cos(gap) >= reach[:, None] - MARGIN)

    return wanted


def _asked(queries: DataFrame) -> DataFrame:
    return materialise(
        queries.select(
            F.col("query_id").cast("bigint"),
            F.col("q").cast("array<double>"),
            F.lit(-2.0).alias("reach"),
        ),
        "queries",
    )


def search_index(
    index: VectorIndex, queries: DataFrame, k: int, probes: int = 8, exact: bool = True
) -> DataFrame:
    """(query_id, key, score): the k nearest vectors to each query (query_id, q).

    The `probes` nearest buckets are scored first. With `exact` the k-th score found so far then
    rules out every bucket whose vectors are all farther, and the others are scored as well, so
    the result is that of `top_k`. Without, it is what the nearest buckets hold. Queries without
    a direction have no answer.
    """
    asked = _asked(queries)
    first = _answers(index, _probes(index, asked, _nearest(probes)), k)
    found = first
    if exact:
        held = first.groupBy("query_id").agg(
            F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(-2.0).alias("least")
        )
        again = asked.join(held, "query_id", "left").select(
            "query_id", "q", F.coalesce("least", "reach").alias("reach")
        )
        rest = _probes(index, again, _within_reach(probes, index.centres()[1]))
        if not rest.isEmpty():
            found = _best(first.unionByName(_answers(index, rest, k)), index.key, k)
    return found.drop("bucket")


def probes_for(index: VectorIndex, queries: DataFrame, k: int, recall: float = 0.95) -> int:
    """The fewest probes with which the given queries, a small sample, find that share of their
    exact answers: the place of each answer's bucket in its query's order tells it at once."""
    centres, _ = index.centres()
    size = index.size
    asked = _asked(queries)
    every = _answers(index, _probes(index, asked, _nearest(len(centres))), k)
    pairs = every.join(asked, "query_id").select("query_id", "q", "bucket")

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, points, length = _usable(b.column(1), size)
            order = np.argsort(-((points / length[:, None]) @ centres.T), axis=1, kind="stable")
            at = np.argsort(order, axis=1)[np.arange(len(b)), b.column(2).to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))], names=["place"])

    counts = pairs.mapInArrow(place, "place bigint").groupBy("place").count().collect()
    total, seen = sum(r["count"] for r in counts), 0
    for r in sorted(counts, key=lambda r: r.place):
        seen += r["count"]
        if seen >= recall * total:
            return int(r.place) + 1
    return len(centres)
