"""Text index, text search, vector search and generated rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakemill.functions import scalars as S
from lakemill.functions.text import (
    STOP_WORDS,
    inverted_index,
    search,
    search_stored,
    write_index,
)
from lakemill.functions.vectors import build_index, search_index, top_k
from lakemill.plans.registry import query
from lakemill.session import work_folder

C = F.col

STOPPED = ", ".join(f"'{w}'" for w in STOP_WORDS)
TOKENS_SQL = (
    "SELECT doc_id, token FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text),"
    f" '[^\\p{{L}}\\p{{N}}]+')) AS token FROM documents) WHERE token <> '' AND token NOT IN"
    f" ({STOPPED})"
)


@query(
    "txt_index",
    f"SELECT token, doc_id, COUNT(*) AS hits FROM ({TOKENS_SQL}) GROUP BY token, doc_id",
)
def txt_index(t):
    return inverted_index(t.documents, "doc_id", "text")


SEARCH_SQL = (
    f"SELECT doc_id, CAST(COUNT(*) AS INTEGER) AS hits FROM ({TOKENS_SQL})"
    " WHERE token IN ('from', 'tion', 'ing') GROUP BY doc_id HAVING COUNT(DISTINCT token) = 3"
    " ORDER BY hits DESC, doc_id"
)


@query("txt_search", SEARCH_SQL)
def txt_search(t):
    return search(t.documents, "doc_id", "text", ["from", "tion", "ing"])


@query("txt_search_index", SEARCH_SQL)
def txt_search_index(t):
    """The same search from a stored index, of which it reads the buckets of three tokens."""
    path = work_folder(t.spark, "text-index")
    write_index(inverted_index(t.documents, "doc_id", "text"), path)
    return search_stored(t.spark, path, "doc_id", ["from", "tion", "ing"])


@query(
    "vec_top_k",
    "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label"
    " FROM embeddings), q AS (SELECT CAST(label AS BIGINT) AS query_id, arg_min(e, vec_id) AS q FROM v GROUP BY"
    " label) SELECT query_id, vec_id, ROUND(score, 5) AS score FROM (SELECT query_id, vec_id,"
    " list_cosine_similarity(e, q) AS score, row_number() OVER (PARTITION BY query_id ORDER BY"
    " list_cosine_similarity(e, q) DESC, vec_id) AS r FROM v, q) WHERE r <= 10",
)
def vec_top_k(t):
    """The ten nearest vectors to the first vector of every label."""
    first = t.embeddings.groupBy(C("label").alias("query_id")).agg(
        F.min_by("embedding", "vec_id").alias("q")
    )
    best = top_k(t.embeddings, "vec_id", "embedding", first, 64, 10)
    return best.withColumn("score", F.round("score", 5))


@query(
    "vec_top_k_index",
    "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
    " SELECT query_id, vec_id, ROUND(score, 5) AS score FROM (SELECT q.vec_id AS query_id,"
    " v.vec_id, list_cosine_similarity(v.e, q.e) AS score, row_number() OVER (PARTITION BY"
    " q.vec_id ORDER BY list_cosine_similarity(v.e, q.e) DESC, v.vec_id) AS r FROM v, v q"
    " WHERE q.vec_id % 50 = 0) WHERE r <= 10",
)
def vec_top_k_index(t):
    """The ten nearest vectors to every fiftieth vector, through buckets stored for the search."""
    index = build_index(
        t.embeddings, "vec_id", "embedding", 64, work_folder(t.spark, "vector-index")
    )
    asked = t.embeddings.filter(C("vec_id") % 50 == 0)
    queries = asked.select(C("vec_id").alias("query_id"), C("embedding").alias("q"))
    return search_index(index, queries, 10).withColumn("score", F.round("score", 5))


# Appointments generated per customer: a number list of three and values fixed by key and number.
def _rnd(key: str, seed: int, bound: int) -> str:
    mixed = f"((({key}) % 2147483647 * 48271 + {seed * 7919}) % 2147483647)"
    return f"((({mixed} * 16807) // 127) % {bound})"


KEY = "(c_custkey * 3 + n)"


@query(
    "gen_rows",
    f"SELECT {KEY} AS appointment_id, DATE '2024-01-01' - CAST({_rnd(KEY, 1, 1000)} AS INTEGER)"
    f" AS held_on, printf('%02d:%02d:%02d', 8 + {_rnd(KEY, 2, 8)}, 0, 0) AS start_time,"
    f" 200 + {_rnd(KEY, 3, 800)} AS cost, CASE {_rnd(KEY, 4, 4)} WHEN 0 THEN 'scheduled' WHEN 1"
    " THEN 'in progress' WHEN 2 THEN 'postponed' ELSE 'completed' END AS status FROM customer,"
    " (SELECT unnest([0, 1, 2]) AS n)",
)
def gen_rows(t):
    """Three rows per customer. Values depend on key and seed only, so a retried task or a
    different partitioning gives the same rows."""
    numbers = F.explode(F.sequence(F.lit(0), F.lit(2)))
    keyed = t.customer.select("c_custkey", numbers.alias("n")).select(
        (C("c_custkey") * 3 + C("n")).alias("k")
    )

    def rnd(seed, bound):
        return S.pseudo_random("k", seed, bound)

    states = F.array(*[F.lit(s) for s in ("scheduled", "in progress", "postponed", "completed")])
    return keyed.select(
        C("k").alias("appointment_id"),
        F.date_sub(F.lit("2024-01-01").cast("date"), rnd(1, 1000).cast("int")).alias("held_on"),
        S.time_text((rnd(2, 8) + 8).cast("int"), F.lit(0), F.lit(0)).alias("start_time"),
        (rnd(3, 800) + 200).alias("cost"),
        F.get(states, rnd(4, 4).cast("int")).alias("status"),
    )
