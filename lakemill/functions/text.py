"""Words of a text."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.session import spread

# English words left out of the index.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it",
    "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these",
    "they", "this", "to", "was", "will", "with",
)


# Fixed value: what separates words.
BREAK = r"[^\p{L}\p{N}]+"
LETTER = r"[\p{L}\p{N}]"


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token): one row per run of letters and digits, lower-cased, without stop words."""
    split = F.split(F.lower(F.col(text)), BREAK)
    return spread(df.select(key, text)).select(key, F.explode(split).alias("token")).filter(
        (F.col("token") != "") & ~F.col("token").isin(*STOP_WORDS)
    )


def inverted_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key, hits): one row per token and document.

    Postings stay rows. A token found in most documents is many rows spread over tasks, never
    one list.
    """
    return (
        tokens(df, key, text).groupBy("token", key).agg(F.count(F.lit(1)).alias("hits"))
    )


def whole_word(pattern: str) -> str:
    return f"(?<!{LETTER})(?:{pattern})(?!{LETTER})"


def search(df: DataFrame, key: str, text: str, query: Sequence[str]) -> DataFrame:
    """(key, hits) of the documents that hold every query word, most hits first.

    Each row is decided on its own: no index, and no shuffle before the sort. A plain substring
    test drops most documents before the whole-word test.
    """
    wanted = sorted({w.lower() for w in query})
    low = F.lower(F.col(text))

    def holds_all(t):
        tests = [t.contains(w) for w in wanted]
        tests += [t.rlike(whole_word(re.escape(w))) for w in wanted]
        return reduce(lambda a, b: a & b, tests)

    # The one-element array names the lower-cased text, so that all tests share one copy.
    found = spread(df.select(key, text)).filter(F.exists(F.array(low), holds_all))
    any_word = whole_word("|".join(re.escape(w) for w in wanted))
    hits = F.regexp_count(low, F.lit(any_word))
    # A sort samples its input first; the rebalanced hits are sampled, not the texts again.
    ranked = found.select(key, hits.alias("hits")).hint("rebalance")
    return ranked.orderBy(F.desc("hits"), key)


def search_index(index: DataFrame, key: str, query: Sequence[str]) -> DataFrame:
    """The same answer from an index: only the postings of the query words are kept."""
    wanted = sorted({w.lower() for w in query})
    return (
        index.filter(F.col("token").isin(*wanted))
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("hits").cast("int").alias("hits"))
        .filter(F.col("_n") == len(wanted))
        .select(key, "hits")
        .orderBy(F.desc("hits"), key)
    )


# ------------------------------------------------------------------------- a stored index

INDEX_BUCKETS = 64


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def write_index(index: DataFrame, path: str, buckets: int = INDEX_BUCKETS) -> None:
    """Store postings (token, key, hits) in one folder per bucket of tokens, sorted by token, and
    beside them how many documents hold each token.

    A bucket that is too large for one task, as one with a very frequent token, is written by
    several; the sort lets a reader skip row groups inside a bucket.
    """
    placed = index.withColumn("bucket", _bucket(F.col("token"), buckets))
    placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token").write.partitionBy(
        "bucket"
    ).parquet(f"{path}/postings")
    stored = index.sparkSession.read.schema(
        "token string, bucket int"
    ).parquet(f"{path}/postings")
    stored.groupBy("bucket", "token").agg(F.count(F.lit(1)).alias("documents")).hint(
        "rebalance", "bucket"
    ).write.partitionBy("bucket").parquet(f"{path}/tokens")
    index.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(
        f"{path}/layout"
    )


def _token_buckets(spark: SparkSession, path: str, wanted: Sequence[str]) -> dict[str, int]:
    layout = spark.read.schema("buckets int").parquet(f"{path}/layout")
    words = F.explode(F.array(*[F.lit(w) for w in wanted])).alias("token")
    asked = layout.select("buckets", words)
    placed = asked.select("token", F.pmod(F.xxhash64("token"), F.col("buckets")).cast("int").alias("b"))
    return {r.token: r.b for r in placed.collect()}  # one row per query word


def postings(spark: SparkSession, path: str, key: str, token: str, bucket: int) -> DataFrame:
    """(key, hits) of one token: one bucket's folder, and in it the row groups of the token."""
    rows = spark.read.schema(f"token string, {key} bigint, hits bigint, bucket int").parquet(
        f"{path}/postings"
    )
    held = rows.filter((F.col("bucket") == bucket) & (F.col("token") == token))
    return held.select(key, "hits")


def search_stored(spark: SparkSession, path: str, key: str, query: Sequence[str]) -> DataFrame:
    """(key, hits) of the documents that hold every query word, most hits first, from a stored
    index; the texts are not read.

    The rarest word comes first: its documents are all that the postings of the others can
    leave, and a short side is what Spark sends to the tasks of a long one.
    """
    wanted = sorted({w.lower() for w in query})
    buckets = _token_buckets(spark, path, wanted)
    counted = spark.read.schema("token string, documents bigint, bucket int").parquet(f"{path}/tokens")
    known = counted.filter(
        F.col("bucket").isin(*set(buckets.values())) & F.col("token").isin(*wanted)
    ).collect()  # one row per query word
    documents = {r.token: r.documents for r in known}
    order = sorted(wanted, key=lambda w: (documents.get(w, 0), w))
    found = postings(spark, path, key, order[0], buckets[order[0]])
    for word in order[1:]:
        other = postings(spark, path, key, word, buckets[word]).withColumnRenamed("hits", "_more")
        found = found.join(other, key).select(key, (F.col("hits") + F.col("_more")).alias("hits"))
    return found.select(key, F.col("hits").cast("int").alias("hits")).orderBy(F.desc("hits"), key)
