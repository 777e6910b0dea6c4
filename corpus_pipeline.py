"""The corpus pipeline: quality rules, line dedup, near duplicates, decontamination, encoding.

Each stage is (spark, docs, sf_dir) -> DataFrame and works on all rows its predecessor kept. A
stage's result is written as Parquet and read again as the next one's input. All stages but the
last return the columns of `docs`, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakemill.llm import bpe, decontaminate, fertility, line_dedup, ngram_join
from lakemill.session import load, materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep to the rules and bands. A null or empty text has too few words and goes;
    repeated rows are judged alike; a null doc_id changes nothing."""
    return fertility.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a larger doc_id holds as well. Null texts, empty ones and
    rows without doc_id stay as they are; rows of one doc_id count as one document."""
    return line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that of the smallest doc_id with all its rows.
    Texts without words and rows without doc_id are similar to nothing and stay."""
    return ngram_join.one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark; those without words stay."""
    return decontaminate.remove_leaks(docs, load(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, a row per row; a null or empty
    text has no ids."""
    return bpe.text_digests(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("bpe_encoding", encoding),
]

# Tokenizer pieces are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
