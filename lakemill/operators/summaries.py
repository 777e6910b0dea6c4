"""Stored summaries: written by a refresh job, read by later queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def create_summary(df: DataFrame, path: str) -> None:
    """Create the stored summary with the schema of its query and no rows."""
    df.limit(0).write.mode("errorifexists").parquet(path)


def refresh_summary(df: DataFrame, path: str) -> None:
    """Compute the summary again and replace the stored rows."""
    df.write.mode("overwrite").parquet(path)


def read_summary(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)
