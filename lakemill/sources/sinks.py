"""Partitioned and appended Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUT_OF_RANGE = "OUT_OF_RANGE"


def period_column(day: Column, bounds: Sequence[tuple[str, str]], lowest: str | None = None):
    """Label of the half-open range a day falls into; `bounds` lists (label, end) in order.

    Days before `lowest` or from the last end on get the label OUT_OF_RANGE, not an error.
    """
    label = F.when(day < F.lit(lowest or "0001-01-01").cast("date"), OUT_OF_RANGE)
    for name, end in bounds:
        label = label.when(day < F.lit(end).cast("date"), name)
    return label.otherwise(OUT_OF_RANGE)


def month_bounds(first_year: int, last_year: int) -> list[tuple[str, str]]:
    """One range per month of the years given."""
    out = []
    for year in range(first_year, last_year + 1):
        for month in range(1, 13):
            end = f"{year + 1}-01-01" if month == 12 else f"{year}-{month + 1:02d}-01"
            out.append((f"{year}-{month:02d}", end))
    return out


def year_half_quarter_bounds(split_year: int, last_year: int) -> list[tuple[str, str]]:
    """All earlier years in one range, the split year in halves, later years in quarters."""
    out = [
        (f"before_{split_year}", f"{split_year}-01-01"),
        (f"h1_{split_year}", f"{split_year}-07-01"),
        (f"h2_{split_year}", f"{split_year + 1}-01-01"),
    ]
    for year in range(split_year + 1, last_year + 1):
        ends = [f"{year}-04-01", f"{year}-07-01", f"{year}-10-01", f"{year + 1}-01-01"]
        out += [(f"q{i}_{year}", end) for i, end in enumerate(ends, 1)]
    return out


def write_by_period(df: DataFrame, path: str, period: Column, mode: str = "overwrite") -> None:
    """Partition a fact table by a derived period.

    REBALANCE brings the rows of a period together so that files are few, and splits a period
    that is too large for one task, so one heavy period cannot hold up the write.
    """
    labelled = df.withColumn("period", period).hint("rebalance", F.col("period"))
    labelled.write.mode(mode).partitionBy("period").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
