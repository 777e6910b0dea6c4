"""Small relational building blocks shared by the queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemill.session import materialise


def money(col: str | Column) -> Column:
    """Exact two-digit money, so that sums do not depend on the order of addition."""
    return (F.col(col) if isinstance(col, str) else col).cast("decimal(18,2)")


def cents(col: str | Column) -> Column:
    """Two-digit money as whole cents."""
    return F.round((F.col(col) if isinstance(col, str) else col) * 100).cast("bigint")


def sum_cents(amount: Column) -> Column:
    """Exact total of cents as money.

    Millions and rest are summed as two longs, which aggregate more than twice as fast as wide
    decimals and stay within range for trillions of rows.
    """
    million = 1000000
    high = F.sum(F.call_function("div", amount, F.lit(million))).cast("decimal(20,0)")
    low = F.sum(amount % million).cast("decimal(20,0)")
    return ((high * million + low) * F.lit(Decimal("0.01"))).cast("decimal(28,2)")


def money_sum(col: str | Column) -> Column:
    """Exact total of a money column held as double."""
    return sum_cents(cents(col))


def row_count() -> Column:
    return F.count(F.lit(1))


def on_days(col: str | Column, first: str, last: str) -> Column:
    """Timestamp lies on a day in [first, last]; half-open bounds reach the Parquet scan."""
    c = F.col(col) if isinstance(col, str) else col
    low = F.lit(first).cast("date").cast("timestamp_ntz")
    high = F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz")
    return (c >= low) & (c < high)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first under `order`, which must end in a tie-break.

    `row_number() == 1` lets Spark cut every map task down to one row per key before
    the shuffle, so a key holding a third of the rows costs no more than any other.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def with_group_values(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Add per-group aggregates to every row: aggregate, then join back.

    The window form would bring a whole group into one task. Here groups are combined before
    the shuffle and written out, so that the planner knows their size: a short list is
    broadcast and the rows stay where they are, a long one takes a sort-merge join with skew
    handling. Groups are matched null-safe, as PARTITION BY does.
    """
    grouped = materialise(
        df.groupBy(*[F.col(k).alias(f"_g_{k}") for k in keys]).agg(*aggregates), "groups"
    )
    match = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys]
    )
    return df.join(grouped, match).drop(*[f"_g_{k}" for k in keys])


def stack_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row (table_name, n) per table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def with_total(counts: DataFrame, labels: Sequence[str], value: str = "n") -> DataFrame:
    """Add a TOTAL row to a table of counts, from one evaluation of it."""
    first, *others = labels
    keys = F.struct(*labels)
    total = F.struct(F.lit("TOTAL").alias(first), *[F.lit("").alias(c) for c in others])
    twice = counts.select(F.explode(F.array(keys, total)).alias("_l"), value)
    return (
        twice.groupBy("_l").agg(F.sum(value).alias(value)).select("_l.*", value)
    )


def dense_row_numbers(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Number the rows of an unfiltered Parquet read 1..N in source order, without sorting them.

    A row's number is the count of rows in earlier files plus its index in its own file,
    both fixed by the files themselves: a lost task recomputes the same numbers.
    The running total and the broadcast are over one row per file, a list that the driver's
    file index holds already; counting reads no column.
    """
    columns = df.columns
    placed = df.select(
        *columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_index"),
    )
    files = df.select(F.col("_metadata.file_path").alias("_of")).groupBy("_of").count()
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("_of", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    numbered = placed.join(F.broadcast(offsets), F.col("_file") == F.col("_of"))
    return numbered.select((F.col("_base") + F.col("_index") + 1).alias(name), *columns)


def first_in_source_order(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep the first row per key in the order of a Parquet read."""
    return latest_per_key(dense_row_numbers(df, "_row"), keys, [F.col("_row")]).drop("_row")
