"""Matching rows with the validity period they fall into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


FAR = "9999-01-01"


ORIGIN = "0001-01-01"  # day 0
LEVELS = 22  # 2^22 days reach beyond the year 9999


def _day_number(day: Column) -> Column:
    return F.datediff(day, F.lit(ORIGIN).cast("date")).cast("long")


def join_periods(
    facts: DataFrame,
    day: Column,
    periods: DataFrame,
    start: str = "from_date",
    end: str = "to_date",
    keys: dict[str, str] | None = None,
) -> DataFrame:
    """Facts with every period where `start <= day < end`; a NULL end is open.

    With `keys` (fact column -> period column) the join is an equality on them with the bounds as
    a residual test, and a period is one row. Without, a period is cut into ranges of 2^k days
    that begin at multiples of their length, at most two a length, and each day that occurs looks
    up the one range of every length that holds it. A range meets at most as many rows as it has
    days, since facts come in only afterwards, by day; an open end costs no listing.
    """
    until = F.coalesce(F.col(end), F.lit(FAR).cast("date"))
    if keys:
        same = [F.col(a) == F.col(b) for a, b in keys.items()]
        return facts.withColumn("_day", day).join(
            periods, [*same, F.col("_day") >= F.col(start), F.col("_day") < until]
        ).drop("_day")
    dated = facts.withColumn("_day", day)
    days = dated.select("_day").filter(F.col("_day").isNotNull()).distinct()
    met = day_probes(days, "_day").join(period_ranges(periods, F.col(start), until), ["_level", "_at"])
    held = met.drop("_level", "_at").withColumnRenamed("_day", "_held")
    return dated.join(held, F.col("_day") == F.col("_held")).drop("_day", "_held")


def day_probes(days: DataFrame, day: str) -> DataFrame:
    """Each distinct day with the range of every length that holds it."""
    level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("_level")
    number = _day_number(F.col(day))
    at = F.call_function("shiftright", number, F.col("_level")).alias("_at")
    return days.select(day, level).select(day, "_level", at)


def period_ranges(periods: DataFrame, first: Column, end: Column) -> DataFrame:
    """Each period once per range that it is made of; empty periods have none.

    At length 2^k the whole ranges inside [first, end) run from ceil(first / 2^k) up to
    floor(end / 2^k). The first of them is not part of a longer one if its place is odd, nor is
    the last if its place is even.
    """
    spread = periods.withColumn("_first", _day_number(first)).withColumn("_end", _day_number(end))
    level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))
    spread = spread.filter("_first < _end").withColumn("_level", level)
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_level"))
    low = F.call_function("shiftright", F.col("_first") + size - 1, F.col("_level"))
    high = F.call_function("shiftright", F.col("_end"), F.col("_level"))
    spread = spread.withColumn("_low", low).withColumn("_high", high).filter("_low < _high")
    edges = F.array(
        F.when(F.col("_low") % 2 == 1, F.col("_low")), F.when(F.col("_high") % 2 == 1, F.col("_high") - 1)
    )
    cut = spread.withColumn("_at", F.explode(edges)).filter("_at IS NOT NULL")
    return cut.drop("_first", "_end", "_low", "_high")


def valid_on(history: DataFrame, day: str, start: str = "from_date", end: str = "to_date"):
    """The history rows valid on one day; an open end is a NULL or far-future date."""
    point = F.lit(day).cast("date")
    return history.filter(
        (F.col(start) <= point) & (F.coalesce(F.col(end), F.lit("9999-01-01").cast("date")) > point)
    )
