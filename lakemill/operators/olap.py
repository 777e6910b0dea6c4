"""Totals along dimension hierarchies, grouping sets, and the calendar dimension."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rollup_along(df: DataFrame, levels: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """Sums for every level of a hierarchy, coarsest level first in `levels`, and the total.
    `sums` names additive aggregates.

    Rows are summed to the finest level once, and the coarser levels are summed from that:
    the expansion into one copy per level then works on groups, not on raw rows.
    `level` is the number of hierarchy levels a row keeps; 0 is the grand total.
    """
    finest = df.groupBy(*levels).agg(*[total.alias(out) for out, total in sums.items()])
    depth = F.grouping_id()
    kept = F.lit(len(levels)) - F.length(F.regexp_replace(F.bin(depth), "0", ""))
    rolled = finest.rollup(*levels).agg(
        kept.cast("int").alias("level"), *[F.sum(out).alias(out) for out in sums]
    )
    return rolled


def rollup_from(stored: DataFrame, keys: Mapping[str, Column], sums: Sequence[str]) -> DataFrame:
    """Answer a coarser question from a stored summary instead of the fact table."""
    return stored.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(
        *[F.sum(s).alias(s) for s in sums]
    )


def determines(df: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """Keys that do not fix their attributes: more than one combination per key.

    Combinations are made distinct before they are counted per key, so a key holding most
    of the rows is a handful of rows by then. NULL counts as a value of its own.
    """
    combos = df.select(key, F.struct(*attributes).alias("_v")).distinct()
    return (
        combos.groupBy(key)
        .agg(F.count(F.lit(1)).alias("combinations"))
        .filter("combinations > 1")
    )


def time_dimension(days: DataFrame, day: str, fiscal_months: int = 0) -> DataFrame:
    """The 38-column calendar and fiscal date dimension for a column of days.

    The fiscal calendar is the calendar moved by `fiscal_months`; a week ends on Sunday and
    belongs to the fiscal period of its last day's month rules through the same shift.
    """
    d = F.col(day)
    f = F.add_months(F.trunc(d, "MM"), fiscal_months)

    def end_of(unit):
        return F.date_sub(F.add_months(F.trunc(d, unit), {"quarter": 3, "year": 12}[unit]), 1)

    def fiscal_end(unit):
        last = F.date_sub(F.add_months(F.trunc(f, unit), {"quarter": 3, "year": 12}[unit]), 1)
        return F.last_day(F.add_months(F.trunc(last, "MM"), -fiscal_months))

    def fiscal_start(unit):
        return F.add_months(F.trunc(f, unit), -fiscal_months)

    def number(col):
        return col.cast("int")

    week_end = F.next_day(F.date_sub(d, 1), "SUN")
    year, fyear = F.year(d), F.year(f)
    month, fmonth = F.month(d), F.month(f)
    quarter, fquarter = F.quarter(d), F.quarter(f)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return days.select(
        d.alias("time_id"),
        F.date_format(d, "EEEE").alias("day_name"),
        number(F.weekday(d) + 1).alias("day_number_in_week"),
        number(F.dayofmonth(d)).alias("day_number_in_month"),
        number(F.weekofyear(d)).alias("calendar_week_number"),
        number(F.floor(F.datediff(d, fiscal_start("year")) / 7) + 1).alias("fiscal_week_number"),
        week_end.alias("week_ending_day"),
        number(F.date_format(week_end, "yyyyMMdd")).alias("week_ending_day_id"),
        number(month).alias("calendar_month_number"),
        number(fmonth).alias("fiscal_month_number"),
        F.date_format(d, "yyyy-MM").alias("calendar_month_desc"),
        number(year * 100 + month).alias("calendar_month_id"),
        F.concat(fyear.cast("string"), F.lit("-"), two(fmonth)).alias("fiscal_month_desc"),
        number(fyear * 100 + fmonth).alias("fiscal_month_id"),
        number(F.dayofmonth(F.last_day(d))).alias("days_in_cal_month"),
        number(F.dayofmonth(F.last_day(d))).alias("days_in_fis_month"),
        F.last_day(d).alias("end_of_cal_month"),
        F.last_day(d).alias("end_of_fis_month"),
        F.date_format(d, "MMMM").alias("calendar_month_name"),
        F.date_format(d, "MMMM").alias("fiscal_month_name"),
        F.concat(year.cast("string"), F.lit("-Q"), quarter.cast("string")).alias(
            "calendar_quarter_desc"
        ),
        number(year * 10 + quarter).alias("calendar_quarter_id"),
        F.concat(fyear.cast("string"), F.lit("-Q"), fquarter.cast("string")).alias(
            "fiscal_quarter_desc"
        ),
        number(fyear * 10 + fquarter).alias("fiscal_quarter_id"),
        number(F.datediff(end_of("quarter"), F.trunc(d, "quarter")) + 1).alias(
            "days_in_cal_quarter"
        ),
        number(F.datediff(fiscal_end("quarter"), fiscal_start("quarter")) + 1).alias(
            "days_in_fis_quarter"
        ),
        end_of("quarter").alias("end_of_cal_quarter"),
        fiscal_end("quarter").alias("end_of_fis_quarter"),
        number(quarter).alias("calendar_quarter_number"),
        number(fquarter).alias("fiscal_quarter_number"),
        number(year).alias("calendar_year"),
        number(year).alias("calendar_year_id"),
        number(fyear).alias("fiscal_year"),
        number(fyear).alias("fiscal_year_id"),
        number(F.datediff(end_of("year"), F.trunc(d, "year")) + 1).alias("days_in_cal_year"),
        number(F.datediff(fiscal_end("year"), fiscal_start("year")) + 1).alias("days_in_fis_year"),
        end_of("year").alias("end_of_cal_year"),
        fiscal_end("year").alias("end_of_fis_year"),
    )


def days_between(df: DataFrame, column: str) -> DataFrame:
    """One row per day from the first to the last value of a date or timestamp column."""
    bounds = df.agg(
        F.min(column).cast("date").alias("first"), F.max(column).cast("date").alias("last")
    )
    return bounds.select(F.explode(F.sequence("first", "last")).alias("day"))
