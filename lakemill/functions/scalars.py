"""Column functions whose source-dialect meaning differs from Spark's built-in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Texts that mean NULL in loaded files, and texts that mean true.
NULL_TOKENS = ("", "NULL", "NA", "null")
TRUE_TOKENS = ("1", "true", "t", "yes", "y")


def sentence_case(c: str | Column) -> Column:
    """First letter upper, all others lower; `initcap` would raise every word."""
    return F.concat(F.upper(F.substring(col(c), 1, 1)), F.lower(F.substr(col(c), F.lit(2))))


def null_tokens(c: str | Column) -> Column:
    """Trimmed text, NULL where it is one of the NULL tokens."""
    text = F.trim(col(c))
    return F.when(~text.isin(*NULL_TOKENS), text)


def truthy(c: str | Column) -> Column:
    """Boolean from text or number: the true tokens are true, other non-NULL values false."""
    return F.lower(F.trim(col(c).cast("string"))).isin(*TRUE_TOKENS)


def pad_time(c: str | Column) -> Column:
    """`9:00` and `9:0:5` as `09:00:00` and `09:00:05`."""
    parts = F.split(F.trim(col(c)), ":")
    full = F.when(F.size(parts) == 2, F.concat(parts, F.array(F.lit("00")))).otherwise(parts)
    padded = F.transform(full, lambda p: F.when(F.length(p) < 2, F.lpad(p, 2, "0")).otherwise(p))
    return F.when(col(c).isNotNull(), F.array_join(padded, ":"))


def date_part(c: str | Column) -> Column:
    """Date of a text that may carry a time after a blank or a `T`."""
    return F.to_date(date_text(c))


def date_text(c: str | Column) -> Column:
    return F.substring_index(F.replace(F.trim(col(c)), F.lit("T"), F.lit(" ")), " ", 1)


def date_from_month_name(year: str | Column, month: str | Column, day: str | Column) -> Column:
    """Date of a year, an English month name and a day."""
    return F.to_date(F.concat_ws("-", col(year), col(month), col(day)), "yyyy-MMMM-d")


def month_start(c: str | Column, months_back: int = 0) -> Column:
    """First day of the month `months_back` before the date."""
    return F.trunc(F.add_months(col(c).cast("date"), -months_back), "MM")


def day_mon_yy(c: str | Column) -> Column:
    """Date of a literal such as `25-DEC-22`, in any case."""
    return F.to_date(F.initcap(F.lower(col(c))), "dd-MMM-yy")


def time_text(hours: Column, minutes: Column, seconds: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", hours, minutes, seconds)


def is_json(c: str | Column) -> Column:
    """The text parses as JSON; NULL stays NULL, as a CHECK lets it pass."""
    return F.when(col(c).isNotNull(), F.try_parse_json(col(c)).isNotNull())


def key_value(c: str | Column, type_name: str) -> Column:
    """Comparable form of a key cell by its declared type, so that 1 and '1' are one key."""
    text = F.trim(col(c).cast("string"))
    given = F.when(text != "", text)
    base = type_name.split("(")[0]
    if base == "int":
        return given.cast("bigint")
    if base == "dec":
        return given.cast("decimal(38,10)")
    if base == "bool":
        return truthy(given)
    return given


def pseudo_random(key: str | Column, seed: int, bound: int) -> Column:
    """Whole number in [0, bound) fixed by key and seed: a retried task repeats it exactly."""
    mixed = F.pmod(col(key).cast("bigint") % 2147483647 * 48271 + seed * 7919, F.lit(2147483647))
    spread = F.call_function("div", mixed * 16807, F.lit(127))
    return F.pmod(spread, F.lit(bound))
