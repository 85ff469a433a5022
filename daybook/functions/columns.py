"""Expressions that several operators use; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import COVERAGE, EARTH_MILES, TWO_DECIMALS


def compare(value: Column, op: str, threshold: float) -> Column:
    """``value op threshold``; null where the value is null."""
    t = F.lit(float(threshold))
    return {">": value > t, ">=": value >= t, "<": value < t, "<=": value <= t, "=": value == t}[op]


def hit(value: Column, op: str | None, threshold: float | None) -> Column:
    """1 if the value meets the threshold, else 0; null for a null value; 0 without a threshold."""
    met = F.lit(0) if op is None else F.when(compare(value, op, threshold), 1).otherwise(0)
    return F.when(value.isNull(), F.lit(None)).otherwise(met).cast("int")


def bucket_year(date: Column, start_month: int = 1) -> Column:
    """The year a bucket of twelve months ends in; the calendar year if it starts in January."""
    return F.year(date if start_month == 1 else F.add_months(date, 13 - start_month))


def month_days(year: Column, month: Column | int) -> Column:
    m = F.lit(month) if isinstance(month, int) else month
    return F.day(F.last_day(F.make_date(year, m, F.lit(1))))


def window_days(year: Column, start_month: int = 1, months: list[int] | None = None) -> Column:
    """Days of a twelve-month bucket, of the given months only."""
    total = F.lit(0)
    for m in sorted(set(months or range(1, 13))):
        total = total + month_days(year - 1 if start_month > 1 and m >= start_month else year, m)
    return total


def covered(n_days: Column, expected: Column) -> Column:
    """At least nine tenths of the days have a value."""
    return n_days >= F.lit(COVERAGE) * expected


def decimals(metric: str) -> int:
    return 2 if metric in TWO_DECIMALS else 1


def collapse(how: str) -> Column:
    """A bucket's value from its days (columns value, hit)."""
    return {"mean": F.avg("value"), "sum": F.sum("value"), "count": F.sum("hit").cast("double"), "any": F.max("hit").cast("double")}[how]


def rounded(value: Column, digits: int) -> Column:
    """Rounded; never minus zero."""
    return F.round(value, digits) + F.lit(0.0)


def miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_MILES * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def celsius(f: Column) -> Column:
    return (f - 32) * 5 / 9


def season_day(date: Column, start_month: int = 1) -> Column:
    """Days since the first day of the bucket that the date is in."""
    year = bucket_year(date, start_month) - (1 if start_month > 1 else 0)
    return F.datediff(date, F.make_date(year, F.lit(start_month), F.lit(1)))
