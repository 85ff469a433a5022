"""Buckets of months, years, seasons and snow seasons, with the coverage rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bucket_year, collapse, compare, covered, decimals, month_days, rounded, window_days
from ..functions.vocabulary import SEASONS, WEEK_DAYS
from .daily import extremes


def season_window(season: str) -> tuple[int, list[int]]:
    """Start month and months of a yearly season; winter is named by the year it ends in."""
    return (12 if season == "winter" else 1), list(SEASONS[season])


def buckets(days: DataFrame, unit: str, how: str, start_month: int = 1, months: list[int] | None = None) -> DataFrame:
    """(station_id, bucket_year, bucket_month, value, n_days) of the complete buckets.

    ``days`` already holds only ``months``; dates outside the read are missing days,
    so a bucket that the read cuts is incomplete.
    """
    date = F.col("obs_date")
    if unit == "month":
        keyed = days.select("station_id", F.year(date).alias("bucket_year"), F.month(date).alias("bucket_month"), "value", "hit")
        expected = month_days(F.col("bucket_year"), F.col("bucket_month"))
    else:
        keyed = days.select("station_id", bucket_year(date, start_month).alias("bucket_year"), F.lit(None).cast("int").alias("bucket_month"), "value", "hit")
        expected = window_days(F.col("bucket_year"), start_month, months)
    made = keyed.groupBy("station_id", "bucket_year", "bucket_month").agg(collapse(how).alias("value"), F.count("value").alias("n_days"))
    return made.filter(F.col("value").isNotNull() & covered(F.col("n_days"), expected))


def period_stats(found: DataFrame, *how: str) -> DataFrame:
    """Aggregates across complete buckets, their number, and the first and last one."""
    made = {"mean": F.avg, "median": F.median, "sum": F.sum, "max": F.max, "min": F.min, "stddev": F.stddev}
    at = F.col("bucket_year") * 100 + F.coalesce("bucket_month", F.lit(0))
    return found.groupBy("station_id").agg(*[made[h]("value").alias(h) for h in how], F.count("*").alias("n_buckets"), F.min(at).alias("first_bucket"), F.max(at).alias("last_bucket"))


def extreme_periods(found: DataFrame, lowest: bool = False) -> DataFrame:
    """The complete buckets of the extreme value, latest first, with the number, first and last of all of them."""
    w = Window.partitionBy("station_id")
    at = F.col("bucket_year") * 100 + F.coalesce("bucket_month", F.lit(0))
    counted = found.withColumns({"n_buckets": F.count("*").over(w), "first_bucket": F.min(at).over(w), "last_bucket": F.max(at).over(w)})
    return extremes(counted, ["bucket_year", "bucket_month"], lowest)


def period_count(found: DataFrame, op: str, threshold: float) -> DataFrame:
    """Buckets that meet a threshold, of how many."""
    return found.groupBy("station_id").agg(F.count_if(F.coalesce(compare(F.col("value"), op, threshold), F.lit(False))).cast("double").alias("value"), F.count("*").alias("n_buckets"))


def series(found: DataFrame, metric: str) -> DataFrame:
    """The buckets as points, rounded for the metric."""
    return found.withColumn("value", rounded(F.col("value"), decimals(metric)))


def first_last_dates(days: DataFrame, start_month: int = 1, months: list[int] | None = None) -> DataFrame:
    """(station_id, year, first, last, n_days): first and last hit of each covered year."""
    made = days.groupBy("station_id", bucket_year(F.col("obs_date"), start_month).alias("year")).agg(
        F.min(F.when(F.col("hit") == 1, F.col("obs_date"))).alias("first"), F.max(F.when(F.col("hit") == 1, F.col("obs_date"))).alias("last"), F.count("value").alias("n_days")
    )
    return made.filter(covered(F.col("n_days"), window_days(F.col("year"), start_month, months)))


def _across(found: DataFrame, key: str, metric: str, how: str) -> DataFrame:
    digits = 3 if how == "any" else decimals(metric)
    return found.groupBy("station_id", key).agg(rounded(F.avg("value"), digits).alias("value"), rounded(F.stddev("value"), decimals(metric)).alias("stddev"), F.count("*").alias("n_years"))


def month_of_year(days: DataFrame, metric: str, how: str) -> DataFrame:
    """(station_id, month, value, stddev, n_years) across complete months, unrounded before the mean."""
    return _across(buckets(days, "month", how).withColumnRenamed("bucket_month", "month"), "month", metric, how)


def week_of_year(days: DataFrame, metric: str, how: str) -> DataFrame:
    """As :func:`month_of_year` by week 1 to 52 of the year; the last week runs to Dec 31."""
    week = F.least(F.lit(52), F.floor((F.dayofyear("obs_date") - 1) / 7).cast("int") + 1)
    made = days.groupBy("station_id", F.year("obs_date").alias("y"), week.alias("week")).agg(collapse(how).alias("value"), F.count("value").alias("n_days"))
    return _across(made.filter(F.col("value").isNotNull() & (F.col("n_days") >= WEEK_DAYS)), "week", metric, how)


def season_of_year(days: DataFrame, metric: str, how: str, first_year: int, last_year: int) -> DataFrame:
    """As :func:`month_of_year` by season; ``days`` starts a month early for the first winter's December."""
    year, month = F.year(F.add_months("obs_date", 1)), F.month("obs_date")
    number = (F.floor((month % 12) / 3) + 1).cast("int")
    made = days.filter(year.between(first_year, last_year)).groupBy("station_id", year.alias("y"), number.alias("k")).agg(collapse(how).alias("value"), F.count("value").alias("n_days"))
    start = F.make_date(F.col("y") - (F.col("k") == 1).cast("int"), F.when(F.col("k") == 1, 12).otherwise(3 * F.col("k") - 3), F.lit(1))
    full = made.filter(F.col("value").isNotNull() & covered(F.col("n_days"), F.datediff(F.add_months(start, 3), start)))
    names = F.array(*[F.lit(s) for s in SEASONS])
    return _across(full, "k", metric, how).select("station_id", F.element_at(names, F.col("k")).alias("season"), "value", "stddev", "n_years")


def day_of_year(days: DataFrame, metric: str, how: str = "mean") -> DataFrame:
    """(station_id, day, value, stddev, n_years, max, max_year, min, min_year) by calendar day; ties: the latest year."""
    y = F.year("obs_date")
    mean = rounded(F.avg("hit"), 3) if how == "any" else rounded(F.avg("value"), decimals(metric))
    made = days.filter(F.col("value").isNotNull()).groupBy("station_id", F.date_format("obs_date", "MM-dd").alias("day")).agg(
        mean.alias("value"), rounded(F.stddev("value"), decimals(metric)).alias("stddev"), F.count("value").alias("n_years"), F.max(F.struct(F.col("value").alias("v"), y.alias("y"))).alias("hi"), F.min(F.struct(F.col("value").alias("v"), (-y).alias("y"))).alias("lo")
    )
    return made.select("station_id", "day", "value", "stddev", "n_years", F.col("hi.v").alias("max"), F.col("hi.y").alias("max_year"), F.col("lo.v").alias("min"), (-F.col("lo.y")).alias("min_year"))


def histogram(days: DataFrame, metric: str) -> DataFrame:
    """(station_id, value, count) of rounded daily values."""
    v = rounded(F.col("value"), 2 if decimals(metric) == 2 else 0)
    return days.filter(F.col("value").isNotNull()).groupBy("station_id", v.alias("value")).agg(F.count("*").alias("count"))


def daily_series(days: DataFrame, metric: str) -> DataFrame:
    """(station_id, obs_date, value) of the days with a value."""
    return days.filter(F.col("value").isNotNull()).select("station_id", "obs_date", rounded(F.col("value"), decimals(metric)).alias("value"))
