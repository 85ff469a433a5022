"""The read that every query starts from, and aggregates and rankings over days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hit
from ..functions.vocabulary import RANK_DEFAULT, RANK_MAX, ROW_CAP


def daily_values(obs: DataFrame, metric: str, start: str, end: str, months: list[int] | None = None, op: str | None = None, threshold: float | None = None, station: str | None = None) -> DataFrame:
    """(station_id, obs_date, value, hit) of one metric; the filters reach the scan."""
    date = F.col("obs_date")
    rows = obs.filter(date.between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    if station is not None:
        rows = rows.filter(F.col("station_id") == station)
    if months:
        rows = rows.filter(F.month(date).isin(*months))
    value = F.col(metric).cast("double")
    return rows.select("station_id", "obs_date", value.alias("value"), hit(value, op, threshold).alias("hit"))


def aggregate(how: str, column: str = "value") -> Column:
    """One aggregate over non-null values; count is of hits."""
    made = {"mean": F.avg, "median": F.median, "sum": F.sum, "max": F.max, "min": F.min, "stddev": F.stddev}
    return F.count_if(F.col("hit") == 1).cast("double") if how == "count" else made[how](column)


def day_stats(days: DataFrame, *how: str) -> DataFrame:
    """station_id, one column an aggregate, n_days (days with a value)."""
    return days.groupBy("station_id").agg(*[aggregate(h).alias(h) for h in how], F.count("value").alias("n_days"))


def rank_limit(n: int | None) -> int:
    return max(min(RANK_DEFAULT if n is None else n, RANK_MAX), 1)


def ranked(rows: DataFrame, order: list[str], limit: int | None = None, lowest: bool = False, by: tuple[str, ...] = ("station_id",)) -> DataFrame:
    """The first ``limit`` dense ranks of ``value`` for each station, ties kept, ``ROW_CAP`` rows by
    (rank, ``order``); rows_truncated tells that more qualified. Null values aren't ranked."""
    key = F.round(-F.col("value") if lowest else F.col("value"), 2)
    w = Window.partitionBy(*by)
    kept = rows.filter(F.col("value").isNotNull()).withColumn("rank", F.dense_rank().over(w.orderBy(F.desc_nulls_last(key)))).filter(F.col("rank") <= rank_limit(limit))
    place = w.orderBy("rank", *order)
    return kept.withColumn("_n", F.row_number().over(place)).withColumn("rows_truncated", F.count("*").over(w) > ROW_CAP).filter(F.col("_n") <= ROW_CAP).drop("_n")


def extremes(rows: DataFrame, at: list[str], lowest: bool = False) -> DataFrame:
    """Rows of each station's extreme value (at most ``ROW_CAP``, latest by ``at`` first); is_answer
    marks the latest, n_ties counts all of them. Null values don't count."""
    w = Window.partitionBy("station_id")
    key = F.round(-F.col("value") if lowest else F.col("value"), 2)
    top = rows.filter(F.col("value").isNotNull()).withColumn("_r", F.dense_rank().over(w.orderBy(F.desc_nulls_last(key)))).filter("_r = 1").drop("_r")
    n = F.row_number().over(w.orderBy(*[F.desc_nulls_last(c) for c in at]))
    made = top.withColumn("_n", n).withColumn("n_ties", F.count("*").over(w)).filter(F.col("_n") <= ROW_CAP)
    return made.withColumn("is_answer", F.col("_n") == 1).drop("_n")


def extreme_days(days: DataFrame, lowest: bool = False) -> DataFrame:
    """The extreme value's days, by :func:`extremes`."""
    return extremes(days, ["obs_date"], lowest).select("station_id", "obs_date", "value", "is_answer")


def matching_days(days: DataFrame, lowest: bool = False, enough: int = 5) -> DataFrame:
    """Extreme days by rank until ``enough`` are listed; the last tie is finished."""
    w = Window.partitionBy("station_id")
    key = F.round(-F.col("value") if lowest else F.col("value"), 2)
    order = w.orderBy(F.desc_nulls_last(key))
    rows = days.filter(F.col("value").isNotNull()).withColumn("rank", F.dense_rank().over(order)).withColumn("ahead", F.rank().over(order) - 1)
    return rows.filter(F.col("ahead") < enough).select("station_id", "rank", "obs_date", "value")
