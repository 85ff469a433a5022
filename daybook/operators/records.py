"""Calendar-day records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import RECORD_YEARS, ROW_CAP


def record_days(days: DataFrame, start: str, end: str, high: bool = True, positive_only: bool = False) -> DataFrame:
    """Days in the range that set or tie their calendar day's record as it stood.

    ``days`` is the whole record through the later of the range's end and today. A day
    counts from ``RECORD_YEARS`` earlier years with a value, or if it still holds the record.
    Null values hold no record. One shuffle by (station, calendar day) serves all windows.
    """
    rows = days.withColumn("md", F.date_format("obs_date", "MM-dd")).withColumn("in_range", F.col("obs_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    key = Window.partitionBy("station_id", "md")
    before = key.orderBy("obs_date").rowsBetween(Window.unboundedPreceding, -1)
    best = F.max if high else F.min
    year = F.year("obs_date")
    held = F.struct("value", (year if high else -year).alias("y"))
    rows = rows.select(
        "*", best("value").over(before).alias("previous_record"), best(F.when(F.col("value").isNotNull(), held)).over(before)["y"].alias("held"),
        F.count("value").over(before).alias("prior_years"), best("value").over(key).alias("whole_record"),
    )
    v, prev = F.col("value"), F.col("previous_record")
    beats = lambda bar: v >= bar if high else v <= bar
    is_record = F.col("in_range") & v.isNotNull() & (prev.isNull() | beats(prev)) & ((F.col("prior_years") >= RECORD_YEARS) | beats(F.col("whole_record")))
    if positive_only:
        is_record = is_record & (v > 0)
    return rows.filter(is_record).select("station_id", "obs_date", "value", "previous_record", F.abs("held").alias("previous_record_year"), F.coalesce(v == prev, F.lit(False)).alias("tied"))


def record_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("station_id").agg(F.count("*").cast("double").alias("value"), F.count_if("tied").alias("n_tied"), (F.count("*") > ROW_CAP).alias("rows_truncated"))


def first_records(found: DataFrame) -> DataFrame:
    """The first ``ROW_CAP`` record days of each station."""
    n = F.row_number().over(Window.partitionBy("station_id").orderBy("obs_date"))
    return found.withColumn("n", n).filter(F.col("n") <= ROW_CAP).drop("n")
