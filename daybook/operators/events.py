"""Events: runs of consecutive days that meet a threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import compare


def events(days: DataFrame) -> DataFrame:
    """(station_id, event_start, event_end, total, duration); a missing or null day ends an event."""
    w = Window.partitionBy("station_id").orderBy("obs_date")
    hits = days.filter("hit = 1").withColumn("island", F.date_sub("obs_date", F.row_number().over(w)))
    return hits.groupBy("station_id", "island").agg(F.min("obs_date").alias("event_start"), F.max("obs_date").alias("event_end"), F.sum("value").alias("total"), F.count("*").cast("double").alias("duration")).drop("island")


def valued(found: DataFrame, by: str = "total") -> DataFrame:
    """Adds value: the event's total or duration."""
    return found.withColumn("value", F.col(by))


def over(found: DataFrame, op: str, threshold: float) -> DataFrame:
    return found.filter(compare(F.col("value"), op, threshold))


def event_stats(found: DataFrame) -> DataFrame:
    return found.groupBy("station_id").agg(F.count("*").alias("n_events"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.sum("value").alias("sum"), F.max("value").alias("max"), F.min("value").alias("min"), F.stddev("value").alias("stddev"))


def picked(found: DataFrame, how: str) -> DataFrame:
    """The latest, earliest, largest or smallest event; equal values: the latest."""
    keys = {"latest": F.struct("event_start"), "earliest": F.struct(-F.datediff("event_start", F.lit("1970-01-01"))), "max": F.struct(F.round("value", 2), "event_start"), "min": F.struct(F.round(-F.col("value"), 2), "event_start")}
    row = F.struct("event_start", "event_end", "total", "duration", "value")
    return found.groupBy("station_id").agg(F.max_by(row, keys[how]).alias("e")).select("station_id", "e.*")
