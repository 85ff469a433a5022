"""Landed observations as a stream: each micro-batch is merged into the stored table; events and counts with watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import compare
from ..plans.elt import KEY
from ..plans.store import Store

SCHEMA = "station_id string, obs_date date, variable string, value double, mflag string, qflag string, sflag string, ingested_at timestamp"
SOURCED = SCHEMA + ", source string"
FLAGS = ("mflag", "qflag", "sflag")


def age(prefix: str = "") -> Column:
    """What makes a row the newer one of two: its time, then its value and flags, so that no tie is left to chance."""
    return F.struct(*[F.col(f"{prefix}{c}") for c in ("ingested_at", "value", *FLAGS)])


def precedence(prefix: str = "") -> Column:
    """What makes a row the better one of two: the archive's with a value or a flag, then any with a value, then the newer one.

    This is an order of all rows of a key, so merging them in any batches and in any order gives the same table.
    """
    some = F.col(f"{prefix}value").isNotNull()
    archive = (F.coalesce(F.col(f"{prefix}source"), F.lit("")) == "GHCN") & (some | F.col(f"{prefix}qflag").isNotNull())
    return F.struct(archive.alias("archive"), some.alias("some"), age(prefix).alias("age"), F.col(f"{prefix}source").alias("source"))


def _first(rows: DataFrame, order: Column) -> DataFrame:
    whole = F.struct(*[c for c in rows.columns if c not in KEY])
    return rows.groupBy(*KEY).agg(F.max_by(whole, order).alias("r")).select(*KEY, "r.*")


def newest(rows: DataFrame) -> DataFrame:
    """One row a key: the newest ingested."""
    return _first(rows, age())


def settled(rows: DataFrame) -> DataFrame:
    """One row a key, by :func:`precedence`: what a stream of these rows leaves in the table."""
    return _first(rows, precedence())


def _run(stream: DataFrame, merge, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(spark: SparkSession, landing: str, store: Store, name: str, checkpoint: str, by: dict[str, str] | None = None) -> StreamingQuery:
    """Reads what has landed and stops; a value isn't replaced by a missing one. A batch's number is stored with what it merged,
    so one that runs again changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        better = F.col("s_value").isNotNull() | F.col("t_value").isNull()
        store.upsert(name, newest(batch), KEY, better, by=by, stream=(checkpoint, number))

    return _run(spark.readStream.schema(SCHEMA).parquet(landing), merge, checkpoint)


def ingest_sources(spark: SparkSession, landing: str, store: Store, name: str, checkpoint: str, by: dict[str, str] | None = None, files_a_batch: int | None = None) -> StreamingQuery:
    """As :func:`ingest` for rows of both sources, by :func:`precedence`: late and repeated rows change nothing that a
    better row settled."""

    def merge(batch: DataFrame, number: int) -> None:
        store.upsert(name, settled(batch), KEY, precedence("s_") > precedence("t_"), by=by, stream=(checkpoint, number))

    reader = spark.readStream.schema(SOURCED)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return _run(reader.parquet(landing), merge, checkpoint)


def once_each(rows: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Rows without those that repeat a key and time within the watermark; the state holds no more than the watermark's span."""
    return rows.withWatermark("ingested_at", lateness).dropDuplicatesWithinWatermark([*KEY, "ingested_at"])


def sessions(rows: DataFrame, variable: str, op: str, threshold: float, lateness: str = "30 days") -> DataFrame:
    """(station_id, event_start, event_end, total, duration) of runs of days that meet a threshold, as session windows.

    On a stream an event comes out once the watermark has passed it; on a table all do, the same ones.
    """
    met = rows.filter((F.col("variable") == variable) & compare(F.col("value"), op, threshold)).withColumn("at", F.col("obs_date").cast("timestamp"))
    # A day reaches an hour into the next but one, so days in a row overlap and others don't.
    run = met.withWatermark("at", lateness).groupBy("station_id", F.session_window("at", "25 hours").alias("w"))
    made = run.agg(F.sum("value").alias("total"), F.count("*").cast("double").alias("duration"))
    return made.select("station_id", F.to_date("w.start").alias("event_start"), F.date_sub(F.to_date("w.end"), 1).alias("event_end"), "total", "duration")


def hourly_counts(rows: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Rows a variable and hour of ingest; later rows than ``lateness`` are left out."""
    return rows.withWatermark("ingested_at", lateness).groupBy(F.window("ingested_at", "1 hour"), "variable").agg(F.count("*").alias("n"))
