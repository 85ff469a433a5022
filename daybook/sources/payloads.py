"""Landed JSON answers with a quarantine: good rows go on, the others are kept with the reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .parse import API_ELEMENTS

SCHEMA = "station_id string, data array<array<string>>, _corrupt string"
KINDS = ("not JSON", "no station", "no data", "short row", "no date")


def landed(spark: SparkSession, path: str) -> DataFrame:
    """One row a landed answer (a line each): station_id, data, raw_line, source_file and reason, null for a good one.

    An answer is ``{"station_id": ..., "data": [[date, value, ...]]}``. Lines are read once and parsed
    permissively, so one broken answer costs no other.
    """
    rows = spark.read.text(path).select(F.col("value").alias("raw_line"), F.col("_metadata.file_path").alias("source_file")).filter(F.trim("raw_line") != "")
    parsed = rows.withColumn("p", F.from_json("raw_line", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    row = F.get("p.data", F.lit(0))
    reason = (
        F.when(F.col("p").isNull() | F.col("p._corrupt").isNotNull(), KINDS[0]).when(F.coalesce(F.trim("p.station_id"), F.lit("")) == "", KINDS[1]).when(row.isNull(), KINDS[2])
        .when(F.size(row) < 1 + len(API_ELEMENTS), KINDS[3]).when(F.try_to_date(F.get(row, F.lit(0))).isNull(), KINDS[4])
    )
    return parsed.select("p.station_id", "p.data", "raw_line", "source_file", reason.alias("reason"))


def observations(answers: DataFrame) -> DataFrame:
    """(station_id, obs_date, variable, value) of good answers, strings as they came; an answer of "M" alone has no rows."""
    row = F.get("data", F.lit(0))
    values = F.slice(row, 2, len(API_ELEMENTS))
    pairs = F.arrays_zip(F.array(*[F.lit(e) for e in API_ELEMENTS]).alias("variable"), values.alias("value"))
    some = answers.filter(F.col("reason").isNull() & ~F.forall(values, lambda v: F.coalesce(v == "M", F.lit(False))))
    return some.select("station_id", F.try_to_date(F.get(row, F.lit(0))).alias("obs_date"), F.explode(pairs).alias("p")).select("station_id", "obs_date", F.col("p.variable").alias("variable"), F.col("p.value").alias("value"))


def rejects(answers: DataFrame) -> DataFrame:
    """(raw_line, source_file, reason) of the others."""
    return answers.filter(F.col("reason").isNotNull()).select("raw_line", "source_file", "reason")
