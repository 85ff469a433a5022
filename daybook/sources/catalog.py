"""Catalog tables clustered by station, so that what goes by station needs no shuffle.

A clustered table's files are hashed by station into buckets and sorted by station and date within each. Windows and
groups that include the station, and joins of two such tables with equal bucket counts, read buckets as they are.
Choose buckets so that one is a task's work: stored bytes over some 128 MB, and not over the number of stations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 64


def cluster(df: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Stores observations as the external table ``name`` at ``path``, replacing it, and gives it back as read."""
    spark = df.sparkSession
    # One task writes a bucket, so that a bucket is one file and its order is that of the table.
    rows = df.repartition(buckets, "station_id")
    rows.write.mode("overwrite").format("parquet").bucketBy(buckets, "station_id").sortBy("station_id", "obs_date").option("path", path).saveAsTable(name)
    return spark.table(name)


def shuffles(df: DataFrame) -> int:
    """How many exchanges the plan has."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def drop(spark: SparkSession, name: str) -> None:
    """Forgets the table; its files are whoever's who chose their path."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
