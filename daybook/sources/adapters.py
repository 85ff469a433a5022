"""Adapters: general tables shaped as observations, raw inputs, stations, places, chat turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.elt import derived


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _observed(keyed: DataFrame) -> DataFrame:
    """Metrics from a whole number per (station_id, obs_date); all arithmetic is on integers."""
    h, m = F.col("h"), F.month("obs_date")
    s = 30 + 10 * (6 - F.abs(m - 7))
    wide = keyed.select(
        "station_id", "obs_date",
        (h % 25).cast("double").alias("AWND"),
        F.when(h % 37 == 0, None).when(h % 10 < 3, (h % 150) / F.lit(100.0)).otherwise(0.0).alias("PRCP"),
        F.when(m.isin(11, 12, 1, 2, 3, 4) & (h % 7 < 2), (h % 60) / F.lit(10.0)).otherwise(0.0).alias("SNOW"),
        F.when(m.isin(12, 1, 2), (h % 9).cast("double")).otherwise(0.0).alias("SNWD"),
        F.when(h % 29 != 0, (s + h % 21).cast("double")).alias("TMAX"),
        F.when(h % 31 != 0, (s - 20 + h % 17).cast("double")).alias("TMIN"),
    )
    return derived(wide)


def _weight() -> Column:
    return F.sum(F.col("l_partkey") * 31 + F.col("l_suppkey")).cast("long").alias("h")


def obs_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stations, about seven years."""
    lines = table(spark, sf_dir, "lineitem")
    return _observed(lines.groupBy(F.concat(F.lit("R"), "l_returnflag").alias("station_id"), F.to_date("l_shipdate").alias("obs_date")).agg(_weight()))


def obs_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One station, 1971 to 2020."""
    day = ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729 + F.col("l_partkey") * 31) % 18263).cast("int")
    lines = table(spark, sf_dir, "lineitem").withColumn("obs_date", F.date_add(F.to_date(F.lit("1971-01-01")), day))
    return _observed(lines.groupBy(F.lit("LONG").alias("station_id"), "obs_date").agg(_weight()))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event by (station, date, variable), with k, the first number in its properties."""
    kinds = {"view": "TMAX", "click": "TMIN", "error": "PRCP", "signup": "SNOW"}
    variable = F.lit("SNWD")
    for kind, name in kinds.items():
        variable = F.when(F.col("event_type") == kind, name).otherwise(variable)
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("U"), (F.col("user_id") % 10).cast("string")).alias("station_id"), F.to_date("ts").alias("obs_date"), variable.alias("variable"), "ts", "event_id", F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k")
    )
    latest = F.max_by(F.struct("ts", "event_id", "k"), "ts").alias("e")
    return rows.groupBy("station_id", "obs_date", "variable").agg(latest).select("station_id", "obs_date", "variable", "e.*")


def raw_ghcn(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = _raw(spark, sf_dir).filter(k % 2 == 0)
    none = F.lit(None).cast("string")
    return rows.select("station_id", "obs_date", "variable", F.when(k % 14 != 0, (F.col("event_id") % 300).cast("double")).alias("value"), none.alias("mflag"), F.when(k % 20 == 0, "X").alias("qflag"), none.alias("sflag"), F.col("ts").alias("ingested_at"))


def allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).filter(F.col("k") % 40 == 0).select("station_id", "obs_date", "variable")


def raw_acis(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    native = {"TMAX": "maxt", "TMIN": "mint", "PRCP": "pcpn", "SNOW": "snow"}
    code = F.lit("snwd")
    for name, c in native.items():
        code = F.when(F.col("variable") == name, c).otherwise(code)
    rows = _raw(spark, sf_dir).filter(k % 2 == 1)
    return rows.select("station_id", "obs_date", code.alias("variable"), F.when(k % 10 == 1, "T").when(k % 10 == 3, "M").otherwise((F.col("event_id") % 300).cast("string")).alias("value"), F.col("ts").alias("ingested_at"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("USW"), F.lpad(n.cast("string"), 8, "0")).alias("ghcn_id"), F.format_string("STATION %d INTL AP", n.cast("long")).alias("name"), F.col("n_name").alias("city"), F.lit("ST").alias("state"),
        (25.0 + n).alias("latitude"), (-(70.0 + 2 * n)).alias("longitude"), (n % 5 != 0).alias("selected"), F.when(n % 7 != 0, (70000 + n).cast("string")).alias("wmo"), F.col("r_name").alias("country_name"),
        F.concat(F.lit("K"), F.lpad(n.cast("string"), 3, "0")).alias("icao"), F.concat(F.lit("Q"), F.lpad(n.cast("string"), 2, "0")).alias("iata"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        s.cast("long").alias("geonameid"), F.col("s_name").alias("place_name"), F.lower("s_name").alias("name_key"), F.col("n_name").alias("admin1_name"), (25 + (s * 37 % 2500) / F.lit(100.0)).alias("latitude"), (-(70 + (s * 91 % 5000) / F.lit(100.0))).alias("longitude"),
        (F.floor(F.col("s_acctbal") * 100) + 100000).cast("long").alias("population"),
    )


def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("turn_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("status"), F.col("user_id").cast("string").alias("user_id"), F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("session_id"))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first by ``order``."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")
