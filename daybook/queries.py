"""Registered queries of the engine and the same questions in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import analysis as an
from .operators import daily, periods, records
from .operators import events as ev
from .plans import answers, charts, elt, stations, work
from .plans import places as resolving
from .plans import query as structured
from .sources import adapters as ad
from .sources import parse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SHORT = ("1995-01-01", "2001-12-31")
LONG = ("1971-01-01", "2020-12-31")
NORMAL = ("1991-01-01", "2020-12-31")
TODAY = "2020-12-31"


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Rounds float results, whose last bits depend on the order of summation."""
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


# --- the same adapters in SQL

_METRICS = """
  SELECT station_id, obs_date, (h % 25)::DOUBLE AS AWND,
    CASE WHEN h % 37 = 0 THEN NULL WHEN h % 10 < 3 THEN (h % 150)::DOUBLE / 100::DOUBLE ELSE 0 END AS PRCP,
    CASE WHEN month(obs_date) IN (11, 12, 1, 2, 3, 4) AND h % 7 < 2 THEN (h % 60)::DOUBLE / 10::DOUBLE ELSE 0 END AS SNOW,
    CASE WHEN month(obs_date) IN (12, 1, 2) THEN (h % 9)::DOUBLE ELSE 0 END AS SNWD,
    CASE WHEN h % 29 <> 0 THEN (30 + 10 * (6 - abs(month(obs_date) - 7)) + h % 21)::DOUBLE END AS TMAX,
    CASE WHEN h % 31 <> 0 THEN (30 + 10 * (6 - abs(month(obs_date) - 7)) - 20 + h % 17)::DOUBLE END AS TMIN
  FROM g"""
_DERIVED = """
  SELECT *, (TMAX + TMIN) / 2::DOUBLE AS TAVG,
    CASE WHEN TMAX IS NOT NULL AND TMIN IS NOT NULL THEN round(greatest(65 - (TMAX + TMIN) / 2::DOUBLE, 0))::INT END AS HDD,
    CASE WHEN TMAX IS NOT NULL AND TMIN IS NOT NULL THEN round(greatest((TMAX + TMIN) / 2::DOUBLE - 65, 0))::INT END AS CDD FROM w"""
_SHORT = f"""
obs_short AS (WITH g AS (SELECT 'R' || l_returnflag AS station_id, l_shipdate::DATE AS obs_date, sum(l_partkey * 31 + l_suppkey)::BIGINT AS h FROM lineitem GROUP BY 1, 2), w AS ({_METRICS}) {_DERIVED})"""
_LONG = f"""
obs_long AS (WITH g AS (SELECT 'LONG' AS station_id, DATE '1971-01-01' + ((l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 18263)::INT AS obs_date, sum(l_partkey * 31 + l_suppkey)::BIGINT AS h FROM lineitem GROUP BY 1, 2), w AS ({_METRICS}) {_DERIVED})"""
_RAW = """
e AS (SELECT 'U' || (user_id % 10) AS station_id, ts::DATE AS obs_date,
    CASE event_type WHEN 'view' THEN 'TMAX' WHEN 'click' THEN 'TMIN' WHEN 'error' THEN 'PRCP' WHEN 'signup' THEN 'SNOW' ELSE 'SNWD' END AS variable,
    ts, event_id, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k FROM events),
raw AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY station_id, obs_date, variable ORDER BY ts DESC) = 1),
raw_ghcn AS (SELECT station_id, obs_date, variable, CASE WHEN k % 14 <> 0 THEN (event_id % 300)::DOUBLE END AS value, NULL::VARCHAR AS mflag, CASE WHEN k % 20 = 0 THEN 'X' END AS qflag, NULL::VARCHAR AS sflag, ts AS ingested_at FROM raw WHERE k % 2 = 0),
allowed AS (SELECT station_id, obs_date, variable FROM raw WHERE k % 40 = 0),
raw_acis AS (SELECT station_id, obs_date, CASE variable WHEN 'TMAX' THEN 'maxt' WHEN 'TMIN' THEN 'mint' WHEN 'PRCP' THEN 'pcpn' WHEN 'SNOW' THEN 'snow' ELSE 'snwd' END AS variable,
    CASE WHEN k % 10 = 1 THEN 'T' WHEN k % 10 = 3 THEN 'M' ELSE (event_id % 300)::VARCHAR END AS value, ts AS ingested_at FROM raw WHERE k % 2 = 1)"""
_CONV = """
ghcn_conv AS (SELECT station_id, obs_date, variable, CASE variable
      WHEN 'PRCP' THEN round(v * 0.00393701::DOUBLE, 2) WHEN 'SNOW' THEN round(v * 0.0393701::DOUBLE, 1) WHEN 'SNWD' THEN round(v * 0.0393701::DOUBLE, 1)
      WHEN 'TMAX' THEN round(v * 0.18::DOUBLE + 32, 0) WHEN 'TMIN' THEN round(v * 0.18::DOUBLE + 32, 0) WHEN 'AWND' THEN round(v * 0.223694::DOUBLE, 0) ELSE v END AS value, mflag, qflag, sflag, ingested_at
  FROM (SELECT g.*, CASE WHEN g.qflag IS NOT NULL AND a.station_id IS NULL THEN NULL ELSE g.value END AS v FROM raw_ghcn g LEFT JOIN allowed a ON a.station_id = g.station_id AND a.obs_date = g.obs_date AND a.variable = g.variable)),
acis_conv AS (SELECT station_id, obs_date, CASE variable WHEN 'maxt' THEN 'TMAX' WHEN 'mint' THEN 'TMIN' WHEN 'pcpn' THEN 'PRCP' WHEN 'snow' THEN 'SNOW' WHEN 'snwd' THEN 'SNWD' ELSE variable END AS variable, value, ingested_at FROM raw_acis),
cut AS (SELECT max(obs_date) - 7 AS cutoff FROM ghcn_conv WHERE value IS NOT NULL),
both_sources AS (SELECT station_id, obs_date, variable, value, mflag, qflag, sflag, ingested_at, 'GHCN' AS source FROM ghcn_conv
  UNION ALL SELECT station_id, obs_date, variable, CASE WHEN value = 'T' THEN 0.001::DOUBLE ELSE TRY_CAST(value AS DOUBLE) END, NULL, NULL, NULL, ingested_at, 'ACIS' FROM acis_conv),
merged AS (SELECT station_id, obs_date, variable, value, mflag, qflag, sflag, ingested_at, source FROM (
    SELECT u.*, cutoff FROM both_sources u, cut
    QUALIFY row_number() OVER (PARTITION BY station_id, obs_date, variable ORDER BY CASE WHEN source = 'ACIS' AND obs_date > cutoff THEN 1 WHEN source = 'GHCN' AND value IS NOT NULL THEN 2 WHEN source = 'ACIS' AND value IS NOT NULL THEN 3 ELSE 4 END, ingested_at DESC, source) = 1)
  WHERE NOT (source = 'GHCN' AND obs_date > cutoff AND value IS NULL))"""
_PIVOT = """
pivoted AS (SELECT station_id, obs_date, max(value) FILTER (variable = 'AWND') AS AWND, max(value) FILTER (variable = 'PRCP') AS PRCP, max(value) FILTER (variable = 'SNOW') AS SNOW,
  max(value) FILTER (variable = 'SNWD') AS SNWD, max(value) FILTER (variable = 'TMAX') AS TMAX, max(value) FILTER (variable = 'TMIN') AS TMIN,
  CASE WHEN count(DISTINCT source) > 1 THEN 'GHCN' ELSE min(source) END AS source FROM merged GROUP BY station_id, obs_date)"""
_STATIONS = """
stations AS (SELECT 'USW' || lpad(n_nationkey::VARCHAR, 8, '0') AS ghcn_id, 'STATION ' || n_nationkey || ' INTL AP' AS name, n_name AS city, 25::DOUBLE + n_nationkey AS latitude, -(70::DOUBLE + 2 * n_nationkey) AS longitude,
  n_nationkey % 5 <> 0 AS selected, CASE WHEN n_nationkey % 7 <> 0 THEN (70000 + n_nationkey)::VARCHAR END AS wmo, r_name AS country_name, 'K' || lpad(n_nationkey::VARCHAR, 3, '0') AS icao FROM nation JOIN region ON n_regionkey = r_regionkey),
places AS (SELECT s_suppkey::BIGINT AS geonameid, s_name AS place_name, lower(s_name) AS name_key, 25 + (s_suppkey * 37 % 2500)::DOUBLE / 100::DOUBLE AS latitude, -(70 + (s_suppkey * 91 % 5000)::DOUBLE / 100::DOUBLE) AS longitude,
  floor(s_acctbal * 100)::BIGINT + 100000 AS population FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def _days(table: str, metric: str, span: tuple[str, str], where: str = "", hit: str = "0") -> str:
    extra = f" AND {where}" if where else ""
    return f"d AS (SELECT station_id, obs_date, {metric}::DOUBLE AS value, CASE WHEN {metric} IS NULL THEN NULL WHEN {hit} THEN 1 ELSE 0 END AS hit FROM {table} WHERE obs_date BETWEEN DATE '{span[0]}' AND DATE '{span[1]}'{extra})"


def _w(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


# --- days


def short(s, d, metric, **k):
    return daily.daily_values(ad.obs_short(s, d), metric, *SHORT, **k)


def long(s, d, metric, **k):
    return daily.daily_values(ad.obs_long(s, d), metric, *LONG, **k)


@query("day_stats", _w(_SHORT, _days("obs_short", "TMAX", SHORT)) + "SELECT station_id, round(avg(value), 6) AS mean, median(value) AS median, sum(value) AS sum, max(value) AS max, min(value) AS min, round(stddev(value), 6) AS stddev, count(value) AS n_days FROM d GROUP BY station_id")
def day_stats(s, d):
    return r6(daily.day_stats(short(s, d, "TMAX"), "mean", "median", "sum", "max", "min", "stddev"), "mean", "stddev")


@query("day_count_threshold", _w(_SHORT, _days("obs_short", "TMIN", SHORT, hit="TMIN <= 32")) + "SELECT station_id, count(*) FILTER (hit = 1)::DOUBLE AS count, count(value) AS n_days FROM d GROUP BY station_id")
def day_count_threshold(s, d):
    return daily.day_stats(short(s, d, "TMIN", op="<=", threshold=32.0), "count")


@query("daily_hits", _w(_SHORT, _days("obs_short", "SNOW", SHORT, "month(obs_date) IN (1, 2)", "SNOW >= 0.5")) + "SELECT station_id, obs_date, value, hit FROM d")
def daily_hits(s, d):
    return short(s, d, "SNOW", months=[1, 2], op=">=", threshold=0.5)


def _ranked_sql(lowest: bool = False, limit: int = 3) -> str:
    key = "round(-value, 2)" if lowest else "round(value, 2)"
    return f"""SELECT station_id, obs_date, value, rank::INT AS rank, n > 15 AS rows_truncated FROM (
      SELECT *, count(*) OVER (PARTITION BY station_id) AS n, row_number() OVER (PARTITION BY station_id ORDER BY rank, obs_date) AS i FROM (
        SELECT *, dense_rank() OVER (PARTITION BY station_id ORDER BY {key} DESC NULLS LAST) AS rank FROM d WHERE value IS NOT NULL) WHERE rank <= {limit}) WHERE i <= 15"""


@query("day_top_ranked", _w(_SHORT, _days("obs_short", "PRCP", SHORT)) + _ranked_sql())
def day_top_ranked(s, d):
    return daily.ranked(short(s, d, "PRCP"), ["obs_date"]).select("station_id", "obs_date", "value", "rank", "rows_truncated")


@query("day_bottom_months", _w(_SHORT, _days("obs_short", "TMIN", SHORT, "month(obs_date) IN (12, 1, 2)")) + _ranked_sql(True, 5))
def day_bottom_months(s, d):
    return daily.ranked(short(s, d, "TMIN", months=[12, 1, 2]), ["obs_date"], 5, lowest=True).select("station_id", "obs_date", "value", "rank", "rows_truncated")


@query("day_extreme", _w(_SHORT, _days("obs_short", "TMAX", SHORT)) + """SELECT station_id, obs_date, value, i = 1 AS is_answer FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY obs_date DESC) AS i FROM (
  SELECT *, dense_rank() OVER (PARTITION BY station_id ORDER BY round(value, 2) DESC) AS r FROM d WHERE value IS NOT NULL) WHERE r = 1) WHERE i <= 15""")  # fmt: skip
def day_extreme(s, d):
    return daily.extreme_days(short(s, d, "TMAX"))


@query("matching_days", _w(_SHORT, _days("obs_short", "PRCP", SHORT)) + "SELECT station_id, rank::INT AS rank, obs_date, value FROM (SELECT *, dense_rank() OVER w AS rank, rank() OVER w - 1 AS ahead FROM d WHERE value IS NOT NULL WINDOW w AS (PARTITION BY station_id ORDER BY round(value, 2) DESC)) WHERE ahead < 5")
def matching_days(s, d):
    return daily.matching_days(short(s, d, "PRCP"))


@query("days_observed", _w(_LONG, _days("obs_long", "TMAX", LONG, "month(obs_date) IN (6, 7, 8)")) + "SELECT station_id, count(value) AS observed, (SELECT count(*) FROM range(DATE '1971-01-01', DATE '2021-01-01', INTERVAL 1 DAY) t(x) WHERE month(x) IN (6, 7, 8))::INT AS in_range FROM d GROUP BY station_id")
def days_observed(s, d):
    return an.days_observed(long(s, d, "TMAX", months=[6, 7, 8]), *LONG, [6, 7, 8])


# --- events

_EVENTS = "e AS (SELECT station_id, min(obs_date) AS event_start, max(obs_date) AS event_end, sum(value) AS total, count(*)::DOUBLE AS duration FROM (SELECT *, obs_date - row_number() OVER (PARTITION BY station_id ORDER BY obs_date)::INT AS i FROM d WHERE hit = 1) GROUP BY station_id, i)"
_RAIN = _w(_SHORT, _days("obs_short", "PRCP", SHORT, hit="PRCP >= 0.05"), _EVENTS)


def _rain(s, d):
    return ev.events(short(s, d, "PRCP", op=">=", threshold=0.05))


@query("event_list", _RAIN + "SELECT station_id, event_start, event_end, round(total, 6) AS total, duration FROM e")
def event_list(s, d):
    return r6(_rain(s, d), "total")


@query("event_stats", _RAIN + "SELECT station_id, count(*) AS n_events, round(avg(total), 6) AS mean, round(median(total), 6) AS median, round(sum(total), 6) AS sum, round(max(total), 6) AS max, round(min(total), 6) AS min, round(stddev(total), 6) AS stddev FROM e GROUP BY station_id")
def event_stats(s, d):
    return r6(ev.event_stats(ev.valued(_rain(s, d))), "mean", "median", "sum", "max", "min", "stddev")


@query("event_top_total", _w(_SHORT, _days("obs_short", "PRCP", SHORT, hit="PRCP >= 0.05"), _EVENTS, "x AS (SELECT *, total AS value, event_start AS obs_date FROM e)") + """SELECT station_id, event_start, event_end, round(value, 6) AS value, rank::INT AS rank, n > 15 AS rows_truncated FROM (
  SELECT *, count(*) OVER (PARTITION BY station_id) AS n, row_number() OVER (PARTITION BY station_id ORDER BY rank, event_start) AS i FROM (SELECT *, dense_rank() OVER (PARTITION BY station_id ORDER BY round(value, 2) DESC) AS rank FROM x) WHERE rank <= 3) WHERE i <= 15""")  # fmt: skip
def event_top_total(s, d):
    return r6(daily.ranked(ev.valued(_rain(s, d)), ["event_start"]), "value").select("station_id", "event_start", "event_end", "value", "rank", "rows_truncated")


@query("event_longest", _RAIN + "SELECT station_id, event_start, event_end, round(total, 6) AS total, duration, duration AS value FROM e QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY duration DESC, event_start DESC) = 1")
def event_longest(s, d):
    return r6(ev.picked(ev.valued(_rain(s, d), "duration"), "max"), "total")


@query("event_latest_over", _RAIN + "SELECT station_id, event_start, event_end, round(total, 6) AS total, duration, round(total, 6) AS value FROM e WHERE total > 2 QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY event_start DESC) = 1")
def event_latest_over(s, d):
    return r6(ev.picked(ev.over(ev.valued(_rain(s, d)), ">", 2.0), "latest"), "total", "value")


@query("event_earliest", _RAIN + "SELECT station_id, event_start, event_end, round(total, 6) AS total, duration, round(total, 6) AS value FROM e QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY event_start) = 1")
def event_earliest(s, d):
    return r6(ev.picked(ev.valued(_rain(s, d)), "earliest"), "total", "value")


# --- periods


def _buckets(how: str, unit: str = "year", start: int = 1, months: tuple[int, ...] = ()) -> str:
    value = {"mean": "avg(value)", "sum": "sum(value)", "count": "sum(hit)::DOUBLE", "any": "max(hit)::DOUBLE"}[how]
    if unit == "month":
        return f"b AS (SELECT * FROM (SELECT station_id, year(obs_date)::INT AS bucket_year, month(obs_date)::INT AS bucket_month, {value} AS value, count(value) AS n_days FROM d GROUP BY 1, 2, 3) WHERE value IS NOT NULL AND n_days >= 0.9 * day(last_day(make_date(bucket_year::BIGINT, bucket_month::BIGINT, 1))))"
    year = "year(obs_date)" if start == 1 else f"year((obs_date + INTERVAL {13 - start} MONTH)::DATE)"
    chosen = ", ".join(map(str, months or range(1, 13)))
    expected = f"(SELECT count(*) FROM range(make_date((bucket_year - {int(start > 1)})::BIGINT, {start}, 1), (make_date((bucket_year - {int(start > 1)})::BIGINT, {start}, 1) + INTERVAL 12 MONTH)::DATE, INTERVAL 1 DAY) t(x) WHERE month(x) IN ({chosen}))"
    return f"b AS (SELECT * FROM (SELECT station_id, {year}::INT AS bucket_year, NULL::INT AS bucket_month, {value} AS value, count(value) AS n_days FROM d GROUP BY 1, 2) WHERE value IS NOT NULL AND n_days >= 0.9 * {expected})"


_PSTATS = "SELECT station_id, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(max(value), 6) AS max, round(min(value), 6) AS min, round(stddev(value), 6) AS stddev, count(*) AS n_buckets, min(bucket_year * 100 + coalesce(bucket_month, 0)) AS first_bucket, max(bucket_year * 100 + coalesce(bucket_month, 0)) AS last_bucket FROM b GROUP BY station_id"


def _pstats(found: DataFrame) -> DataFrame:
    return r6(periods.period_stats(found, "mean", "median", "max", "min", "stddev"), "mean", "median", "max", "min", "stddev")


@query("period_month_stats", _w(_SHORT, _days("obs_short", "TMAX", SHORT), _buckets("mean", "month")) + _PSTATS)
def period_month_stats(s, d):
    return _pstats(periods.buckets(short(s, d, "TMAX"), "month", "mean"))


@query("period_year_top", _w(_LONG, _days("obs_long", "PRCP", LONG), _buckets("sum")) + """SELECT station_id, bucket_year, round(value, 6) AS value, n_days, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY rank, bucket_year) AS i FROM (SELECT *, dense_rank() OVER (PARTITION BY station_id ORDER BY round(value, 2) DESC) AS rank FROM b) WHERE rank <= 5) WHERE i <= 15""")  # fmt: skip
def period_year_top(s, d):
    return r6(daily.ranked(periods.buckets(long(s, d, "PRCP"), "year", "sum"), ["bucket_year"], 5), "value").select("station_id", "bucket_year", "value", "n_days", "rank")


@query("period_count_threshold", _w(_SHORT, _days("obs_short", "TMAX", SHORT), _buckets("mean", "month")) + "SELECT station_id, count(*) FILTER (value >= 80)::DOUBLE AS value, count(*) AS n_buckets FROM b GROUP BY station_id")
def period_count_threshold(s, d):
    return periods.period_count(periods.buckets(short(s, d, "TMAX"), "month", "mean"), ">=", 80.0)


@query("period_season_winter", _w(_LONG, _days("obs_long", "TMIN", LONG, "month(obs_date) IN (12, 1, 2)"), _buckets("mean", "year", 12, (12, 1, 2))) + _PSTATS)
def period_season_winter(s, d):
    start, months = periods.season_window("winter")
    return _pstats(periods.buckets(long(s, d, "TMIN", months=months), "year", "mean", start, months))


@query("period_snow_season", _w(_LONG, _days("obs_long", "SNOW", LONG), _buckets("sum", "year", 7)) + _PSTATS)
def period_snow_season(s, d):
    return _pstats(periods.buckets(long(s, d, "SNOW"), "year", "sum", 7))


# --- series


@query("series_month", _w(_SHORT, _days("obs_short", "TMAX", SHORT), _buckets("mean", "month")) + "SELECT station_id, bucket_year, bucket_month, round(round(value, 9), 1) AS value, n_days FROM b")
def series_month(s, d):
    return periods.series(r9(periods.buckets(short(s, d, "TMAX"), "month", "mean")), "TMAX")


def r9(df: DataFrame, *columns: str) -> DataFrame:
    """Drops float noise before a coarser rounding, so that both engines round alike."""
    return df.withColumns({c: F.round(c, 9) for c in columns or ("value",)})


@query("series_year", _w(_LONG, _days("obs_long", "SNOW", LONG, hit="SNOW >= 0.5"), _buckets("count")) + "SELECT station_id, bucket_year, bucket_month, round(value, 2) AS value, n_days FROM b")
def series_year(s, d):
    return periods.series(periods.buckets(long(s, d, "SNOW", op=">=", threshold=0.5), "year", "count"), "SNOW")


_DATES = "f AS (SELECT * FROM (SELECT station_id, year(obs_date)::INT AS year, min(obs_date) FILTER (hit = 1) AS first, max(obs_date) FILTER (hit = 1) AS last, count(value) AS n_days FROM d GROUP BY 1, 2) WHERE n_days >= 0.9 * (make_date(year::BIGINT + 1, 1, 1) - make_date(year::BIGINT, 1, 1)))"


@query("series_first_last_date", _w(_LONG, _days("obs_long", "TMIN", LONG, hit="TMIN <= 32"), _DATES) + "SELECT station_id, year, first, last, n_days FROM f")
def series_first_last_date(s, d):
    return periods.first_last_dates(long(s, d, "TMIN", op="<=", threshold=32.0))


def _across_sql(key: str, how: str, digits: int, source: str = "b") -> str:
    top = 3 if how == "any" else digits
    return f"SELECT station_id, {key}, round(round(avg(value), 9), {top}) AS value, round(round(stddev(value), 9), {digits}) AS stddev, count(*) AS n_years FROM {source} GROUP BY 1, 2"


@query("series_month_of_year", _w(_LONG, _days("obs_long", "TMAX", LONG), _buckets("mean", "month"), "m AS (SELECT station_id, bucket_month AS month, value FROM b)") + "SELECT station_id, month, round(avg(value), 1) AS value, round(stddev(value), 1) AS stddev, count(*) AS n_years FROM m GROUP BY 1, 2")
def series_month_of_year(s, d):
    return periods.month_of_year(long(s, d, "TMAX"), "TMAX", "mean")


@query("series_week_of_year", _w(_LONG, _days("obs_long", "PRCP", LONG), "k AS (SELECT * FROM (SELECT station_id, year(obs_date) AS y, least(52, (dayofyear(obs_date) - 1) // 7 + 1)::INT AS week, sum(value) AS value, count(value) AS n FROM d GROUP BY 1, 2, 3) WHERE value IS NOT NULL AND n >= 6)") + "SELECT station_id, week, round(avg(value), 2) AS value, round(stddev(value), 2) AS stddev, count(*) AS n_years FROM k GROUP BY 1, 2")
def series_week_of_year(s, d):
    return periods.week_of_year(long(s, d, "PRCP"), "PRCP", "sum")


_SEASON = """k AS (SELECT * FROM (SELECT station_id, year((obs_date + INTERVAL 1 MONTH)::DATE) AS y, ((month(obs_date) % 12) // 3 + 1)::INT AS k, avg(value) AS value, count(value) AS n FROM d WHERE year((obs_date + INTERVAL 1 MONTH)::DATE) BETWEEN 1972 AND 2020 GROUP BY 1, 2, 3)
  WHERE value IS NOT NULL AND n >= 0.9 * CASE k WHEN 1 THEN make_date(y, 3, 1) - make_date(y - 1, 12, 1) ELSE (make_date(y, 3 * k - 3, 1) + INTERVAL 3 MONTH)::DATE - make_date(y, 3 * k - 3, 1) END)"""


@query("series_season_of_year", _w(_LONG, _days("obs_long", "TMAX", ("1971-12-01", "2020-12-31")), _SEASON) + "SELECT station_id, ['winter', 'spring', 'summer', 'fall'][k] AS season, round(avg(value), 1) AS value, round(stddev(value), 1) AS stddev, count(*) AS n_years FROM k GROUP BY 1, 2")
def series_season_of_year(s, d):
    days = daily.daily_values(ad.obs_long(s, d), "TMAX", "1971-12-01", "2020-12-31")
    return periods.season_of_year(days, "TMAX", "mean", 1972, 2020)


_DOY = """c AS (SELECT station_id, strftime(obs_date, '%m-%d') AS day, round(round(avg(value), 9), 1) AS value, round(round(stddev(value), 9), 1) AS stddev, count(value) AS n_years, max(value) AS max, min(value) AS min,
  arg_max(year(obs_date), value * 10000 + year(obs_date))::INT AS max_year, arg_min(year(obs_date), value * 10000 - year(obs_date))::INT AS min_year FROM d WHERE value IS NOT NULL GROUP BY 1, 2)"""


@query("series_day_of_year", _w(_LONG, _days("obs_long", "TMAX", LONG), _DOY) + "SELECT station_id, day, value, stddev, n_years, max, max_year, min, min_year FROM c")
def series_day_of_year(s, d):
    return periods.day_of_year(long(s, d, "TMAX"), "TMAX")


@query("series_histogram", _w(_LONG, _days("obs_long", "TMAX", LONG)) + "SELECT station_id, round(value, 0) AS value, count(*) AS count FROM d WHERE value IS NOT NULL GROUP BY 1, 2")
def series_histogram(s, d):
    return periods.histogram(long(s, d, "TMAX"), "TMAX")


@query("series_daily", _w(_SHORT, _days("obs_short", "TAVG", ("1998-01-01", "1998-12-31"))) + "SELECT station_id, obs_date, round(value, 1) AS value FROM d WHERE value IS NOT NULL")
def series_daily(s, d):
    return periods.daily_series(daily.daily_values(ad.obs_short(s, d), "TAVG", "1998-01-01", "1998-12-31"), "TAVG")


@query("odds_month", _w(_LONG, _days("obs_long", "SNOW", LONG, hit="SNOW >= 5.5"), _buckets("any", "month"), "m AS (SELECT station_id, bucket_month AS month, value FROM b)") + "SELECT station_id, month, round(avg(value), 3) AS value, round(stddev(value), 2) AS stddev, count(*) AS n_years FROM m GROUP BY 1, 2")
def odds_month(s, d):
    return periods.month_of_year(long(s, d, "SNOW", op=">=", threshold=5.5), "SNOW", "any")


@query("count_month_of_year", _w(_LONG, _days("obs_long", "TMIN", LONG, hit="TMIN <= 28"), _buckets("count", "month"), "m AS (SELECT station_id, bucket_month AS month, value FROM b)") + "SELECT station_id, month, round(avg(value), 1) AS value, round(stddev(value), 1) AS stddev, count(*) AS n_years FROM m GROUP BY 1, 2")
def count_month_of_year(s, d):
    return periods.month_of_year(long(s, d, "TMIN", op="<=", threshold=28.0), "TMIN", "count")


@query("odds_day", _w(_LONG, _days("obs_long", "PRCP", LONG, hit="PRCP >= 0.05")) + "SELECT station_id, strftime(obs_date, '%m-%d') AS day, round(avg(hit), 3) AS value, count(value) AS n_years FROM d WHERE value IS NOT NULL GROUP BY 1, 2")
def odds_day(s, d):
    return periods.day_of_year(long(s, d, "PRCP", op=">=", threshold=0.05), "PRCP", "any").select("station_id", "day", "value", "n_years")


# --- records


def _record_sql(high: bool, start: str) -> str:
    best, cmp, pick = ("max", ">=", "DESC") if high else ("min", "<=", "ASC")
    return f"""x AS (SELECT *, strftime(obs_date, '%m-%d') AS md FROM d),
y AS (SELECT x.*, {best}(value) OVER w AS previous_record, count(value) OVER w AS prior_years, {best}(value) OVER (PARTITION BY station_id, md) AS whole FROM x WINDOW w AS (PARTITION BY station_id, md ORDER BY obs_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT y.*, (SELECT year(q.obs_date) FROM x q WHERE q.station_id = y.station_id AND q.md = y.md AND q.obs_date < y.obs_date AND q.value IS NOT NULL ORDER BY q.value {pick}, q.obs_date DESC LIMIT 1)::INT AS previous_record_year
  FROM y WHERE obs_date >= DATE '{start}' AND value IS NOT NULL AND (previous_record IS NULL OR value {cmp} previous_record) AND (prior_years >= 30 OR value {cmp} whole))
"""


@query("records_high", _w(_LONG, _days("obs_long", "TMAX", ("1800-01-01", TODAY)), _record_sql(True, "1990-01-01")) + "SELECT station_id, obs_date, value, previous_record, previous_record_year, coalesce(value = previous_record, FALSE) AS tied FROM z")
def records_high(s, d):
    return records.record_days(daily.daily_values(ad.obs_long(s, d), "TMAX", "1800-01-01", TODAY), "1990-01-01", TODAY)


@query("records_low", _w(_LONG, _days("obs_long", "TMIN", ("1800-01-01", TODAY)), _record_sql(False, "2000-01-01")) + "SELECT station_id, obs_date, value, previous_record, previous_record_year, coalesce(value = previous_record, FALSE) AS tied FROM z")
def records_low(s, d):
    return records.record_days(daily.daily_values(ad.obs_long(s, d), "TMIN", "1800-01-01", TODAY), "2000-01-01", TODAY, high=False)


@query("records_count", _w(_LONG, _days("obs_long", "TMAX", ("1800-01-01", TODAY)), _record_sql(True, "1990-01-01")) + "SELECT station_id, count(*)::DOUBLE AS value, count(*) FILTER (value = previous_record) AS n_tied, count(*) > 15 AS rows_truncated FROM z GROUP BY station_id")
def records_count(s, d):
    return records.record_counts(records_high(s, d))


@query("records_first_rows", _w(_LONG, _days("obs_long", "TMAX", ("1800-01-01", TODAY)), _record_sql(True, "1990-01-01")) + "SELECT station_id, obs_date, value FROM z QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY obs_date) <= 15")
def records_first_rows(s, d):
    return records.first_records(records_high(s, d)).select("station_id", "obs_date", "value")


# --- points

_N = "n AS (SELECT station_id, day, value AS normal, stddev AS sd FROM c WHERE n_years >= 0.8 * 30 OR day = '02-29')"
_P = "p AS (SELECT station_id, obs_date, strftime(obs_date, '%m-%d') AS day, TMAX::DOUBLE AS value FROM obs_long WHERE obs_date BETWEEN DATE '2019-01-01' AND DATE '2019-12-31' AND TMAX IS NOT NULL)"


def _climatology(s, d, metric="TMAX"):
    days = daily.daily_values(ad.obs_long(s, d), metric, *NORMAL)
    return periods.day_of_year(days, metric)


@query("normals_overlay", _w(_LONG, _days("obs_long", "TMAX", NORMAL), _DOY, _N, _P) + "SELECT station_id, obs_date, day, value, normal, round(normal - sd, 4) AS lower, round(normal + sd, 4) AS upper, round(value - normal, 4) AS anomaly FROM p LEFT JOIN n USING (station_id, day)")
def normals_overlay(s, d):
    points = periods.daily_series(daily.daily_values(ad.obs_long(s, d), "TMAX", "2019-01-01", "2019-12-31"), "TMAX").withColumn("day", F.date_format("obs_date", "MM-dd"))
    return an.overlay(points.select("station_id", "obs_date", "day", "value"), an.day_normals(_climatology(s, d), 30), ["station_id", "day"])


_MN = "n AS (SELECT station_id, bucket_month, round(avg(value), 1) AS normal, round(stddev(value), 1) AS sd FROM b WHERE bucket_year BETWEEN 1991 AND 2020 GROUP BY 1, 2 HAVING count(*) >= 0.8 * 30)"


@query("anomaly_month", _w(_LONG, _days("obs_long", "TMAX", LONG), _buckets("mean", "month"), _MN) + "SELECT station_id, bucket_year, bucket_month, round(value, 1) AS value, n_days, normal, round(normal - sd, 4) AS lower, round(normal + sd, 4) AS upper, round(round(value, 1) - normal, 4) AS anomaly FROM b LEFT JOIN n USING (station_id, bucket_month)")
def anomaly_month(s, d):
    points = periods.series(periods.buckets(long(s, d, "TMAX"), "month", "mean"), "TMAX")
    days = daily.daily_values(ad.obs_long(s, d), "TMAX", *NORMAL)
    normals = an.month_normals(periods.month_of_year(days, "TMAX", "mean"), 30).withColumnRenamed("month", "bucket_month")
    return an.overlay(points, normals, ["station_id", "bucket_month"])


@query("year_normals", _w(_LONG, _days("obs_long", "PRCP", NORMAL), _buckets("sum")) + "SELECT station_id, round(avg(value), 6) AS normal, round(coalesce(stddev(value), 0), 6) AS normal_stddev, count(*) AS n_years FROM b GROUP BY station_id")
def year_normals(s, d):
    return r6(an.year_normals(periods.buckets(daily.daily_values(ad.obs_long(s, d), "PRCP", *NORMAL), "year", "sum")), "normal", "normal_stddev")


@query("smoothed_normal", _w(_LONG, _days("obs_long", "TMAX", NORMAL), _DOY, "q AS (SELECT station_id, day, value, row_number() OVER (PARTITION BY station_id ORDER BY day) AS i, count(*) OVER (PARTITION BY station_id) AS n FROM c)") + "SELECT a.station_id, a.day, round(avg(b.value), 4) AS smoothed FROM q a JOIN q b ON a.station_id = b.station_id AND least(abs(a.i - b.i), a.n - abs(a.i - b.i)) <= 7 GROUP BY 1, 2")
def smoothed_normal(s, d):
    return an.smoothed(_climatology(s, d))


@query("trend_year", _w(_LONG, _days("obs_long", "TMAX", LONG), _buckets("mean"), "p AS (SELECT station_id, bucket_year AS x, round(round(value, 9), 1) AS value FROM b)") + "SELECT station_id, round(regr_slope(value, x) * 10, 2) AS per_decade, round(regr_intercept(value, x), 4) AS intercept, count(*) AS n FROM p GROUP BY station_id HAVING count(*) >= 3")
def trend_year(s, d):
    return an.trend(periods.series(r9(periods.buckets(long(s, d, "TMAX"), "year", "mean")), "TMAX"), "bucket_year")


_CUM = "t AS (SELECT station_id, year((obs_date + INTERVAL 6 MONTH)::DATE)::INT AS season, obs_date, obs_date - make_date(year((obs_date + INTERVAL 6 MONTH)::DATE) - 1, 7, 1) AS day, value AS daily FROM d WHERE value IS NOT NULL)"


@query("cumulative_season", _w(_LONG, _days("obs_long", "SNOW", ("2015-07-01", "2020-06-30")), _CUM) + "SELECT station_id, season, obs_date, day::INT AS day, daily, round(sum(daily) OVER (PARTITION BY station_id, season ORDER BY obs_date), 2) AS total FROM t")
def cumulative_season(s, d):
    return an.running_total(daily.daily_values(ad.obs_long(s, d), "SNOW", "2015-07-01", "2020-06-30"))


@query("cumulative_aligned", _w(_LONG, _days("obs_long", "SNOW", ("2017-07-01", "2020-06-30")), _CUM, "u AS (SELECT *, round(sum(daily) OVER (PARTITION BY station_id, season ORDER BY obs_date), 2) AS total FROM t)") + "SELECT station_id, day::INT AS day, max(total) FILTER (season = 2018) AS total_2018, max(total) FILTER (season = 2019) AS total_2019, max(total) FILTER (season = 2020) AS total_2020 FROM u GROUP BY 1, 2")
def cumulative_aligned(s, d):
    return an.aligned_totals(an.running_total(daily.daily_values(ad.obs_long(s, d), "SNOW", "2017-07-01", "2020-06-30")), [2018, 2019, 2020])


@query("station_difference", _w(_SHORT, _days("obs_short", "TMAX", SHORT)) + "SELECT a.obs_date, a.value AS a, b.value AS b, round(a.value - b.value, 4) AS difference FROM d a JOIN d b USING (obs_date) WHERE a.station_id = 'RA' AND b.station_id = 'RR' AND a.value IS NOT NULL AND b.value IS NOT NULL")
def station_difference(s, d):
    days = periods.daily_series(short(s, d, "TMAX"), "TMAX")
    return an.difference(days.filter("station_id = 'RA'"), days.filter("station_id = 'RR'"), ["obs_date"])


_GROW = """s1 AS (SELECT station_id, year(obs_date)::INT AS year, max(obs_date) FILTER (TMIN <= 32) AS spring, count(TMIN) AS n FROM obs_long WHERE month(obs_date) <= 6 GROUP BY 1, 2),
f1 AS (SELECT station_id, year(obs_date)::INT AS year, min(obs_date) FILTER (TMIN <= 32) AS fall, count(TMIN) AS n FROM obs_long WHERE month(obs_date) > 6 GROUP BY 1, 2)"""


@query("growing_season", _w(_LONG, _GROW) + "SELECT station_id, year, spring, fall, (fall - spring)::INT AS days FROM s1 JOIN f1 USING (station_id, year) WHERE spring IS NOT NULL AND fall IS NOT NULL AND s1.n >= 0.9 * (make_date(year::BIGINT, 7, 1) - make_date(year::BIGINT, 1, 1)) AND f1.n >= 0.9 * 184")
def growing_season(s, d):
    first, last = list(range(1, 7)), list(range(7, 13))
    spring = periods.first_last_dates(long(s, d, "TMIN", months=first, op="<=", threshold=32.0), 1, first)
    fall = periods.first_last_dates(long(s, d, "TMIN", months=last, op="<=", threshold=32.0), 1, last)
    return an.growing_season(spring, fall)


_HIST = "h AS (SELECT station_id, round(value, 0) AS value, count(*) AS count FROM d WHERE value IS NOT NULL GROUP BY 1, 2)"


@query("hist_percentiles", _w(_LONG, _days("obs_long", "TMAX", LONG), _HIST) + "SELECT station_id, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.1), 4) AS p10, round(quantile_cont(value, 0.9), 4) AS p90, (SELECT value FROM h WHERE h.station_id = d.station_id ORDER BY count DESC, value LIMIT 1) AS mode, count(*) AS n FROM d WHERE value IS NOT NULL GROUP BY station_id")
def hist_percentiles(s, d):
    return an.histogram_stats(periods.histogram(long(s, d, "TMAX"), "TMAX"))


@query("hist_bins", _w(_LONG, _days("obs_long", "TMAX", LONG), _HIST) + "SELECT station_id, bin, count, round(100 * count / sum(count) OVER (PARTITION BY station_id), 4) AS pct FROM (SELECT station_id, floor(value / 5) * 5 AS bin, sum(count)::BIGINT AS count FROM h GROUP BY 1, 2)")
def hist_bins(s, d):
    return an.bins(periods.histogram(long(s, d, "TMAX"), "TMAX"), 5.0)


@query("date_summary", _w(_LONG, _days("obs_long", "TMIN", LONG, hit="TMIN <= 32"), _DATES, "k AS (SELECT *, (first - make_date(year::BIGINT, 1, 1))::INT AS x FROM f)") + """SELECT station_id, list_sort(list(x) FILTER (x IS NOT NULL))[count(x) // 2 + 1] AS typical_day, min(x) AS earliest_day, arg_min(year, x * 10000 - year) AS earliest_year, max(x) AS latest_day,
  arg_max(year, x * 10000 + year) AS latest_year, count(x) AS years_counted, count(*) FILTER (x IS NULL) AS years_without FROM k GROUP BY station_id HAVING count(x) > 0""")  # fmt: skip
def date_summary(s, d):
    return an.date_summary(series_first_last_date(s, d), "first")


_CG = """hi AS (SELECT station_id, strftime(obs_date, '%m-%d') AS day, max(TMAX) AS record_high, min(TMIN) AS record_low FROM obs_long WHERE obs_date < DATE '2020-01-01' GROUP BY 1, 2),
nh AS (SELECT station_id, strftime(obs_date, '%m-%d') AS day, round(round(avg(TMAX), 9), 1) AS normal_high FROM obs_long WHERE obs_date BETWEEN DATE '1991-01-01' AND DATE '2020-12-31' AND TMAX IS NOT NULL GROUP BY 1, 2 HAVING count(TMAX) >= 24 OR day = '02-29'),
nl AS (SELECT station_id, strftime(obs_date, '%m-%d') AS day, round(round(avg(TMIN), 9), 1) AS normal_low FROM obs_long WHERE obs_date BETWEEN DATE '1991-01-01' AND DATE '2020-12-31' AND TMIN IS NOT NULL GROUP BY 1, 2 HAVING count(TMIN) >= 24 OR day = '02-29'),
o AS (SELECT station_id, obs_date, strftime(obs_date, '%m-%d') AS day, TMAX AS tmax, TMIN AS tmin FROM obs_long WHERE obs_date BETWEEN DATE '2020-01-01' AND DATE '2020-12-31' AND (TMAX IS NOT NULL OR TMIN IS NOT NULL))"""


@query("climate_daily", _w(_LONG, _CG) + "SELECT station_id, day, obs_date, tmax, tmin, normal_high, normal_low, record_high, record_low, CASE WHEN tmax >= record_high THEN 'high' WHEN tmin <= record_low THEN 'low' END AS record_set FROM o LEFT JOIN nh USING (station_id, day) LEFT JOIN nl USING (station_id, day) LEFT JOIN hi USING (station_id, day)")
def climate_daily(s, d):
    obs = ad.obs_long(s, d)
    year = lambda m: periods.daily_series(daily.daily_values(obs, m, "2020-01-01", "2020-12-31"), m)
    bars = obs.filter(F.col("obs_date") < F.to_date(F.lit("2020-01-01"))).groupBy("station_id", F.date_format("obs_date", "MM-dd").alias("day")).agg(F.max("TMAX").alias("record_high"), F.min("TMIN").alias("record_low"))
    return an.climate_graph(year("TMAX"), year("TMIN"), an.day_normals(_climatology(s, d), 30), an.day_normals(_climatology(s, d, "TMIN"), 30), bars)


@query("climograph", _w(_LONG, *[x.replace("d AS", f"d{k} AS", 1).replace("FROM d ", f"FROM d{k} ").replace("b AS", f"b{k} AS", 1) for k, (m, how) in enumerate((("TMAX", "mean"), ("TMIN", "mean"), ("PRCP", "sum"))) for x in (_days("obs_long", m, LONG), _buckets(how, "month"))]) + "SELECT station_id, month, tmax, tmin, prcp FROM (SELECT station_id, bucket_month AS month, round(avg(value), 1) AS tmax FROM b0 GROUP BY 1, 2) FULL JOIN (SELECT station_id, bucket_month AS month, round(avg(value), 1) AS tmin FROM b1 GROUP BY 1, 2) USING (station_id, month) FULL JOIN (SELECT station_id, bucket_month AS month, round(avg(value) + 1e-9, 2) AS prcp FROM b2 GROUP BY 1, 2) USING (station_id, month)")
def climograph(s, d):
    part = lambda m, how: periods.month_of_year(long(s, d, m), m, how).select("station_id", "month", F.col("value").alias(m.lower()))
    return part("TMAX", "mean").join(part("TMIN", "mean"), ["station_id", "month"], "full_outer").join(part("PRCP", "sum"), ["station_id", "month"], "full_outer")


# --- parsers


@query("raw_parse_dly", _w(_SHORT) + "SELECT station_id, obs_date, 'TMAX' AS variable, CASE WHEN TMAX IS NOT NULL THEN TMAX * 10 END::DOUBLE AS value, NULL::VARCHAR AS mflag, CASE WHEN day(obs_date) % 10 = 0 THEN 'X' END AS qflag, 'S' AS sflag FROM obs_short")
def raw_parse_dly(s, d):
    """Observations written as month lines and parsed back."""
    return parse.daily_lines(month_lines(s, d).select("value")).withColumn("station_id", F.trim("station_id"))


def month_lines(s, d):
    """(station_id, y, m, value): the daily archive's lines of one variable."""
    cell = F.format_string("%5d %s%s", F.coalesce(F.col("TMAX") * 10, F.lit(-9999.0)).cast("int"), F.when(F.day("obs_date") % 10 == 0, "X").otherwise(" "), F.lit("S"))
    months = ad.obs_short(s, d).groupBy("station_id", F.year("obs_date").alias("y"), F.month("obs_date").alias("m")).agg(F.map_from_entries(F.collect_list(F.struct(F.day("obs_date"), cell))).alias("cells"))
    blocks = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(31)), lambda k: F.coalesce(F.try_element_at("cells", k), F.lit("    -   "))))
    line = F.concat(F.rpad("station_id", 11, " "), F.format_string("%04d%02d", "y", "m"), F.lit("TMAX"), blocks)
    return months.select("station_id", "y", "m", line.alias("value"))


@query("raw_parse_acis", _w(_SHORT) + """SELECT station_id, obs_date, variable, value FROM (SELECT station_id, obs_date, unnest(['maxt', 'mint', 'pcpn', 'snow', 'snwd']) AS variable,
  unnest([coalesce(TMAX::INT::VARCHAR, 'M'), coalesce(TMIN::INT::VARCHAR, 'M'), CASE WHEN PRCP > 0 THEN 'T' ELSE 'M' END, 'M', 'M']) AS value, TMAX IS NULL AND TMIN IS NULL AND NOT coalesce(PRCP > 0, FALSE) AS none FROM obs_short) WHERE NOT none""")  # fmt: skip
def raw_parse_acis(s, d):
    """Observations written as JSON answers and parsed back."""
    text = lambda c: F.coalesce(F.col(c).cast("int").cast("string"), F.lit("M"))
    row = F.array(F.col("obs_date").cast("string"), text("TMAX"), text("TMIN"), F.when(F.col("PRCP") > 0, "T").otherwise("M"), F.lit("M"), F.lit("M"))
    return parse.api_payloads(ad.obs_short(s, d).select("station_id", F.to_json(F.struct(F.array(row).alias("data"))).alias("payload")))


@query("parse_station_list", _w(_STATIONS) + "SELECT ghcn_id AS station_id, round(latitude, 4) AS latitude, round(longitude, 4) AS longitude, 10.0::DOUBLE AS elevation, '' AS state, name, NULL::VARCHAR AS gsn, 'HCN' AS hcn_crn, wmo FROM stations")
def parse_station_list(s, d):
    st = ad.stations(s, d)
    line = F.concat("ghcn_id", F.lit(" "), F.format_string("%8.4f", "latitude"), F.lit(" "), F.format_string("%9.4f", "longitude"), F.lit(" "), F.lit("  10.0"), F.lit("    "), F.rpad("name", 30, " "), F.lit("    "), F.lit(" HCN"), F.lit(" "), F.rpad(F.coalesce("wmo", F.lit("")), 5, " "))
    return parse.station_lines(st.select(line.alias("value"))).drop("raw_line")


_HIST_LINES = "SELECT lpad(n_nationkey::VARCHAR, 8, '0') AS ncdc, '19500101' AS beg_dt, (20000101 + n_nationkey)::VARCHAR AS end_dt, 'K' || lpad(n_nationkey::VARCHAR, 3, '0') AS icao, NULL::VARCHAR AS faa, CASE WHEN n_nationkey % 7 <> 0 THEN (70000 + n_nationkey)::VARCHAR END AS wmo, 'USW' || lpad((n_nationkey // 2)::VARCHAR, 8, '0') AS ghcnd, 'STATION ' || n_nationkey || ' INTL AP' AS station_name, 'US' AS country_code, 'UNITED STATES' AS country_name FROM nation"


def _history_lines(s, d):
    n = F.col("n_nationkey")
    gap = lambda k: F.lit(" " * k)
    wmo = F.rpad(F.when(n % 7 != 0, (70000 + n).cast("string")).otherwise(""), 5, " ")
    name = F.rpad(F.format_string("STATION %d INTL AP", n.cast("long")), 100, " ")
    line = F.concat(F.lpad(n.cast("string"), 8, "0"), F.lit(" 19500101 "), (20000101 + n).cast("string"), gap(14), F.lit("K"), F.lpad(n.cast("string"), 3, "0"), gap(1), gap(5), gap(7), wmo, gap(12), F.lit("USW"), F.lpad(F.floor(n / 2).cast("string"), 8, "0"), gap(1), name, gap(1), F.lit("US"), gap(1), F.rpad(F.lit("UNITED STATES"), 35, " "))
    return ad.table(s, d, "nation").select(line.alias("value"))


@query("parse_history", _HIST_LINES)
def parse_history(s, d):
    return parse.history_lines(_history_lines(s, d))


@query("station_filter_latest", f"SELECT ghcnd AS station_id, icao, faa, wmo, country_code, country_name, station_name, end_dt FROM ({_HIST_LINES}) QUALIFY row_number() OVER (PARTITION BY ghcnd ORDER BY end_dt DESC, station_name) = 1")
def station_filter_latest(s, d):
    return stations.latest_history(parse.history_lines(_history_lines(s, d)))


@query("parse_gazetteer", "SELECT s_suppkey::BIGINT AS geonameid, s_name AS place_name, 'C' || (s_nationkey % 5) AS country_code, r_name AS country_name, s_nationkey::VARCHAR AS admin1_code, n_name AS admin1_name, 25 + (s_suppkey % 50) AS latitude, -(70 + s_suppkey % 50) AS longitude, s_suppkey::BIGINT * 1000 AS population FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON r_regionkey = s_nationkey % 5".replace("25 + (s_suppkey % 50) AS", "(25 + (s_suppkey % 50))::DOUBLE AS").replace("-(70 + s_suppkey % 50) AS", "(-(70 + s_suppkey % 50))::DOUBLE AS"))
def parse_gazetteer(s, d):
    k, nat = F.col("s_suppkey"), F.col("s_nationkey")
    tab = lambda *c: F.concat_ws("\t", *[x.cast("string") for x in c])
    none = F.lit("")
    country = F.concat(F.lit("C"), (nat % 5).cast("string"))
    city = tab(k, none, F.col("s_name"), none, 25 + k % 50, -(70 + k % 50), none, none, country, none, nat, none, none, none, k * 1000)
    cities = ad.table(s, d, "supplier").select(city.alias("raw_line"), F.lit("cities.txt").alias("source_file"))
    key = F.col("n_nationkey")
    admin = ad.table(s, d, "nation").select(tab(F.concat(F.lit("C"), (key % 5).cast("string"), F.lit("."), key.cast("string")), none, F.col("n_name")).alias("raw_line"), F.lit("admin1.txt").alias("source_file"))
    rk = F.col("r_regionkey")
    countries = ad.table(s, d, "region").select(tab(F.concat(F.lit("C"), rk.cast("string")), none, none, none, F.col("r_name")).alias("raw_line"), F.lit("country.txt").alias("source_file"))
    note = s.createDataFrame([("# a comment", "country.txt")], "raw_line string, source_file string")
    return parse.gazetteer(cities.unionByName(admin).unionByName(countries).unionByName(note))


@query("parse_countries", "SELECT substr(n_name, 1, 2) AS code, trim(substr(n_name || ' X', 4)) AS country_name FROM nation")
def parse_countries(s, d):
    return parse.country_lines(ad.table(s, d, "nation").select(F.concat("n_name", F.lit(" X")).alias("value")))


# --- from raw to wide


@query("convert_ghcn", _w(_RAW, _CONV) + "SELECT * FROM ghcn_conv")
def convert_ghcn(s, d):
    return elt.convert(elt.blank_flagged(ad.raw_ghcn(s, d), ad.allowlist(s, d)))


@query("map_acis", _w(_RAW, _CONV) + "SELECT * FROM acis_conv")
def map_acis(s, d):
    return elt.map_codes(ad.raw_acis(s, d))


def _merged(s, d):
    clean = convert_ghcn(s, d)
    return elt.by_precedence(elt.union_sources(clean, map_acis(s, d)), elt.cutoff(clean))


@query("merge_precedence", _w(_RAW, _CONV) + "SELECT * FROM merged")
def merge_precedence(s, d):
    return _merged(s, d)


@query("pivot_obs", _w(_RAW, _CONV, _PIVOT) + "SELECT * FROM pivoted")
def pivot_obs(s, d):
    return elt.pivoted(_merged(s, d))


@query("derive_vars", _w(_RAW, _CONV, _PIVOT, "w AS (SELECT * FROM pivoted)") + _DERIVED)
def derive_vars(s, d):
    return elt.observations(ad.raw_ghcn(s, d), ad.raw_acis(s, d), ad.allowlist(s, d))


@query("incremental_cutoff", _w(_RAW, _CONV) + "SELECT station_id, obs_date, variable, value, ingested_at FROM ghcn_conv WHERE ingested_at > (SELECT max(ingested_at) FROM ghcn_conv WHERE obs_date <= DATE '2024-01-15')")
def incremental_cutoff(s, d):
    conv = convert_ghcn(s, d)
    return elt.newer(conv, conv.filter(F.col("obs_date") <= F.to_date(F.lit("2024-01-15")))).select("station_id", "obs_date", "variable", "value", "ingested_at")


@query("upsert_keep_existing", _w(_RAW, _CONV, "t AS (SELECT station_id, obs_date, variable, value FROM ghcn_conv WHERE day(obs_date) <= 20)", "s AS (SELECT station_id, obs_date, variable, CASE WHEN day(obs_date) % 2 = 0 THEN value + 1 END AS value FROM ghcn_conv WHERE day(obs_date) >= 10)") + "SELECT station_id, obs_date, variable, CASE WHEN t.station_id IS NULL OR (s.station_id IS NOT NULL AND (s.value IS NOT NULL OR t.value IS NULL)) THEN s.value ELSE t.value END AS value FROM (SELECT station_id, obs_date, variable FROM t UNION SELECT station_id, obs_date, variable FROM s) LEFT JOIN t USING (station_id, obs_date, variable) LEFT JOIN s USING (station_id, obs_date, variable)")
def upsert_keep_existing(s, d):
    rows = convert_ghcn(s, d).select("station_id", "obs_date", "variable", "value")
    day = F.day("obs_date")
    return elt.keep_existing_values(rows.filter(day <= 20), rows.filter(day >= 10).withColumn("value", F.when(day % 2 == 0, F.col("value") + 1)))


@query("upsert_all", _w(_RAW, _CONV, "t AS (SELECT station_id, obs_date, variable, value FROM ghcn_conv WHERE day(obs_date) <= 20)", "s AS (SELECT station_id, obs_date, variable, value * 2 AS value FROM ghcn_conv WHERE day(obs_date) >= 10)") + "SELECT * FROM s UNION ALL SELECT * FROM t ANTI JOIN s USING (station_id, obs_date, variable)")
def upsert_all(s, d):
    rows = convert_ghcn(s, d).select("station_id", "obs_date", "variable", "value")
    return elt.upsert(rows.filter(F.day("obs_date") <= 20), rows.filter(F.day("obs_date") >= 10).withColumn("value", F.col("value") * 2), elt.KEY)


_ACIS_FIRST = "t AS (SELECT * FROM both_sources WHERE source = 'ACIS'), s AS (SELECT * FROM both_sources WHERE source = 'GHCN')"
_MERGE_SQL = "SELECT station_id, obs_date, variable, " + ", ".join(f"CASE WHEN t.source IS NULL OR (s.source IS NOT NULL AND (s.value IS NOT NULL OR s.qflag IS NOT NULL)) THEN s.{c} ELSE t.{c} END AS {c}" for c in ("value", "mflag", "qflag", "sflag", "ingested_at", "source")) + " FROM (SELECT station_id, obs_date, variable FROM t UNION SELECT station_id, obs_date, variable FROM s) LEFT JOIN t USING (station_id, obs_date, variable) LEFT JOIN s USING (station_id, obs_date, variable)"


@query("merge_conditional", _w(_RAW, _CONV, _ACIS_FIRST) + _MERGE_SQL)
def merge_conditional(s, d):
    """API rows stored first, the archive merged in."""
    both = elt.union_sources(convert_ghcn(s, d), map_acis(s, d))
    return elt.merge_into(both.filter("source = 'ACIS'"), both.filter("source = 'GHCN'"))


@query("source_watermarks", _w(_RAW, _CONV) + "SELECT source, max(ingested_at) AS newest, count(*) AS n FROM merged GROUP BY source")
def source_watermarks(s, d):
    return _merged(s, d).groupBy("source").agg(F.max("ingested_at").alias("newest"), F.count("*").alias("n"))


_NOQC = _CONV.replace("CASE WHEN g.qflag IS NOT NULL AND a.station_id IS NULL THEN NULL ELSE g.value END AS v", "g.value AS v")


def _unchecked(s, d):
    clean = elt.convert(ad.raw_ghcn(s, d))
    return elt.by_precedence(elt.union_sources(clean, map_acis(s, d)), elt.cutoff(clean))


@query("qc_cleanup", _w(_RAW, _NOQC) + "SELECT m.* REPLACE (CASE WHEN m.source = 'GHCN' AND m.qflag IS NOT NULL AND a.station_id IS NULL THEN NULL ELSE m.value END AS value) FROM merged m LEFT JOIN allowed a USING (station_id, obs_date, variable)")
def qc_cleanup(s, d):
    return elt.qc_cleanup(_unchecked(s, d), ad.allowlist(s, d))


_BLANK = "bad AS (SELECT m.station_id, m.obs_date, m.variable FROM merged m LEFT JOIN allowed a USING (station_id, obs_date, variable) WHERE m.source = 'GHCN' AND m.qflag IS NOT NULL AND (a.station_id IS NULL OR m.value IS NULL))"


@query("qc_to_wide", _w(_RAW, _NOQC, _PIVOT, _BLANK, "w AS (SELECT p.station_id, p.obs_date, " + ", ".join(f"CASE WHEN EXISTS (SELECT 1 FROM bad WHERE bad.station_id = p.station_id AND bad.obs_date = p.obs_date AND bad.variable = '{v}') THEN NULL ELSE p.{v} END AS {v}" for v in ("AWND", "PRCP", "SNOW", "SNWD", "TMAX", "TMIN")) + ", p.source FROM pivoted p)") + _DERIVED)
def qc_to_wide(s, d):
    merged = work.kept(_unchecked(s, d))
    return elt.qc_to_wide(elt.derived(elt.pivoted(merged)), elt.qc_cleanup(merged, ad.allowlist(s, d)))


@query("revision_sync", _w(_RAW, _CONV) + "SELECT m.* REPLACE (CASE WHEN m.source = 'GHCN' AND day(m.obs_date) % 3 = 0 AND c.value IS NOT NULL THEN c.value + 1 ELSE m.value END AS value) FROM merged m LEFT JOIN ghcn_conv c USING (station_id, obs_date, variable)")
def revision_sync(s, d):
    changed = F.when((F.day("obs_date") % 3 == 0) & F.col("value").isNotNull(), F.col("value") + 1).otherwise(F.col("value"))
    clean, merged = elt.nightly(ad.raw_ghcn(s, d), ad.raw_acis(s, d), ad.allowlist(s, d), work.kept, keep_merged=False)
    return elt.revise(merged, clean.withColumn("value", changed))


_REV = "m2 AS (SELECT * REPLACE (CASE WHEN source = 'GHCN' AND day(obs_date) % 3 = 0 THEN value + 1 ELSE value END AS value) FROM merged)"


@query("revision_wide", _w(_RAW, _CONV, _REV, _PIVOT.replace("FROM merged", "FROM m2"), "w AS (SELECT * EXCLUDE (source) FROM pivoted)") + _DERIVED)
def revision_wide(s, d):
    _, merged = elt.nightly(ad.raw_ghcn(s, d), ad.raw_acis(s, d), ad.allowlist(s, d), work.kept)
    wide = elt.derived(elt.pivoted(merged).drop("source"))
    revised = merged.withColumn("value", F.when((F.col("source") == "GHCN") & (F.day("obs_date") % 3 == 0), F.col("value") + 1).otherwise(F.col("value")))
    return elt.revise_wide(wide, revised)


_PARTS = "c AS (SELECT station_id, obs_date, variable, value FROM ghcn_conv WHERE station_id IN ('U0', 'U1')), cur AS (SELECT 'X' AS station_id, obs_date, variable, min(value) AS value FROM c WHERE station_id = 'U0' GROUP BY 2, 3), old AS (SELECT 'X' AS station_id, obs_date, variable, value, priority FROM (SELECT *, CASE station_id WHEN 'U1' THEN 1 WHEN 'U2' THEN 2 END AS priority FROM ghcn_conv WHERE station_id IN ('U1', 'U2')))"


def _current_and_old(s, d):
    conv = convert_ghcn(s, d).select("station_id", "obs_date", "variable", "value")
    x = lambda st: conv.filter(F.col("station_id") == st).withColumn("station_id", F.lit("X"))
    return x("U0"), x("U1").withColumn("priority", F.lit(1)).unionByName(x("U2").withColumn("priority", F.lit(2)))


@query("history_fill", _w(_RAW, _CONV, _PARTS) + "SELECT station_id, obs_date, variable, value, priority FROM (SELECT * FROM old QUALIFY row_number() OVER (PARTITION BY obs_date, variable ORDER BY priority) = 1) o ANTI JOIN cur USING (obs_date, variable)")
def history_fill(s, d):
    return elt.history_fill(*_current_and_old(s, d)).select("station_id", "obs_date", "variable", "value", "priority")


@query("overlap_check", _w(_RAW, _CONV, _PARTS) + "SELECT variable, count(*) AS n, min(obs_date) AS first, max(obs_date) AS last, round(avg(cur.value - old.value), 6) AS mean_difference, count(*) FILTER (cur.value <> old.value) AS differing, round(sum(cur.value) / nullif(sum(old.value), 0), 6) AS ratio FROM cur JOIN old USING (obs_date, variable) WHERE cur.value IS NOT NULL AND old.value IS NOT NULL AND priority = 1 GROUP BY variable")
def overlap_check(s, d):
    current, old = _current_and_old(s, d)
    return r6(elt.overlap(current, old.filter("priority = 1").drop("priority")), "mean_difference", "ratio")


_USAGE = "u AS (SELECT ts::DATE AS usage_date, event_type AS status, count(*) AS turns, count(DISTINCT user_id) AS users, count(DISTINCT user_id || '-' || ts::DATE) AS sessions FROM events WHERE ts < TIMESTAMP '2024-01-25' GROUP BY 1, 2)"


@query("usage_rollup", _w(_USAGE) + "SELECT * FROM u")
def usage_rollup(s, d):
    return elt.usage_rollup(ad.chat_history(s, d), "2024-01-25")


@query("usage_insert_only", _w(_USAGE) + "SELECT usage_date, status, CASE WHEN usage_date <= DATE '2024-01-10' THEN 0 ELSE turns END AS turns, users, sessions FROM u")
def usage_insert_only(s, d):
    rolled = usage_rollup(s, d)
    stored = rolled.filter(F.col("usage_date") <= F.to_date(F.lit("2024-01-10"))).withColumn("turns", F.lit(0).cast("long"))
    return elt.insert_only(stored, rolled, ["usage_date", "status"])


@query("retention", "SELECT event_id AS turn_id, event_type AS status FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 14 DAY")
def retention(s, d):
    return elt.retained(ad.chat_history(s, d), "2024-01-30").select("turn_id", "status")


@query("latest_by_station", _w(_SHORT) + "SELECT station_id, max(obs_date) AS latest, count(*) AS n FROM obs_short GROUP BY station_id")
def latest_by_station(s, d):
    return ad.obs_short(s, d).groupBy("station_id").agg(F.max("obs_date").alias("latest"), F.count("*").alias("n"))


# --- stations and places


@query("station_merge", _w(_STATIONS, f"hl AS ({_HIST_LINES})", "h AS (SELECT * FROM hl QUALIFY row_number() OVER (PARTITION BY ghcnd ORDER BY end_dt DESC, station_name) = 1)") + "SELECT ghcn_id AS station_id, s.name, coalesce(CASE WHEN s.selected THEN s.icao END, h.icao) AS icao, h.faa, CASE WHEN s.selected THEN 'Q' || substr(ghcn_id, 10, 2) END AS iata, 'US' AS country_code, 'UNITED STATES' AS country_name FROM stations s LEFT JOIN h ON h.ghcnd = s.ghcn_id")
def station_merge(s, d):
    st = ad.stations(s, d).withColumnRenamed("ghcn_id", "station_id")
    codes = st.filter("selected").select("station_id", "icao", "iata")
    countries = s.createDataFrame([("US", "United States")], "code string, country_name string")
    return stations.merge_stations(st.select("station_id", "name"), station_filter_latest(s, d), codes, countries)


@query("active_stations", _w(_STATIONS) + "SELECT ghcn_id, name, city, wmo, country_name FROM stations WHERE selected AND wmo IS NOT NULL")
def active_stations(s, d):
    return stations.active(ad.stations(s, d)).select("ghcn_id", "name", "city", "wmo", "country_name")


@query("lookup_station", _w(_STATIONS) + "SELECT ghcn_id, name, city, 'ST' AS state FROM stations WHERE city = 'NATION_6'")
def lookup_station(s, d):
    aliases = s.createDataFrame([("USW00000001", "Buenos")], "ghcn_id string, alias string")
    return stations.lookup(ad.stations(s, d), aliases, "nation_6!")


_MILES = "3958.8::DOUBLE * 2 * asin(sqrt(least(1.0, pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"


@query("nearest_station", _w(_STATIONS, "p AS (SELECT *, " + _MILES.format(a="latitude", b="35.5::DOUBLE", c="longitude", d="-91::DOUBLE") + " AS d FROM stations WHERE selected AND wmo IS NOT NULL)") + "SELECT ghcn_id, city, round(d)::BIGINT AS miles FROM p WHERE d <= 150 ORDER BY miles, ghcn_id LIMIT 3")
def nearest_station(s, d):
    return stations.nearest(ad.stations(s, d), 35.5, -91.0)


@query("near_pairs", _w(_STATIONS, "p AS (SELECT geonameid, ghcn_id, " + _MILES.format(a="p.latitude", b="s.latitude", c="p.longitude", d="s.longitude") + " AS d FROM places p, stations s WHERE selected AND wmo IS NOT NULL)", "q AS (SELECT geonameid, ghcn_id, round(d)::BIGINT AS miles FROM p WHERE d <= 150)") + "SELECT geonameid, ghcn_id, miles, n FROM (SELECT *, row_number() OVER (PARTITION BY geonameid ORDER BY miles, ghcn_id) AS n FROM q) WHERE n <= 3")
def near_pairs(s, d):
    return stations.near_pairs(ad.places(s, d), ad.stations(s, d))


@query("place_search", _w(_STATIONS) + "SELECT geonameid, place_name, population FROM places WHERE name_key = 'supplier#000000007' OR starts_with(name_key, 'supplier#000000007 ') ORDER BY population DESC LIMIT 1")
def place_search(s, d):
    return stations.search_place(ad.places(s, d), "Supplier#000000007").select("geonameid", "place_name", "population")


@query("place_choices", _w(_STATIONS, "q AS (SELECT geonameid, 'supplier x' AS place_name, population FROM places)", "t AS (SELECT * FROM q ORDER BY population DESC, geonameid LIMIT 4)") + "SELECT geonameid, population FROM t WHERE population >= 0.15 * (SELECT max(population) FROM t)")
def place_choices(s, d):
    named = ad.places(s, d).withColumn("name_key", F.concat(F.lit("springfield, "), F.col("geonameid").cast("string")))
    return stations.place_choices(named, "Springfield").select("geonameid", "population")


@query("countries", _w(_STATIONS) + "SELECT DISTINCT country_name FROM stations WHERE selected AND wmo IS NOT NULL")
def countries(s, d):
    return stations.active(ad.stations(s, d)).select("country_name").distinct()


@query("activate_station", _w(_STATIONS) + "SELECT ghcn_id, CASE WHEN ghcn_id = 'USW00000005' THEN 'HERE' ELSE city END AS city, selected OR ghcn_id = 'USW00000005' AS selected FROM stations")
def activate_station(s, d):
    return stations.activate(ad.stations(s, d), "USW00000005", "HERE").select("ghcn_id", "city", "selected")


@query("upsert_preserving", _w(_STATIONS) + "SELECT ghcn_id, CASE WHEN wmo IS NULL THEN name ELSE name || ' NEW' END AS name, selected, city FROM stations")
def upsert_preserving(s, d):
    """Names are refreshed, what people chose stays."""
    st = ad.stations(s, d).select("ghcn_id", "name", "selected", "city", "wmo")
    news = st.filter("wmo IS NOT NULL").select("ghcn_id", F.concat("name", F.lit(" NEW")).alias("name"), F.lit(False).alias("selected"), F.lit(None).cast("string").alias("city"))
    return elt.upsert(st.drop("wmo"), news, ["ghcn_id"], keep=("selected", "city"))


@query("fill_empty", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'new' END AS c_name, c_mktsegment FROM customer")
def fill_empty(s, d):
    rows = ad.table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    partial = rows.withColumn("c_name", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")))
    return elt.fill_empty(partial, rows.withColumn("c_name", F.lit("new")), ["c_custkey"])


@query("resolved_turns", "SELECT event_type AS status, count(*) AS n FROM events WHERE ts::DATE = DATE '2024-01-20' AND event_type = 'click' GROUP BY 1")
def resolved_turns(s, d):
    return ad.chat_history(s, d).filter((F.to_date("created_at") == F.to_date(F.lit("2024-01-20"))) & (F.col("status") == "click")).groupBy("status").agg(F.count("*").alias("n"))


@query("incremental_by_source", _w(_RAW, _CONV, "old AS (SELECT source, max(ingested_at) AS mark FROM both_sources WHERE obs_date <= CASE source WHEN 'GHCN' THEN DATE '2024-01-10' ELSE DATE '2024-01-20' END GROUP BY source)") + "SELECT station_id, obs_date, variable, source FROM both_sources JOIN old USING (source) WHERE ingested_at > mark")
def incremental_by_source(s, d):
    both = elt.union_sources(convert_ghcn(s, d), map_acis(s, d))
    seen = both.filter(F.col("obs_date") <= F.to_date(F.when(F.col("source") == "GHCN", "2024-01-10").otherwise("2024-01-20")))
    return elt.newer(both, seen, by_source=True).select("station_id", "obs_date", "variable", "source")


@query("ghcn_cutoff", _w(_RAW, _CONV) + "SELECT cutoff FROM cut")
def ghcn_cutoff(s, d):
    return elt.cutoff(convert_ghcn(s, d))


@query("celsius_means", _w(_SHORT, _days("obs_short", "TMAX", SHORT)) + "SELECT station_id, round((avg(value) - 32) * 5 / 9, 6) AS mean, round(stddev(value) * 5 / 9, 6) AS stddev, count(value) AS n_days FROM d GROUP BY station_id")
def celsius_means(s, d):
    return r6(answers.in_unit(daily.day_stats(short(s, d, "TMAX"), "mean", "stddev"), "TMAX", "C", ("mean",), ("stddev",)), "mean", "stddev")


@query("odds_percent", _w(_LONG, _days("obs_long", "SNOW", LONG, hit="SNOW >= 5.5"), _buckets("any", "month"), "m AS (SELECT station_id, bucket_month AS month, value FROM b)") + "SELECT station_id, month, round(100 * round(avg(value), 3), 1) AS value FROM m GROUP BY 1, 2")
def odds_percent(s, d):
    return answers.as_percent(odds_month(s, d)).select("station_id", "month", "value")


@query("climatology_bounds", _w(_LONG, _days("obs_long", "TMAX", LONG), _buckets("mean", "month"), "m AS (SELECT station_id, bucket_month AS x, round(avg(value), 1) AS value, round(stddev(value), 1) AS stddev FROM b GROUP BY 1, 2)") + "SELECT station_id, x, x::VARCHAR AS label, value, stddev, round(value - stddev, 4) AS lower, round(value + stddev, 4) AS upper FROM m")
def climatology_bounds(s, d):
    return answers.bounded(answers.points(series_month_of_year(s, d).drop("n_years"), "month"))


@query("series_summary", _w(_LONG, _days("obs_long", "SNOW", LONG), _buckets("sum", "year", 7), "p AS (SELECT station_id, bucket_year AS x, round(round(value, 6), 2) AS value FROM b)") + "SELECT station_id, max(value) AS highest, (SELECT max(x) FROM p q WHERE q.station_id = p.station_id AND q.value = (SELECT max(value) FROM p r WHERE r.station_id = q.station_id)) AS highest_at, min(value) AS lowest, (SELECT max(x) FROM p q WHERE q.station_id = p.station_id AND q.value = (SELECT min(value) FROM p r WHERE r.station_id = q.station_id)) AS lowest_at, round(avg(value), 4) AS mean, count(*) AS n FROM p GROUP BY station_id")
def series_summary(s, d):
    found = periods.series(periods.buckets(long(s, d, "SNOW"), "year", "sum", 7), "SNOW")
    return answers.summary(answers.points(found.select("station_id", "bucket_year", "value"), "bucket_year"))


@query("climatology_table", _w(_LONG, *[x.replace("d AS", f"d{k} AS", 1).replace("FROM d ", f"FROM d{k} ").replace("b AS", f"b{k} AS", 1) for k, m in enumerate(("TMAX", "TMIN")) for x in (_days("obs_long", m, LONG), _buckets("mean", "month"))]) + "SELECT station_id, month, high, low FROM (SELECT station_id, bucket_month AS month, round(avg(value), 1) AS high FROM b0 GROUP BY 1, 2) FULL JOIN (SELECT station_id, bucket_month AS month, round(avg(value), 1) AS low FROM b1 GROUP BY 1, 2) USING (station_id, month)")
def climatology_table(s, d):
    part = lambda m: periods.month_of_year(long(s, d, m), m, "mean")
    return answers.climatology_table({"high": part("TMAX"), "low": part("TMIN")}, "month")


def _ask(s, d, q: structured.Query, table=ad.obs_short) -> DataFrame:
    today = date.fromisoformat(TODAY)
    full = structured.apply_defaults(q, today)
    if found := structured.problems(full, today):
        raise ValueError("; ".join(found))
    return structured.answer(table(s, d), full, today)


@query("ask_freezes", _w(_SHORT, _days("obs_short", "TMIN", SHORT, hit="TMIN <= 32")) + "SELECT station_id, count(*) FILTER (hit = 1)::DOUBLE AS count, count(value) AS n_days FROM d GROUP BY station_id")
def ask_freezes(s, d):
    return _ask(s, d, structured.Query(aggregation="count", condition="freeze", start=SHORT[0], end=SHORT[1]))


@query("ask_wettest_storms", _w(_SHORT, _days("obs_short", "PRCP", SHORT, hit="PRCP >= 0.05"), _EVENTS) + "SELECT station_id, event_start, duration, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY rank, event_start) AS i FROM (SELECT *, dense_rank() OVER (PARTITION BY station_id ORDER BY round(total, 2) DESC) AS rank FROM e) WHERE rank <= 2) WHERE i <= 15")
def ask_wettest_storms(s, d):
    return _ask(s, d, structured.Query("PRCP", "top", "event", limit=2, start=SHORT[0], end=SHORT[1])).select("station_id", "event_start", "duration", "rank")


@query("ask_snowiest_season", _w(_LONG, _days("obs_long", "SNOW", LONG), _buckets("sum", "year", 7)) + "SELECT station_id, bucket_year, round(value, 6) AS value, n_days FROM b QUALIFY dense_rank() OVER (PARTITION BY station_id ORDER BY round(value, 2) DESC) = 1")
def ask_snowiest_season(s, d):
    return r6(_ask(s, d, structured.Query("SNOW", "max", "snow_season", start=LONG[0], end=LONG[1]), ad.obs_long), "value").select("station_id", "bucket_year", "value", "n_days")


@query("ask_json", _w(_SHORT, _days("obs_short", "SNWD", SHORT)) + """SELECT '{"station_id":"' || station_id || '","max":' || max(value) || ',"n_days":' || count(value) || '}' AS json FROM d GROUP BY station_id""")
def ask_json(s, d):
    return structured.as_json(daily.day_stats(short(s, d, "SNWD"), "max"))


# --- finished answers

_SMOOTH = "q AS (SELECT station_id, day, value, row_number() OVER (PARTITION BY station_id ORDER BY day) AS i, count(*) OVER (PARTITION BY station_id) AS n FROM c), sm AS (SELECT a.station_id, a.day, round(avg(b.value), 4) AS smoothed FROM q a JOIN q b ON a.station_id = b.station_id AND least(abs(a.i - b.i), a.n - abs(a.i - b.i)) <= 7 GROUP BY 1, 2)"
_BASE = ("1981-01-01", "2010-12-31")


@query("calendar_day_normal", _w(_LONG, _days("obs_long", "TMAX", NORMAL), _DOY, _SMOOTH) + "SELECT station_id, day AS calendar_day, smoothed AS value, n_years, NULL::INT AS record_year FROM sm JOIN c USING (station_id, day) WHERE day = '07-04'")
def calendar_day_normal(s, d):
    return _ask(s, d, structured.Query("TMAX", "mean", "day_of_year", calendar_day="07-04"), ad.obs_long)


@query("calendar_day_odds", _w(_LONG, _days("obs_long", "PRCP", NORMAL, hit="PRCP >= 0.05")) + "SELECT station_id, '06-15' AS calendar_day, round(100 * round(avg(hit), 3), 1) AS value, count(value) AS n_years, NULL::INT AS record_year FROM d WHERE value IS NOT NULL AND strftime(obs_date, '%m-%d') = '06-15' GROUP BY 1")
def calendar_day_odds(s, d):
    return _ask(s, d, structured.Query("PRCP", "mean", "day_of_year", calendar_day="06-15", period_aggregation="any", threshold=structured.Threshold(">=", 0.05)), ad.obs_long)


@query("calendar_day_record", _w(_LONG, _days("obs_long", "TMIN", ("1800-01-01", TODAY)), _DOY) + "SELECT station_id, day AS calendar_day, min AS value, n_years, min_year AS record_year FROM c WHERE day = '01-15'")
def calendar_day_record(s, d):
    return _ask(s, d, structured.Query("TMIN", "min", "day_of_year", calendar_day="01-15"), ad.obs_long)


def _date_answer_sql(which: str, start: str) -> str:
    return f"""k AS (SELECT station_id, year, {which} AS dd, ({which} - {start})::INT AS x FROM f),
p AS (SELECT station_id, list(dd ORDER BY x, dd) FILTER (x IS NOT NULL) AS l, min(x) AS lo, max(x) AS hi, count(*) AS years_counted, count(*) FILTER (dd IS NULL) AS years_without, min(year) AS a, max(year) AS b FROM k GROUP BY 1)
SELECT station_id, CASE WHEN years_counted = 1 THEN l[1] END AS value, CASE WHEN years_counted = 1 THEN a END AS bucket_year, CASE WHEN years_counted > 1 THEN strftime(l[len(l) // 2 + 1], '%m-%d') END AS typical_date,
  CASE WHEN years_counted > 1 THEN (SELECT string_agg(dd::VARCHAR, ',' ORDER BY dd) FROM k WHERE k.station_id = p.station_id AND k.x = lo) END AS earliest_on_record,
  CASE WHEN years_counted > 1 THEN (SELECT string_agg(dd::VARCHAR, ',' ORDER BY dd) FROM k WHERE k.station_id = p.station_id AND k.x = hi) END AS latest_on_record,
  CASE WHEN years_counted > 1 THEN a END AS first_year, CASE WHEN years_counted > 1 THEN b END AS last_year, years_counted, years_without FROM p"""


def _dates_listed(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("earliest_on_record", "latest_on_record")})


_FALL = "f AS (SELECT * FROM (SELECT station_id, year(obs_date)::INT AS year, min(obs_date) FILTER (hit = 1) AS first, count(value) AS n_days FROM d GROUP BY 1, 2) WHERE n_days >= 0.9 * 184)"


@query("first_date_answer", _w(_LONG, _days("obs_long", "TMIN", LONG, "month(obs_date) >= 7", "TMIN <= 32"), _FALL, _date_answer_sql("first", "make_date(year::BIGINT, 1, 1)").split("\nSELECT")[0]) + "SELECT" + _date_answer_sql("first", "make_date(year::BIGINT, 1, 1)").split("\nSELECT", 1)[1])
def first_date_answer(s, d):
    """The first fall freeze of all years."""
    return _dates_listed(_ask(s, d, structured.Query(None, "first_date", "year", condition="freeze", half_year=2, start=LONG[0], end=LONG[1]), ad.obs_long))


@query("last_date_answer", _w(_LONG, _days("obs_long", "TMIN", ("2001-01-01", "2001-06-30"), hit="TMIN <= 32"), _FALL.replace("min(", "max(").replace("AS first", "AS last").replace("184", "181"), _date_answer_sql("last", "make_date(year::BIGINT, 1, 1)").split("\nSELECT")[0]) + "SELECT" + _date_answer_sql("last", "make_date(year::BIGINT, 1, 1)").split("\nSELECT", 1)[1])
def last_date_answer(s, d):
    """The last spring freeze of one year."""
    return _dates_listed(_ask(s, d, structured.Query(None, "last_date", "year", condition="freeze", half_year=1, start="2001-01-01", end="2001-06-30"), ad.obs_long))


@query("period_max_ties", _w(_LONG, _days("obs_long", "SNOW", LONG), _buckets("sum", "month")) + """SELECT station_id, bucket_year, bucket_month, value, n_buckets, first_bucket, last_bucket, n_ties, i = 1 AS is_answer FROM (
  SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY bucket_year DESC, bucket_month DESC) AS i, count(*) OVER (PARTITION BY station_id) AS n_ties FROM (
    SELECT station_id, bucket_year, bucket_month, round(value, 2) AS value, dense_rank() OVER (PARTITION BY station_id ORDER BY round(-value, 2) DESC) AS r, count(*) OVER (PARTITION BY station_id) AS n_buckets,
      min(bucket_year * 100 + bucket_month) OVER (PARTITION BY station_id) AS first_bucket, max(bucket_year * 100 + bucket_month) OVER (PARTITION BY station_id) AS last_bucket FROM b) WHERE r = 1) WHERE i <= 15""")
def period_max_ties(s, d):
    """The least snowy months: many tie at none, and the latest one answers."""
    found = _ask(s, d, structured.Query("SNOW", "min", "month", start=LONG[0], end=LONG[1]), ad.obs_long)
    return found.select("station_id", "bucket_year", "bucket_month", F.round("value", 2).alias("value"), "n_buckets", "first_bucket", "last_bucket", "n_ties", "is_answer")


_MBASE = "n AS (SELECT station_id, bucket_month, round(round(avg(value), 9), 1) AS normal, round(round(stddev(value), 9), 1) AS sd FROM b WHERE bucket_year BETWEEN 1981 AND 2010 GROUP BY 1, 2 HAVING count(*) >= 0.8 * 30)"
_ANOM = "p AS (SELECT station_id, make_date(bucket_year::BIGINT, bucket_month::BIGINT, 1) AS x, bucket_year + (bucket_month - 0.5::DOUBLE) / 12 AS x_num, round(round(value, 9), 1) AS value, normal, round(normal - sd + 1e-9, 1) AS lower, round(normal + sd + 1e-9, 1) AS upper, round(round(round(value, 9), 1) - normal, 1) AS anomaly FROM b LEFT JOIN n USING (station_id, bucket_month))"


@query("anomaly_answer", _w(_LONG, _days("obs_long", "TMAX", LONG), _buckets("mean", "month"), _MBASE, _ANOM, "t AS (SELECT station_id, round(regr_slope(anomaly, x_num) * 10, 2) AS per_decade FROM p WHERE anomaly IS NOT NULL GROUP BY 1 HAVING count(*) >= 3)") + "SELECT station_id, x, value, normal, lower, upper, anomaly, per_decade FROM p LEFT JOIN t USING (station_id)")
def anomaly_answer(s, d):
    """Monthly departures from the 1981-2010 normals, and their trend."""
    found = _ask(s, d, structured.Query("TMAX", "series", "month", display="anomaly", baseline=(1981, 2010), trend=True, period_aggregation="mean", start=LONG[0], end=LONG[1]), ad.obs_long)
    return found.select("station_id", "x", "value", "normal", "lower", "upper", "anomaly", "per_decade")


@query("running_total_answer", _w(_LONG, _days("obs_long", "SNOW", ("2018-07-01", "2019-06-30"))) + "SELECT station_id, obs_date AS x, value AS daily, round(sum(value) OVER (PARTITION BY station_id ORDER BY obs_date), 2) AS value, (obs_date - DATE '2018-07-01')::INT AS x_day FROM d WHERE value IS NOT NULL")
def running_total_answer(s, d):
    """A season's snow so far; the normal total beside it is tested on small tables."""
    found = _ask(s, d, structured.Query("SNOW", "series", "day", display="cumulative", baseline=(1981, 2010), start="2018-07-01", end="2019-06-30"), ad.obs_long)
    return found.select("station_id", "x", "daily", "value", "x_day")


@query("climate_answer", _w(_LONG, _days("obs_long", "TMAX", ("1800-01-01", TODAY)), _DOY) + "SELECT station_id, obs_date AS x, d.value, c.max AS record_high, c.max_year AS record_high_year, CASE WHEN d.value >= c.max THEN 'high' END AS record_set FROM d JOIN c USING (station_id) WHERE strftime(obs_date, '%m-%d') = c.day AND d.value IS NOT NULL AND obs_date BETWEEN DATE '2019-01-01' AND DATE '2019-12-31'")
def climate_answer(s, d):
    found = _ask(s, d, structured.Query("TMAX", "series", "day", display="climate", baseline=(1981, 2010), start="2019-01-01", end="2019-12-31"), ad.obs_long)
    return found.select("station_id", "x", "value", "record_high", "record_high_year", "record_set")


@query("histogram_answer", _w(_LONG, _days("obs_long", "PRCP", LONG), "h AS (SELECT station_id, floor(round(value, 2) / 0.1::DOUBLE + 1e-9)::BIGINT AS k, count(*) AS n FROM d WHERE round(value, 2) > 0 GROUP BY 1, 2)", "g AS (SELECT station_id, unnest(range(min(k), max(k) + 1)) AS k, sum(n) AS total FROM h GROUP BY 1)") + "SELECT station_id, round(k * 0.1::DOUBLE, 2) AS bin, round((k + 1) * 0.1::DOUBLE, 2) AS bin_end, coalesce(n, 0)::BIGINT AS count, round(100 * coalesce(n, 0) / total, 1) AS pct FROM g LEFT JOIN h USING (station_id, k)")
def histogram_answer(s, d):
    """How much it rains on days with rain: days without aren't counted, empty bins are kept."""
    return charts.series(ad.obs_long(s, d), structured.Query("PRCP", "series", "value", start=LONG[0], end=LONG[1]), date.fromisoformat(TODAY))


@query("celsius_answer", _w(_SHORT, _days("obs_short", "TMAX", SHORT)) + "SELECT station_id, round((avg(value) - 32) * 5 / 9, 6) AS mean, count(value) AS n_days FROM d GROUP BY 1")
def celsius_answer(s, d):
    return r6(_ask(s, d, structured.Query("TMAX", "mean", "day", output_unit="C", start=SHORT[0], end=SHORT[1])), "mean")


@query("difference_answer", _w(_SHORT, _days("obs_short", "TMAX", SHORT)) + "SELECT a.station_id, a.obs_date AS x, round(a.value - b.value, 2) AS value FROM d a JOIN d b USING (obs_date) WHERE a.station_id = 'RA' AND b.station_id = 'RR' AND a.value IS NOT NULL AND b.value IS NOT NULL AND a.obs_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'")
def difference_answer(s, d):
    pair = [structured.Query("TMAX", "series", "day", display="difference", station=x, start="1997-01-01", end="1997-12-31") for x in ("RA", "RR")]
    return charts.chart(ad.obs_short(s, d), pair, date.fromisoformat(TODAY)).select("station_id", "x", "value")


# --- places and stations by rule


def _qualified(s, d):
    """Every place is named Springfield and lies in a state of its nation's number."""
    state = F.translate("admin1_name", "_", " ")
    return ad.places(s, d).withColumns({"name_key": F.lit("springfield"), "admin1_code": F.regexp_extract("admin1_name", "([0-9]+)", 1), "admin1_name": state, "country_code": F.lit("US"), "country_name": F.lit("United States")})


@query("place_qualified", _w(_STATIONS, "q AS (SELECT p.geonameid, p.population FROM places p JOIN supplier ON s_suppkey = geonameid JOIN nation ON n_nationkey = s_nationkey WHERE n_name = 'NATION_6')") + "SELECT geonameid, population FROM q ORDER BY population DESC, geonameid LIMIT 1")
def place_qualified(s, d):
    return resolving.find_place(_qualified(s, d), "Springfield Nation 6").select("geonameid", "population")


@query("station_choice", _w(_STATIONS, "pl AS (SELECT geonameid, CASE WHEN geonameid % 3 = 0 THEN 'nation' ELSE 'supplier' END AS key, latitude, longitude FROM places)",
    "pr AS (SELECT geonameid, ghcn_id, key, 'nation' AS s_key, " + _MILES.format(a="p.latitude", b="s.latitude", c="p.longitude", d="s.longitude") + " AS dist FROM pl p, stations s WHERE selected AND wmo IS NOT NULL)",
    "nr AS (SELECT * FROM (SELECT geonameid, ghcn_id, key, s_key, round(dist)::BIGINT AS miles, row_number() OVER (PARTITION BY geonameid ORDER BY round(dist), ghcn_id) AS n FROM pr WHERE dist <= 150) WHERE n <= 3)",
    "ag AS (SELECT geonameid, min(n) FILTER (miles <= 50 AND key = s_key) AS same, count(*) FILTER (miles <= 10) AS close, min(n) FILTER (miles <= 10) AS only_n, min(miles) FILTER (n = 1) AS first_miles, string_agg(ghcn_id, ',' ORDER BY n) FILTER (n = 1 OR miles <= 50) AS offers FROM nr GROUP BY 1)",
    "ch AS (SELECT geonameid, CASE WHEN same IS NOT NULL THEN 'same city' WHEN close = 1 THEN 'only one' WHEN first_miles IS NOT NULL THEN 'ask' ELSE 'none' END AS how, coalesce(same, CASE WHEN close = 1 THEN only_n END) AS pick, first_miles, offers FROM pl LEFT JOIN ag USING (geonameid))") + """
SELECT ch.geonameid, how, nr.ghcn_id, coalesce(nr.miles, first_miles) AS miles, CASE WHEN how = 'ask' THEN offers END AS offers, CASE WHEN how = 'ask' THEN first_miles > 50 END AS far FROM ch LEFT JOIN nr ON nr.geonameid = ch.geonameid AND nr.n = pick""")  # fmt: skip
def station_choice(s, d):
    named = ad.places(s, d).withColumn("place_name", F.when(F.col("geonameid") % 3 == 0, "Nation").otherwise(F.col("place_name")))
    found = stations.choose(named, ad.stations(s, d).withColumn("city", F.regexp_replace("city", "_[0-9]+", "")))
    return found.withColumn("offers", F.array_join("offers", ","))


@query("home_locations", _w(_STATIONS) + "SELECT icao AS code, city || ', ST (' || icao || ')' AS label FROM stations WHERE selected AND wmo IS NOT NULL")
def home_locations(s, d):
    return stations.home_locations(ad.stations(s, d))


@query("station_codes", _w(_STATIONS) + "SELECT ghcn_id, CASE WHEN wmo IS NOT NULL THEN 'X' || substr(icao, 2) ELSE icao END AS icao, CASE WHEN wmo IS NOT NULL THEN 'new' END AS note FROM stations")
def station_codes(s, d):
    """Codes merged in by station; a column that the table lacks is added."""
    st = ad.stations(s, d).select("ghcn_id", "icao", "wmo")
    codes = st.filter("wmo IS NOT NULL").select("ghcn_id", F.concat(F.lit("X"), F.substring("icao", 2, 9)).alias("icao"), F.lit("new").alias("note"))
    return elt.upsert(st.drop("wmo"), codes, ["ghcn_id"])
