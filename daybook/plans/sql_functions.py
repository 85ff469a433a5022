"""The operators as SQL functions of the session, for callers that write SQL.

``register`` names the observations and creates temporary functions: tables (``daily_values``, ``day_summary``,
``event_list``, ``event_summary``, ``period_list``, ``period_summary``) and two scalars (``answer_value``, ``lookup_station_id``). All
take their arguments by name, with defaults, and are plans like any other: with constant arguments the
metric is picked and the filters reach the scan before anything is read, and beside ``LATERAL`` or over a
column of stations they become joins and aggregations of all the stations at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.vocabulary import ALL_TIME, COVERAGE, METRICS

VIEW = "daybook_observations"
STATIONS, ALIASES = "daybook_stations", "daybook_aliases"
END = "9999-12-31"
SPAN = f"p_start DATE DEFAULT DATE '{ALL_TIME}', p_end DATE DEFAULT DATE '{END}', p_months ARRAY<INT> DEFAULT NULL"
LIMIT = "p_operator STRING DEFAULT NULL, p_threshold DOUBLE DEFAULT NULL"


def _met(value: str) -> str:
    return "CASE p_operator " + " ".join(f"WHEN '{op}' THEN {value} {op} p_threshold" for op in (">", ">=", "<", "<=", "=")) + " END"


METRIC = "CASE p_metric " + " ".join(f"WHEN '{m}' THEN CAST({m} AS DOUBLE)" for m in METRICS) + " END"
SUMMARY = "avg(value) AS mean, median(value) AS median, sum(value) AS sum, max(value) AS max, min(value) AS min, stddev(value) AS stddev"
SUMMED = "mean DOUBLE, median DOUBLE, sum DOUBLE, max DOUBLE, min DOUBLE, stddev DOUBLE"

#: Name, arguments, result, body.
TABLES = {
    "daily_values": (
        f"p_station STRING, p_metric STRING, {SPAN}, {LIMIT}",
        "obs_date DATE, value DOUBLE, hit INT",
        f"""SELECT obs_date, value, CASE WHEN value IS NULL THEN NULL WHEN p_operator IS NULL THEN 0 WHEN {_met("value")} THEN 1 ELSE 0 END AS hit
        FROM (SELECT station_id, obs_date, {METRIC} AS value FROM {VIEW}) WHERE station_id = p_station AND obs_date BETWEEN p_start AND p_end AND (p_months IS NULL OR array_contains(p_months, month(obs_date)))""",
    ),
    "day_summary": (
        f"p_station STRING, p_metric STRING, {SPAN}, {LIMIT}",
        f"{SUMMED}, hits DOUBLE, n_days BIGINT",
        f"SELECT {SUMMARY}, CAST(count_if(hit = 1) AS DOUBLE) AS hits, count(value) AS n_days FROM daily_values(p_station, p_metric, p_start, p_end, p_months, p_operator, p_threshold)",
    ),
    "event_list": (
        f"p_station STRING, p_metric STRING, {SPAN}, p_operator STRING DEFAULT '>=', p_threshold DOUBLE DEFAULT 0.05",
        "event_start DATE, event_end DATE, total DOUBLE, duration DOUBLE",
        """SELECT min(obs_date) AS event_start, max(obs_date) AS event_end, sum(value) AS total, CAST(count(*) AS DOUBLE) AS duration
        FROM (SELECT obs_date, value, date_sub(obs_date, CAST(row_number() OVER (ORDER BY obs_date) AS INT)) AS island FROM daily_values(p_station, p_metric, p_start, p_end, p_months, p_operator, p_threshold) WHERE hit = 1) GROUP BY island""",
    ),
    "event_summary": (
        f"p_station STRING, p_metric STRING, {SPAN}, p_operator STRING DEFAULT '>=', p_threshold DOUBLE DEFAULT 0.05, p_event_value STRING DEFAULT 'total'",
        f"{SUMMED}, n_events BIGINT",
        f"SELECT {SUMMARY}, count(*) AS n_events FROM (SELECT CASE p_event_value WHEN 'total' THEN total WHEN 'duration' THEN duration END AS value FROM event_list(p_station, p_metric, p_start, p_end, p_months, p_operator, p_threshold))",
    ),
    "period_list": (
        f"p_station STRING, p_metric STRING, p_unit STRING, p_how STRING, {SPAN}, p_first_month INT DEFAULT 1, {LIMIT}",
        "bucket_year INT, bucket_month INT, value DOUBLE, n_days BIGINT",
        # What a caller gives may stand beside columns, but not beside aggregates: hence a level each.
        f"""SELECT y AS bucket_year, m AS bucket_month, value, n_days FROM (
          SELECT y, m, n_days, CASE p_how WHEN 'mean' THEN mean WHEN 'sum' THEN total WHEN 'count' THEN hits WHEN 'any' THEN met END AS value,
            CASE WHEN p_unit = 'month' THEN day(last_day(make_date(y, m, 1))) ELSE aggregate(coalesce(p_months, sequence(1, 12)), 0, (n, k) -> n + day(last_day(make_date(CASE WHEN p_first_month > 1 AND k >= p_first_month THEN y - 1 ELSE y END, k, 1)))) END AS expected
          FROM (SELECT y, m, count(value) AS n_days, avg(value) AS mean, sum(value) AS total, CAST(sum(hit) AS DOUBLE) AS hits, CAST(max(hit) AS DOUBLE) AS met
            FROM (SELECT value, hit, CASE WHEN p_unit = 'month' THEN month(obs_date) END AS m, CASE WHEN p_unit = 'month' OR p_first_month = 1 THEN year(obs_date) ELSE year(add_months(obs_date, 13 - p_first_month)) END AS y
              FROM daily_values(p_station, p_metric, p_start, p_end, p_months, p_operator, p_threshold)) GROUP BY y, m))
        WHERE value IS NOT NULL AND n_days >= {COVERAGE}D * expected""",
    ),
    "period_summary": (
        f"p_station STRING, p_metric STRING, p_unit STRING, p_how STRING, {SPAN}, p_first_month INT DEFAULT 1, {LIMIT}",
        f"{SUMMED}, n_buckets BIGINT",
        f"SELECT {SUMMARY}, count(*) AS n_buckets FROM period_list(p_station, p_metric, p_unit, p_how, p_start, p_end, p_months, p_first_month, p_operator, p_threshold)",
    ),
}
PICK = "CASE p_aggregation WHEN 'mean' THEN mean WHEN 'median' THEN median WHEN 'sum' THEN sum WHEN 'max' THEN max WHEN 'min' THEN min WHEN 'stddev' THEN stddev WHEN 'count' THEN {count} END"
SCALARS = {
    "answer_value": (
        f"p_station STRING, p_metric STRING, p_aggregation STRING, p_unit STRING DEFAULT 'day', {SPAN}, {LIMIT}, p_how STRING DEFAULT 'mean', p_event_value STRING DEFAULT 'total'",
        "DOUBLE",
        f"""CASE WHEN p_unit = 'day' THEN (SELECT {PICK.format(count="hits")} FROM day_summary(p_station, p_metric, p_start, p_end, p_months, p_operator, p_threshold))
        WHEN p_unit = 'event' THEN (SELECT {PICK.format(count="CAST(n_events AS DOUBLE)")} FROM event_summary(p_station, p_metric, p_start, p_end, p_months, coalesce(p_operator, '>='), coalesce(p_threshold, 0.05D), p_event_value))
        WHEN p_unit IN ('month', 'year') THEN (SELECT {PICK.format(count="CAST(n_buckets AS DOUBLE)")} FROM period_summary(p_station, p_metric, p_unit, p_how, p_start, p_end, p_months)) END""",
    ),
    "lookup_station_id": (
        "p_text STRING",
        "STRING",
        f"""SELECT min_by(ghcn_id, named_struct('match', match, 'id', ghcn_id)) FROM (
          SELECT ghcn_id, stack(5, 1, lower(icao), 1, lower(iata), 1, lower(ghcn_id), 3, lower(regexp_replace(city, '[^a-zA-Z0-9 ]', '')), 4, lower(regexp_replace(name, '[^a-zA-Z0-9 ]', ''))) AS (match, key) FROM {STATIONS}
          UNION ALL SELECT ghcn_id, 2, lower(regexp_replace(alias, '[^a-zA-Z0-9 ]', '')) FROM {ALIASES})
        WHERE key = lower(regexp_replace(p_text, '[^a-zA-Z0-9 ]', ''))""",
    ),
}


def register(spark: SparkSession, obs: DataFrame, stations: DataFrame | None = None, aliases: DataFrame | None = None) -> None:
    """Creates the functions in the session over these tables; again over others, if called again."""
    obs.createOrReplaceTempView(VIEW)
    for name, (arguments, result, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE ({result}) RETURN {body}")
    scalars = dict(SCALARS)
    if stations is None:
        del scalars["lookup_station_id"]
        spark.sql("DROP TEMPORARY FUNCTION IF EXISTS lookup_station_id")  # it would look into an earlier call's stations
    else:
        stations.createOrReplaceTempView(STATIONS)
        (stations.sparkSession.createDataFrame([], "ghcn_id string, alias string") if aliases is None else aliases).createOrReplaceTempView(ALIASES)
    for name, (arguments, result, body) in scalars.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")


def days_asked(spark: SparkSession, station: str, metric: str, start: str, end: str, months: list[int] | None = None, operator: str | None = None, threshold: float | None = None) -> DataFrame:
    """``daily_values`` by a parameterised statement: what callers give are values, never SQL."""
    listed = None if months is None else "[" + ",".join(str(int(m)) for m in months) + "]"
    text = "SELECT * FROM daily_values(:station, :metric, CAST(:start AS DATE), CAST(:end AS DATE), from_json(:months, 'array<int>'), :operator, :threshold)"
    return spark.sql(text, args={"station": station, "metric": metric, "start": start, "end": end, "months": listed, "operator": operator, "threshold": threshold})
