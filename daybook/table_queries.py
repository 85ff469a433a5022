"""Registered queries over whole tables of texts, requests, landed files and stored versions, and their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from .operators import daily, state
from .plans import places, requests, sql_functions, work
from .plans import query as structured
from .plans.store import Store
from .queries import _LONG, _MILES, _SHORT, _STATIONS, QUERIES, SHORT, SQL, TODAY, _days, _w, month_lines, query, r6
from .sources import adapters as ad
from .sources import files, parse, payloads

__all__ = ["QUERIES", "SQL"]

# --- stored tables

_WEEK = "obs_date BETWEEN DATE '1999-07-01' AND DATE '1999-07-07'"


@query("upsert_pruned", _w(_LONG, f"t AS (SELECT station_id, obs_date, TMAX FROM obs_long), s AS (SELECT station_id, obs_date, TMAX + 1 AS TMAX FROM t WHERE {_WEEK} UNION ALL SELECT 'NEW', obs_date, TMAX FROM t WHERE {_WEEK})") + "SELECT * FROM s UNION ALL SELECT * FROM t ANTI JOIN s USING (station_id, obs_date)")
def upsert_pruned(s, d):
    """Fifty years stored by year; a week of two stations is merged in, which reads and writes one year."""
    store = Store(s, work.work_path(s, "store"))
    rows = ad.obs_long(s, d).select("station_id", "obs_date", "TMAX")
    store.overwrite("observations", rows, {"p_year": "year(obs_date)"})
    week = store.where("observations", lambda p: p["p_year"] == "1999").filter(_WEEK)
    store.upsert("observations", week.withColumn("TMAX", F.col("TMAX") + 1).unionByName(week.withColumn("station_id", F.lit("NEW"))), ["station_id", "obs_date"])
    return store.read("observations")


# --- texts

_TOWNS = """
towns AS (SELECT s_suppkey::BIGINT AS geonameid, 'town ' || (s_suppkey % 10) || CASE WHEN s_suppkey % 4 = 0 THEN ' east' WHEN s_suppkey % 4 = 1 THEN ', old' ELSE '' END AS name_key, floor(s_acctbal * 100)::BIGINT + 100000 AS population,
  s_nationkey::VARCHAR AS code, 'nation ' || s_nationkey AS state, CASE WHEN s_suppkey % 3 = 0 THEN 'gb' ELSE 'us' END AS cc, CASE WHEN s_suppkey % 3 = 0 THEN 'united kingdom' ELSE 'united states' END AS country FROM supplier),
texts AS (SELECT c_custkey, 'Town ' || (c_custkey % 12) || CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN ', Nation ' || c_nationkey WHEN 2 THEN ' UK' WHEN 3 THEN ', ' || c_nationkey || ', USA' WHEN 4 THEN ' nation ' || c_nationkey ELSE ' east united states' END AS text FROM customer),
w AS (SELECT c_custkey, lower(text) AS f, string_split(lower(text), ' ') AS ws FROM texts),
r AS (SELECT c_custkey, 0 AS reading, trim(split_part(f, ',', 1)) AS name, list_transform(string_split(f, ',')[2:], lambda x: trim(x)) AS marks FROM w WHERE contains(f, ',')
  UNION ALL SELECT c_custkey, k, array_to_string(ws[1 : len(ws) - k], ' '), CASE WHEN k = 0 THEN [] ELSE [array_to_string(ws[len(ws) - k + 1 :], ' ')] END FROM (SELECT *, unnest(range(0, least(3, len(ws) - 1) + 1)) AS k FROM w WHERE NOT contains(f, ','))),
met AS (SELECT c_custkey, reading, geonameid, name_key = name AS exact, population FROM r JOIN towns ON name_key = name OR starts_with(name_key, name || ' ') OR starts_with(name_key, name || ',')
  WHERE len(list_filter(marks, lambda q: NOT (q IN (code, state, cc, country) OR (q = 'uk' AND cc = 'gb') OR (q = 'usa' AND cc = 'us')))) = 0),
best AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY reading, exact DESC, population DESC, geonameid) = 1)"""


def towns(s, d):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("Town "), (k % 10).cast("string"), F.when(k % 4 == 0, " East").when(k % 4 == 1, ", Old").otherwise(""))
    code = F.col("s_nationkey").cast("string")
    gb = k % 3 == 0
    return ad.table(s, d, "supplier").select(
        k.cast("long").alias("geonameid"), name.alias("place_name"), F.lower(name).alias("name_key"), (F.floor(F.col("s_acctbal") * 100) + 100000).cast("long").alias("population"), code.alias("admin1_code"), F.concat(F.lit("Nation "), code).alias("admin1_name"),
        F.when(gb, "GB").otherwise("US").alias("country_code"), F.when(gb, "United Kingdom").otherwise("United States").alias("country_name"), F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"),
    )


@query("resolve_places", _w(_TOWNS) + "SELECT c_custkey, text, geonameid, reading::INT AS reading, exact FROM texts LEFT JOIN best USING (c_custkey)")
def resolve_places(s, d):
    """A place for the text of every customer."""
    k, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    rest = F.when(k % 6 == 0, "").when(k % 6 == 1, F.concat(F.lit(", Nation "), nation)).when(k % 6 == 2, " UK").when(k % 6 == 3, F.concat(F.lit(", "), nation, F.lit(", USA"))).when(k % 6 == 4, F.concat(F.lit(" nation "), nation)).otherwise(" east united states")
    texts = ad.table(s, d, "customer").select("c_custkey", F.concat(F.lit("Town "), (k % 12).cast("string"), rest).alias("text"))
    return places.resolve_places(texts, towns(s, d)).select("c_custkey", "text", "geonameid", "reading", "exact")


_STATION_TEXTS = f"""
asked AS (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN 'Nation_' || c_nationkey WHEN 3 THEN CASE WHEN c_custkey % 8 = 3 THEN 'N/A' ELSE 'k' || lpad(c_nationkey::VARCHAR, 3, '0') END ELSE 'Supplier#' || lpad((1 + c_custkey % 130)::VARCHAR, 9, '0') END AS text FROM customer),
known AS (SELECT text, (SELECT min(ghcn_id) FROM stations WHERE lower(regexp_replace(city, '[^a-zA-Z0-9 ]', '', 'g')) = lower(regexp_replace(text, '[^a-zA-Z0-9 ]', '', 'g')) OR lower(icao) = lower(text)) AS ghcn_id FROM asked WHERE text <> 'N/A'),
pr AS (SELECT p.geonameid, s.ghcn_id, {_MILES.format(a="p.latitude", b="s.latitude", c="p.longitude", d="s.longitude")} AS dist FROM places p, stations s WHERE selected AND wmo IS NOT NULL),
nr AS (SELECT geonameid, ghcn_id, round(dist)::BIGINT AS miles, row_number() OVER (PARTITION BY geonameid ORDER BY round(dist), ghcn_id) AS n FROM pr WHERE dist <= 150 QUALIFY n <= 3),
ag AS (SELECT geonameid, count(*) FILTER (miles <= 10) AS close, min(n) FILTER (miles <= 10) AS only_n, min(miles) FILTER (n = 1) AS first_miles, string_agg(ghcn_id, ',' ORDER BY n) FILTER (n = 1 OR miles <= 50) AS offers FROM nr GROUP BY 1),
ch AS (SELECT p.geonameid, place_name, name_key, CASE WHEN close = 1 THEN 'only one' WHEN first_miles IS NOT NULL THEN 'ask' ELSE 'none' END AS how, CASE WHEN close = 1 THEN only_n END AS pick, first_miles, offers FROM places p LEFT JOIN ag USING (geonameid))"""


@query("resolve_stations", _w(_STATIONS, _STATION_TEXTS) + """SELECT text, 'no place' AS how, NULL AS ghcn_id, NULL::BIGINT AS miles, NULL AS offers, NULL::BOOLEAN AS far, NULL AS place FROM asked WHERE text = 'N/A'
  UNION ALL SELECT text, 'named', k.ghcn_id, NULL, NULL, NULL, city FROM known k JOIN stations s ON s.ghcn_id = k.ghcn_id
  UNION ALL SELECT text, coalesce(how, 'none'), nr.ghcn_id, coalesce(nr.miles, first_miles), CASE WHEN how = 'ask' THEN offers END, CASE WHEN how = 'ask' THEN first_miles > 50 END, place_name
    FROM known k LEFT JOIN ch ON ch.name_key = lower(text) LEFT JOIN nr ON nr.geonameid = ch.geonameid AND nr.n = pick WHERE k.ghcn_id IS NULL""")  # fmt: skip
def resolve_stations(s, d):
    """A station, or what to ask, for each text that the customers' table gives."""
    k, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    place = F.concat(F.lit("Supplier#"), F.lpad((1 + k % 130).cast("string"), 9, "0"))
    code = F.when(k % 8 == 3, "N/A").otherwise(F.concat(F.lit("k"), F.lpad(nation, 3, "0")))
    text = F.when(k % 4 == 0, F.concat(F.lit("Nation_"), nation)).when(k % 4 == 3, code).otherwise(place)
    none = F.lit(None).cast("double")
    asked = ad.table(s, d, "customer").select(text.alias("text"), none.alias("latitude"), none.alias("longitude"))
    places_ = ad.places(s, d).withColumns({c: F.lit("x") for c in ("admin1_code", "country_code", "country_name")})
    found = places.resolve_stations(asked, ad.stations(s, d), s.createDataFrame([], "ghcn_id string, alias string"), places_)
    return found.withColumn("offers", F.array_join("offers", ",")).drop("latitude", "longitude")


# --- SQL callers


def _registered(s, d):
    sql_functions.register(s, ad.obs_short(s, d), ad.stations(s, d))


@query("sql_daily_values", _w(_SHORT, _days("obs_short", "SNOW", SHORT, "month(obs_date) IN (1, 2)", "SNOW >= 0.5")) + "SELECT station_id, obs_date, value, hit FROM d")
def sql_daily_values(s, d):
    _registered(s, d)
    return s.sql(f"SELECT s.station_id, v.* FROM (SELECT DISTINCT station_id FROM {sql_functions.VIEW}) s, LATERAL daily_values(s.station_id, 'SNOW', DATE'{SHORT[0]}', DATE'{SHORT[1]}', array(1, 2), '>=', 0.5) v")


_AT = "CASE s_suppkey % 3 WHEN 0 THEN 'RA' WHEN 1 THEN 'RN' ELSE 'RR' END"
_ASKED = f"q AS (SELECT s_suppkey, {_AT} AS station_id, 1995 + s_suppkey % 5 AS y, (s_suppkey % 7) / 10::DOUBLE AS t FROM supplier)"
_EVENTS = "ev AS (SELECT s_suppkey, sum(PRCP) AS total FROM (SELECT s_suppkey, obs_date, PRCP, obs_date - (row_number() OVER (PARTITION BY s_suppkey ORDER BY obs_date))::INT AS g FROM q JOIN obs_short o ON o.station_id = q.station_id AND year(obs_date) = y WHERE PRCP >= t) GROUP BY s_suppkey, g)"


@query("sql_answer_lateral", _w(_SHORT, _ASKED, _EVENTS, "dy AS (SELECT s_suppkey, avg(TMAX) AS mean, count(TMAX) AS n FROM q JOIN obs_short o ON o.station_id = q.station_id AND year(obs_date) = y GROUP BY 1)",
    "mo AS (SELECT s_suppkey, avg(TMIN) AS v FROM q JOIN obs_short o ON o.station_id = q.station_id AND year(obs_date) = y GROUP BY s_suppkey, month(obs_date), y HAVING count(TMIN) >= 0.9 * day(last_day(make_date(y::BIGINT, month(obs_date), 1))))")
    + "SELECT s_suppkey, round(mean, 6) AS mean, coalesce(n, 0) AS n_days, (SELECT count(*) FROM ev WHERE ev.s_suppkey = q.s_suppkey) AS n_events, round((SELECT max(total) FROM ev WHERE ev.s_suppkey = q.s_suppkey), 6) AS wettest, round((SELECT min(v) FROM mo WHERE mo.s_suppkey = q.s_suppkey), 6) AS coldest_month FROM q LEFT JOIN dy USING (s_suppkey)")
def sql_answer_lateral(s, d):
    """Three operators for every supplier's station and year."""
    _registered(s, d)
    ad.table(s, d, "supplier").createOrReplaceTempView("daybook_asked")
    found = s.sql(f"""
        WITH q AS (SELECT s_suppkey, {_AT} AS station_id, make_date(1995 + s_suppkey % 5, 1, 1) AS a, make_date(1995 + s_suppkey % 5, 12, 31) AS b, (s_suppkey % 7) / 10D AS t FROM daybook_asked)
        SELECT s_suppkey, x.mean, x.n_days, e.n_events, e.max AS wettest, p.min AS coldest_month
        FROM q, LATERAL day_summary(q.station_id, 'TMAX', q.a, q.b) x, LATERAL event_summary(q.station_id, 'PRCP', q.a, q.b, NULL, '>=', q.t) e, LATERAL period_summary(q.station_id, 'TMIN', 'month', 'mean', q.a, q.b) p""")
    return r6(found, "mean", "wettest", "coldest_month")


@query("sql_named_parameters", _w(_SHORT, _days("obs_short", "TMIN", ("1996-01-01", "2000-12-31"), "station_id = 'RN' AND month(obs_date) IN (1, 2, 12)", "TMIN <= 20")) + "SELECT obs_date, value, hit FROM d")
def sql_named_parameters(s, d):
    _registered(s, d)
    return sql_functions.days_asked(s, "RN", "TMIN", "1996-01-01", "2000-12-31", [12, 1, 2], "<=", 20.0)


# --- many requests

_REQUESTS = f"""
q AS (SELECT s_suppkey::BIGINT AS request_id, {_AT} AS station_id, CASE s_suppkey % 2 WHEN 0 THEN 'TMAX' ELSE 'PRCP' END AS metric, ['mean', 'sum', 'max', 'min', 'count', 'median'][1 + s_suppkey // 2 % 6] AS aggregation,
  ['day', 'event', 'month', 'year'][1 + s_suppkey // 12 % 4] AS unit, make_date(1993 + s_suppkey % 6, 1, 1) AS a, make_date(1997 + s_suppkey % 9, 12, 31) AS b, CASE WHEN s_suppkey % 2 = 0 THEN 70::DOUBLE ELSE 0.2::DOUBLE END AS t FROM supplier),
dq AS (SELECT q.*, obs_date, CASE metric WHEN 'TMAX' THEN TMAX ELSE PRCP END AS v FROM q JOIN obs_short o ON o.station_id = q.station_id AND obs_date BETWEEN a AND b),
b AS (SELECT request_id, v, 1 AS n, (v >= t)::INT AS hit FROM dq WHERE unit = 'day' AND v IS NOT NULL
  UNION ALL SELECT request_id, sum(v), 1, 1 FROM (SELECT *, obs_date - (row_number() OVER (PARTITION BY request_id ORDER BY obs_date))::INT AS g FROM dq WHERE unit = 'event' AND v >= t) GROUP BY request_id, g
  UNION ALL SELECT request_id, sum(v), 1, 1 FROM dq WHERE unit = 'month' GROUP BY request_id, year(obs_date), month(obs_date) HAVING count(v) >= 0.9 * day(last_day(min(obs_date)))
  UNION ALL SELECT request_id, sum(v), 1, 1 FROM dq WHERE unit = 'year' GROUP BY request_id, year(obs_date) HAVING count(v) >= 0.9 * (make_date(year(obs_date) + 1, 1, 1) - make_date(year(obs_date), 1, 1))),
s AS (SELECT request_id, count(*) AS n, sum(hit)::DOUBLE AS hits, avg(v) AS mean, sum(v) AS sum, max(v) AS max, min(v) AS min, median(v) AS median FROM b GROUP BY 1)"""


@query("answer_requests", _w(_SHORT, _REQUESTS) + "SELECT request_id, round(CASE aggregation WHEN 'mean' THEN mean WHEN 'sum' THEN sum WHEN 'max' THEN max WHEN 'min' THEN min WHEN 'median' THEN median ELSE coalesce(hits, 0) END, 6) AS value, coalesce(n, 0)::BIGINT AS n FROM q LEFT JOIN s USING (request_id)")
def answer_requests(s, d):
    """A request for each supplier, of four units and six aggregations."""
    k = F.col("s_suppkey")
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))
    asked = ad.table(s, d, "supplier").select(
        k.cast("long").alias("request_id"), pick(["RA", "RN", "RR"], k % 3).alias("station_id"), pick(["TMAX", "PRCP"], k % 2).alias("metric"), pick(["mean", "sum", "max", "min", "count", "median"], F.floor(k / 2) % 6).alias("aggregation"),
        pick(["day", "event", "month", "year"], F.floor(k / 12) % 4).alias("unit"), F.make_date((1993 + k % 6).cast("int"), F.lit(1), F.lit(1)).alias("start"), F.make_date((1997 + k % 9).cast("int"), F.lit(12), F.lit(31)).alias("end"),
        F.lit(None).cast("array<int>").alias("months"), F.lit(">=").alias("operator"), F.when(k % 2 == 0, 70.0).otherwise(0.2).alias("threshold"), F.when(F.floor(k / 12) % 4 == 1, "total").otherwise("sum").alias("how"),
    )
    return r6(requests.answered(asked, ad.obs_short(s, d)), "value")


# --- stored sums


@query("climate_from_state", SQL["climate_answer"])
def climate_from_state(s, d):
    """A year beside normals and records that are read from stored sums: the history is summed once, then later days are added."""
    store, name = Store(s, work.work_path(s, "sums")), "calendar_days"
    days = daily.daily_values(ad.obs_long(s, d), "TMAX", "1800-01-01", TODAY)
    for k, (first, last) in enumerate([("1800-01-01", "2019-06-30"), ("2019-07-01", TODAY)]):
        some = days.filter(F.col("obs_date").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))
        state.advance(store, name, state.sums(some, "TMAX", *state.ALL_YEARS).unionByName(state.sums(some, "TMAX", 1981, 2010)), ("load", k))
    asked = structured.Query("TMAX", "series", "day", display="climate", baseline=(1981, 2010), start="2019-01-01", end="2019-12-31")
    found = structured.answer(ad.obs_long(s, d), structured.apply_defaults(asked, date.fromisoformat(TODAY)), date.fromisoformat(TODAY), store.read(name))
    return found.select("station_id", "x", "value", "record_high", "record_high_year", "record_set")


# --- landed answers

_STEP = "day(obs_date) % 9"
_VALUES = "coalesce(TMAX::INT::VARCHAR, 'M') AS maxt, coalesce(TMIN::INT::VARCHAR, 'M') AS mint, CASE WHEN PRCP > 0 THEN 'T' ELSE 'M' END AS pcpn"


def _landed(s, d):
    """Observations written as answers, a line each, some of them broken in ways that depend on the day, and read again."""
    text = lambda c: F.coalesce(F.col(c).cast("int").cast("string"), F.lit("M"))
    row = F.array(F.col("obs_date").cast("string"), text("TMAX"), text("TMIN"), F.when(F.col("PRCP") > 0, "T").otherwise("M"), F.lit("M"), F.lit("M"))
    step = F.day("obs_date") % 9
    none = F.lit(None).cast("string")
    data = F.when(step == 3, F.array().cast("array<array<string>>")).when(step == 4, F.array(F.slice(row, 1, 3))).otherwise(F.array(row))
    line = F.to_json(F.struct(F.when(step == 5, none).otherwise(F.col("station_id")).alias("station_id"), data.alias("data")))
    path = work.work_path(s, "answers")
    ad.obs_short(s, d).select(F.when(step == 6, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    return payloads.landed(s, path)


@query("acis_landed", _w(_SHORT) + f"""SELECT station_id, obs_date, variable, value FROM (SELECT station_id, obs_date, unnest(['maxt', 'mint', 'pcpn', 'snow', 'snwd']) AS variable, unnest([maxt, mint, pcpn, 'M', 'M']) AS value, maxt = 'M' AND mint = 'M' AND pcpn = 'M' AS none
  FROM (SELECT station_id, obs_date, {_VALUES} FROM obs_short WHERE {_STEP} NOT IN (3, 4, 5, 6))) WHERE NOT none""")  # fmt: skip
def acis_landed(s, d):
    return payloads.observations(_landed(s, d))


@query("acis_rejects", _w(_SHORT) + f"SELECT CASE {_STEP} WHEN 3 THEN 'no data' WHEN 4 THEN 'short row' WHEN 5 THEN 'no station' ELSE 'not JSON' END AS reason, count(*) AS n FROM obs_short WHERE {_STEP} IN (3, 4, 5, 6) GROUP BY 1")
def acis_rejects(s, d):
    return payloads.rejects(_landed(s, d)).groupBy("reason").agg(F.count("*").alias("n"))


# --- ends of landed files

LINE_BYTES = 21 + 31 * 8 + 1
_TAIL = "mm AS (SELECT *, dense_rank() OVER (PARTITION BY station_id ORDER BY year(obs_date) * 12 + month(obs_date) DESC) AS back FROM obs_short)"


@query("tail_parse_dly", _w(_SHORT, _TAIL) + "SELECT station_id, obs_date, 'TMAX' AS variable, CASE WHEN TMAX IS NOT NULL THEN TMAX * 10 END::DOUBLE AS value, CASE WHEN day(obs_date) % 10 = 0 THEN 'X' END AS qflag FROM mm WHERE back <= 24")
def tail_parse_dly(s, d):
    """A landed file a station; the last 24 months of each, from the files' last bytes."""
    path = work.work_path(s, "archive")
    lines = month_lines(s, d).withColumn("st", F.col("station_id"))
    lines.repartition("st").sortWithinPartitions("st", "y", "m").select("st", "value").write.partitionBy("st").text(path)
    files.register(s)
    tail = s.read.format("tail_lines").option("tail_bytes", 24 * LINE_BYTES).load(path)
    return parse.daily_lines(tail).withColumn("station_id", F.trim("station_id")).drop("mflag", "sflag")
