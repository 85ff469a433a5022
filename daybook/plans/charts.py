"""Series with what is drawn beside them: normals, anomalies, records, running totals, trends, pairs of series.

Every function takes and gives DataFrames for all stations at once; a chart's points have
``x`` (a date, or the number of a calendar month or season) and ``x_num`` (for trends).
"""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.columns import celsius, decimals, rounded, season_day
from ..operators import analysis as an
from ..operators import state as summed
from .query import Query, raw_series


def normals_query(q: Query) -> Query | None:
    """The query of a series' normals: the baseline's years at the series' grain; None without a baseline."""
    if not q.baseline:
        return None
    first, last = q.baseline
    plain = replace(q, display=None, trend=False, baseline=None, output_unit=None, start=f"{first}-01-01", end=f"{last}-12-31")
    if q.unit == "snow_season":
        return replace(plain, start=f"{first - 1}-07-01", end=f"{last}-06-30")
    return replace(plain, unit={"day": "day_of_year", "month": "month_of_year", "season": "season_of_year"}.get(q.unit, q.unit), season=None if q.unit == "season" else q.season)


def records_query(q: Query, today: date) -> Query | None:
    """The query of the records that a climate graph shows: the whole record by calendar day."""
    if q.display != "climate":
        return None
    return replace(q, unit="day_of_year", display=None, trend=False, baseline=None, output_unit=None, period_aggregation=None, start=v.ALL_TIME, end=today.isoformat())


def digits(q: Query) -> int:
    return 1 if q.period_aggregation == "count" else decimals(q.metric)


def in_celsius(q: Query) -> bool:
    return q.output_unit == "C" and q.metric in v.TEMPERATURES and q.period_aggregation not in ("count", "any")


def reading(q: Query, value: Column) -> Column:
    """A value in the asked unit, rounded."""
    return rounded(celsius(value) if in_celsius(q) else value, digits(q))


def spread(q: Query, value: Column) -> Column:
    """A deviation in the asked unit, which has no offset."""
    return value * 5 / 9 if in_celsius(q) else value


def time_points(found: DataFrame, q: Query) -> DataFrame:
    """station_id, x, x_num, year, month and value of a daily, monthly or yearly series."""
    value = reading(q, F.col("value")).alias("value")
    if q.unit == "day":
        at = F.col("obs_date")
        return found.select("station_id", at.alias("x"), (F.year(at) + (F.dayofyear(at) - 0.5) / 365.25).alias("x_num"), F.year(at).alias("year"), F.month(at).alias("month"), value)
    year, month = F.col("bucket_year"), F.col("bucket_month")
    number = year + (month - 0.5) / 12 if q.unit == "month" else year.cast("double")
    return found.select("station_id", F.make_date(year, F.coalesce(month, F.lit(1)), F.lit(1)).alias("x"), number.alias("x_num"), year.alias("year"), month.alias("month"), value)


def climatology_points(found: DataFrame, q: Query) -> DataFrame:
    """A climatology's points: smoothed by calendar day, percents for odds, lower and upper by the deviation, daily records."""
    key = {"day_of_year": "day", "week_of_year": "week", "month_of_year": "month", "season_of_year": "season"}[q.unit]
    if q.unit == "day_of_year":
        for column in ("value", "stddev"):
            found = found.join(an.smoothed(found, column).withColumnRenamed("smoothed", f"_{column}"), ["station_id", "day"], "left")
        found = found.withColumns({c: F.col(f"_{c}") for c in ("value", "stddev")}).drop("_value", "_stddev")
    if q.period_aggregation == "any":
        return found.select("station_id", F.col(key).alias("x"), rounded(100 * F.col("value"), 1).alias("value"), "n_years")
    value, sd = reading(q, F.col("value")), rounded(spread(q, F.col("stddev")), digits(q))
    records = [] if q.unit != "day_of_year" else [reading(q, F.col("max")).alias("record_high"), F.col("max_year").alias("record_high_year"), reading(q, F.col("min")).alias("record_low"), F.col("min_year").alias("record_low_year")]
    return found.select("station_id", F.col(key).alias("x"), value.alias("value"), sd.alias("stddev"), rounded(value - sd, digits(q)).alias("lower"), rounded(value + sd, digits(q)).alias("upper"), "n_years", *records)


def by_day(obs: DataFrame, q: Query, state: DataFrame | None) -> DataFrame:
    """A calendar-day query's points: from stored sums where there are some (:mod:`operators.state`), else from the days."""
    if state is None or q.unit != "day_of_year" or q.period_aggregation == "any":
        return raw_series(obs, q)
    first, last = (summed.ALL_YEARS if q.start == v.ALL_TIME else (int(q.start[:4]), int(q.end[:4])))
    found = summed.day_of_year(state, q.metric, first, last)
    return found if q.station is None else found.filter(F.col("station_id") == q.station)


def normals(obs: DataFrame, q: Query, state: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """(station_id, key columns, normal, normal_stddev) of the baseline, unrounded, where enough of its years have a value."""
    base = normals_query(q)
    found = by_day(obs, base, state)
    years = q.baseline[1] - q.baseline[0] + 1
    if q.unit == "day":
        both = an.smoothed(found).withColumnRenamed("smoothed", "normal").join(an.smoothed(found, "stddev").withColumnRenamed("smoothed", "normal_stddev"), ["station_id", "day"])
        enough = found.filter((F.col("n_years") >= v.NORMAL_SHARE * years) | (F.col("day") == "02-29")).select("station_id", "day")
        return both.join(enough, ["station_id", "day"]), ["day"]
    if q.unit == "month":
        return an.month_normals(found, years), ["month"]
    if q.unit == "season":
        own = found.filter((F.col("season") == q.season) & (F.col("n_years") >= v.NORMAL_SHARE * years))
        return own.select("station_id", F.col("value").alias("normal"), F.col("stddev").alias("normal_stddev")), []
    return an.year_normals(found).filter(F.col("n_years") >= v.NORMAL_SHARE * years).drop("n_years"), []


def with_normals(points: DataFrame, obs: DataFrame, q: Query, state: DataFrame | None = None) -> DataFrame:
    """Adds normal, lower, upper and anomaly."""
    base, key = normals(obs, q, state)
    rows = points.withColumn("day", F.date_format("x", "MM-dd")) if q.unit == "day" else points
    n = digits(q)
    normal, sd = reading(q, F.col("normal")), spread(q, F.col("normal_stddev"))
    made = rows.join(base, ["station_id", *key], "left").withColumns({"lower": rounded(normal - sd, n), "upper": rounded(normal + sd, n), "normal": normal, "anomaly": rounded(F.col("value") - normal, n)})
    return made.drop("normal_stddev", "day")


def with_records(points: DataFrame, obs: DataFrame, q: Query, today: date, state: DataFrame | None = None) -> DataFrame:
    """Adds each calendar day's records with their years, and record_set where a day meets one."""
    found = by_day(obs, records_query(q, today), state)
    records = found.select("station_id", "day", reading(q, F.col("max")).alias("record_high"), F.col("max_year").alias("record_high_year"), reading(q, F.col("min")).alias("record_low"), F.col("min_year").alias("record_low_year"))
    made = points.withColumn("day", F.date_format("x", "MM-dd")).join(records, ["station_id", "day"], "left").drop("day")
    met = F.when(F.col("value") >= F.col("record_high"), "high") if q.metric == "TMAX" else F.when(F.col("value") <= F.col("record_low"), "low") if q.metric == "TMIN" else F.lit(None).cast("string")
    return made.withColumn("record_set", met)


def running(points: DataFrame, q: Query) -> DataFrame:
    """Totals from the range's first day on, and the normal total where there are normals; x_day counts days from the first."""
    w = Window.partitionBy("station_id").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    n, total = digits(q), F.sum("value").over(w)
    made = points.withColumn("daily", F.col("value")).withColumn("_total", rounded(total, n))
    if "normal" in points.columns:
        so_far = F.when(F.col("normal").isNotNull(), rounded(F.sum("normal").over(w), n))
        made = made.withColumn("normal", so_far).withColumn("anomaly", rounded(F.col("_total") - F.col("normal"), n)).drop("lower", "upper")
    return made.withColumn("value", F.col("_total")).drop("_total").withColumn("x_day", F.datediff("x", F.to_date(F.lit(q.start))))


def with_trend(points: DataFrame, column: str = "value", number: str = "x_num") -> DataFrame:
    """Adds the least-squares line: per_decade, and trend, its value at each point; null for under three points."""
    lines = points.filter(F.col(column).isNotNull()).groupBy("station_id").agg(F.regr_slope(column, number).alias("_s"), F.regr_intercept(column, number).alias("_i"), F.count("*").alias("_n")).filter("_n >= 3")
    made = points.join(lines, "station_id", "left")
    return made.withColumns({"per_decade": rounded(F.col("_s") * 10, 2), "trend": rounded(F.col("_s") * F.col(number) + F.col("_i"), 2)}).drop("_s", "_i", "_n")


def date_points(found: DataFrame, q: Query) -> DataFrame:
    """Yearly first or last dates: station_id, x_num (the year), date and value (its day in the season); years without one are left out."""
    which = "first" if "first_date" in (q.aggregation, q.period_aggregation) else "last"
    start = 7 if q.unit == "snow_season" else 1
    return found.filter(F.col(which).isNotNull()).select("station_id", F.col("year").cast("double").alias("x_num"), "year", F.col(which).alias("date"), season_day(F.col(which), start).alias("value"))


def series(obs: DataFrame, q: Query, today: date, state: DataFrame | None = None) -> DataFrame:
    """The points of one series as its display, baseline, trend and output unit ask."""
    found = raw_series(obs, q)
    if q.period_aggregation in ("first_date", "last_date"):
        points = date_points(found, q)
        return with_trend(points) if q.trend else points
    if q.unit == "value":
        counts = an.without_zeros(found, q.metric)
        if in_celsius(q):
            counts = counts.withColumn("value", celsius(F.col("value")))
        return an.whole_bins(counts, v.HISTOGRAM_WIDTHS.get(q.metric, v.HISTOGRAM_WIDTHS["C" if in_celsius(q) else "F"]))
    if q.unit in v.CLIMATOLOGY_UNITS:
        return climatology_points(found, q)
    points = time_points(found, q)
    if q.display == "histogram":
        return spread_of(points)
    if q.baseline:
        points = with_normals(points, obs, q, state)
    if q.display == "climate":
        points = with_records(points, obs, q, today, state)
    if q.display == "cumulative":
        points = running(points, q)
    return with_trend(points, "anomaly" if q.display == "anomaly" else "value") if q.trend else points


def spread_of(points: DataFrame, parts: int = 10) -> DataFrame:
    """A histogram of a series' values, each station's bins as wide as the least of 1, 2 and 5 times a power of ten that needs ``parts`` of them at most."""
    span = points.groupBy("station_id").agg(((F.max("value") - F.min("value")) / parts).alias("raw"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("total"))
    power = F.pow(F.lit(10.0), F.floor(F.log10("raw")))
    ratio = F.col("raw") / power
    width = F.when(F.col("raw") <= 0, 1.0).otherwise(power * F.when(ratio <= 1 + 1e-12, 1.0).when(ratio <= 2, 2.0).when(ratio <= 5, 5.0).otherwise(10.0))
    span = span.withColumn("width", width)
    grid = span.select("station_id", "width", "total", F.explode(F.sequence(F.floor(F.col("low") / F.col("width")), F.floor(F.col("high") / F.col("width") + 1e-9))).alias("k"))
    counted = points.filter(F.col("value").isNotNull()).join(span.select("station_id", "width"), "station_id").groupBy("station_id", F.floor(F.col("value") / F.col("width") + 1e-9).alias("k")).agg(F.count("*").alias("count"))
    made = grid.join(counted, ["station_id", "k"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return made.select("station_id", F.round(F.col("k") * F.col("width"), 6).alias("bin"), F.round((F.col("k") + 1) * F.col("width"), 6).alias("bin_end"), "count", rounded(100 * F.col("count") / F.col("total"), 1).alias("pct"))


def difference(a: DataFrame, b: DataFrame, trend: bool = False) -> DataFrame:
    """One station's points less another's where both have one, and the trend of the gap."""
    other = b.select("x", F.col("value").alias("_b"))
    gap = a.join(other, "x").filter(F.col("value").isNotNull() & F.col("_b").isNotNull())
    points = gap.select("station_id", "x", "x_num", rounded(F.col("value") - F.col("_b"), 2).alias("value"))
    return with_trend(points) if trend else points


def growing_season(spring: DataFrame, fall: DataFrame, trend: bool = False) -> DataFrame:
    """Days from the last spring date to the first fall date of each year that has both."""
    f = fall.select("station_id", "year", F.col("date").alias("fall"))
    points = spring.select("station_id", "year", "x_num", F.col("date").alias("spring")).join(f, ["station_id", "year"]).withColumn("value", F.datediff("fall", "spring"))
    return with_trend(points) if trend else points


def climograph(members: dict[str, DataFrame]) -> DataFrame:
    """Monthly climatologies side by side: station_id, x and a column a series."""
    out = None
    for name, points in members.items():
        own = points.select("station_id", "x", F.col("value").alias(name))
        out = own if out is None else out.join(own, ["station_id", "x"], "full_outer")
    return out


def chart(obs: DataFrame, queries: list[Query], today: date) -> DataFrame:
    """The points of the series that one chart shows: a pair for a difference or a growing season, a
    climograph's months, or several series under each other, told apart by ``series``."""
    q = queries[0]
    if q.display == "difference":
        return difference(series(obs, queries[0], today), series(obs, queries[1], today), any(x.trend for x in queries))
    if q.display == "growing_season":
        spring, fall = sorted(queries, key=lambda x: x.period_aggregation, reverse=True)
        return growing_season(series(obs, spring, today), series(obs, fall, today), any(x.trend for x in queries))
    if q.display == "climograph":
        return climograph({x.metric: series(obs, x, today) for x in queries})
    out = None
    for x in queries:
        own = series(obs, x, today).withColumn("series", F.lit(x.metric))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def ranking(rows: DataFrame, by: str = "value") -> DataFrame:
    """A ranking's rows as bars from the first: station_id, x (0 on), label, rank and value (``by``)."""
    label = F.concat_ws(" to ", *[F.col(c).cast("string") for c in ("event_start", "event_end")]) if "event_start" in rows.columns else F.col("obs_date").cast("string") if "obs_date" in rows.columns else F.concat_ws("-", F.col("bucket_year").cast("string"), F.lpad(F.col("bucket_month").cast("string"), 2, "0"))
    at = "event_start" if "event_start" in rows.columns else "obs_date" if "obs_date" in rows.columns else "bucket_year"
    order = [at, *["bucket_month"] * ("bucket_month" in rows.columns)]
    x = F.row_number().over(Window.partitionBy("station_id").orderBy("rank", *order)) - 1
    return rows.select("station_id", x.alias("x"), label.alias("label"), "rank", F.col(by).alias("value"))


def summary(points: DataFrame, q: Query) -> DataFrame:
    """What a sentence may say of a series, a row a station: its span, highest, lowest and mean, the departures
    from normal, the trend, and for a running total its end beside the normal one. Ties: the latest point."""
    x = "x" if "x" in points.columns else "x_num"
    rows = points.filter(F.col("value").isNotNull())
    if q.display == "cumulative":
        last = lambda c: F.max_by(c, x).alias(f"{c}_to_date")
        return rows.groupBy("station_id").agg(F.min(x).alias("first"), F.max(x).alias("last"), *[last(c) for c in ("value", "normal", "anomaly") if c in points.columns])
    n = digits(q)
    made = [F.count("*").alias("points"), F.min(x).alias("first"), F.max(x).alias("last"), F.max("value").alias("highest"), F.max_by(x, F.struct("value", x)).alias("highest_at"), F.min("value").alias("lowest"), F.max_by(x, F.struct(-F.col("value"), x)).alias("lowest_at"), rounded(F.avg("value"), n).alias("mean")]
    if "anomaly" in points.columns:
        some = F.when(F.col("anomaly").isNotNull(), F.struct(F.col("anomaly").alias("a"), F.col(x).alias("x")))
        low = F.when(F.col("anomaly").isNotNull(), F.struct((-F.col("anomaly")).alias("a"), F.col(x).alias("x")))
        made += [rounded(F.avg("anomaly"), n).alias("mean_departure"), F.max(some).alias("furthest_above"), F.max(low).alias("_low")]
    if "per_decade" in points.columns:
        made.append(F.first("per_decade").alias("per_decade"))
    if "record_set" in points.columns:
        made.append(F.sort_array(F.collect_list(F.when(F.col("record_set").isNotNull(), F.struct(F.col(x).alias("x"), "record_set")))).alias("records"))
    out = rows.groupBy("station_id").agg(*made)
    return out.withColumn("furthest_below", F.struct((-F.col("_low.a")).alias("a"), F.col("_low.x").alias("x"))).drop("_low") if "_low" in out.columns else out
