"""Operators on points: normals, anomalies, smoothing, trends, running totals, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bucket_year, rounded, season_day
from ..functions.vocabulary import AMOUNTS, NORMAL_SHARE, SMOOTHING


def day_normals(climatology: DataFrame, years: int) -> DataFrame:
    """Calendar-day means with values in at least four fifths of the years; 02-29 always."""
    return climatology.filter((F.col("n_years") >= NORMAL_SHARE * years) | (F.col("day") == "02-29")).select("station_id", "day", F.col("value").alias("normal"), F.col("stddev").alias("normal_stddev"))


def month_normals(climatology: DataFrame, years: int) -> DataFrame:
    return climatology.filter(F.col("n_years") >= NORMAL_SHARE * years).select("station_id", "month", F.col("value").alias("normal"), F.col("stddev").alias("normal_stddev"))


def year_normals(found: DataFrame) -> DataFrame:
    """Mean and sample deviation of complete buckets; 0 for one bucket."""
    return found.groupBy("station_id").agg(F.avg("value").alias("normal"), F.coalesce(F.stddev("value"), F.lit(0.0)).alias("normal_stddev"), F.count("*").alias("n_years"))


def overlay(points: DataFrame, normals: DataFrame, key: list[str]) -> DataFrame:
    """Points with normal, lower, upper and anomaly."""
    return points.join(normals, key, "left").select(
        *points.columns, "normal", rounded(F.col("normal") - F.col("normal_stddev"), 4).alias("lower"), rounded(F.col("normal") + F.col("normal_stddev"), 4).alias("upper"), rounded(F.col("value") - F.col("normal"), 4).alias("anomaly")
    )


def smoothed(climatology: DataFrame, column: str = "value", reach: int = SMOOTHING) -> DataFrame:
    """Circular mean over ``reach`` calendar days to both sides, among the days present."""
    w = Window.partitionBy("station_id")
    placed = climatology.select("station_id", "day", F.col(column).alias("v"), F.row_number().over(w.orderBy("day")).alias("i"), F.count("*").over(w).alias("n"))
    # Only the days near each end are repeated beyond the other end.
    shifted = placed.withColumn("shift", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("p", (F.col("i") + F.col("shift") * F.col("n")).cast("long")).filter(F.col("p").between(1 - reach, F.col("n") + reach))
    mean = F.avg("v").over(w.orderBy("p").rangeBetween(-reach, reach))
    return shifted.withColumn("smoothed", rounded(mean, 4)).filter("shift = 0").select("station_id", "day", "smoothed")


def trend(points: DataFrame, x: str) -> DataFrame:
    """Least-squares slope for ten units of ``x`` and its intercept; three points at least."""
    return points.groupBy("station_id").agg(F.regr_slope("value", x).alias("s"), F.regr_intercept("value", x).alias("i"), F.count("value").alias("n")).filter("n >= 3").select("station_id", rounded(F.col("s") * 10, 2).alias("per_decade"), rounded(F.col("i"), 4).alias("intercept"), "n")


def running_total(days: DataFrame, start_month: int = 7) -> DataFrame:
    """(station_id, season, obs_date, day, daily, total): totals since each season's first day."""
    season = bucket_year(F.col("obs_date"), start_month)
    rows = days.filter(F.col("value").isNotNull()).select("station_id", season.alias("season"), "obs_date", season_day(F.col("obs_date"), start_month).alias("day"), F.col("value").alias("daily"))
    w = Window.partitionBy("station_id", "season").orderBy("obs_date").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("total", rounded(F.sum("daily").over(w), 2))


def aligned_totals(totals: DataFrame, seasons: list[int]) -> DataFrame:
    """Running totals of several seasons side by side by day of season."""
    return totals.groupBy("station_id", "day").pivot("season", seasons).agg(F.max("total")).select("station_id", "day", *[F.col(str(s)).alias(f"total_{s}") for s in seasons])


def difference(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """a - b where both have a point."""
    return a.select(*key, F.col("value").alias("a")).join(b.select(*key, F.col("value").alias("b")), key).withColumn("difference", rounded(F.col("a") - F.col("b"), 4))


def growing_season(spring: DataFrame, fall: DataFrame) -> DataFrame:
    """Days from the last date in spring to the first one in fall, by year."""
    s = spring.select("station_id", "year", F.col("last").alias("spring")).filter("spring IS NOT NULL")
    f = fall.select("station_id", "year", F.col("first").alias("fall")).filter("fall IS NOT NULL")
    return s.join(f, ["station_id", "year"]).withColumn("days", F.datediff("fall", "spring"))


def histogram_stats(counts: DataFrame) -> DataFrame:
    """Median, 10th and 90th percentile, most frequent value (the lowest of several) and days of a histogram."""
    p = lambda q: rounded(F.percentile("value", F.lit(q), F.col("count")), 4)
    return counts.groupBy("station_id").agg(p(0.5).alias("median"), p(0.1).alias("p10"), p(0.9).alias("p90"), F.max_by("value", F.struct("count", -F.col("value"))).alias("mode"), F.sum("count").alias("n"))


def without_zeros(counts: DataFrame, metric: str) -> DataFrame:
    """A histogram of amounts leaves out the days with none."""
    return counts.filter(F.col("value") > 0) if metric in AMOUNTS else counts


def whole_bins(counts: DataFrame, width: float) -> DataFrame:
    """Counts by bin from the lowest value's on, with the empty ones between: bin, bin_end, count and percent."""
    low = F.floor(F.min("value") / width)
    spans = counts.groupBy("station_id").agg(low.alias("a"), F.floor(F.max("value") / width + 1e-9).alias("b"), F.sum("count").alias("total"))
    grid = spans.select("station_id", "total", F.explode(F.sequence("a", "b")).alias("k"))
    filled = counts.groupBy("station_id", F.floor(F.col("value") / width + 1e-9).alias("k")).agg(F.sum("count").alias("count"))
    made = grid.join(filled, ["station_id", "k"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return made.select("station_id", F.round(F.col("k") * width, 2).alias("bin"), F.round((F.col("k") + 1) * width, 2).alias("bin_end"), "count", rounded(100 * F.col("count") / F.col("total"), 1).alias("pct"))


def bins(counts: DataFrame, width: float) -> DataFrame:
    """Counts by bin of the given width, and their share in percent."""
    made = counts.groupBy("station_id", (F.floor(F.col("value") / width) * width).cast("double").alias("bin")).agg(F.sum("count").alias("count"))
    return made.withColumn("pct", rounded(100 * F.col("count") / F.sum("count").over(Window.partitionBy("station_id")), 4))


def nice_width(low: float, high: float, parts: int = 20) -> float:
    """The least of 1, 2 and 5 times a power of ten that cuts the span in at most ``parts`` bins."""
    import math

    raw = max(high - low, 1e-9) / parts
    power = 10.0 ** math.floor(math.log10(raw))
    return next(m * power for m in (1, 2, 5, 10) if m * power >= raw * (1 - 1e-12))


def date_summary(found: DataFrame, column: str, start_month: int = 1) -> DataFrame:
    """Of yearly dates: the upper median by day of season, the earliest and latest (ties: the latest year), years with and without."""
    day = season_day(F.col(column), start_month)
    rows = found.withColumn("d", F.when(F.col(column).isNotNull(), day))
    some = F.col("d").isNotNull()
    made = rows.groupBy("station_id").agg(
        F.sort_array(F.collect_list("d")).alias("ds"), F.min(F.when(some, F.struct("d", (-F.col("year")).alias("y")))).alias("lo"), F.max(F.when(some, F.struct("d", F.col("year").alias("y")))).alias("hi"),
        F.count("d").alias("years_counted"), F.count_if(~some).alias("years_without"),
    ).filter("years_counted > 0")
    return made.select("station_id", F.get("ds", F.floor(F.size("ds") / 2).cast("int")).alias("typical_day"), F.col("lo.d").alias("earliest_day"), (-F.col("lo.y")).alias("earliest_year"), F.col("hi.d").alias("latest_day"), F.col("hi.y").alias("latest_year"), "years_counted", "years_without")


def date_answer(found: DataFrame, column: str, start_month: int = 1) -> DataFrame:
    """One row a station from its yearly dates. Of one year: its date. Of several: the upper median by day
    of season, all dates of the earliest and of the latest day, and the years with and without.

    A station's years are few, so their list is bounded.
    """
    date, day = F.col(column), season_day(F.col(column), start_month)
    rows = found.withColumn("_p", F.when(date.isNotNull(), F.struct(day.alias("d"), date.alias("date"))))
    made = rows.groupBy("station_id").agg(
        F.sort_array(F.collect_list("_p")).alias("p"), F.count("*").alias("years_counted"), F.count_if(date.isNull()).alias("years_without"), F.min("year").alias("first_year"), F.max("year").alias("last_year")
    )
    one, some = F.col("years_counted") == 1, F.size("p") > 0
    many = ~one & some
    tied = lambda k: F.when(many, F.array_sort(F.transform(F.filter("p", lambda x: x["d"] == F.element_at("p", k)["d"]), lambda x: x["date"])))
    return made.select(
        "station_id", F.when(one & some, F.element_at("p", 1)["date"]).alias("value"), F.when(one, F.col("first_year")).alias("bucket_year"),
        F.when(many, F.date_format(F.element_at("p", (F.floor(F.size("p") / 2) + 1).cast("int"))["date"], "MM-dd")).alias("typical_date"),
        tied(1).alias("earliest_on_record"), tied(-1).alias("latest_on_record"),
        F.when(~one, F.col("first_year")).alias("first_year"), F.when(~one, F.col("last_year")).alias("last_year"), "years_counted", "years_without",
    )


def calendar_day(climatology: DataFrame, day: str, what: str) -> DataFrame:
    """One calendar day of a :func:`..periods.day_of_year` result: what is "max" or "min" (the record and its
    latest year), "any" (percent of years) or "mean" (the normal, smoothed over the days around it)."""
    own = climatology.filter(F.col("day") == day)
    if what == "mean":
        value, year = F.col("smoothed"), F.lit(None).cast("int")
        own = own.join(smoothed(climatology).filter(F.col("day") == day).drop("day"), "station_id")
    elif what == "any":
        value, year = rounded(100 * F.col("value"), 1), F.lit(None).cast("int")
    else:
        value, year = F.col(what), F.col(f"{what}_year")
    return own.select("station_id", F.col("day").alias("calendar_day"), value.alias("value"), "n_years", year.alias("record_year"))


def days_observed(days: DataFrame, start: str, end: str, months: list[int] | None = None) -> DataFrame:
    """Days with a value, and days that the range has."""
    calendar = F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
    inside = F.size(F.filter(calendar, lambda d: F.month(d).isin(*months)) if months else calendar)
    return days.groupBy("station_id").agg(F.count("value").alias("observed")).withColumn("in_range", inside)


def climate_graph(high: DataFrame, low: DataFrame, high_normals: DataFrame, low_normals: DataFrame, records: DataFrame) -> DataFrame:
    """Daily highs and lows by date with normals and the records before the range; record_set names a record met."""
    both = high.select("station_id", "obs_date", F.col("value").alias("tmax")).join(low.select("station_id", "obs_date", F.col("value").alias("tmin")), ["station_id", "obs_date"], "full_outer").withColumn("day", F.date_format("obs_date", "MM-dd"))
    h = high_normals.select("station_id", "day", F.col("normal").alias("normal_high"))
    n = low_normals.select("station_id", "day", F.col("normal").alias("normal_low"))
    made = both.join(h, ["station_id", "day"], "left").join(n, ["station_id", "day"], "left").join(records, ["station_id", "day"], "left")
    mark = F.when(F.col("tmax") >= F.col("record_high"), "high").when(F.col("tmin") <= F.col("record_low"), "low")
    return made.withColumn("record_set", mark)
