"""A structured query: its fields, defaults, checks, and the plan it becomes."""

from __future__ import annotations

import calendar
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.columns import celsius
from ..operators import analysis, daily, events, periods, records


@dataclass(frozen=True)
class Threshold:
    operator: str
    value: float


@dataclass(frozen=True)
class Query:
    """One question about one metric; None in ``station`` asks it of every station."""

    metric: str | None = None
    aggregation: str = "mean"
    unit: str = "day"
    start: str | None = None
    end: str | None = None
    station: str | None = None
    threshold: Threshold | None = None
    event_day: Threshold | None = None
    event_value: str | None = None
    period_aggregation: str | None = None
    months: tuple[int, ...] | None = None
    limit: int | None = None
    season: str | None = None
    condition: str | None = None
    half_year: int | None = None
    calendar_day: str | None = None
    display: str | None = None
    trend: bool = False
    baseline: tuple[int, int] | None = None
    output_unit: str | None = None
    normal: bool = False
    asked_limit: int | None = None


DATE_AGGREGATIONS = ("first_date", "last_date")


def apply_defaults(q: Query, today: date) -> Query:
    """Fills what a question leaves open."""
    if q.condition:
        if q.condition not in v.CONDITIONS:
            raise ValueError(f"unknown condition: {q.condition}")
        metric, op, value = v.CONDITIONS[q.condition]
        q = replace(q, metric=q.metric or metric, threshold=q.threshold or Threshold(op, value))
    if q.half_year and not q.months:
        q = replace(q, months=tuple(range(1, 7) if q.half_year == 1 else range(7, 13)))
    if q.unit == "event":
        q = replace(q, event_value=q.event_value or "total", event_day=q.event_day or (Threshold(">=", 0.05 if q.metric == "PRCP" else 0.5) if q.metric in ("PRCP", "SNOW") else None))
    if q.period_aggregation is None and (q.unit in v.PERIOD_UNITS or (q.aggregation == "series" and q.unit in v.CLIMATOLOGY_UNITS)) and q.aggregation not in ("first_date", "last_date"):
        q = replace(q, period_aggregation=v.NATURAL.get(q.metric or "", "mean"))
    if q.start is None and q.end is None and (q.normal or (q.unit in v.CLIMATOLOGY_UNITS and q.aggregation in ("series", "mean"))):
        first, last = v.NORMAL_YEARS
        q = replace(q, start=f"{first}-01-01", end=f"{last}-12-31")
    return replace(q, start=q.start or v.ALL_TIME, end=q.end or today.isoformat())


def coerce(q: Query) -> tuple[Query, list[str]]:
    """Rank limits over the cap and series that would have too many points, with a note for each change."""
    notes = []
    if q.limit is not None and q.limit > v.RANK_MAX:
        notes.append(f"{q.limit} ranks were cut to {v.RANK_MAX}")
        q = replace(q, limit=v.RANK_MAX, asked_limit=q.limit)
    if q.limit == 1 and q.aggregation in ("max", "min"):
        q = replace(q, limit=None)
    if q.aggregation == "series" and q.unit == "day" and q.period_aggregation in ("mean", "sum"):
        q = replace(q, period_aggregation=None)  # a day is its own value
    if q.aggregation == "series" and q.start and q.end:
        span = (date.fromisoformat(q.end) - date.fromisoformat(q.start)).days
        if q.unit == "day" and span > v.DAILY_SPAN and q.display not in ("climate", "cumulative"):
            notes.append("days were changed to months")
            q = replace(q, unit="month", period_aggregation=q.period_aggregation or v.NATURAL.get(q.metric or "", "mean"))
        if q.unit == "month" and int(q.end[:4]) - int(q.start[:4]) + 1 > v.MONTHLY_YEARS:
            notes.append("months were changed to years")
            q = replace(q, unit="year")
    return q, notes


def problems(q: Query, today: date, known: set[str] | None = None) -> list[str]:
    """What is wrong with a query, a message for each rule."""
    out: list[str] = []
    rule = lambda ok, message: None if ok else out.append(message)
    series, ranks = q.aggregation == "series", q.aggregation in ("top", "bottom")
    dated = q.aggregation in ("first_date", "last_date") or q.period_aggregation in ("first_date", "last_date")
    rule(known is None or q.station is None or q.station in known, "the station isn't known")
    rule(q.metric in v.METRICS, "the metric isn't known")
    rule(q.aggregation in v.AGGREGATIONS, "the aggregation isn't known")
    rule(q.unit in v.UNITS, "the unit isn't known")
    rule(q.aggregation not in ("latest", "earliest") or q.unit == "event", "latest and earliest are for events")
    if q.unit == "event":
        rule(q.metric in ("PRCP", "SNOW"), "events are of rain or snow")
        rule(q.event_day is not None, "an event needs a threshold for its days")
        rule(q.event_value in ("total", "duration"), "an event's value is its total or duration")
    rule(q.limit is None or (ranks and isinstance(q.limit, int) and 1 <= q.limit <= v.RANK_MAX), f"a limit of 1 to {v.RANK_MAX} goes with top or bottom")
    rule(q.unit != "season" or q.season is not None, "the unit season needs a season")
    rule(q.unit == "season" or q.season is None or series, "a season goes with the unit season")
    rule(q.season is None or q.season in v.SEASONS, "the season isn't known")
    if q.calendar_day is not None:
        rule(q.unit == "day_of_year" and not series, "a calendar day goes with day_of_year")
        rule(_calendar_day(q.calendar_day), "a calendar day is MM-DD")
    if q.unit == "day_of_year" and not series:
        rule(q.calendar_day is not None, "day_of_year needs a calendar day")
        rule(q.aggregation in ("max", "min", "mean"), "a calendar day takes max, min or mean")
        rule(q.period_aggregation is None or (q.period_aggregation == "any" and q.aggregation == "mean" and q.threshold is not None), "a calendar day's odds are of a mean with a threshold")
    if q.aggregation in ("record_high", "record_low"):
        rule(q.metric in (("TMAX", "TMIN", "PRCP", "SNOW") if q.aggregation == "record_high" else ("TMIN",)), "the metric has no such records")
        rule(q.unit == "day" and q.threshold is None, "records are of days, without a threshold")
    if dated:
        rule(q.unit in ("year", "snow_season"), "first and last dates are by year or snow season")
        rule(q.threshold is not None, "first and last dates need a threshold")
    rule(q.aggregation != "count" or q.threshold is not None or q.unit == "event", "a count needs a threshold")
    rule(q.unit not in v.CLIMATOLOGY_UNITS or series or q.calendar_day is not None, "this unit is for series")
    rule(series or not (q.trend or q.baseline or q.display), "trend, baseline and display are for series")
    if q.unit in v.PERIOD_UNITS and not dated:
        allowed = ("mean", "sum", "count", "any") if series else ("mean", "sum")
        rule(q.period_aggregation in allowed, "the period aggregation doesn't fit")
    rule(q.unit != "snow_season" or q.metric == "SNOW" or (series and q.period_aggregation == "count"), "a snow season is of snow")
    rule(not (q.unit == "season" and q.metric == "SNOW"), "snow goes by snow season")
    for t in (q.threshold, q.event_day):
        rule(t is None or (t.operator in v.OPERATORS and isinstance(t.value, int | float) and not isinstance(t.value, bool)), "a threshold is an operator and a number")
    rule(q.condition is None or q.condition in v.CONDITIONS, "the condition isn't known")
    rule(q.condition is None or q.unit != "event", "a condition isn't for events")
    if q.condition in v.CONDITIONS and q.unit != "event":
        rule(q.metric == v.CONDITIONS[q.condition][0], "the condition is of another metric")
        rule(q.threshold is not None and v.CONDITIONS[q.condition][1:] == (q.threshold.operator, q.threshold.value), "the condition and the threshold differ")
    if q.months is not None:
        rule(len(q.months) > 0 and all(isinstance(m, int) and 1 <= m <= 12 for m in q.months), "months are numbers from 1 to 12")
        rule(q.unit in ("month", "value") or (q.unit == "day" and not series) or (dated and q.unit == "year"), "months go with days, months and yearly dates")
    if q.half_year is not None:
        rule(q.half_year in v.HALF_YEARS, "a half year is 1 or 2")
        rule(dated, "a half year goes with first and last dates")
        rule(q.unit != "snow_season", "a snow season needs no half year: it begins before fall")
        rule(q.unit in ("year", "snow_season"), "a half year is of the unit year")
        rule(q.unit != "year" or q.months == v.HALF_YEARS.get(q.half_year), "the half year and the months differ")
    rule(isinstance(q.normal, bool), "normal is true or left out")
    rule(q.trend in (True, False), "trend is true or left out")
    rule(q.output_unit in (None, "C", "F"), "the output unit is C or F")
    rule(q.display is None or q.display in v.DISPLAYS, "the display isn't known")
    if series:
        _series_problems(q, today, rule)
    try:
        start, end = date.fromisoformat(q.start or ""), date.fromisoformat(q.end or "")
        rule(start <= end, "the dates are out of order")
        rule(start >= date.fromisoformat(v.ALL_TIME), "the dates begin before all records")
        rule(start <= today, "the dates are in the future")
        rule(not (series and q.unit == "day") or (end - start).days <= v.DAILY_SPAN, "a daily series spans 366 days at most")
    except ValueError:
        out.append("the dates aren't given as YYYY-MM-DD")
    return out


def _series_problems(q: Query, today: date, rule) -> None:
    """Rules of what only a series may have."""
    marked = ("count", "any", *DATE_AGGREGATIONS)
    rule(q.unit != "event", "a series isn't of events")
    rule(q.period_aggregation not in marked or q.threshold is not None, "counted series, odds and dates need a threshold")
    rule(q.threshold is None or q.period_aggregation in marked, "a series has a threshold for counts, odds and dates alone")
    rule(q.period_aggregation != "any" or q.unit in v.CLIMATOLOGY_UNITS, "odds go by climatology units")
    rule(not q.trend or q.unit not in v.CLIMATOLOGY_UNITS, "a climatology has no trend")
    if q.unit == "day":
        rule(not q.trend, "days of one year have no trend")
        rule(q.period_aggregation is None, "a daily series has no period aggregation")
    if q.unit == "value":
        rule(not (q.baseline or q.trend or q.display or q.threshold or q.period_aggregation), "a histogram takes none of these options")
    if q.baseline:
        whole = all(isinstance(y, int) and not isinstance(y, bool) for y in q.baseline) and len(q.baseline) == 2
        rule(whole, "a baseline is two years")
        if whole:
            rule(v.BASELINE_YEARS[0] <= q.baseline[1] - q.baseline[0] + 1 <= v.BASELINE_YEARS[1], "a baseline has 10 to 50 years")
            rule(q.baseline[1] < today.year, "a baseline is in the past")
        rule(q.unit not in v.CLIMATOLOGY_UNITS, "a climatology's dates are its baseline")
    match q.display:
        case "growing_season":
            rule(q.period_aggregation in DATE_AGGREGATIONS and q.metric == "TMIN", "a growing season is of first and last dates of TMIN")
        case "difference":
            rule(not q.baseline and q.unit != "value", "a difference has no baseline and no histogram")
        case "climograph":
            rule(q.unit == "month_of_year" and q.metric in (*v.TEMPERATURES, *v.TOTALS), "a climograph is by month of temperatures, rain and snow")
        case "histogram":
            rule(q.unit in v.PERIOD_UNITS, "a histogram of periods needs months, years or seasons")
            rule(not q.baseline and not q.trend, "a histogram has no baseline and no trend")
        case "climate" | "cumulative":
            rule(q.unit == "day", "this display needs days")
            rule(q.metric in (v.TEMPERATURES if q.display == "climate" else v.TOTALS), "this display isn't for the metric")
            rule(q.display != "climate" or q.baseline is not None, "a climate graph needs a baseline")
        case "overlay" | "anomaly":
            rule(q.baseline is not None, "this display needs a baseline")


def cross_problems(queries: list[Query], plot: str | None = "inherited") -> list[str]:
    """Rules across the queries of one question; ``plot``: "explicit" (a chart was asked for), "inherited" (either will do) or None (no chart)."""
    if not queries:
        return ["there are no queries"]
    if len(queries) > v.MAX_QUERIES:
        return [f"a question has 1 to {v.MAX_QUERIES} queries"]
    out, of = [], lambda name: [q for q in queries if q.display == name]
    gap, grow, months = of("difference"), of("growing_season"), {q.metric for q in of("climograph")}
    if gap and (len(gap) != 2 or len({(q.metric, q.unit) for q in gap}) != 1 or len({q.station for q in gap}) != 2):
        out.append("a difference is of two stations, one metric and one unit")
    if grow and sorted(q.period_aggregation or q.aggregation for q in grow) != ["first_date", "last_date"]:
        out.append("a growing season is one last date and one first date")
    if months and not (months & set(v.TEMPERATURES) and months & set(v.TOTALS)):
        out.append("a climograph has a temperature and rain or snow")
    series, ranks = [q.aggregation == "series" for q in queries], [q.aggregation in ("top", "bottom") for q in queries]
    if plot is None and any(series):
        out.append("a series needs a chart")
    elif plot == "explicit" and not (all(series) or all(ranks)):
        out.append("a chart is of series or of a ranking")
    elif any(series) and not all(series):
        out.append("series and single values don't mix")
    return out


def _calendar_day(text: str) -> bool:
    try:
        date.fromisoformat(f"2000-{text}")
    except ValueError:
        return False
    return True


def bucketing(q: Query) -> tuple[str, int, list[int] | None]:
    """Unit, start month and months of a period query."""
    months = list(q.months) if q.months else None
    if q.unit == "snow_season":
        return "year", 7, months
    if q.unit == "season":
        start, own = periods.season_window(q.season or "winter")
        return "year", start, own
    return q.unit, 1, months


def answer(obs: DataFrame, q: Query, today: date, state: DataFrame | None = None) -> DataFrame:
    """The DataFrame that answers a query with its defaults applied, in its output unit. ``state``: stored sums of calendar
    days (:mod:`operators.state`), which normals and records of daily series are taken from instead of the whole history."""
    if q.aggregation == "series":
        from . import charts

        return charts.series(obs, q, today, state) if q.display or q.baseline or q.trend or q.output_unit else raw_series(obs, q)
    found = _single(obs, q, today)
    if q.output_unit != "C" or q.metric not in v.TEMPERATURES or q.aggregation in ("count", "record_high", "record_low", *DATE_AGGREGATIONS) or q.period_aggregation == "any":
        return found
    readings = [c for c in ("value", "mean", "median", "sum", "max", "min") if c in found.columns]
    return found.withColumns({c: celsius(F.col(c)) for c in readings} | {c: F.col(c) * 5 / 9 for c in ("stddev",) if c in found.columns})


def _single(obs: DataFrame, q: Query, today: date) -> DataFrame:
    op, limit = (q.threshold.operator, q.threshold.value) if q.threshold else (None, None)
    lowest = q.aggregation in ("bottom", "min")
    if q.aggregation in ("record_high", "record_low"):
        whole = daily.daily_values(obs, q.metric, v.ALL_TIME, max(q.end, today.isoformat()), list(q.months) if q.months else None, station=q.station)
        return records.record_days(whole, q.start, q.end, q.aggregation == "record_high", q.metric in ("PRCP", "SNOW"))
    if q.aggregation in DATE_AGGREGATIONS:
        return analysis.date_answer(raw_series(obs, q), q.aggregation.removesuffix("_date"), 7 if q.unit == "snow_season" else 1)
    if q.unit == "day_of_year":
        what = "any" if q.period_aggregation == "any" else q.aggregation
        return analysis.calendar_day(raw_series(obs, q), q.calendar_day, what)
    if q.unit == "event":
        days = daily.daily_values(obs, q.metric, q.start, q.end, op=q.event_day.operator, threshold=q.event_day.value, station=q.station)
        found = events.valued(events.events(days), q.event_value or "total")
        if op and q.aggregation not in ("top", "bottom"):
            found = events.over(found, op, limit)
        if q.aggregation in ("max", "min"):
            return daily.extremes(found, ["event_start"], lowest)
        if q.aggregation in ("latest", "earliest"):
            return events.picked(found, q.aggregation)
        return daily.ranked(found, ["event_start"], q.limit, lowest) if q.aggregation in ("top", "bottom") else events.event_stats(found)
    if q.unit in v.PERIOD_UNITS:
        unit, start, months = bucketing(q)
        days = daily.daily_values(obs, q.metric, q.start, q.end, months, station=q.station)
        found = periods.buckets(days, unit, q.period_aggregation or "mean", start, months if unit == "year" else None)
        if q.aggregation in ("max", "min"):
            return periods.extreme_periods(found, lowest)
        if q.aggregation in ("top", "bottom"):
            return daily.ranked(found, ["bucket_year", "bucket_month"], q.limit, lowest)
        return periods.period_count(found, op, limit) if q.aggregation == "count" else periods.period_stats(found, q.aggregation)
    days = daily.daily_values(obs, q.metric, q.start, q.end, list(q.months) if q.months else None, op, limit, q.station)
    if q.aggregation in ("top", "bottom"):
        return daily.ranked(days.select("station_id", "obs_date", "value"), ["obs_date"], q.limit, lowest)
    return daily.extreme_days(days.select("station_id", "obs_date", "value"), lowest) if q.aggregation in ("max", "min") else daily.day_stats(days, q.aggregation)


def month_before(day: date) -> date:
    """The same day a month earlier, or that month's last day if it is shorter."""
    year, month = (day.year - 1, 12) if day.month == 1 else (day.year, day.month - 1)
    return date(year, month, min(day.day, calendar.monthrange(year, month)[1]))


def raw_series(obs: DataFrame, q: Query) -> DataFrame:
    """A series' points as the data have them, in stored units."""
    op, limit = (q.threshold.operator, q.threshold.value) if q.threshold else (None, None)
    how = q.period_aggregation or v.NATURAL.get(q.metric or "", "mean")
    read = lambda start, months=None: daily.daily_values(obs, q.metric, start, q.end, months, op, limit, q.station)
    if q.aggregation in DATE_AGGREGATIONS or how in DATE_AGGREGATIONS:
        unit, start, months = bucketing(q)
        return periods.first_last_dates(read(q.start, months), start, months)
    match q.unit:
        case "month_of_year":
            return periods.month_of_year(read(q.start), q.metric, how)
        case "week_of_year":
            return periods.week_of_year(read(q.start), q.metric, how)
        case "season_of_year":
            first, last = date.fromisoformat(q.start), date.fromisoformat(q.end)
            return periods.season_of_year(read(month_before(first).isoformat()), q.metric, how, first.year, last.year)
        case "day_of_year":
            return periods.day_of_year(read(q.start), q.metric, how)
        case "value":
            return periods.histogram(read(q.start, list(q.months) if q.months else None), q.metric)
        case "day":
            return periods.daily_series(read(q.start, list(q.months) if q.months else None), q.metric)
    unit, start, months = bucketing(q)
    return periods.series(periods.buckets(read(q.start, months), unit, how, start, months if unit == "year" else None), q.metric)


def as_json(answered: DataFrame) -> DataFrame:
    """One JSON text a row; null fields are left out."""
    return answered.select(F.to_json(F.struct(*answered.columns)).alias("json"))


TEMPLATES = {
    "mean": "average", "median": "median", "sum": "total", "max": "highest", "min": "lowest", "stddev": "spread of", "count": "number of days or periods of",
    "latest": "latest event of", "earliest": "earliest event of", "top": "highest ranks of", "bottom": "lowest ranks of", "series": "series of",
    "first_date": "first date of", "last_date": "last date of", "record_high": "record highs of", "record_low": "record lows of",
}


def describe(q: Query) -> str:
    """What was computed, in words."""
    limit = f" {q.threshold.operator} {q.threshold.value:g}" if q.threshold else ""
    return f"{TEMPLATES[q.aggregation]} {q.metric}{limit} by {q.unit.replace('_', ' ')}, {q.start} to {q.end}"
