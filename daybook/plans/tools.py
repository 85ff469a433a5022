"""Named questions: each builds the query that answers it."""

from __future__ import annotations

import re
from dataclasses import replace
from datetime import date

from ..functions import dates
from ..functions import vocabulary as v
from .query import Query, Threshold


def _period(today: date, kind: str = "all_time", **parts: int | str) -> dict[str, str]:
    start, end = dates.resolve(kind, today, **parts)
    return {"start": start.isoformat(), "end": end.isoformat()}


def summarize_days(today: date, metric: str, stat: str | None = None, station: str | None = None, **period) -> Query:
    names = {"average": "mean", "total": "sum", "median": "median", "stddev": "stddev"}
    return Query(metric, names.get(stat or "", v.NATURAL[metric]), "day", station=station, **_period(today, **period))


def extreme_days(today: date, metric: str, which: str = "highest", n: int | None = None, station: str | None = None, **period) -> Query:
    how = {"highest": ("max", "top"), "lowest": ("min", "bottom")}[which][n is not None]
    return Query(metric, how, "day", limit=n, station=station, **_period(today, **period))


def count_days(today: date, condition: str | None = None, metric: str | None = None, threshold: Threshold | None = None, station: str | None = None, **period) -> Query:
    if (condition is None) == (threshold is None):
        raise ValueError("give a condition or a threshold")
    return Query(metric, "count", "day", threshold=threshold, condition=condition, station=station, **_period(today, **period))


def record_days(today: date, metric: str, which: str = "high", station: str | None = None, **period) -> Query:
    return Query(metric, f"record_{which}", "day", station=station, **_period(today, **period))


def calendar_day(today: date, metric: str, day: str, what: str = "normal", threshold: Threshold | None = None, station: str | None = None) -> Query:
    span = {"start": f"{v.NORMAL_YEARS[0]}-01-01", "end": f"{v.NORMAL_YEARS[1]}-12-31"} if what == "normal" else _period(today)
    how = {"normal": "mean", "odds": "mean", "highest": "max", "lowest": "min"}[what]
    return Query(metric, how, "day_of_year", calendar_day=day, threshold=threshold, period_aggregation="any" if what == "odds" else None, station=station, **span)


def first_last_date(today: date, which: str, condition: str, station: str | None = None, half_year: int | None = None, **period) -> Query:
    unit = "snow_season" if v.CONDITIONS[condition][0] == "SNOW" else "year"
    return Query(None, f"{which}_date", unit, condition=condition, half_year=half_year, station=station, **_period(today, **period))


def event_question(today: date, metric: str, which: str = "largest", measure: str = "total", n: int | None = None, size: Threshold | None = None, day_cutoff: Threshold | None = None, station: str | None = None, **period) -> Query:
    names = {"largest": "top" if n else "max", "smallest": "bottom" if n else "min", "latest": "latest", "earliest": "earliest", "count": "count", "average": "mean", "total": "sum"}
    return Query(metric, names[which], "event", event_value=measure, event_day=day_cutoff, threshold=size, limit=n, station=station, **_period(today, **period))


def compare_periods(today: date, metric: str, unit: str, which: str = "highest", n: int | None = None, season: str | None = None, threshold: Threshold | None = None, station: str | None = None, **period) -> Query:
    names = {"highest": "top" if n else "max", "lowest": "bottom" if n else "min", "average": "mean", "median": "median", "count": "count"}
    return Query(metric, names[which], unit, season=season, threshold=threshold, limit=n, station=station, **_period(today, **period))


def chart_over_time(today: date, metrics: list[str], display: str | None = None, baseline: tuple[int, int] | None = None, trend: bool = False, station: str | None = None, **period) -> list[Query]:
    span = _period(today, **period)
    unit = dates.grain(date.fromisoformat(span["start"]), date.fromisoformat(span["end"]))
    return [Query(m, "series", unit, display=display, baseline=baseline, trend=trend, station=station, **span) for m in metrics]


def chart_climatology(metrics: list[str], unit: str = "month_of_year", station: str | None = None) -> list[Query]:
    return [Query(m, "series", unit, station=station) for m in metrics]


def chart_count_days(today: date, condition: str, unit: str = "year", station: str | None = None, **period) -> Query:
    return Query(None, "series", unit, condition=condition, period_aggregation="count", station=station, **_period(today, **period))


def chart_odds(condition: str, unit: str = "day_of_year", station: str | None = None) -> Query:
    return Query(None, "series", unit, condition=condition, period_aggregation="any", station=station)


def chart_dates_by_year(today: date, which: str = "growing_season", condition: str = "freeze", station: str | None = None, **period) -> list[Query]:
    made = {"first": [("first", 2)], "last": [("last", 1)]}.get(which, [("last", 1), ("first", 2)])
    span, display = _period(today, **period), "growing_season" if which == "growing_season" else None
    return [Query(None, "series", "year", condition=condition, half_year=half, period_aggregation=f"{name}_date", display=display, station=station, **span) for name, half in made]


def chart_histogram(today: date, metric: str, station: str | None = None, **period) -> Query:
    return Query(metric, "series", "value", station=station, **_period(today, **period))


def chart_climate_graph(today: date, station: str | None = None, **period) -> list[Query]:
    span = _period(today, **period) if period else {"start": f"{today.year}-01-01", "end": today.isoformat()}
    return [Query(m, "series", "day", display="climate", baseline=v.NORMAL_YEARS, station=station, **span) for m in ("TMAX", "TMIN")]


def chart_running_total(today: date, metric: str, seasons: list[int], station: str | None = None) -> list[Query]:
    return [Query(metric, "series", "day", display="cumulative", station=station, **_period(today, "snow_season" if metric == "SNOW" else "absolute_year", year=y)) for y in seasons[: v.MAX_QUERIES]]


def chart_station_difference(today: date, metric: str, a: str, b: str, **period) -> list[Query]:
    span = _period(today, **period)
    unit = dates.grain(date.fromisoformat(span["start"]), date.fromisoformat(span["end"]))
    return [Query(metric, "series", unit, display="difference", station=s, **span) for s in (a, b)]


def chart_climograph(rain: str = "PRCP", station: str | None = None) -> list[Query]:
    return [Query(m, "series", "month_of_year", display="climograph", station=station) for m in ("TMAX", "TMIN", rain)]


def chart_ranking(today: date, metric: str, of: str, order: str = "highest", n: int | None = None, measure: str | None = None, season: str | None = None, months: tuple[int, ...] | None = None, station: str | None = None, **period) -> Query:
    """A ranking as bars: of days, storms, or whole months, years, seasons or snow seasons."""
    if of != "storm" and measure:
        raise ValueError("a measure is for storms")
    if of in ("day", "storm") and season:
        raise ValueError("a season is for whole periods; days take months")
    if of == "storm" and months:
        raise ValueError("storms take no months")
    how = {"highest": "top", "lowest": "bottom"}[order]
    if of == "storm":
        return Query(metric, how, "event", event_value=measure or "total", limit=n, station=station, **_period(today, **period))
    return Query(metric, how, of, limit=n, season=season, months=months, station=station, **_period(today, **period))


def grain_meant(q: Query, question: str) -> Query:
    """A monthly series over a year or less becomes daily where the question asks for days."""
    if q.aggregation != "series" or q.unit != "month" or not re.search(r"\b(daily|each day|every day|day by day)\b", question, re.I):
        return q
    span = (date.fromisoformat(q.end) - date.fromisoformat(q.start)).days
    return replace(q, unit="day", period_aggregation=None, trend=False) if span <= v.DAILY_SPAN else q
