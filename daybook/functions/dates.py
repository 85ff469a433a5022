"""Date ranges named in words; ``today`` is always given."""

from __future__ import annotations

import calendar
from datetime import date, timedelta

from .vocabulary import ALL_TIME, SEASONS

Range = tuple[date, date]
FIRST = date.fromisoformat(ALL_TIME)


def month_range(year: int, month: int) -> Range:
    return date(year, month, 1), date(year, month, calendar.monthrange(year, month)[1])


def season_range(season: str, year: int) -> Range:
    """A season by the year of its last month."""
    months = SEASONS[{"autumn": "fall"}.get(season, season)]
    first = year - 1 if months[0] > months[-1] else year
    return month_range(first, months[0])[0], month_range(year, months[-1])[1]


def resolve(kind: str, today: date, **p: int | str) -> Range:
    """First and last day of a named range; ValueError for an unknown kind or missing part."""
    try:
        match kind:
            case "absolute_year":
                return date(p["year"], 1, 1), date(p["year"], 12, 31)
            case "absolute_year_range":
                return date(p["start_year"], 1, 1), date(p["end_year"], 12, 31)
            case "absolute_month":
                return month_range(p["year"], p["month"])
            case "absolute_day":
                return (d := date(p["year"], p["month"], p["day"])), d
            case "season":
                if p.get("year"):
                    return season_range(p["season"], p["year"])
                return next(r for y in (today.year + 1, today.year, today.year - 1) if (r := season_range(p["season"], y))[1] <= today)
            case "snow_season":
                return date(p["year"] - 1, 7, 1), date(p["year"], 6, 30)
            case "relative_days":
                return today - timedelta(days=p["days"]), today
            case "last_years":
                if p["years"] < 1:
                    raise ValueError("years must be 1 or more")
                return date(today.year - p["years"] + 1, 1, 1), today
            case "recent_month":
                return month_range(today.year if p["month"] <= today.month else today.year - 1, p["month"])
            case "weekday":
                names = [d.lower() for d in calendar.day_name]
                back = (today.weekday() - names.index(str(p["weekday"]).lower())) % 7 or 7
                return (d := today - timedelta(days=back)), d
            case "all_time":
                return FIRST, today
    except KeyError as e:
        raise ValueError(f"{kind} needs {e.args[0]}") from e
    raise ValueError(f"unknown kind of range: {kind}")


def grain(start: date, end: date) -> str:
    """The unit that a chart over the range gets."""
    days = (end - start).days
    return "day" if days <= 366 else "month" if days <= 30 * 366 else "year"


def season_label(year: int) -> str:
    """A snow season by the year it ends in."""
    return f"{year - 1}-{year % 100:02d}"


def day_label(md: str) -> str:
    """Jul 4 of 07-04."""
    month, day = map(int, md.split("-"))
    return f"{calendar.month_abbr[month]} {day}"


def span_label(start: date, end: date) -> str:
    """Jul 4, 2020; Jul 4-6, 2020; Jul 30 - Aug 2, 2020; Dec 30, 2020 - Jan 2, 2021."""
    name = lambda d: f"{calendar.month_abbr[d.month]} {d.day}"
    if start == end:
        return f"{name(start)}, {start.year}"
    if (start.year, start.month) == (end.year, end.month):
        return f"{name(start)}-{end.day}, {start.year}"
    if start.year == end.year:
        return f"{name(start)} - {name(end)}, {end.year}"
    return f"{name(start)}, {start.year} - {name(end)}, {end.year}"


def bucket_label(unit: str, year: int, month: int | None = None, season: str | None = None) -> str:
    """Jan 2020, 2020, 2019-20 of a snow season, winter 2019-20, summer 2020."""
    if unit == "month" and month:
        return f"{calendar.month_abbr[month]} {year}"
    if unit == "snow_season":
        return season_label(year)
    if unit == "season" and season:
        return f"{season} {season_label(year) if season == 'winter' else year}"
    return str(year)


def months_label(months: tuple[int, ...]) -> str:
    """Jun-Aug for three or more in a row, else Jan, Mar, Jul."""
    names = [calendar.month_abbr[m] for m in months]
    run = list(months) == list(range(months[0], months[0] + len(months)))
    return f"{names[0]}-{names[-1]}" if run and len(months) > 2 else ", ".join(names)
