"""Answers for people: payloads, tables, charts as points, and their files."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, units
from ..functions import vocabulary as v
from ..functions.columns import celsius, rounded
from .query import DATE_AGGREGATIONS, Query, answer, describe


def in_unit(df: DataFrame, metric: str, unit: str | None, columns: tuple[str, ...] = ("value",), spreads: tuple[str, ...] = ()) -> DataFrame:
    """Temperatures in the asked unit; spreads and differences have no offset."""
    if unit != "C" or metric not in units.TEMPERATURES:
        return df
    return df.withColumns({c: celsius(F.col(c)) for c in columns} | {c: F.col(c) * 5 / 9 for c in spreads})


def as_percent(df: DataFrame, column: str = "value") -> DataFrame:
    return df.withColumn(column, rounded(100 * F.col(column), 1))


def points(series: DataFrame, x: str, label: str | None = None) -> DataFrame:
    """A chart's points: station_id, x, label and what the series has beside them."""
    rest = [c for c in series.columns if c not in ("station_id", x, "value")]
    return series.select("station_id", F.col(x).alias("x"), F.col(label or x).cast("string").alias("label"), "value", *rest)


def bounded(series: DataFrame) -> DataFrame:
    """Adds lower and upper: the value less and plus its deviation."""
    return series.withColumn("lower", rounded(F.col("value") - F.col("stddev"), 4)).withColumn("upper", rounded(F.col("value") + F.col("stddev"), 4))


def climatology_table(series: dict[str, DataFrame], x: str) -> DataFrame:
    """One row a point, one column a series."""
    out = None
    for name, df in series.items():
        own = df.select("station_id", x, F.col("value").alias(name))
        out = own if out is None else out.join(own, ["station_id", x], "full_outer")
    return out


def summary(series: DataFrame) -> DataFrame:
    """Highest, lowest and mean point of each station's series; ties: the latest."""
    x = "x"
    return series.groupBy("station_id").agg(
        F.max("value").alias("highest"), F.max_by(x, F.struct("value", x)).alias("highest_at"), F.min("value").alias("lowest"), F.max_by(x, F.struct(-F.col("value"), x)).alias("lowest_at"),
        rounded(F.avg("value"), 4).alias("mean"), F.count("value").alias("n"),
    )


def chart_kind(queries: list[Query]) -> str:
    """What a group of series is drawn as."""
    q = queries[0]
    if q.display in v.DISPLAYS:
        return q.display
    if q.unit == "value":
        return "histogram"
    if q.period_aggregation in ("first_date", "last_date") or q.aggregation in ("first_date", "last_date"):
        return "dates"
    if q.period_aggregation == "any":
        return "odds"
    return "climatology" if q.unit.endswith("_of_year") else "time_series"


def grouped(queries: list[Query]) -> list[list[Query]]:
    """Queries that share a chart: same kind and unit, and one metric unless the display mixes them."""
    charts: dict[tuple, list[Query]] = {}
    for q in queries:
        mixes = q.display in ("climograph", "climate", "growing_season")
        charts.setdefault((chart_kind([q]), q.unit, None if mixes else units.UNIT_NAMES.get(q.metric or "")), []).append(q)
    return list(charts.values())


def excluded(q: Query) -> str | None:
    """What the coverage rule leaves out of an answer over months, years or seasons."""
    if q.unit not in v.PERIOD_UNITS or q.aggregation in DATE_AGGREGATIONS:
        return None
    return f"{q.unit.replace('_', ' ')}s with under {v.COVERAGE:.0%} of their days observed in the range are left out"


def answer_units(q: Query) -> str:
    """What an answer's value is in."""
    if q.period_aggregation == "any":
        return "percent of years"
    if q.aggregation in DATE_AGGREGATIONS:
        return "date"
    if q.aggregation in ("count", "record_high", "record_low"):
        return f"{q.unit.replace('_', ' ')}s"
    if q.unit == "event" and q.event_value == "duration":
        return "days"
    return q.output_unit if q.output_unit and q.metric in units.TEMPERATURES else units.UNIT_NAMES[q.metric]


def payload(obs: DataFrame, q: Query, today: date, most: int = 1000) -> dict[str, object]:
    """One station's answer as a small dictionary: rows in order of their columns, unit and words.

    ``truncated`` says that there are more than ``most`` rows, of which the first are given;
    no daily, monthly or yearly series within the engine's limits has so many.
    """
    if q.station is None:
        raise ValueError("a payload is for one station; use answer() for many")
    found = answer(obs, q, today)
    order = [c for c in ("rank", "obs_date", "x", "event_start", "bucket_year", "bucket_month", "year", "season", "month", "week", "day", "value") if c in found.columns]
    rows = found.orderBy(*order).limit(most + 1).collect()
    out = {"station": q.station, "metric": q.metric, "aggregation": q.aggregation, "unit": q.unit, "units": answer_units(q), "start": q.start, "end": q.end, "computed": describe(q), "rows": [r.asDict(recursive=True) for r in rows[:most]], "truncated": len(rows) > most}
    if note := excluded(q):
        out["excluded"] = note
    if q.asked_limit:
        out["asked_limit"] = q.asked_limit
    return out


def _shown(x: float | None, unit: str) -> str:
    return "" if x is None else f"{round(x, 1):g} {unit}"


def _when(row: dict, q: Query) -> tuple[str, str]:
    """A row's time as a table names it: the column and its text."""
    if "event_start" in row:
        return "Dates", f"{row['event_start']} to {row['event_end']}" if row["event_start"] != row["event_end"] else str(row["event_start"])
    if "obs_date" in row:
        return "Date", str(row["obs_date"])
    if row.get("bucket_month"):
        return "Month", f"{row['bucket_year']}-{row['bucket_month']:02d}"
    if q.unit in ("season", "snow_season"):
        split = q.unit == "snow_season" or q.season == "winter"
        return "Season", dates.season_label(row["bucket_year"]) if split else str(row["bucket_year"])
    return "Year", str(row["bucket_year"])


def ranking_table(made: dict[str, object], q: Query) -> dict[str, object]:
    """A ranking's payload as rows of texts, with what the limits left out."""
    rows, by_length = [], q.event_value == "duration"
    for r in made["rows"]:
        column, text = _when(r, q)
        row = {"Rank": r["rank"], column: text, "Value": _shown(r["value"], made["units"])}
        if "duration" in r:
            row |= {"Total": _shown(r["total"], units.UNIT_NAMES[q.metric])} if by_length else {"Days": int(r["duration"])}
        rows.append(row)
    notes = [f"at most {v.RANK_MAX} ranks are shown of the {q.asked_limit} asked for"] if q.asked_limit else []
    if any(r.get("rows_truncated") for r in made["rows"]):
        notes.append("more rows are tied than are shown")
    return {"title": f"{q.aggregation} {q.unit.replace('_', ' ')}s by {'length' if by_length else q.metric}", "rows": rows, "notes": notes}


def records_table(made: dict[str, object]) -> list[dict[str, str]]:
    """A records payload as rows of texts: the day, its value and the record it met."""
    unit, out = units.UNIT_NAMES[made["metric"]], []
    for r in made["rows"]:
        before = "none" if r["previous_record"] is None else f"{'tied ' * bool(r['tied'])}{_shown(r['previous_record'], unit)} ({r['previous_record_year']})"
        out.append({"Date": str(r["obs_date"]), "Value": _shown(r["value"], unit), "Previous record": before})
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """Points as CSV files with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
