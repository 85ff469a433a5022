"""Climatologies as stored sums that new days are added to, instead of aggregates over the whole history.

A row sums one calendar day of a station and metric over a span of years: n, total, m2 (the sum of squared
deviations), and the highest and lowest value with their years. Sums of disjoint days can be merged in any order, so
a day's rows change the rows of that calendar day alone, and what reads the sums (normals, daily records) reads 366 rows
a station and span, however long the record is. A revised day can't be taken out of a highest or lowest value:
its calendar day's rows are made anew from the history (:func:`redone`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import decimals, rounded
from ..plans.store import Store
from ..plans.work import discard, kept

KEY = ["station_id", "metric", "span", "day"]
BY = {"p_month": "substring(day, 1, 2)"}
ALL_YEARS = (1800, 9999)


def span_name(first: int, last: int) -> str:
    return f"{first:04d}-{last:04d}"


def sums(days: DataFrame, metric: str, first: int, last: int) -> DataFrame:
    """The state of (station_id, obs_date, value) rows of one metric within the years."""
    y = F.year("obs_date")
    rows = days.filter(F.col("value").isNotNull() & y.between(first, last))
    high, low = F.struct(F.col("value").alias("v"), y.alias("y")), F.struct(F.col("value").alias("v"), (-y).alias("y"))
    made = rows.groupBy("station_id", F.lit(metric).alias("metric"), F.lit(span_name(first, last)).alias("span"), F.date_format("obs_date", "MM-dd").alias("day"))
    return made.agg(F.count("*").alias("n"), F.sum("value").alias("total"), (F.var_pop("value") * F.count("*")).alias("m2"), F.max(high).alias("hi"), F.min(low).alias("lo"))


def merged(*states: DataFrame) -> DataFrame:
    """One state of several over disjoint days."""
    rows = states[0]
    for s in states[1:]:
        rows = rows.unionByName(s)
    n, total = F.sum("n"), F.sum("total")
    spread = F.sum(F.col("m2") + F.col("total") * F.col("total") / F.col("n")) - total * total / n
    return rows.groupBy(*KEY).agg(n.alias("n"), total.alias("total"), F.greatest(F.lit(0.0), spread).alias("m2"), F.max("hi").alias("hi"), F.min("lo").alias("lo"))


def day_of_year(state: DataFrame, metric: str, first: int, last: int) -> DataFrame:
    """As :func:`periods.day_of_year` of the same days: (station_id, day, value, stddev, n_years, max, max_year, min, min_year)."""
    rows = state.filter((F.col("metric") == metric) & (F.col("span") == span_name(first, last)))
    sd = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return rows.select(
        "station_id", "day", rounded(F.col("total") / F.col("n"), decimals(metric)).alias("value"), rounded(sd, decimals(metric)).alias("stddev"), F.col("n").alias("n_years"),
        F.col("hi.v").alias("max"), F.col("hi.y").alias("max_year"), F.col("lo.v").alias("min"), (-F.col("lo.y")).alias("min_year"),
    )


def advance(store: Store, name: str, new: DataFrame, batch: tuple[str, int] | None = None) -> None:
    """Adds the sums of days that the stored state doesn't have yet; a batch that is stored already changes nothing.

    Reads and writes the months of the new days. :class:`store.Stale` if another writer was first: nothing is lost, call again.
    """
    before = store.version(name)
    if before is None:
        store.upsert(name, new, KEY, by=BY, stream=batch, expect=0)
        return
    new = kept(new, "new-sums")  # used three times
    months = {r.m for r in new.select(F.substring("day", 1, 2).alias("m")).distinct().collect()}  # twelve at most
    old = store.where(name, lambda p: p["p_month"] in months).join(new.select(*KEY), KEY, "left_semi")
    store.upsert(name, merged(old, new), KEY, stream=batch, expect=before.number)
    discard(new)


def redone(history: DataFrame, changed: DataFrame, metric: str, first: int, last: int) -> DataFrame:
    """Sums of the calendar days that ``changed`` (station_id, obs_date) touches, from all days of the history, to be
    upserted in place of the stored ones."""
    touched = changed.select("station_id", F.date_format("obs_date", "MM-dd").alias("_day")).distinct()
    rows = history.withColumn("_day", F.date_format("obs_date", "MM-dd")).join(touched, ["station_id", "_day"], "left_semi")
    return sums(rows, metric, first, last)
