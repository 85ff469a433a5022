"""Semantics on small made tables."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from daybook.functions import dates, units
from daybook.functions.columns import window_days
from daybook.operators import analysis, daily, events, periods, records
from daybook.plans import elt, query, stations, tools
from daybook.plans.query import Query, Threshold
from daybook.plans.store import Store
from daybook.sources import parse

D = date.fromisoformat
TODAY = date(2026, 3, 15)


def days(spark, values, start="2020-01-01", station="A", op=None, threshold=None):
    rows = [(station, D(start) + timedelta(days=k), v) for k, v in enumerate(values) if v != "gap"]
    obs = spark.createDataFrame(rows, "station_id string, obs_date date, PRCP double")
    return daily.daily_values(obs, "PRCP", "1800-01-01", "2100-01-01", op=op, threshold=threshold)


def test_hit_is_three_valued(spark):
    got = [r.hit for r in days(spark, [1.0, 0.0, None], op=">=", threshold=0.5).orderBy("obs_date").collect()]
    assert got == [1, 0, None]
    assert [r.hit for r in days(spark, [1.0, None]).orderBy("obs_date").collect()] == [0, None]


def test_event_totals_and_durations(spark):
    found = events.events(days(spark, [1.0, 1.0, 0.0, 0.45, 0.45, 0.45], op=">=", threshold=0.05)).orderBy("event_start").collect()
    assert [(round(r.total, 2), r.duration) for r in found] == [(2.0, 2.0), (1.35, 3.0)]


@pytest.mark.parametrize("values", [[1.0, "gap", 1.0], [1.0, None, 1.0]])
def test_missing_day_ends_an_event(spark, values):
    assert events.events(days(spark, values, op=">=", threshold=0.05)).count() == 2


def test_event_totals_add_up(spark):
    read = days(spark, [(k * 7 % 11) / 10 for k in range(60)], op=">=", threshold=0.4)
    hits = read.filter("hit = 1").agg(F.sum("value")).first()[0]
    assert events.events(read).agg(F.sum("total")).first()[0] == pytest.approx(hits)


def test_ranks_keep_ties_and_float_noise(spark):
    got = daily.ranked(days(spark, [5.0, 4.0, 4.0, 3.0]), ["obs_date"], 2).orderBy("rank", "obs_date").collect()
    assert [(r["rank"], r.value) for r in got] == [(1, 5.0), (2, 4.0), (2, 4.0)]
    noisy = daily.ranked(days(spark, [53.3, 53.300000000000004]), ["obs_date"], 3)
    assert {r["rank"] for r in noisy.collect()} == {1}


def test_rank_rows_are_capped_and_answer_is_latest(spark):
    read = days(spark, [2.0] * 20)
    got = daily.ranked(read, ["obs_date"], 1)
    assert got.count() == 15 and got.first().rows_truncated
    assert daily.extreme_days(read.select("station_id", "obs_date", "value")).filter("is_answer").first().obs_date == D("2020-01-20")


def test_coverage_edges(spark):
    month = lambda n: periods.buckets(days(spark, [1.0] * n, "2021-04-01"), "month", "mean").count()
    assert month(27) == 1 and month(26) == 0
    winter = [1.0] * 90
    start, months = periods.season_window("winter")
    made = periods.buckets(days(spark, winter, "2009-12-01"), "year", "mean", start, months).collect()
    assert [r.bucket_year for r in made] == [2010]


def test_window_days(spark):
    one = spark.range(1).select(window_days(F.lit(2020)).alias("a"), window_days(F.lit(2021), 7).alias("b"), window_days(F.lit(2020), 12, [12, 1, 2]).alias("c"), window_days(F.lit(2020), 1, [2]).alias("d")).first()
    assert tuple(one) == (366, 365, 91, 29)


def test_records(spark):
    values = {1970: 5.0, 1971: None, 1972: 5.0, 1973: 4.0} | {1974 + k: 3.0 for k in range(30)} | {2010: 6.0}
    rows = [("A", date(y, 7, 4), v) for y, v in values.items()]
    read = daily.daily_values(spark.createDataFrame(rows, "station_id string, obs_date date, TMAX double"), "TMAX", "1800-01-01", "2100-01-01")
    got = {r.obs_date.year: r for r in records.record_days(read, "1990-01-01", "2020-12-31").collect()}
    assert set(got) == {2010} and (got[2010].previous_record, got[2010].previous_record_year) == (5.0, 1972)
    low = records.record_days(read, "1971-01-01", "1973-12-31", high=False).collect()
    assert [r.obs_date.year for r in low] == []  # later years are lower and under 30 years have passed


def test_smoothing_wraps_around(spark):
    rows = [("A", f"{m:02d}-{d:02d}", float(m == 1 and d == 1)) for m in range(1, 13) for d in range(1, 29)]
    got = {r.day: r.smoothed for r in analysis.smoothed(spark.createDataFrame(rows, "station_id string, day string, value double")).collect()}
    assert got["12-28"] == got["01-02"] == pytest.approx(1 / 15, abs=1e-4) and got["06-01"] == 0


def test_upsert_twice_is_once(spark):
    t = spark.createDataFrame([(1, 1.0), (2, None)], "k int, v double")
    s = spark.createDataFrame([(2, 5.0), (3, 7.0)], "k int, v double")
    once = elt.upsert(t, s, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, 1.0), (2, 5.0), (3, 7.0)] == sorted(map(tuple, elt.upsert(once, s, ["k"]).collect()))


def test_conditional_merge_branches(spark):
    schema = "station_id string, obs_date date, variable string, value double, mflag string, qflag string, sflag string, ingested_at timestamp, source string"
    row = lambda v, value, source, q=None: ("A", D("2020-01-01"), v, value, None, q, None, None, source)
    t = spark.createDataFrame([row("a", 1.0, "ACIS"), row("b", 1.0, "ACIS"), row("c", 1.0, "ACIS"), row("d", None, "GHCN"), row("e", None, "GHCN", "X"), row("f", 2.0, "GHCN")], schema)
    s = spark.createDataFrame([row("a", 9.0, "GHCN"), row("b", None, "GHCN"), row("c", None, "GHCN", "X"), row("d", 9.0, "ACIS"), row("e", 9.0, "ACIS"), row("f", 9.0, "GHCN"), row("g", 9.0, "GHCN")], schema)
    got = {r.variable: r.value for r in elt.merge_into(t, s).collect()}
    assert got == {"a": 9.0, "b": 1.0, "c": None, "d": 9.0, "e": None, "f": 2.0, "g": 9.0}


def test_values_of_the_api(spark):
    rows = spark.createDataFrame([("T",), ("M",), ("0.05",), ("0.05A",), (None,)], "v string")
    assert [r[0] for r in rows.select(elt.decoded(F.col("v"))).collect()] == [0.001, None, 0.05, None, None]


def test_unit_conversion_and_degree_days(spark):
    rows = spark.createDataFrame([("PRCP", 254.0), ("TMAX", 0.0), ("TMIN", -178.0), ("AWND", 45.0)], "variable string, value double")
    assert [r.value for r in elt.convert(rows).collect()] == [1.0, 32.0, 0.0, 10.0]
    wide = spark.createDataFrame([(65.0, 64.0), (65.0, 65.0), (66.0, 65.0), (None, 60.0)], "TMAX double, TMIN double")
    assert [(r.HDD, r.CDD) for r in elt.derived(wide).collect()] == [(1, 0), (0, 0), (0, 1), (None, None)]


def test_month_line(spark):
    block = lambda v, f="   ": f"{v:5d}{f}"
    line = "USW00000001" + "2021" + "02" + "TMAX" + block(100, " XS") + block(-9999) + block(50) * 29
    got = parse.daily_lines(spark.createDataFrame([(line,), (line[:40],), ("",)], "value string")).orderBy("obs_date", "value").collect()
    full = [r for r in got]
    assert max(r.obs_date for r in full) == D("2021-02-28")
    assert {(r.value, r.qflag, r.sflag) for r in full if r.obs_date == D("2021-02-01")} == {(100.0, "X", "S")}
    assert [r.value for r in full if r.obs_date == D("2021-02-02")][0] is None


def test_payloads(spark):
    rows = [("A", '{"data": [["2020-01-01", "50", "T", "M", "0.1", "M"]]}'), ("B", '{"data": [["2020-01-01", "M", "M", "M", "M", "M"]]}'), ("C", '{"data": []}'), ("D", "broken"), ("E", None)]
    got = parse.api_payloads(spark.createDataFrame(rows, "station_id string, payload string")).collect()
    assert {r.station_id for r in got} == {"A"} and {r.variable: r.value for r in got}["mint"] == "T"


@pytest.mark.parametrize(("kind", "parts", "want"), [
    ("absolute_year", {"year": 2020}, ("2020-01-01", "2020-12-31")),
    ("absolute_year_range", {"start_year": 1991, "end_year": 2020}, ("1991-01-01", "2020-12-31")),
    ("absolute_month", {"year": 2024, "month": 2}, ("2024-02-01", "2024-02-29")),
    ("absolute_day", {"year": 2024, "month": 2, "day": 29}, ("2024-02-29", "2024-02-29")),
    ("season", {"season": "winter", "year": 2026}, ("2025-12-01", "2026-02-28")),
    ("season", {"season": "winter"}, ("2025-12-01", "2026-02-28")),
    ("season", {"season": "autumn"}, ("2025-09-01", "2025-11-30")),
    ("relative_days", {"days": 7}, ("2026-03-08", "2026-03-15")),
    ("last_years", {"years": 2}, ("2025-01-01", "2026-03-15")),
    ("recent_month", {"month": 3}, ("2026-03-01", "2026-03-31")),
    ("recent_month", {"month": 12}, ("2025-12-01", "2025-12-31")),
    ("weekday", {"weekday": "Sunday"}, ("2026-03-08", "2026-03-08")),
    ("all_time", {}, ("1800-01-01", "2026-03-15")),
    ("snow_season", {"year": 2010}, ("2009-07-01", "2010-06-30")),
])
def test_date_ranges(kind, parts, want):
    assert tuple(d.isoformat() for d in dates.resolve(kind, TODAY, **parts)) == want


def test_date_range_errors():
    for kind, parts in (("nothing", {}), ("absolute_year", {}), ("last_years", {"years": 0})):
        with pytest.raises(ValueError):
            dates.resolve(kind, TODAY, **parts)


def test_labels_and_units():
    assert dates.season_label(2010) == "2009-10" and dates.day_label("07-04") == "Jul 4"
    assert units.converted(50.0, "TMAX", "C") == 10 and units.converted(9.0, "TMAX", "C", spread=True) == 5 and units.converted(1.0, "PRCP", "C") == 1.0
    assert units.shown(3.0, "count") == 3 and units.shown(3.14, "mean") == 3.1 and units.percent(0.1234) == 12.3


GOOD = Query("TMAX", start="2020-01-01", end="2020-12-31")


@pytest.mark.parametrize("change", [
    {"metric": "HUM"}, {"aggregation": "mode"}, {"unit": "hour"}, {"aggregation": "latest"}, {"limit": 3}, {"aggregation": "top", "limit": 16}, {"aggregation": "count"},
    {"unit": "event"}, {"unit": "season", "period_aggregation": "mean"}, {"aggregation": "record_low", "metric": "TMAX"}, {"trend": True}, {"unit": "month_of_year"},
    {"months": ()}, {"months": (13,)}, {"output_unit": "K"}, {"start": "2021-01-01"}, {"start": "x"}, {"threshold": Threshold("!", 1.0), "aggregation": "count"},
    {"threshold": Threshold(">", True), "aggregation": "count"}, {"aggregation": "series", "start": "2000-01-01"}, {"aggregation": "series", "unit": "month", "period_aggregation": "count"},
    {"aggregation": "first_date", "unit": "year"}, {"unit": "snow_season", "period_aggregation": "sum"}, {"aggregation": "series", "unit": "month", "period_aggregation": "mean", "baseline": (2015, 2020)},
])
def test_invalid_queries(change):
    from dataclasses import replace

    assert query.problems(GOOD, TODAY) == []
    assert query.problems(replace(GOOD, **change), TODAY)


def test_defaults_coercion_and_cross_rules():
    made = query.apply_defaults(Query(aggregation="count", condition="freeze"), TODAY)
    assert (made.metric, made.threshold, made.start, made.end) == ("TMIN", Threshold("<=", 32.0), "1800-01-01", "2026-03-15")
    assert query.apply_defaults(Query("PRCP", unit="year"), TODAY).period_aggregation == "sum"
    cut, notes = query.coerce(Query("TMAX", "top", limit=20, start="2020-01-01", end="2020-02-01"))
    assert cut.limit == 15 and notes
    cut, _ = query.coerce(Query("TMAX", "series", start="2000-01-01", end="2020-02-01"))
    assert cut.unit == "month"
    assert query.cross_problems([]) and query.cross_problems([Query("TMAX", "series", display="difference")])
    assert not query.cross_problems(tools.chart_station_difference(TODAY, "TMAX", "A", "B", kind="absolute_year", year=2020))


def test_tools_build_valid_queries(spark):
    one = [
        tools.summarize_days(TODAY, "TMAX", "average", kind="absolute_year", year=2020), tools.extreme_days(TODAY, "TMAX", n=3), tools.count_days(TODAY, "freeze"), tools.record_days(TODAY, "TMAX"),
        tools.calendar_day(TODAY, "TMAX", "07-04"), tools.first_last_date(TODAY, "last", "freeze", half_year=1), tools.event_question(TODAY, "PRCP"), tools.compare_periods(TODAY, "TMAX", "year"),
        tools.chart_count_days(TODAY, "freeze"), tools.chart_odds("rain_day"), tools.chart_histogram(TODAY, "TMAX"), *tools.chart_climatology(["TMAX", "PRCP"], "season_of_year"),
        *tools.chart_over_time(TODAY, ["TMAX"], kind="absolute_year", year=2020), *tools.chart_dates_by_year(TODAY), *tools.chart_climograph(),
    ]
    rows = [("A", D("2018-12-01") + timedelta(days=k), float(k % 90), float(k % 60), (k % 5) / 10, 0.0) for k in range(800)]
    obs = spark.createDataFrame(rows, "station_id string, obs_date date, TMAX double, TMIN double, PRCP double, SNOW double")
    for q in one:
        q = query.apply_defaults(q, TODAY)
        assert query.problems(q, TODAY) == [], q
        assert query.answer(obs, q, TODAY).columns[0] == "station_id"
        assert query.describe(q)
    assert query.as_json(query.answer(obs, query.apply_defaults(one[0], TODAY), TODAY)).first().json.startswith("{")


def test_places_and_lookup(spark):
    st = spark.createDataFrame([("USW1", "SEATTLE AP", "Seattle", "WA", 47.4, -122.3, True, "1", "KSEA", "SEA"), ("USW2", "X", "Seattle", "WA", 10.0, 10.0, False, "2", "KXXX", "XXX")], "ghcn_id string, name string, city string, state string, latitude double, longitude double, selected boolean, wmo string, icao string, iata string")
    aliases = spark.createDataFrame([("USW2", "Sea-Tac")], "ghcn_id string, alias string")
    name = lambda text: [r.ghcn_id for r in stations.lookup(st, aliases, text).collect()]
    assert (name("sea"), name("SeaTac"), name("seattle"), name("nowhere")) == (["USW1"], ["USW2"], ["USW1"], [])
    assert [r.ghcn_id for r in stations.nearest(st, 47.0, -122.0).collect()] == ["USW1"]
    assert stations.fold("  Montréal  Île ") == "montreal ile"
    assert [r.city for r in stations.activate(st, "USW2", "Sea").filter("selected").orderBy("ghcn_id").collect()] == ["Seattle", "Sea"]


def test_store_and_stream(spark, tmp_path):
    from daybook.streaming import ingest

    schema = ingest.SCHEMA
    stamp = lambda h: __import__("datetime").datetime(2024, 1, 1, h)
    row = lambda v, h, d=1: ("A", date(2024, 1, d), "TMAX", v, None, None, None, stamp(h))
    landing, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "store"))
    spark.createDataFrame([row(1.0, 1), row(2.0, 2), row(5.0, 1, 2)], schema).write.mode("append").parquet(landing)
    ingest.ingest(spark, landing, store, "obs", str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([row(None, 3), row(6.0, 3, 2)], schema).write.mode("append").parquet(landing)
    ingest.ingest(spark, landing, store, "obs", str(tmp_path / "c")).awaitTermination()
    assert {r.obs_date.day: r.value for r in store.read("obs").collect()} == {1: 2.0, 2: 6.0}
    store.upsert("obs", spark.createDataFrame([], schema), elt.KEY)
    assert store.read("obs").count() == 2
