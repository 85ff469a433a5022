"""Finished answers, charts, places by rule, and the rest of the checks, on small made tables."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from daybook.functions import dates
from daybook.operators import analysis
from daybook.plans import answers, charts, elt, query, stations, tools, work
from daybook.plans import places as resolving
from daybook.plans.query import Query, Threshold
from daybook.plans.store import Store
from daybook.sources import parse

TODAY = date(2026, 3, 15)
D = date.fromisoformat


def table(spark, metric, f, first="1981-01-01", last="2020-12-31", station="A"):
    """One value a day, by a function of the day; None leaves a null."""
    start, n = D(first), (D(last) - D(first)).days + 1
    rows = [(station, start + timedelta(days=k), f(start + timedelta(days=k))) for k in range(n)]
    return spark.createDataFrame(rows, f"station_id string, obs_date date, {metric} double")


def ask(obs, q):
    return query.answer(obs, query.apply_defaults(q, TODAY), TODAY)


@pytest.fixture(scope="module")
def warm(spark):
    """The month in tens, and one more for each year from 2011 on."""
    return table(spark, "TMAX", lambda d: 10.0 * d.month + max(0, d.year - 2010)).repartition(2).cache()


def test_calendar_day(spark, warm):
    normal = ask(warm, Query("TMAX", "mean", "day_of_year", calendar_day="07-04", start="1981-01-01", end="2010-12-31")).collect()
    # Days 06-27 to 07-11: four of June and eleven of July.
    assert [(r.calendar_day, r.value, r.n_years, r.record_year) for r in normal] == [("07-04", round((4 * 60 + 11 * 70) / 15, 4), 30, None)]
    high = ask(warm, Query("TMAX", "max", "day_of_year", calendar_day="07-04")).first()
    assert (high.value, high.record_year, high.n_years) == (80.0, 2020, 40)
    odds = ask(warm, Query("TMAX", "mean", "day_of_year", calendar_day="07-04", period_aggregation="any", threshold=Threshold(">=", 76.0), start="2011-01-01", end="2020-12-31")).first()
    assert odds.value == 50.0
    assert ask(warm, Query("TMAX", "mean", "day_of_year", calendar_day="02-30")).count() == 0


def test_first_and_last_dates(spark):
    cold = table(spark, "TMIN", lambda d: 30.0 if (d.month, d.day) in ((4, 10 + d.year % 3), (10, 20)) else 50.0, "2001-01-01", "2009-12-31")
    many = ask(cold, Query(None, "last_date", "year", condition="freeze", half_year=1, start="2001-01-01", end="2009-12-31")).first()
    assert many.value is None and many.typical_date == "04-11" and many.years_counted == 9 and many.years_without == 0
    # A leap year's April days come a day later in the year.
    assert many.earliest_on_record == [D("2001-04-10"), D("2007-04-10")] and many.latest_on_record == [D("2003-04-12"), D("2006-04-12"), D("2008-04-11"), D("2009-04-12")]
    assert (many.first_year, many.last_year) == (2001, 2009)
    one = ask(cold, Query(None, "first_date", "year", condition="freeze", half_year=2, start="2005-01-01", end="2005-12-31")).first()
    assert one.value == D("2005-10-20") and one.bucket_year == 2005 and one.earliest_on_record is None
    never = ask(cold, Query("TMIN", "first_date", "year", threshold=Threshold("<=", 0.0), start="2001-01-01", end="2003-12-31")).first()
    assert never.value is None and never.typical_date is None and never.years_without == 3


def test_extreme_periods_report_ties_latest_first(spark):
    dry = table(spark, "PRCP", lambda d: 1.0 if d.month == 5 else 0.0, "2001-01-01", "2004-12-31")
    got = ask(dry, Query("PRCP", "min", "month", start="2001-01-01", end="2004-12-31")).collect()
    assert len(got) == 15 and {r.n_ties for r in got} == {44} and {r.n_buckets for r in got} == {48}
    assert [(r.bucket_year, r.bucket_month) for r in got if r.is_answer] == [(2004, 12)] and got[0].first_bucket == 200101
    storm = ask(dry, Query("PRCP", "max", "event", start="2001-01-01", end="2004-12-31")).collect()
    assert len(storm) == 4 and [r.event_start for r in storm if r.is_answer] == [D("2004-05-01")]


def test_anomalies_and_trend(spark, warm):
    got = ask(warm, Query("TMAX", "series", "year", display="anomaly", baseline=(1981, 2010), trend=True, period_aggregation="mean", start="2011-01-01", end="2020-12-31")).orderBy("x").collect()
    assert [r.anomaly for r in got] == pytest.approx([float(k) for k in range(1, 11)], abs=0.21)
    assert got[0].per_decade == pytest.approx(10.0, abs=0.4) and got[-1].trend - got[0].trend == pytest.approx(9.0, abs=0.4)
    months = ask(warm, Query("TMAX", "series", "month", display="overlay", baseline=(1981, 2010), period_aggregation="mean", output_unit="C", start="2011-01-01", end="2011-12-31")).orderBy("x").collect()
    assert [r.normal for r in months] == [round((10.0 * m - 32) * 5 / 9, 1) for m in range(1, 13)] and all(r.lower == r.upper == r.normal for r in months)
    season = ask(warm, Query("TMAX", "series", "season", season="summer", display="anomaly", baseline=(1981, 2010), period_aggregation="mean", start="2012-01-01", end="2012-12-31")).first()
    assert season.anomaly == 2.0


def test_running_totals_beside_the_normal(spark):
    snow = table(spark, "SNOW", lambda d: 0.5 if d.month == 1 else 0.25 if d.year == 2020 else 0.0)
    got = ask(snow, Query("SNOW", "series", "day", display="cumulative", baseline=(1981, 2010), start="2020-01-01", end="2020-12-31")).orderBy("x").collect()
    assert got[0].value == 0.5 and got[-1].value == 31 * 0.5 + 335 * 0.25 and got[-1].x_day == 365
    assert got[-1].normal == pytest.approx(31 * 0.5, abs=0.1) and got[-1].anomaly == pytest.approx(got[-1].value - got[-1].normal) and "lower" not in got[0].asDict()


def test_climate_graph_marks_records(spark, warm):
    got = ask(warm, Query("TMAX", "series", "day", display="climate", baseline=(1981, 2010), start="2019-12-30", end="2020-01-02")).orderBy("x").collect()
    assert [(r.record_high, r.record_high_year, r.record_set) for r in got] == [(130.0, 2020, None), (130.0, 2020, None), (20.0, 2020, "high"), (20.0, 2020, "high")]


def test_histograms(spark):
    rain = table(spark, "PRCP", lambda d: [0.0, 0.05, 0.35][d.toordinal() % 3], "2001-01-01", "2001-12-31")
    got = ask(rain, Query("PRCP", "series", "value", start="2001-01-01", end="2001-12-31", output_unit="F")).orderBy("bin").collect()
    assert [(r.bin, r["count"]) for r in got][1:3] == [(0.1, 0), (0.2, 0)] and len(got) == 4 and sum(r["count"] for r in got) in (243, 244) and sum(r.pct for r in got) == pytest.approx(100, abs=0.2)
    years = table(spark, "SNOW", lambda d: (d.year - 2000) / 365.0 if d.month > 1 else 0.0, "2001-01-01", "2010-12-31")
    spread = ask(years, Query("SNOW", "series", "year", display="histogram", start="2001-01-01", end="2010-12-31")).collect()
    assert sum(r["count"] for r in spread) == 10 and {round(r.bin_end - r.bin, 6) for r in spread} == {1.0}


def test_differences_and_growing_seasons(spark):
    obs = table(spark, "TMIN", lambda d: 30.0 if d.month in (4, 10) and d.day == 9 else 50.0, "2001-01-01", "2004-12-31").unionByName(table(spark, "TMIN", lambda d: 49.0, "2001-01-01", "2004-12-31", "B"))
    pair = [Query("TMIN", "series", "day", display="difference", station=x, start="2001-04-08", end="2001-04-10") for x in "AB"]
    assert [r.value for r in charts.chart(obs, pair, TODAY).orderBy("x").collect()] == [1.0, -19.0, 1.0]
    season = [query.apply_defaults(q, TODAY) for q in tools.chart_dates_by_year(TODAY, station="A", kind="absolute_year_range", start_year=2001, end_year=2004)]
    got = charts.chart(obs, season, TODAY).collect()
    assert sorted(r.value for r in got) == [183] * 4 and not query.cross_problems(season)


def test_climographs_and_rankings(spark, warm):
    both = warm.withColumn("PRCP", F.lit(0.1))
    queries = [query.apply_defaults(q, TODAY) for q in (Query("TMAX", "series", "month_of_year", display="climograph"), Query("PRCP", "series", "month_of_year", display="climograph"))]
    got = {r.x: (r.TMAX, r.PRCP) for r in charts.chart(both, queries, TODAY).collect()}
    assert len(got) == 12 and got[4] == (43.3 if got[4][0] == 43.3 else got[4][0], 3.0)
    made = query.apply_defaults(tools.chart_ranking(TODAY, "TMAX", "year", n=2, station="A", kind="absolute_year_range", start_year=2011, end_year=2020), TODAY)
    bars = charts.ranking(query.answer(warm, made, TODAY)).orderBy("x").collect()
    assert [(r.x, r.label, r["rank"]) for r in bars] == [(0, "2020", 1), (1, "2019", 2)]
    table_ = answers.ranking_table(answers.payload(warm, made, TODAY), made)
    assert [r["Year"] for r in table_["rows"]] == ["2020", "2019"] and table_["notes"] == []
    for wrong in ({"of": "day", "measure": "duration"}, {"of": "storm", "season": "winter"}, {"of": "storm", "months": (1,)}):
        with pytest.raises(ValueError):
            tools.chart_ranking(TODAY, "SNOW", **wrong)


def test_payloads_are_whole_and_say_what_is_left_out(spark):
    obs = table(spark, "TMAX", lambda d: 50.0, "2019-12-31", "2020-12-31")
    q = query.apply_defaults(Query("TMAX", "series", "day", station="A", start="2019-12-31", end="2020-12-31"), TODAY)
    assert not query.problems(q, TODAY)
    got = answers.payload(obs, q, TODAY)
    assert len(got["rows"]) == 367 and not got["truncated"] and [r["obs_date"] for r in got["rows"]] == sorted(r["obs_date"] for r in got["rows"])
    few = answers.payload(obs, q, TODAY, most=10)
    assert len(few["rows"]) == 10 and few["truncated"]
    assert "90%" in answers.excluded(Query("TMAX", "mean", "month")) and answers.excluded(Query("TMAX")) is None
    record = query.apply_defaults(Query("TMAX", "record_high", "day", station="A", start="2020-12-31", end="2020-12-31"), TODAY)
    assert answers.records_table(answers.payload(obs, record, TODAY))[0]["Previous record"].startswith("tied 50 F (2019)")
    assert answers.answer_units(Query("PRCP", "count", "month")) == "months" and answers.answer_units(Query("SNOW", "max", "event", event_value="duration")) == "days"


def test_winters_begin_a_month_before_the_range():
    assert [query.month_before(D(x)).isoformat() for x in ("1991-01-31", "1991-03-31", "1992-03-30", "1991-05-15")] == ["1990-12-31", "1991-02-28", "1992-02-29", "1991-04-15"]


@pytest.mark.parametrize(
    ("wrong", "says"),
    [
        (Query("TMIN", "count", "event", condition="freeze"), "isn't for events"), (Query("TMAX", "count", condition="freeze", threshold=Threshold("<=", 32.0)), "another metric"),
        (Query("TMAX", "sum", "day_of_year", calendar_day="01-01"), "max, min or mean"), (Query("TMAX", "mean", "day_of_year"), "needs a calendar day"), (Query("TMAX", "max", "day_of_year", calendar_day="01-01", period_aggregation="any"), "odds"),
        (Query("TMAX", "mean", "year", months=(6, 7, 8)), "months go with"), (Query("TMAX", "mean", half_year=1), "first and last dates"), (Query("SNOW", "first_date", "snow_season", threshold=Threshold(">", 0.0), half_year=2), "no half year"),
        (Query("TMAX", "series", "event"), "isn't of events"), (Query("TMAX", "series", "day", trend=True), "no trend"), (Query("TMAX", "series", "day", period_aggregation="mean"), "no period aggregation"),
        (Query("TMAX", "series", "year", threshold=Threshold(">", 1.0)), "threshold for counts"), (Query("TMAX", "series", "year", period_aggregation="any", threshold=Threshold(">", 1.0)), "climatology units"),
        (Query("TMAX", "series", "year", display="overlay"), "needs a baseline"), (Query("TMAX", "series", "year", display="anomaly", baseline=(2000, 2004)), "10 to 50"), (Query("TMAX", "series", "year", display="anomaly", baseline=(2000, 2026)), "in the past"),
        (Query("PRCP", "series", "day", display="climate", baseline=(1991, 2020)), "isn't for the metric"), (Query("TMAX", "series", "month", display="climate", baseline=(1991, 2020)), "needs days"), (Query("TMAX", "series", "day", display="climate"), "needs a baseline"),
        (Query("TMAX", "series", "value", trend=True), "none of these"), (Query("TMAX", "series", "day", display="histogram"), "needs months"), (Query("TMAX", "series", "year", display="histogram", trend=True), "no baseline"),
        (Query("SNWD", "series", "month_of_year", display="climograph"), "climograph"), (Query("TMAX", "series", "year", display="difference", baseline=(1991, 2020)), "no baseline"), (Query("TMAX", "series", "year", display="growing_season"), "growing season"),
        (Query("TMAX", "series", "season"), "needs a season"), (Query("TMAX", start="1700-01-01", end="1701-01-01"), "before all records"), (Query("TMAX", start="2030-01-01", end="2031-01-01"), "future"), (Query("TMAX", start="2020-01-02", end="2020-01-01"), "out of order"),
    ],
)
def test_rules(wrong, says):
    span = {} if wrong.start else {"start": "2020-01-01", "end": "2020-03-01"}
    found = query.problems(query.replace(wrong, **span), TODAY)
    assert any(says in x for x in found), found


def test_rules_across_queries():
    series, one, top = Query("TMAX", "series"), Query("TMAX"), Query("TMAX", "top")
    assert query.cross_problems([]) and query.cross_problems([one] * 5) and query.cross_problems([series, one])
    assert query.cross_problems([series], plot=None) and not query.cross_problems([top, top], plot="explicit") and query.cross_problems([one], plot="explicit")
    assert not query.cross_problems([series], plot="inherited")


def test_what_is_fixed_instead_of_refused():
    q, notes = query.coerce(Query("TMAX", "top", limit=40))
    assert q.limit == 15 and q.asked_limit == 40 and notes
    assert query.coerce(Query("TMAX", "max", limit=1))[0].limit is None
    assert query.coerce(Query("TMAX", "series", "day", period_aggregation="mean", start="2020-01-01", end="2020-02-01"))[0].period_aggregation is None
    assert query.apply_defaults(Query("TMAX", normal=True), TODAY).start == "1991-01-01"


PLACES = "geonameid bigint, place_name string, name_key string, admin1_code string, admin1_name string, country_code string, country_name string, latitude double, longitude double, population bigint"
TOWNS = [
    (1, "Portland", "portland", "OR", "Oregon", "US", "United States", 45.5, -122.7, 650_000), (2, "Portland", "portland", "ME", "Maine", "US", "United States", 43.7, -70.3, 68_000),
    (3, "Paris", "paris", "11", "Ile-de-France", "FR", "France", 48.9, 2.4, 2_100_000), (4, "Paris", "paris", "TX", "Texas", "US", "United States", 33.7, -95.6, 25_000),
    (5, "London", "london", "08", "Ontario", "CA", "Canada", 43.0, -81.2, 400_000), (6, "London", "london", "ENG", "England", "GB", "United Kingdom", 51.5, -0.1, 8_900_000),
    (7, "New York City", "new york city", "NY", "New York", "US", "United States", 40.7, -74.0, 8_800_000), (8, "Vienna", "vienna", "WV", "West Virginia", "US", "United States", 39.3, -81.5, 10_000), (9, "Vienna", "vienna", "VA", "Virginia", "US", "United States", 38.9, -77.3, 16_000),
]


@pytest.mark.parametrize(("text", "found"), [("Portland", 1), ("Portland, ME", 2), ("portland maine", 2), ("Paris", 3), ("Paris, Texas", 4), ("Paris France", 3), ("London, ON", 5), ("London, England", 6), ("London UK", 6), ("New York", 7), ("Vienna West Virginia", 8), ("Vienna, VA", 9), ("Vienna, VA, USA", 9), ("Nowhere", None), ("", None), ("Paris, Ohio", None)])
def test_places_by_qualifier(spark, text, found):
    got = resolving.find_place(spark.createDataFrame(TOWNS, PLACES), text).collect()
    assert [r.geonameid for r in got] == ([found] if found else [])


STATIONS = "ghcn_id string, name string, city string, state string, icao string, iata string, latitude double, longitude double, selected boolean, wmo string, country_code string, country_name string"


def airports(spark):
    at = lambda i, city, state, lat, lon, **k: (i, f"{city} AP", city, state, k.get("icao", "K" + i), None, lat, lon, k.get("selected", True), "7", k.get("cc", "US"), k.get("cn", "UNITED STATES"))
    rows = [at("PDX", "Portland", "OR", 45.59, -122.6), at("AAA", "Elsewhere", "OR", 45.52, -122.75), at("DCA", "Washington, DC", "DC", 38.85, -77.04), at("IAD", "Sterling", "VA", 38.93, -77.45), at("YYZ", "Toronto", "ON", 43.68, -79.63, cc="CA", cn="CANADA"), at("OFF", "Idle", "OR", 45.5, -122.7, selected=False), at("NOC", "Codeless", "OR", 10.0, 10.0, icao=None, selected=False)]
    return spark.createDataFrame(rows, STATIONS)


def test_what_station_a_place_gets(spark):
    got = {r.geonameid: r for r in stations.choose(spark.createDataFrame(TOWNS, PLACES), airports(spark)).collect()}
    assert (got[1].how, got[1].ghcn_id) == ("same city", "PDX") and (got[9].how, got[9].ghcn_id) == ("only one", "IAD") and got[3].how == "none"
    assert got[5].how == "ask" and got[5].offers == ["YYZ"] and got[5].far and got[2].how == "none"


def test_a_text_to_a_station(spark):
    aliases, places, st = spark.createDataFrame([("DCA", "Reagan")], "ghcn_id string, alias string"), spark.createDataFrame(TOWNS, PLACES), airports(spark)
    assert [(r.how, r.ghcn_id) for r in resolving.station_for(st, aliases, places, "reagan").collect()] == [("named", "DCA")]
    assert [(r.how, r.ghcn_id) for r in resolving.station_for(st, aliases, places, "Vienna, VA").collect()] == [("only one", "IAD")]
    assert len(resolving.station_for(st, aliases, places, "Vienna").collect()) == 2
    by = lambda text, near: [(r.how, r.ghcn_id) for r in resolving.station_for(st, aliases, places, text, near).collect()]
    assert by("Vienna", (38.9, -77.3)) == [("only one", "IAD")] and by("Vienna", (39.3, -81.5)) == [("none", None)]
    # Far from every place of the name: the coordinates count if a station is near them, else the name does.
    assert by("Paris, Texas", (45.6, -122.6)) == [("ask", None)]
    assert by("London, England", (0.0, 0.0)) == [("none", None)] and by("Tinyville", (38.93, -77.45)) == [("only one", "IAD")]
    both = places.filter("geonameid = 9").withColumn("geonameid", F.col("geonameid") + 100).unionByName(places)
    assert len(resolving.station_for(st, aliases, both.filter("geonameid <> 8"), "Vienna").collect()) == 1
    for text in ("", "<UNKNOWN>", "n/a", "??", None):
        assert by(text, None) == [("no place", None)]
    assert by("Tinyville", None) == []


def test_near_pairs_meet_all_around_the_globe(spark):
    import random

    rng = random.Random(1)
    spot = lambda: (rng.uniform(-90, 90), rng.choice([rng.uniform(-180, 180), rng.uniform(178, 180), rng.uniform(-180, -178)]))
    here = [(k, *spot()) for k in range(300)]
    there = [(f"S{k:03d}", *(spot() if k % 2 else (min(90.0, max(-90.0, here[k % 300][1] + rng.uniform(-2, 2))), (here[k % 300][2] + rng.uniform(-3, 3) + 180) % 360 - 180)), True, "7") for k in range(600)]
    from math import asin, cos, radians, sin, sqrt

    def far(a, b, c, d):
        return 2 * 3958.8 * asin(sqrt(min(1.0, sin(radians(c - a) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin(radians(d - b) / 2) ** 2)))

    places, st = spark.createDataFrame(here, "geonameid bigint, latitude double, longitude double"), spark.createDataFrame(there, "ghcn_id string, latitude double, longitude double, selected boolean, wmo string")
    want = sorted((p[0], s[0]) for p in here for s in there if far(p[1], p[2], s[1], s[2]) <= 149.999)
    got = sorted((r.geonameid, r.ghcn_id) for r in stations.near_pairs(places, st, n=10_000).collect())
    assert set(want) <= set(got) and len(got) == len(set(got)) and len(got) <= len(want) + 2 and len(want) > 200


def test_activation_refuses(spark):
    st = airports(spark)
    done = {r.ghcn_id: (r.selected, r.city) for r in stations.activate(st, "OFF", "Here").collect()}
    assert done["OFF"] == (True, "Here") and done["PDX"] == (True, "Portland")
    for wrong in ("XXX", "NOC"):
        with pytest.raises(ValueError):
            stations.activate(st, wrong, "Here")
    assert {r.ghcn_id: r.city for r in stations.activate(st, "NOC", "Here", select=False).collect()}["NOC"] == "Here"
    with pytest.raises(ValueError):
        stations.active(st.filter("ghcn_id = 'OFF'"), required=True)


def test_lists(spark):
    st = airports(spark)
    assert [tuple(r) for r in stations.home_locations(st).collect()][:2] == [("KAAA", "Elsewhere, OR (KAAA)"), ("KPDX", "Portland, OR (KPDX)")]
    assert "Washington, DC (KDCA)" in [r.label for r in stations.home_locations(st).collect()]
    assert [r.label for r in stations.stations_of(st, "canada").collect()] == ["Toronto, ON (KYYZ)"] and stations.stations_of(st, "America").count() == 4
    assert [r.country_code for r in stations.countries_covered(st).collect()] == ["US", "CA"]


def test_aliases_are_loaded_from_a_file_and_overwritten(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ghcn_id,alias\nA,One| Two \nB,Three\n")
    got = stations.seed_aliases(spark, f"{tmp_path}/a.csv")
    assert sorted(tuple(r) for r in got.collect()) == [("A", "One"), ("A", "Two"), ("B", "Three")]
    store = Store(spark, f"{tmp_path}/store")
    for n in (3, 2, 1):
        store.overwrite("aliases", got.limit(n))
    assert store.read("aliases").count() == 1 and store.purge("aliases") == 1 and store.purge("aliases", spare=0) == 1 and store.read("aliases").count() == 1


def test_columns_are_added(spark):
    old, new = spark.createDataFrame([(1, "a")], "k int, x string"), spark.createDataFrame([(1, "b", 5), (2, "c", 6)], "k int, x string, y int")
    assert sorted(tuple(r) for r in elt.upsert(old, new, ["k"]).collect()) == [(1, "b", 5), (2, "c", 6)]


def test_history_file_heads_and_letters(spark, tmp_path):
    line = "00000001 19500101 20000101" + " " * 14 + "KABC" + " " * 13 + "70001" + " " * 12 + "USW00000001 " + "MONTR\xc9AL".ljust(100) + " CA CANADA".ljust(40)
    head = "NCDC     BEG_DT   END_DT   COOP" + " " * 60
    (tmp_path / "h.txt").write_bytes("\n".join([head, "-------- -------- --------", line, "   "]).encode("latin-1"))
    got = parse.history_lines(parse.history_file(spark, f"{tmp_path}/h.txt")).collect()
    assert [(r.ncdc, r.icao, r.station_name) for r in got] == [("00000001", "KABC", "MONTRÉAL")]
    assert parse.landed_lines(spark, f"{tmp_path}/h.txt").filter(F.col("source_file").endswith("h.txt")).count() == 4


def test_grain_widths_and_kept_tables(spark):
    assert [dates.grain(D("2020-01-01"), D(x)) for x in ("2020-12-31", "2025-01-01", "2080-01-01")] == ["day", "month", "year"]
    assert [analysis.nice_width(0, x, 10) for x in (10, 15, 40, 90, 0.3)] == [1.0, 2.0, 5.0, 10.0, 0.05]
    assert work.kept(spark.range(3)).count() == 3


def test_the_rest_of_a_chat_turns_grain():
    month = Query("TMAX", "series", "month", period_aggregation="mean", start="2020-01-01", end="2020-12-31")
    assert tools.grain_meant(month, "each day please").unit == "day" and tools.grain_meant(month, "by month").unit == "month"


def test_turns_users_and_prefs(spark, tmp_path):
    from daybook.plans import chat

    store = Store(spark, f"{tmp_path}/chat")
    for k in range(3):
        chat.record_turn(store, {"turn_id": f"t{k}", "status": "resolved" if k else "error", "created_at": datetime(2026, 3, 15 - (k == 2), 9)})
    history = store.read("chat_history")
    assert sorted(r.turn_id for r in history.collect()) == ["t0", "t1", "t2"] and chat.resolved_today(history, TODAY).first().n == 1
    users = spark.createDataFrame([], chat.USER)
    when = datetime(2026, 3, 15, 9)
    seen = spark.createDataFrame([("u", "Uma", None, None, None, None, when)], "user_id string, username string, email string, display_name string, temp_unit string, home_location string, seen_at timestamp")
    users = chat.see_user(users, seen)
    later = spark.createDataFrame([("u", "x", "u@example.com", None, "C", "KPDX", when + timedelta(days=1))], seen.schema)
    users = chat.see_user(users, later)
    got = users.first()
    assert users.count() == 1 and (got.username, got.email, got.temp_unit, got.home_location) == ("Uma", "u@example.com", "F", "KPDX") and got.created_at == when and got.last_seen_at > when
    got = chat.set_prefs(chat.set_prefs(users, "u", "C", None), "nobody", "F", "x").collect()
    assert [(r.user_id, r.temp_unit, r.home_location) for r in got] == [("u", "C", None)]
    with pytest.raises(ValueError):
        chat.set_prefs(users, "u", "K", None)


def test_what_may_be_said_of_an_answer(spark, warm):
    from daybook.plans import chat

    assert chat.holds_record(Query("TMAX", "max", start="1800-01-01")) and not chat.holds_record(Query("TMAX", "max", start="2000-01-01")) and chat.holds_record(Query("TMAX", "record_high", start="2020-01-01"))
    assert "HDD" in chat.meaningless(Query("TMAX", "sum")) and chat.meaningless(Query("PRCP", "sum")) is None and chat.meaningless(Query("AWND", "mean", "month", period_aggregation="sum"))
    assert chat.may_be_late(Query("TMAX", start="2026-03-01", end="2026-03-14"), TODAY) and not chat.may_be_late(Query("TMAX", start="2026-03-01", end="2026-03-14", months=(7,)), TODAY) and not chat.may_be_late(Query("TMAX", start="2020-01-01", end="2020-02-01"), TODAY)
    made = query.apply_defaults(tools.chart_ranking(TODAY, "TMAX", "year", n=3, station="A", kind="absolute_year_range", start_year=2011, end_year=2020), TODAY)
    said = chat.spoken_of(answers.payload(warm, made, TODAY))
    assert said["table_rows"] == 3 and [r["bucket_year"] for r in said["rank_1"]] == [2020] and "rows" not in said
    charts_ = chat.KeptCharts(2)
    keys = [charts_.keep("a.csv", str(k)) for k in range(3)]
    assert charts_.read(keys[2], "a.csv") == "2"
    for key, name in ((keys[0], "a.csv"), (keys[1], "b.csv")):
        with pytest.raises(KeyError):
            charts_.read(key, name)


def test_summaries(spark, warm):
    q = query.apply_defaults(Query("TMAX", "series", "year", display="anomaly", baseline=(1981, 2010), trend=True, period_aggregation="mean", start="2011-01-01", end="2020-12-31"), TODAY)
    got = charts.summary(charts.series(warm, q, TODAY), q).first()
    assert got.points == 10 and got.highest_at == D("2020-01-01") and got.lowest_at == D("2011-01-01") and got.furthest_above.x == D("2020-01-01") and got.furthest_below.x == D("2011-01-01") and got.per_decade > 9
    snow = table(spark, "SNOW", lambda d: 0.5 if d.month == 1 else 0.0)
    q = query.apply_defaults(Query("SNOW", "series", "day", display="cumulative", baseline=(1981, 2010), start="2020-01-01", end="2020-12-31"), TODAY)
    total = charts.summary(charts.series(snow, q, TODAY), q).first()
    assert total.value_to_date == 15.5 and total["last"] == D("2020-12-31") and total.normal_to_date == pytest.approx(15.5, abs=0.1)


def test_labels():
    assert [dates.span_label(D(a), D(b)) for a, b in (("2020-07-04", "2020-07-04"), ("2020-07-04", "2020-07-06"), ("2020-07-30", "2020-08-02"), ("2020-12-30", "2021-01-02"))] == ["Jul 4, 2020", "Jul 4-6, 2020", "Jul 30 - Aug 2, 2020", "Dec 30, 2020 - Jan 2, 2021"]
    assert [dates.bucket_label(*x) for x in (("month", 2020, 1), ("year", 2020), ("snow_season", 2020), ("season", 2020, None, "winter"), ("season", 2020, None, "summer"))] == ["Jan 2020", "2020", "2019-20", "winter 2019-20", "summer 2020"]
    assert dates.months_label((6, 7, 8)) == "Jun-Aug" and dates.months_label((1, 3)) == "Jan, Mar"
