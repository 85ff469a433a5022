"""Tables of texts and requests, SQL functions, stored sums and clustered tables, on small made tables."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from daybook.functions.vocabulary import COUNTRY_CODES, PROVINCES
from daybook.operators import daily, events, periods, records, state
from daybook.plans import places, query, requests, sql_functions, stations
from daybook.plans.query import Query, Threshold
from daybook.plans.store import Stale, Store
from daybook.sources import catalog

from .test_charts import PLACES, TOWNS, airports

D = date.fromisoformat
TODAY = date(2026, 3, 15)


def history(spark, years=range(1980, 2011), station=("A", "B")):
    rng = random.Random(3)
    rows = [(s, date(y, 1, 1) + timedelta(days=k), None if rng.random() < 0.05 else float(rng.randrange(20, 90)), None if rng.random() < 0.05 else rng.choice([0.0, 0.0, 0.25, 0.5])) for s in station for y in years for k in range(0, 365, 1)]
    return spark.createDataFrame(rows, "station_id string, obs_date date, TMAX double, PRCP double")


# --- texts


def test_folding_in_the_jvm_is_the_plain_one(spark):
    rng = random.Random(5)
    chars = [*map(chr, range(32, 0x250)), *map(chr, range(0x1E00, 0x1F00)), "ﬁ", "½", "①", "漢", "😀", "\t", " ", "K", "ſ", "㎏", "́"]
    texts = ["  Montréal  Île ", "", *("".join(rng.choice(chars) for _ in range(rng.randint(0, 12))) for _ in range(800))]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", places.fold_column(F.col("text")).alias("f")).collect()
    assert [(r.text, r.f) for r in got] == [(t, stations.fold(t)) for t in texts]


def plain_place(text):
    """One text against all places."""
    folded = stations.fold(text)
    parts = [p.strip() for p in folded.split(",")]
    if "," in folded:
        ways = [(parts[0], [p for p in parts[1:] if p])]
    else:
        words = folded.split()
        ways = [(folded, [])] + [(" ".join(words[:-k]), [" ".join(words[-k:])]) for k in (1, 2, 3) if k < len(words)]

    def within(p, q):
        code, state_name, cc, country = (str(x).lower() for x in p[3:7])
        return q in (code, state_name, country) or PROVINCES.get(q) == state_name or COUNTRY_CODES.get(q, q) == cc

    for name, marks in ways:
        if name:
            met = [p for p in TOWNS if (p[2] == name or p[2].startswith((name + " ", name + ","))) and all(within(p, q) for q in marks)]
            if met:
                return min(met, key=lambda p: (p[2] != name, -p[9], p[0]))[0]
    return None


def test_a_table_of_texts_is_each_text_alone(spark):
    rng = random.Random(7)
    names, ends = ["Portland", "Paris", "London", "New York", "New", "Vienna", "vienna ", "Nowhere", ""], ["", " texas", ", TX", ", VA, usa", " uk", " west virginia", ", ON", " united states", ", , OR,", " new york", "  France "]
    texts = [rng.choice(names) + rng.choice(ends) for _ in range(150)] + ["London, England"] * 30 + [None]
    got = places.resolve_places(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string"), spark.createDataFrame(TOWNS, PLACES), "t").collect()
    assert len(got) == len(texts)
    assert {r.k: r.geonameid for r in got} == {k: None if t is None else plain_place(t) for k, t in enumerate(texts)}


def test_a_table_of_requests_for_stations(spark):
    aliases, towns, st = spark.createDataFrame([("DCA", "Reagan")], "ghcn_id string, alias string"), spark.createDataFrame(TOWNS, PLACES), airports(spark)
    asked = [("reagan", None, None), ("Vienna, VA", None, None), ("Vienna", None, None), ("Vienna", 38.9, -77.3), ("Vienna", 38.9, -77.3), ("Paris, Texas", 45.6, -122.6), ("Tinyville", 38.93, -77.45), ("Tinyville", None, None), ("n/a", None, None), (None, None, None)]
    rows = places.resolve_stations(spark.createDataFrame(asked, places.REQUEST), st, aliases, towns).collect()
    got = {}
    for r in rows:
        got.setdefault((r.text, r.latitude), []).append((r.how, r.ghcn_id, r.place))
    assert {k: sorted(v, key=repr) for k, v in got.items()} == {
        ("reagan", None): [("named", "DCA", "Washington, DC")], ("Vienna, VA", None): [("only one", "IAD", "Vienna")], ("Vienna", None): [("none", None, "Vienna"), ("only one", "IAD", "Vienna")], ("Vienna", 38.9): [("only one", "IAD", "Vienna")],
        ("Paris, Texas", 45.6): [("ask", None, "Paris, Texas")], ("Tinyville", 38.93): [("only one", "IAD", "Tinyville")], ("Tinyville", None): [("none", None, None)], ("n/a", None): [("no place", None, None)], (None, None): [("no place", None, None)],
    }


def test_equal_texts_are_folded_once(spark, monkeypatch):
    n, fold = spark.sparkContext.accumulator(0), stations.fold

    def counted(text):
        n.add(1)
        return None if text is None else fold(text)

    monkeypatch.setattr(places, "fold_column", F.udf(counted, "string"))
    texts = spark.range(3000).select(F.element_at(F.array(*[F.lit(t) for t in ("Vienna", "Paris, Texas", "n/a")]), (F.col("id") % 3 + 1).cast("int")).alias("text"))
    towns, aliases = spark.createDataFrame(TOWNS, PLACES), spark.createDataFrame([], "ghcn_id string, alias string")
    assert places.resolve_places(texts, towns).filter("geonameid IS NOT NULL").count() == 2000
    assert 0 < n.value <= 100
    none = F.lit(None).cast("double")
    asked = texts.select("text", none.alias("latitude"), none.alias("longitude"))
    assert places.resolve_stations(asked, airports(spark), aliases, towns).select("text").distinct().count() == 3
    assert n.value <= 200


def test_prefixes_that_no_text_reads_are_not_indexed(spark):
    names = spark.createDataFrame([("new",), ("paris",), ("new",)], "name string")
    got = places.index(spark.createDataFrame(TOWNS, PLACES), names).collect()
    assert {r.prefix for r in got} == {"new", "paris"}
    assert sorted(r.place.geonameid for r in got) == sorted(t[0] for t in TOWNS for name in ("new", "paris") if t[2] == name or t[2].startswith((name + " ", name + ",")))


# --- requests


def test_a_thousand_requests_read_the_table_once(spark, tmp_path):
    history(spark, range(2000, 2003)).write.parquet(f"{tmp_path}/obs")
    obs = spark.read.parquet(f"{tmp_path}/obs")
    rng = random.Random(1)
    asked = [(k, rng.choice(["A", "B", "none"]), rng.choice(["TMAX", "PRCP", "HUM"]), rng.choice(["mean", "max", "count", "median", "sum", "odd"]), rng.choice(["day", "event", "month", "year", "week"]), date(2000 + k % 3, 1, 1), None if k % 5 == 0 else date(2001 + k % 2, 12, 31), [1, 2] if k % 7 == 0 else None, ">=", 0.2, rng.choice(["mean", "sum", "count", "any"])) for k in range(1000)]
    found = requests.answered(spark.createDataFrame(asked, requests.REQUEST), obs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Cartesian" not in plan and "NestedLoop" not in plan
    got = {r.request_id: r for r in found.collect()}
    assert len(got) == 1000
    for k, station, metric, how, unit, a, b, months, op, t, made in rng.sample(asked, 14):
        if station == "none" or metric == "HUM" or how == "odd" or unit == "week" or a > (b or TODAY):
            assert got[k].value in (None, 0.0)
            continue
        read = daily.daily_values(obs, metric, a.isoformat(), (b or TODAY).isoformat(), months, op, t, station)
        if unit == "day":
            want = daily.day_stats(read, how).select(F.col(how).alias("v"), F.col("n_days").alias("n"))
        else:
            rows = events.events(read).withColumn("value", F.col("total")) if unit == "event" else periods.buckets(read, unit, made, 1, months if unit == "year" else None)
            pick = F.count("value").cast("double") if how == "count" else daily.aggregate(how)
            want = rows.agg(pick.alias("v"), F.count("value").alias("n"))
        want = want.collect()
        v, n = (want[0].v, want[0].n) if want else (0.0 if how == "count" else None, 0)
        assert got[k].n == n and (got[k].value == pytest.approx(v) if v is not None else got[k].value is None), asked[k]


def test_requests_that_ask_the_same_meet_the_days_once(spark, monkeypatch):
    obs, met = history(spark, range(2000, 2002)), []
    days = requests.asked_days
    monkeypatch.setattr(requests, "asked_days", lambda *a: met.append(days(*a)) or met[-1])
    how = ["mean", "max", "count", "sum", "median", "min", "stddev"]
    ask = lambda k, months=None: (k, "A", "TMAX", how[k % 7], ["day", "month"][k % 2], date(2000, 1, 1), date(2001, 12, 31), months, ">=", 50.0, "mean")
    found = requests.answered(spark.createDataFrame([ask(k) for k in range(2100)] + [ask(2100, [1]), ask(2100)], requests.REQUEST), obs).collect()
    assert met[0].count() == 2 * 730 + 31 + 31  # two units, and the Januaries
    assert len(found) == 2102 and len({(r.value, r.n) for r in found if r.request_id < 2100}) == 14
    for k in range(14):
        alone = requests.answered(spark.createDataFrame([ask(k)], requests.REQUEST), obs).first()
        assert {(r.value, r.n) for r in found if r.request_id % 14 == k and r.request_id < 2100} == {(alone.value, alone.n)}
    assert len({r.n for r in found if r.request_id == 2100}) == 2


# --- SQL


def test_sql_functions_are_the_operators(spark, tmp_path):
    history(spark, range(2000, 2004)).write.parquet(f"{tmp_path}/obs")
    obs = spark.read.parquet(f"{tmp_path}/obs").withColumns({m: F.lit(None).cast("double") for m in ("TMIN", "TAVG", "SNOW", "SNWD", "AWND")} | {m: F.lit(None).cast("int") for m in ("HDD", "CDD")})
    sql_functions.register(spark, obs)
    read = daily.daily_values(obs, "PRCP", "2001-01-01", "2003-06-30", [1, 2, 3], ">=", 0.2, "A")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    args = "'A', 'PRCP', DATE'2001-01-01', DATE'2003-06-30', array(1, 2, 3)"
    got = spark.sql(f"SELECT * FROM daily_values({args}, '>=', 0.2)")
    assert rows(got) == rows(read.drop("station_id"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(station_id,A)" in plan and "TMAX" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert rows(spark.sql(f"SELECT * FROM event_list({args}, '>=', 0.2)")) == rows(events.events(read).drop("station_id"))
    whole = daily.daily_values(obs, "TMAX", "1800-01-01", "9999-12-31", station="B")
    for unit, first in (("month", 1), ("year", 1), ("year", 7)):
        assert rows(spark.sql(f"SELECT * FROM period_list('B', 'TMAX', '{unit}', 'mean', p_first_month => {first})")) == rows(periods.buckets(whole, unit, "mean", first).drop("station_id"))
    one = spark.sql("SELECT answer_value('B', 'TMAX', 'max', 'month') AS m, answer_value('B', 'TMAX', 'count', p_operator => '>=', p_threshold => 50) AS c, answer_value('B', 'TMAX', 'mean', 'odd') AS n").first()
    want = periods.buckets(whole, "month", "mean").agg(F.max("value")).first()[0]
    assert one.m == pytest.approx(want) and one.c == whole.filter("value >= 50").count() and one.n is None
    sql_functions.register(spark, obs, airports(spark))
    assert spark.sql("SELECT lookup_station_id('k-pdx') AS a, lookup_station_id('Sterling') AS b, lookup_station_id('x') AS c").first() == ("PDX", "IAD", None)
    sql_functions.register(spark, obs)
    with pytest.raises(Exception, match="lookup_station_id"):
        spark.sql("SELECT lookup_station_id('x')").collect()


@pytest.mark.parametrize("hostile", ["A' OR '1'='1", "A'; DROP VIEW daybook_observations; --", ":metric", "\\'", "A\u0000"])
def test_what_callers_give_stays_a_value(spark, hostile):
    obs = history(spark, range(2000, 2001)).withColumns({m: F.lit(None).cast("double") for m in ("TMIN", "TAVG", "SNOW", "SNWD", "AWND", "HDD", "CDD")})
    sql_functions.register(spark, obs)
    assert sql_functions.days_asked(spark, hostile, "TMAX", "1999-01-01", "2001-01-01").count() == 0
    assert sql_functions.days_asked(spark, "A", "TMAX", "1999-01-01", "2001-01-01", operator=hostile, threshold=1.0).filter("hit = 1").count() == 0
    assert sql_functions.days_asked(spark, "A", "TMAX", "2000-02-01", "2001-01-01", [2, 3]).count() == 29 + 31
    with pytest.raises(ValueError):
        sql_functions.days_asked(spark, "A", "TMAX", "1999-01-01", "2001-01-01", [hostile])


# --- stored sums


def test_sums_in_parts_are_those_of_all(spark, tmp_path):
    days = daily.daily_values(history(spark), "TMAX", "1800-01-01", "9999-12-31")
    store, spans = Store(spark, f"{tmp_path}/s"), ((1800, 9999), (1981, 2010))
    made = lambda rows: state.sums(rows, "TMAX", *spans[0]).unionByName(state.sums(rows, "TMAX", *spans[1]))
    for k, (a, b) in enumerate((("1980-01-01", "1999-12-31"), ("2000-01-01", "2010-06-14"), ("2010-06-15", "2010-12-31"))):
        state.advance(store, "sums", made(days.filter(F.col("obs_date").between(a, b))), ("load", k))
    again = made(days.filter("obs_date = '2010-06-20'"))
    before = store.version("sums")
    state.advance(store, "sums", again, ("load", 2))  # is stored already
    assert store.version("sums") == before
    for first, last in spans:
        got = sorted(map(tuple, state.day_of_year(store.read("sums"), "TMAX", first, last).collect()))
        want = sorted(map(tuple, periods.day_of_year(days.filter(F.year("obs_date").between(first, last)), "TMAX").collect()))
        assert [tuple(x if not isinstance(x, float) else pytest.approx(x, abs=0.1) for x in r) for r in want] == got
        assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]  # all but the deviation exactly
    state.advance(store, "sums", again, ("load", 3))
    new = store.version("sums")
    assert {p for p in new.parts if new.parts[p] != before.parts[p]} == {"p_month=06"}
    store.upsert("sums", state.redone(days, days.filter("obs_date = '2010-06-20'"), "TMAX", 1800, 9999), state.KEY)
    n = store.read("sums").filter("day = '06-20' AND span = '1800-9999'").agg(F.sum("n")).first()[0]
    assert n == days.filter("value IS NOT NULL AND date_format(obs_date, 'MM-dd') = '06-20'").count()
    with pytest.raises(Stale):
        store.upsert("sums", again, state.KEY, expect=1)


def test_a_climate_graph_reads_sums_not_the_history(spark, tmp_path):
    history(spark).write.parquet(f"{tmp_path}/obs")
    obs = spark.read.parquet(f"{tmp_path}/obs")
    days = daily.daily_values(obs, "TMAX", "1800-01-01", "9999-12-31")
    state.sums(days, "TMAX", *state.ALL_YEARS).unionByName(state.sums(days, "TMAX", 1981, 2010)).write.parquet(f"{tmp_path}/sums")
    q = query.apply_defaults(Query("TMAX", "series", "day", display="climate", baseline=(1981, 2010), start="2009-01-01", end="2009-12-31"), TODAY)
    kept = query.answer(obs, q, TODAY, spark.read.parquet(f"{tmp_path}/sums"))
    whole = query.answer(obs, q, TODAY)
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("/obs]")
    assert scans(kept) == 1 and scans(whole) > 1 and kept.columns == whole.columns
    a, b = (sorted(df.select("station_id", "x", "value", "normal", "anomaly", "record_high", "record_high_year", "record_low", "record_low_year", "record_set").collect()) for df in (kept, whole))
    assert a == b and len(a) > 600


# --- clustered tables


def test_what_goes_by_station_needs_no_shuffle(spark, tmp_path):
    obs = history(spark, range(1970, 2005))
    table = catalog.cluster(obs, "daybook_clustered_test", f"{tmp_path}/clustered", 4)
    try:
        read = daily.daily_values(table, "PRCP", "1800-01-01", "2100-01-01", op=">=", threshold=0.2)
        whole = daily.daily_values(table, "TMAX", "1800-01-01", "2100-01-01")
        found, high = events.events(read), records.record_days(whole, "2000-01-01", "2004-12-31")
        assert catalog.shuffles(found) == catalog.shuffles(high) == 0
        plain = daily.daily_values(obs, "PRCP", "1800-01-01", "2100-01-01", op=">=", threshold=0.2)
        assert catalog.shuffles(events.events(plain)) > 0
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, events.events(plain).collect())) and high.count() > 0
    finally:
        catalog.drop(spark, "daybook_clustered_test")


def test_thresholds_of_a_query_stay(spark):
    q = Query("PRCP", "count", threshold=Threshold(">=", 0.2), start="2000-01-01", end="2000-12-31", station="A")
    assert query.answer(history(spark, range(2000, 2001)), q, TODAY).count() == 1
