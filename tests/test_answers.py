"""Landing helpers, chart grouping and payloads."""

import io
import zipfile
from datetime import date, timedelta

import pytest

from daybook.plans import answers, query, tools
from daybook.plans.query import Query
from daybook.sources import landing

TODAY = date(2026, 3, 15)


def test_tail_and_zip_and_retries():
    data = b"one\ntwo\nthree\n"
    assert landing.tail_lines(lambda n: data[-n:], 9) == ["three"]
    assert landing.tail_lines(lambda n: data, 100) == ["one", "two", "three"]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.txt", "x\ny")
    assert landing.unzip_lines(packed.getvalue(), "a.txt") == ["x", "y"]
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return b"ok"

    assert landing.retried(flaky, wait=waits.append) == b"ok" and waits == [1.0, 2.0]


def test_landed_lines(spark):
    got = landing.landed(spark, ["a", "b"], "f.txt", "2024-01-01 00:00:00").collect()
    assert [(r.raw_line, r.source_file) for r in got] == [("a", "f.txt"), ("b", "f.txt")]


def test_charts_are_grouped():
    queries = [*tools.chart_over_time(TODAY, ["TMAX", "TMIN", "PRCP"], kind="absolute_year", year=2020), *tools.chart_climograph()]
    assert [len(g) for g in answers.grouped(queries)] == [2, 1, 3]
    assert answers.chart_kind([tools.chart_odds("rain_day")]) == "odds" and answers.chart_kind([tools.chart_histogram(TODAY, "TMAX")]) == "histogram"


def test_payload_and_csv(spark, tmp_path):
    rows = [("A", date(2020, 1, 1) + timedelta(days=k), 50.0) for k in range(366)]
    obs = spark.createDataFrame(rows, "station_id string, obs_date date, TMAX double")
    q = query.apply_defaults(Query("TMAX", "max", "year", station="A", start="2020-01-01", end="2020-12-31", output_unit="C"), TODAY)
    got = answers.payload(obs, q, TODAY)
    assert got["units"] == "C" and got["rows"][0]["value"] == 10.0
    with pytest.raises(ValueError):
        answers.payload(obs, Query("TMAX"), TODAY)
    answers.write_csv(obs, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 366
