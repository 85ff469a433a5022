"""Landed files: tails, archives, answers with a quarantine."""

import zipfile
from datetime import date

import pytest

from daybook.sources import files, parse, payloads


def month(k, station="USW00000001"):
    return f"{station}{1990 + k // 12:04d}{1 + k % 12:02d}TMAX" + "".join(f"{100 + k + d:5d}   " for d in range(31))


@pytest.mark.parametrize("size", [0, 1, 269, 270, 271, 1000, 2700, 10**9])
def test_tails_are_the_last_whole_lines(spark, tmp_path, size):
    files.register(spark)
    want = []
    for n in range(4):
        lines = [month(k, f"USW0000000{n}") for k in range(10 * n)]
        data = "\n".join(lines).encode() + (b"\n" if n % 2 else b"")
        (tmp_path / f"f{n}.dly").write_bytes(data)
        at = 0
        for line in lines:
            if size == 0 or at >= len(data) - size:
                want.append(line)
            at += len(line) + 1
    (tmp_path / "_SUCCESS").write_text("")
    read = spark.read.format("tail_lines").option("tail_bytes", size).load(str(tmp_path))
    assert sorted(r.value for r in read.collect()) == sorted(want)
    if size == 2700:
        tail = parse.daily_lines(read)
        whole = parse.daily_lines(spark.createDataFrame([(x,) for x in want], "value string"))
        assert tail.count() == whole.count() > 0 and tail.exceptAll(whole).count() == 0 and read.select("source_file").distinct().count() == 3


def test_tails_in_small_pieces_and_with_errors(tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PIECE", 7)
    data = b"one\r\ntwo two two two\n\nthree \xe9"
    read = lambda at, n: data[at : at + n]
    assert list(files.lines_from(read, 0, len(data), "latin-1")) == ["one", "two two two two", "", "three é"]
    assert list(files.lines_from(read, 5, len(data), "latin-1")) == ["two two two two", "", "three é"]
    assert list(files.lines_from(read, 6, len(data), "latin-1")) == ["", "three é"]
    assert list(files.lines_from(read, len(data) - 2, len(data), "latin-1")) == []
    tries, waits = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("again")
        return 5

    assert files.retried(flaky, wait=waits.append) == 5 and waits == [0.1, 0.2]
    with pytest.raises(OSError):
        files.retried(lambda: (_ for _ in ()).throw(OSError("never")), attempts=2, wait=waits.append)


def test_sources_say_what_is_missing(spark, tmp_path):
    files.register(spark)
    with pytest.raises(Exception, match="nothing-here"):
        spark.read.format("tail_lines").load(f"{tmp_path}/nothing-here").collect()
    assert spark.read.format("tail_lines").load(str(tmp_path)).collect() == []


def test_a_gazetteer_from_an_archive_is_the_one_from_text(spark, tmp_path):
    cities = "\n".join("\t".join([str(k), "x", f"Town {k}é", "", "45.5", "-122.5", "", "", "US", "", "OR", "", "", "", str(1000 * k)]) for k in range(500))
    other = {"admin1.txt": "US.OR\tOregon\tOregon\t1\n", "countryInfo.txt": "# comment\nUS\tUSA\t840\tUS\tUnited States\n"}
    with zipfile.ZipFile(tmp_path / "places.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("cities500.txt", cities)
        z.writestr("readme/", "")
        z.writestr("readme/notes.txt", "not a place")
        for name, text in other.items():
            z.writestr(name, text)
    files.register(spark)
    lines = spark.read.format("zip_lines").option("pathGlobFilter", "*.zip").load(str(tmp_path)).filter("source_file NOT LIKE '%notes%'").withColumnRenamed("value", "raw_line")
    plain = spark.createDataFrame([(x, n) for n, t in {"cities500.txt": cities, **other}.items() for x in t.rstrip("\n").split("\n")], "raw_line string, source_file string")
    a, b = parse.gazetteer(lines), parse.gazetteer(plain)
    assert a.count() == b.count() == 500 and a.exceptAll(b).count() == 0 and a.filter("admin1_name = 'Oregon' AND country_name = 'United States'").count() == 500
    only = spark.read.format("zip_lines").option("member", "cities*").load(f"{tmp_path}/places.zip")
    assert only.count() == 500 and only.first().source_file.endswith("places.zip!cities500.txt")


def test_broken_answers_are_kept_apart(spark, tmp_path):
    good = '{"station_id": "A", "data": [["2020-01-01", "50", "T", "M", "0.1", "M"]]}'
    rows = {good: None, '{"station_id": "B", "data": [["2020-01-01", "M", "M", "M", "M", "M"]]}': None, '{"station_id": "C", "data": []}': "no data", '{"station_id": "D"': "not JSON", "null": "not JSON", '{"data": [["2020-01-01", "1", "1", "1", "1", "1"]]}': "no station",
            '{"station_id": "E", "data": [["2020-01-01", "1"]]}': "short row", '{"station_id": "F", "data": [["2020-13-41", "1", "1", "1", "1", "1"]]}': "no date", '{"station_id": "G", "data": 5}': "not JSON"}
    lines = list(rows)
    (tmp_path / "a.json").write_text("\n".join(lines[:4]) + "\n\n")
    (tmp_path / "b.json").write_text("\n".join(lines[4:]))
    answers = payloads.landed(spark, str(tmp_path))
    assert {r.raw_line: r.reason for r in payloads.rejects(answers).collect()} == {k: v for k, v in rows.items() if v}
    got = {r.variable: r.value for r in payloads.observations(answers).collect()}
    assert got == {"maxt": "50", "mint": "T", "pcpn": "M", "snow": "0.1", "snwd": "M"} and payloads.observations(answers).first().obs_date == date(2020, 1, 1)
    assert {r.source_file.rsplit("/", 1)[1] for r in payloads.rejects(answers).collect()} == {"a.json", "b.json"}
