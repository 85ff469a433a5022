"""Stored tables: commits, failures at each step, writers at the same time, pruned upserts."""

import threading
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from daybook.plans import store as stores
from daybook.plans import work
from daybook.plans.store import Conflict, Store

BY = {"p_year": "year(d)"}
SCHEMA = "k string, d date, v double"
D = date.fromisoformat


def rows(spark, *some):
    return spark.createDataFrame([(k, D(d), v) for k, d, v in some], SCHEMA)


def held(store, name="t"):
    return sorted(tuple(r) for r in store.read(name).collect())


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"{tmp_path}/store")


def test_upsert_touches_few_files(spark, store, tmp_path):
    """One day into fifty years: under five in a hundred of the files are read and written."""
    days = spark.range(50 * 365).select(F.lit("A").alias("k"), F.date_add(F.lit(D("1970-01-01")), F.col("id").cast("int")).alias("d"), F.lit(1.0).alias("v"))
    store.overwrite("t", days, BY)
    before = store.version("t")
    read = []
    real = store._rows
    store._rows = lambda name, version, parts=None: (read.extend(parts or []), real(name, version, parts))[1]
    store.upsert("t", rows(spark, ("A", "1999-05-05", 9.0), ("B", "1999-05-05", 2.0)), ["k", "d"])
    after = store.version("t")
    new = after.folders() - before.folders()
    assert set(read) == {"p_year=1999"} and len(new) / len(before.folders()) < 0.05 and len(before.parts) == len(after.parts) == 50
    files = lambda v: {f for p in v.folders() for f in (tmp_path / "store/t" / p).glob("*.parquet")}
    assert len(files(after) - files(before)) < 0.05 * len(files(before))
    assert store.read("t").count() == 50 * 365 + 1 and store.read("t").filter("v > 1").count() == 2
    assert store.read("t", 1).filter("v > 1").count() == 0
    assert store.where("t", lambda p: p["p_year"] == "1999").count() == 366


STEPS = ["_write", "_create", "_partitions", "version"]


@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("what", ["overwrite", "upsert", "append"])
def test_a_failure_at_any_step_leaves_the_old_version(spark, store, monkeypatch, step, what):
    store.overwrite("t", rows(spark, ("a", "2020-01-01", 1.0), ("b", "2021-01-01", 2.0)), BY)
    want, new = held(store), rows(spark, ("c", "2020-01-01", 3.0))
    write = {"overwrite": lambda: store.overwrite("t", new), "upsert": lambda: store.upsert("t", new, ["k", "d"]), "append": lambda: store.append("t", new)}[what]

    def stop(*_, **__):
        raise OSError("the driver dies here")

    with monkeypatch.context() as m:
        m.setattr(Store, step, stop)
        if step == "_partitions" and what != "upsert":
            return
        with pytest.raises(OSError, match="dies"):
            write()
    assert store.exists("t") and held(store) == want
    write()
    assert ("c", D("2020-01-01"), 3.0) in held(store)


def test_a_failure_after_the_number_is_taken_is_a_commit(spark, store, monkeypatch):
    store.overwrite("t", rows(spark, ("a", "2020-01-01", 1.0)), BY)
    real = stores.Store._create

    def then_die(self, *a):
        real(self, *a)
        raise OSError("late")

    with monkeypatch.context() as m:
        m.setattr(Store, "_create", then_die)
        with pytest.raises(OSError, match="late"):
            store.upsert("t", rows(spark, ("a", "2020-01-01", 5.0)), ["k", "d"])
    assert held(store) == [("a", D("2020-01-01"), 5.0)]


@pytest.mark.parametrize("links", [True, False])
def test_a_number_is_taken_once(spark, store, monkeypatch, links):
    monkeypatch.setattr(Store, "_links", lambda *_: links)
    store.overwrite("t", rows(spark, ("a", "2020-01-01", 1.0)))
    with pytest.raises(Conflict):
        store._create("t", 1, "{}")
    assert held(store) == [("a", D("2020-01-01"), 1.0)]


def test_writers_at_the_same_time_lose_nothing(spark, store):
    store.overwrite("t", rows(spark, ("a", "2020-01-01", 1.0)), BY)
    some = [(f"w{k}", "2020-01-01" if k % 2 else f"20{10 + k}-01-01", float(k)) for k in range(6)]
    failed = []

    def write(row):
        try:
            store.upsert("t", rows(spark, row), ["k", "d"])
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(r,)) for r in some]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and held(store) == sorted([("a", D("2020-01-01"), 1.0), *[(k, D(d), v) for k, d, v in some]])
    assert store.version("t").number == 7


def test_repeated_source_keys_are_refused(spark, store):
    twice = rows(spark, ("a", "2020-01-01", 1.0), ("a", "2020-01-01", 2.0))
    with pytest.raises(Exception, match="repeats the key"):
        store.upsert("t", twice, ["k", "d"])
    assert not store.exists("t")
    store.upsert("t", rows(spark, ("a", "2020-01-01", 1.0)), ["k", "d"], by=BY)
    with pytest.raises(Exception, match="repeats the key"):
        store.upsert("t", twice, ["k", "d"])
    keys = twice.select("k", "d")
    with pytest.raises(Exception, match="repeats the key"):
        store.upsert("keys", keys, ["k", "d"])
    assert held(store) == [("a", D("2020-01-01"), 1.0)]


def test_partitions_follow_from_keys_alone(spark, store):
    with pytest.raises(Exception, match="v"):
        store.upsert("t", rows(spark, ("a", "2020-01-01", 1.0)), ["k", "d"], by={"p": "floor(v)"})
    with pytest.raises(ValueError, match="partition columns"):
        store.overwrite("t", rows(spark, ("a", "2020-01-01", 1.0)), {"V": "year(d)"})
    odd = rows(spark, ("a/b=c%d é", "2020-01-01", 1.0), ("", "2020-01-01", 2.0), (None, "2020-01-01", 3.0), ("[x]", "2020-01-01", 4.0))
    store.upsert("odd", odd, ["k", "d"], by={"p": "k"})
    store.upsert("odd", odd.filter("k IS NOT NULL").withColumn("v", F.col("v") + 10), ["k", "d"])
    assert sorted((r.k or "-", r.v) for r in store.read("odd").collect()) == sorted([("a/b=c%d é", 11.0), ("-", 12.0), ("-", 3.0), ("[x]", 14.0)])


def test_batches_of_a_stream_count_once(spark, store):
    one = rows(spark, ("a", "2020-01-01", 1.0))
    store.upsert("t", one, ["k", "d"], stream=("s", 0))
    store.upsert("t", one.withColumn("v", F.lit(7.0)), ["k", "d"], stream=("s", 0))
    assert held(store)[0][2] == 1.0
    store.upsert("t", one.limit(0), ["k", "d"], stream=("s", 1))
    store.upsert("t", one.withColumn("v", F.lit(7.0)), ["k", "d"], stream=("s", 1))
    assert held(store)[0][2] == 1.0 and store.version("t").streams == {"s": 1}
    store.upsert("t", one.withColumn("v", F.lit(7.0)), ["k", "d"], stream=("other", 0))
    assert held(store)[0][2] == 7.0


def test_new_columns_and_whole_table_versions(spark, store):
    store.upsert("t", rows(spark, ("a", "2020-01-01", 1.0), ("b", "2021-01-01", 1.0)), ["k", "d"], by=BY)
    store.upsert("t", rows(spark, ("a", "2020-01-01", 2.0)).withColumn("w", F.lit("x")), ["k", "d"])
    assert [(r.k, r.v, r.w) for r in store.read("t").orderBy("k").collect()] == [("a", 2.0, "x"), ("b", 1.0, None)]
    with pytest.raises(LookupError):
        store.read("nothing")
    store.upsert("empty", rows(spark), ["k", "d"], by=BY)
    assert store.exists("empty") and store.read("empty").count() == 0 and store.read("empty").columns == ["k", "d", "v"]


def test_revisions_touch_the_partitions_of_newer_rows(spark, store):
    schema = "station_id string, obs_date date, variable string, value double, mflag string, qflag string, sflag string, ingested_at timestamp, source string"
    row = lambda y, value, hour, source="GHCN": ("A", date(y, 1, 1), "TMAX", value, None, None, None, datetime(2024, 1, 1, hour), source)
    store.overwrite("m", spark.createDataFrame([row(2000, 1.0, 1), row(2001, 2.0, 1), row(2002, 3.0, 1, "ACIS"), row(2003, 4.0, 5)], schema), {"p_year": "year(obs_date)"})
    before = store.version("m")
    news = spark.createDataFrame([row(2000, 9.0, 2), row(2001, 8.0, 7), row(2002, 7.0, 7), row(2003, 4.0, 7), row(2009, 1.0, 7)], schema).drop("source")
    stores.revise_stored(store, "m", news)
    after = store.version("m")
    assert {r.obs_date.year: r.value for r in store.read("m").collect()} == {2000: 1.0, 2001: 8.0, 2002: 3.0, 2003: 4.0}
    assert before.parts["p_year=2000"] == after.parts["p_year=2000"] and before.parts["p_year=2001"] != after.parts["p_year=2001"] and len(after.parts) == 4
    stores.revise_stored(store, "m", news.filter("year(obs_date) = 2009").withColumn("ingested_at", F.lit(datetime(2025, 1, 1))))
    assert store.version("m") == after


def test_compaction_and_purge(spark, store, tmp_path):
    for k in range(12):
        store.append("t", rows(spark, (f"k{k}", "2020-01-01", 1.0)), BY)
    assert len(store.version("t").folders()) == 12 and store.compact("t") == 1 and len(store.version("t").folders()) == 1 and store.compact("t") == 0
    (tmp_path / "store/t/data/_v=orphan").mkdir()
    assert store.purge("t", spare=0) == 12 and store.read("t").count() == 12
    assert len(list((tmp_path / "store/t/data").iterdir())) == 2
    assert store.purge("t", orphan_hours=-1.0) == 0 and len(list((tmp_path / "store/t/data").iterdir())) == 1
    with pytest.raises(ValueError, match="other columns"):
        store.append("t", rows(spark).drop("v"))


def test_work_paths_go(spark):
    before = work.written()
    a, b = work.kept(spark.range(3), "a"), work.kept(spark.range(4), "b")
    assert a.count() == 3 and len(work.written() - before) == 2
    work.sweep(before, but=b)
    assert b.count() == 4 and len(work.written() - before) == 1
    work.discard(b)
    assert work.written() == before
    assert work.shared_dir(spark).startswith("file:") and work.qualified(spark, "/x/y/") == "file:/x/y"


