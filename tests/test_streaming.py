"""Streams against the same rows as a table."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from daybook.operators import daily, events
from daybook.plans.store import Store
from daybook.streaming import ingest


def rows_of_both(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(260):
        value = rng.choice([None, 1.0, 2.0, 3.0])
        out.append((f"S{rng.randrange(3)}", date(2024, 1, 1) + timedelta(days=rng.randrange(6)), "TMAX", value, None, rng.choice([None, None, "X"]), None, datetime(2024, 2, 1, rng.randrange(6)), rng.choice(["GHCN", "ACIS"])))
    return out + out[:40]  # repeated


def test_late_and_repeated_rows_give_the_tables_rows(spark, tmp_path):
    rows = rows_of_both(1)
    want = sorted(map(repr, ingest.settled(spark.createDataFrame(rows, ingest.SOURCED)).collect()))
    for k, seed in enumerate((3, 4)):
        order = rows[:]
        random.Random(seed).shuffle(order)
        landing, store = f"{tmp_path}/in{k}", Store(spark, f"{tmp_path}/store{k}")
        for part in (order[:100], order[100:170], order[170:]):
            spark.createDataFrame(part, ingest.SOURCED).coalesce(1).write.mode("append").parquet(landing)
        run = lambda: ingest.ingest_sources(spark, landing, store, "obs", f"{tmp_path}/c{k}", {"p_day": "obs_date"}, files_a_batch=1).awaitTermination()  # noqa: B023, E731
        run()
        assert sorted(map(repr, store.read("obs").select(*[c.split()[0] for c in ingest.SOURCED.split(", ")]).collect())) == want
        version = store.version("obs")
        assert version.streams == {f"{tmp_path}/c{k}": 2}
        run()  # nothing has landed since
        assert store.version("obs").number == version.number
    kinds = {(r.source, r.value is None) for r in store.read("obs").collect()}
    assert ("GHCN", False) in kinds


def test_ties_are_not_left_to_chance(spark):
    when = datetime(2024, 1, 1)
    rows = [("A", date(2024, 1, 1), "TMAX", v, None, q, None, when) for v in (1.0, 5.0, None) for q in (None, "X")]
    for _ in range(3):
        random.shuffle(rows)
        got = ingest.newest(spark.createDataFrame(rows, ingest.SCHEMA).repartition(3)).collect()
        assert [(r.value, r.qflag) for r in got] == [(5.0, "X")]


def observed():
    rng = random.Random(2)
    return [("A" if k % 2 else "B", date(2020, 1, 1) + timedelta(days=k // 2), "PRCP", rng.choice([0.0, 0.0, 0.5, 1.0, None]), None, None, None, datetime(2020, 1, 1)) for k in range(300)]


def test_sessions_are_the_events(spark, tmp_path):
    rows = spark.createDataFrame(observed(), ingest.SCHEMA)
    days = daily.daily_values(rows.withColumnRenamed("value", "PRCP"), "PRCP", "1800-01-01", "2100-01-01", op=">=", threshold=0.4)
    want = sorted(map(tuple, events.events(days).collect()))
    whole = ingest.sessions(rows, "PRCP", ">=", 0.4)
    assert sorted(map(tuple, whole.collect())) == want and len(want) > 20
    landing = f"{tmp_path}/in"
    for a in range(0, 300, 60):
        spark.createDataFrame(observed()[a : a + 60], ingest.SCHEMA).coalesce(1).write.mode("append").parquet(landing)
    end = [("A", date(2021, 1, 1), "PRCP", 9.0, None, None, None, datetime(2020, 1, 1))]
    spark.createDataFrame(end, ingest.SCHEMA).coalesce(1).write.mode("append").parquet(landing)
    stream = spark.readStream.schema(ingest.SCHEMA).option("maxFilesPerTrigger", 2).parquet(landing)
    ingest.sessions(stream, "PRCP", ">=", 0.4, lateness="200 days").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("station_id", "event_start", "event_end", "total", "duration").collect())) == want


def test_repeats_within_the_watermark_go(spark, tmp_path):
    rows = observed()[:50]
    for part in (rows[:30], rows[20:], rows[:10]):
        spark.createDataFrame(part, ingest.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ingest.SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ingest.once_each(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 50
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.count_distinct("station_id", "obs_date")).first()[0] == 50
