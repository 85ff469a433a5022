"""Many single-value questions answered in one pass over the observations.

A request is a row: request_id, station_id, metric, aggregation, unit (day, event, month or year), start, end,
months, operator, threshold, how (what makes a bucket's value: mean, sum, count or any; an event's: total or duration).
Requests that ask the same but for the aggregation are one question, which gives all aggregations at once.
Questions meet the days by station and year, so the wide table is read once, however many there are,
and only the questions' own days go on; what they are asked is picked by row. Days are summed by (question, bucket) with
partial sums; an event question keeps its hits, bounded by one station's days, and cuts them into runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import covered, month_days, window_days
from ..functions.vocabulary import METRICS

REQUEST = "request_id bigint, station_id string, metric string, aggregation string, unit string, start date, end date, months array<int>, operator string, threshold double, how string"
#: Years that a request's open ends reach.
YEARS = (1800, 2100)
ASKED = ("question", "metric", "unit", "months", "operator", "threshold", "how")
#: What makes a question, besides its name.
QUESTION = ("station_id", "metric", "unit", "start", "end", "months", "operator", "threshold", "how")


def _met() -> Column:
    v, t, op = F.col("value"), F.col("threshold"), F.col("operator")
    return F.when(op == ">", v > t).when(op == ">=", v >= t).when(op == "<", v < t).when(op == "<=", v <= t).when(op == "=", v == t)


def questions(requests: DataFrame) -> DataFrame:
    """The distinct questions of requests that have their ``question``."""
    return requests.select("question", *QUESTION).distinct()


def asked_days(questions: DataFrame, obs: DataFrame, years: tuple[int, int] = YEARS) -> DataFrame:
    """Each question's days: what it asks, obs_date, value and hit (null for a null value, 0 without a threshold)."""
    first, last = F.coalesce("start", F.make_date(F.lit(years[0]), F.lit(1), F.lit(1))), F.coalesce("end", F.make_date(F.lit(years[1]), F.lit(12), F.lit(31)))
    span = F.sequence(F.greatest(F.year(first), F.lit(years[0])), F.least(F.year(last), F.lit(years[1])))
    some = questions.filter((first <= last) & (F.year(first) <= years[1]) & (F.year(last) >= years[0])).select(*ASKED, F.col("station_id").alias("s"), first.alias("first"), last.alias("last"), F.explode(span).alias("y"))
    value = F.lit(None).cast("double")
    for m in METRICS:
        if m in obs.columns:
            value = F.when(F.col("metric") == m, F.col(m).cast("double")).otherwise(value)
    days = obs.join(some, (F.col("station_id") == F.col("s")) & (F.year("obs_date") == F.col("y"))).filter(F.col("obs_date").between(F.col("first"), F.col("last")))
    days = days.filter(F.col("months").isNull() | F.array_contains("months", F.month("obs_date"))).select(*ASKED, "obs_date", value.alias("value"))
    return days.withColumn("hit", F.when(F.col("value").isNotNull(), F.when(F.col("operator").isNotNull() & _met(), 1).otherwise(0)))


def answered(requests: DataFrame, obs: DataFrame, years: tuple[int, int] = YEARS) -> DataFrame:
    """request_id, value and n (days with a value, complete buckets, or events) of every request.

    A day's count is of hits, a bucket's and an event's of themselves. A request without any has n 0 and a null value
    (0 for a count); one whose station, metric, aggregation or unit isn't known likewise.
    """
    unit, event = F.col("unit"), F.col("unit") == "event"
    requests = requests.withColumn("question", F.unhex(F.sha2(F.to_json(F.struct(*QUESTION)), 256)))
    days = asked_days(questions(requests), obs, years)
    y = F.when(unit.isin("month", "year"), F.year("obs_date"))
    m = F.when(unit == "month", F.month("obs_date"))
    v = F.when(event, F.lit(None)).otherwise(F.col("value"))
    sums = [F.avg(v).alias("mean"), F.median(v).alias("median"), F.sum(v).alias("sum"), F.max(v).alias("max"), F.min(v).alias("min"), F.stddev(v).alias("stddev"), F.sum("hit").cast("double").alias("hits"), F.max("hit").cast("double").alias("any"), F.count("value").alias("n_days")]
    hits = F.sort_array(F.collect_list(F.when(event & (F.col("hit") == 1), F.struct("obs_date", "value")))).alias("run")
    by = days.groupBy("question", "unit", "how", "months", y.alias("y"), m.alias("m")).agg(*sums, hits)
    # Hits in a row have one day's number less their own.
    piece = F.transform("run", lambda x, i: F.struct(F.date_sub(x["obs_date"], i).alias("island"), x["value"].alias("v")))
    each = by.withColumn("p", F.explode_outer(F.when(event, piece))).drop("run")
    own = ["question", "unit", "how", "y", "m", "island"]
    stats = ("mean", "median", "sum", "max", "min", "stddev", "hits", "any", "n_days")
    buckets = each.withColumn("island", F.col("p.island")).groupBy(*own).agg(*[F.first(c).alias(c) for c in (*stats, "months")], F.sum("p.v").alias("total"), F.count("p.island").cast("double").alias("duration"))
    how = F.col("how")
    made = F.when(how == "sum", F.col("sum")).when(how == "count", F.col("hits")).when(how == "any", F.col("any")).otherwise(F.col("mean"))
    expected = F.when(unit == "month", month_days(F.col("y"), F.col("m"))).otherwise(F.when(F.col("months").isNull(), window_days(F.col("y"))).otherwise(F.aggregate("months", F.lit(0), lambda n, k: n + F.day(F.last_day(F.make_date(F.col("y"), k, F.lit(1)))))))
    bucket = F.when(event, F.when(F.col("island").isNotNull(), F.when(how == "duration", F.col("duration")).otherwise(F.col("total")))).when(unit.isin("month", "year") & covered(F.col("n_days"), expected), made)
    day = {c: F.max(F.when(unit == "day", F.col(c))).alias(f"d_{c}") for c in stats}
    total = buckets.withColumn("b", bucket).groupBy("question", "unit").agg(
        *day.values(), F.avg("b").alias("mean"), F.median("b").alias("median"), F.sum("b").alias("sum"), F.max("b").alias("max"), F.min("b").alias("min"), F.stddev("b").alias("stddev"), F.count("b").alias("n"))
    made = total.withColumns({"n": F.when(unit == "day", F.col("d_n_days")).otherwise(F.col("n")), "count": F.when(unit == "day", F.col("d_hits")).otherwise(F.col("n").cast("double"))})
    stat = [F.when(unit == "day", F.col(f"d_{c}")).otherwise(F.col(c)).alias(c) for c in ("mean", "median", "sum", "max", "min", "stddev")]
    done = made.select(F.col("question").alias("q"), "n", "count", *stat)
    picked = F.lit(None).cast("double")
    for c in ("mean", "median", "sum", "max", "min", "stddev", "count"):
        picked = F.when(F.col("aggregation") == c, F.col(c)).otherwise(picked)
    zero = F.when((F.col("aggregation") == "count") & F.col("unit").isin("day", "event", "month", "year"), 0.0)
    asked = requests.select("request_id", "aggregation", "unit", "question")
    return asked.join(done, F.col("question") == F.col("q"), "left").select("request_id", F.coalesce(picked, zero).alias("value"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
