"""From raw observations to the wide table: convert, map, merge, pivot, derive, upsert, maintain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import CUTOFF_DAYS, OBSERVED

KEY = ["station_id", "obs_date", "variable"]
# Factor from the source's unit, decimals.
CONVERSIONS = {"PRCP": (0.00393701, 0.0, 2), "SNOW": (0.0393701, 0.0, 1), "SNWD": (0.0393701, 0.0, 1), "TMAX": (0.18, 32.0, 0), "TMIN": (0.18, 32.0, 0), "AWND": (0.223694, 0.0, 0)}
CODES = {"pcpn": "PRCP", "snow": "SNOW", "snwd": "SNWD", "maxt": "TMAX", "mint": "TMIN"}
TRACE = 0.001


def blank_flagged(obs: DataFrame, allowed: DataFrame) -> DataFrame:
    """Values with a quality flag become null unless allowlisted; the rows stay."""
    marked = allowed.select(*KEY, F.lit(True).alias("_ok")).distinct()
    bad = F.col("qflag").isNotNull() & F.col("_ok").isNull()
    return obs.join(marked, KEY, "left").withColumn("value", F.when(~bad, F.col("value"))).drop("_ok")


def convert(obs: DataFrame) -> DataFrame:
    """Source units to application units; other variables pass through."""
    value = F.col("value")
    for name, (factor, offset, digits) in CONVERSIONS.items():
        value = F.when(F.col("variable") == name, F.round(F.col("value") * factor + offset, digits) + F.lit(0.0)).otherwise(value)
    return obs.withColumn("value", value)


def map_codes(obs: DataFrame) -> DataFrame:
    """The API's variable codes to common names; unknown codes pass through."""
    name = F.col("variable")
    for code, common in CODES.items():
        name = F.when(F.col("variable") == code, common).otherwise(name)
    return obs.withColumn("variable", name)


def decoded(value: Column) -> Column:
    """T is a trace, M and what isn't a number are null."""
    return F.when(value == "T", F.lit(TRACE)).otherwise(value.try_cast("double"))


def newer(rows: DataFrame, target: DataFrame | None, by_source: bool = False) -> DataFrame:
    """Rows ingested after the target's newest, overall or within each source.

    The newest time is a scalar subquery, or one row a source to join; nothing is collected.
    """
    if target is None:
        return rows
    if by_source:
        marks = target.groupBy("source").agg(F.max("ingested_at").alias("_m"))
        return rows.join(F.broadcast(marks), "source", "left").filter(F.col("_m").isNull() | (F.col("ingested_at") > F.col("_m"))).drop("_m")
    mark = target.agg(F.max("ingested_at")).scalar()
    return rows.withColumn("_m", mark).filter(F.col("_m").isNull() | (F.col("ingested_at") > F.col("_m"))).drop("_m")


def cutoff(ghcn: DataFrame) -> DataFrame:
    """One row: the last date with a value, less the lookback."""
    return ghcn.filter("value IS NOT NULL").agg(F.date_sub(F.max("obs_date"), CUTOFF_DAYS).alias("cutoff"))


def union_sources(ghcn: DataFrame, acis: DataFrame) -> DataFrame:
    """Both sources with their name; columns that one lacks are null."""
    return ghcn.withColumn("source", F.lit("GHCN")).unionByName(acis.withColumn("value", decoded(F.col("value"))).withColumn("source", F.lit("ACIS")), allowMissingColumns=True)


def by_precedence(rows: DataFrame, last: DataFrame) -> DataFrame:
    """One row a key: recent API rows, then archive values, then API values, then the rest; newest first.

    Archive rows without a value after the cutoff are dropped.
    """
    recent = F.coalesce(F.col("obs_date") > F.col("cutoff"), F.lit(False))
    ghcn, some = F.col("source") == "GHCN", F.col("value").isNotNull()
    rank = F.when(~ghcn & recent, 1).when(ghcn & some, 2).when(~ghcn & some, 3).otherwise(4)
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy(rank, F.desc("ingested_at"), "source"))
    kept = rows.withColumn("cutoff", last.scalar()).withColumn("_n", first).filter("_n = 1")
    return kept.filter(~(ghcn & recent & ~some)).drop("_n", "cutoff")


def once(source: DataFrame, keys: list[str]) -> DataFrame:
    """The source, marked by _s; a key that it repeats is an error, as it is in a merge."""
    repeated = F.raise_error(F.concat(F.lit("the source repeats the key "), F.to_json(F.struct(*keys))))
    return source.withColumn("_s", F.when(F.count("*").over(Window.partitionBy(*keys)) > 1, repeated.cast("boolean")).otherwise(True)).filter("_s")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: Column | None = None, keep: tuple[str, ...] = (), insert: bool = True) -> DataFrame:
    """Target after the source is merged in: unmatched rows of both stay (the source's only with ``insert``); a matched row
    takes the source's values where ``update`` (over t_ and s_ columns; None: always) holds, but for ``keep``.

    A key may occur once in the source; the rows' number by key shares the join's shuffle.
    """
    t = target.select(*keys, *[F.col(c).alias(f"t_{c}") for c in target.columns if c not in keys], F.lit(True).alias("_t"))
    s = once(source, keys).select(*keys, *[F.col(c).alias(f"s_{c}") for c in source.columns if c not in keys], "_s")
    takes = F.col("_s").isNotNull() & (F.col("_t").isNull() | F.coalesce(F.lit(True) if update is None else update, F.lit(False)))
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        elif c not in source.columns:
            out.append(F.col(f"t_{c}").alias(c))
        elif c in keep:
            out.append(F.when(F.col("_t").isNull(), F.col(f"s_{c}")).otherwise(F.col(f"t_{c}")).alias(c))
        else:
            out.append(F.when(takes, F.col(f"s_{c}")).otherwise(F.col(f"t_{c}")).alias(c))
    new = [F.col(f"s_{c}").alias(c) for c in source.columns if c not in target.columns]
    return t.join(s, keys, "full_outer" if insert else "left").select(*out, *new)


def keep_existing_values(target: DataFrame, source: DataFrame) -> DataFrame:
    """A matched row updates only if the source has a value or the target has none."""
    return upsert(target, source, KEY, F.col("s_value").isNotNull() | F.col("t_value").isNull())


def merge_into(target: DataFrame, source: DataFrame) -> DataFrame:
    """Merged rows: the archive replaces the API's row if it has a value or a flag; a late value fills an unflagged null."""
    archive = (F.col("s_source") == "GHCN") & (F.col("t_source") == "ACIS") & (F.col("s_value").isNotNull() | F.col("s_qflag").isNotNull())
    late = F.col("t_value").isNull() & F.col("t_qflag").isNull() & F.col("s_value").isNotNull()
    return upsert(target, source, KEY, archive | late)


def insert_only(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti"))


def fill_empty(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Per column, the target's value if it has one, else the source's."""
    t = target.select(*keys, *[F.col(c).alias(f"t_{c}") for c in target.columns if c not in keys])
    s = source.select(*keys, *[F.col(c).alias(f"s_{c}") for c in source.columns if c not in keys])
    return t.join(s, keys, "full_outer").select(*[F.col(c) if c in keys else F.coalesce(f"t_{c}", f"s_{c}").alias(c) for c in target.columns])


def differs(a: list[Column], b: list[Column]) -> Column:
    same = F.lit(True)
    for x, y in zip(a, b, strict=True):
        same = same & x.eqNullSafe(y)
    return ~same


def pivoted(merged: DataFrame) -> DataFrame:
    """One row a station and date, a column a variable, and the source (GHCN if mixed); one shuffle."""
    cells = [F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in OBSERVED]
    source = F.when(F.min("source") != F.max("source"), "GHCN").otherwise(F.min("source")).alias("source")
    return merged.groupBy("station_id", "obs_date").agg(*cells, source)


def derived(wide: DataFrame) -> DataFrame:
    """Adds TAVG and whole heating and cooling degree days; null without both temperatures."""
    mean = (F.col("TMAX") + F.col("TMIN")) / 2.0
    heat = F.when(mean.isNotNull(), F.round(F.greatest(65 - mean, F.lit(0.0))).cast("int"))
    cool = F.when(mean.isNotNull(), F.round(F.greatest(mean - 65, F.lit(0.0))).cast("int"))
    return wide.withColumn("TAVG", mean).withColumn("HDD", heat).withColumn("CDD", cool)


def observations(ghcn: DataFrame, acis: DataFrame, allowed: DataFrame) -> DataFrame:
    """The whole chain from raw inputs to the wide derived table."""
    clean = convert(blank_flagged(ghcn, allowed))
    return derived(pivoted(by_precedence(union_sources(clean, map_codes(acis)), cutoff(clean))))


# Maintenance: each returns the table after the step; running it again changes nothing.


def qc_cleanup(merged: DataFrame, allowed: DataFrame) -> DataFrame:
    """Flagged archive values that aren't allowlisted become null."""
    marked = allowed.select(*KEY, F.lit(True).alias("_ok")).distinct()
    bad = (F.col("source") == "GHCN") & F.col("qflag").isNotNull() & F.col("_ok").isNull()
    return merged.join(marked, KEY, "left").withColumn("value", F.when(~bad, F.col("value"))).drop("_ok")


def qc_to_wide(wide: DataFrame, merged: DataFrame) -> DataFrame:
    """Blanks the flagged variables of the affected station-dates and derives anew."""
    flagged = merged.filter("source = 'GHCN' AND qflag IS NOT NULL AND value IS NULL").groupBy("station_id", "obs_date").agg(*[F.bool_or(F.col("variable") == v).alias(f"f_{v}") for v in OBSERVED])
    joined = wide.join(flagged, ["station_id", "obs_date"], "left")
    cells = {v: F.when(~F.coalesce(f"f_{v}", F.lit(False)), F.col(v)) for v in OBSERVED}
    return derived(joined.withColumns(cells).select(*wide.columns))


REVISED = ("value", "mflag", "qflag", "sflag")


def revised() -> Column:
    """Over t_ and s_ columns: an archive row whose value or flags differ from the archive's present ones."""
    return (F.col("t_source") == "GHCN") & differs([F.col(f"t_{c}") for c in REVISED], [F.col(f"s_{c}") for c in REVISED])


def revise(merged: DataFrame, converted: DataFrame) -> DataFrame:
    """Archive rows take the archive's present values and flags where these differ."""
    return upsert(merged, converted.select(*KEY, *REVISED, "ingested_at"), KEY, revised(), insert=False)


def revise_wide(wide: DataFrame, merged: DataFrame) -> DataFrame:
    """Re-pivots only the station-dates where an archive value differs, and derives anew where it changed."""
    at = ["station_id", "obs_date"]
    cell = F.coalesce(*[F.when(F.col("variable") == v, F.col(v)) for v in OBSERVED])
    touched = merged.filter("source = 'GHCN'").join(wide.select(*at, *OBSERVED), at).filter(~F.col("value").eqNullSafe(cell)).select(*at).distinct()
    fresh = derived(pivoted(merged.join(touched, at, "left_semi")).drop("source"))
    changed = differs([F.col(f"t_{v}") for v in OBSERVED], [F.col(f"s_{v}") for v in OBSERVED])
    return upsert(wide, fresh, at, changed, insert=False)


def history_fill(current: DataFrame, old: DataFrame) -> DataFrame:
    """Rows of earlier station ids for (date, variable) that the current id and earlier priorities lack.

    ``old`` has a column priority; one window picks the first id, one anti join drops what is covered.
    """
    at = ["station_id", "obs_date", "variable"]
    first = F.row_number().over(Window.partitionBy(*at).orderBy("priority"))
    best = old.withColumn("_n", first).filter("_n = 1").drop("_n")
    return best.join(current.select(*at), at, "left_anti")


def overlap(current: DataFrame, old: DataFrame) -> DataFrame:
    """By variable, days that both have: number, span, mean difference, differing days."""
    both = current.filter("value IS NOT NULL").select(*KEY, F.col("value").alias("a")).join(old.filter("value IS NOT NULL").select(*KEY, F.col("value").alias("b")), KEY)
    return both.groupBy("variable").agg(F.count("*").alias("n"), F.min("obs_date").alias("first"), F.max("obs_date").alias("last"), F.avg(F.col("a") - F.col("b")).alias("mean_difference"), F.count_if(F.col("a") != F.col("b")).alias("differing"), F.try_divide(F.sum("a"), F.sum("b")).alias("ratio"))


def usage_rollup(chat: DataFrame, today: str) -> DataFrame:
    """Turns, users and sessions by completed day and status."""
    rows = chat.filter(F.col("created_at") < F.to_timestamp(F.lit(today)))
    return rows.groupBy(F.to_date("created_at").alias("usage_date"), F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("turns"), F.count_distinct("user_id").alias("users"), F.count_distinct("session_id").alias("sessions"))


def retained(chat: DataFrame, now: str, days: int = 14) -> DataFrame:
    return chat.filter(F.col("created_at") >= F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {int(days)} DAYS"))


def nightly(ghcn: DataFrame, acis: DataFrame, allowed: DataFrame, keep, keep_merged: bool = True) -> tuple[DataFrame, DataFrame]:
    """(converted archive, merged rows): ``keep`` writes a table and gives it back as read.

    One of the two is written: the merged rows, if what follows uses them more than once (pivot and QC), else the
    converted archive, which the cutoff and the revisions start from.
    """
    clean = convert(blank_flagged(ghcn, allowed))
    if not keep_merged:
        clean = keep(clean)
    rows = by_precedence(union_sources(clean, map_codes(acis)), cutoff(clean))
    return clean, keep(rows) if keep_merged else rows
