"""Fixed-width, tab-separated and JSON inputs as typed DataFrames.

Every parser takes a DataFrame with one landed line or payload a row, so reading is
``spark.read.text`` or ``spark.read.json`` and splits like any other scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import blank_to_null

# Fixed values of the input formats: 1-based start and length, names, codes.
STATION_FIELDS = {"station_id": (1, 11), "latitude": (13, 8), "longitude": (22, 9), "elevation": (32, 6), "state": (39, 2), "name": (42, 30), "gsn": (73, 3), "hcn_crn": (77, 3), "wmo": (81, 5)}
HISTORY_FIELDS = {"ncdc": (1, 8), "beg_dt": (10, 8), "end_dt": (19, 8), "icao": (41, 4), "faa": (46, 5), "wmo": (58, 5), "ghcnd": (75, 11), "station_name": (87, 100), "country_code": (188, 2), "country_name": (191, 35)}
DAILY_ELEMENTS = ("PRCP", "SNOW", "SNWD", "TMAX", "TMIN", "AWND")
API_ELEMENTS = ("maxt", "mint", "pcpn", "snow", "snwd")
MISSING = -9999


def field(line: Column, at: tuple[int, int]) -> Column:
    return F.substring(line, at[0], at[1])


def daily_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """(station_id, obs_date, variable, value, mflag, qflag, sflag) of month lines with 31 blocks.

    Short or non-integer blocks and days that the month lacks are dropped; -9999 is null.
    """
    c = F.col(line)
    head = lines.select(
        field(c, (1, 11)).alias("station_id"), field(c, (12, 4)).try_cast("int").alias("y"), field(c, (16, 2)).try_cast("int").alias("m"), field(c, (18, 4)).alias("variable"), c.alias("line")
    ).filter(F.col("variable").isin(*DAILY_ELEMENTS) & F.col("y").isNotNull() & F.col("m").between(1, 12))
    blocks = head.withColumn("d", F.explode(F.sequence(F.lit(1), F.day(F.last_day(F.make_date("y", "m", F.lit(1)))))))
    block = F.substring(F.col("line"), 22 + 8 * (F.col("d") - 1), F.lit(8))
    raw = F.trim(F.substring(block, 1, 5)).try_cast("int")
    made = blocks.filter(F.length(block) == 8).withColumn("raw", raw).filter("raw IS NOT NULL")
    value = F.when(F.col("raw") != MISSING, F.col("raw").cast("double"))
    flag = lambda k: F.nullif(F.substring(block, k, 1), F.lit(" "))
    return made.select("station_id", F.make_date("y", "m", "d").alias("obs_date"), "variable", value.alias("value"), flag(6).alias("mflag"), flag(7).alias("qflag"), flag(8).alias("sflag"))


def api_payloads(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """(station_id, obs_date, variable, value) from JSON answers: strings as they came.

    Takes the first data row; a payload without one, or with "M" alone, has no rows.
    """
    data = F.from_json(F.col(payload), "data array<array<string>>")["data"]
    first = rows.select("station_id", F.get(data, F.lit(0)).alias("row")).filter("row IS NOT NULL")
    values = F.slice("row", 2, len(API_ELEMENTS))
    some = first.filter((F.size(values) > 0) & ~F.forall(values, lambda v: F.coalesce(v == "M", F.lit(False))))
    pairs = F.arrays_zip(F.array(*[F.lit(e) for e in API_ELEMENTS]).alias("variable"), values.alias("value"))
    return some.select("station_id", F.to_date(F.get("row", F.lit(0))).alias("obs_date"), F.explode(pairs).alias("p")).select("station_id", "obs_date", F.col("p.variable").alias("variable"), F.col("p.value").alias("value"))


def station_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Station list: numbers are cast, blank network codes are null, a blank state stays empty."""
    out = []
    for name, at in STATION_FIELDS.items():
        text = F.trim(field(F.col(line), at))
        if name in ("latitude", "longitude", "elevation"):
            text = text.try_cast("double")
        elif name in ("gsn", "hcn_crn", "wmo"):
            text = F.nullif(text, F.lit(""))
        out.append(text.alias(name))
    return lines.select(*out, F.col(line).alias("raw_line"))


def history_file(spark, path: str) -> DataFrame:
    """Lines of a landed station history, whose letters are Latin-1: (value)."""
    return spark.read.option("encoding", "ISO-8859-1").option("sep", "\x00").option("quote", "").schema("value string").csv(path)


def history_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Station history: ten fields, blank ones null; blank lines are dropped, and the two lines of column
    names and dashes that head the file, which have no number in the first field where a record has one."""
    head = F.trim(line).rlike("^[- ]+$") | F.upper(field(F.col(line), HISTORY_FIELDS["beg_dt"])).rlike("[A-Z]")
    return lines.filter((F.trim(line) != "") & ~head).select(*[blank_to_null(field(F.col(line), at)).alias(n) for n, at in HISTORY_FIELDS.items()])


def country_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """(code, name) of lines over three characters long."""
    return lines.filter(F.length(line) > 3).select(F.substring(line, 1, 2).alias("code"), F.trim(F.expr(f"substring(`{line}`, 4)")).alias("country_name"))


def gazetteer(lines: DataFrame) -> DataFrame:
    """Places from (raw_line, source_file) rows: cities, admin1 codes and countries joined.

    The two code lists are small fixed lists; Spark broadcasts them by their measured size.
    """
    body = lines.filter(~F.col("raw_line").startswith("#")).select(F.split("raw_line", "\t").alias("f"), "source_file")
    part = lambda name: body.filter(F.col("source_file").contains(name))
    f = lambda k: F.get("f", F.lit(k))
    cities = part("cities").select(f(0).cast("long").alias("geonameid"), f(2).alias("place_name"), f(8).alias("country_code"), f(10).alias("admin1_code"), f(4).cast("double").alias("latitude"), f(5).cast("double").alias("longitude"), f(14).cast("long").alias("population"))
    code = F.split(f(0), "\\.")
    admin = part("admin1").select(code[0].alias("country_code"), code[1].alias("admin1_code"), f(2).alias("admin1_name"))
    countries = part("country").select(f(0).alias("country_code"), f(4).alias("country_name"))
    joined = cities.join(admin, ["country_code", "admin1_code"], "left").join(countries, "country_code", "left")
    return joined.select("geonameid", "place_name", "country_code", "country_name", "admin1_code", "admin1_name", "latitude", "longitude", "population")


def landed_lines(spark, path: str) -> DataFrame:
    """Lines of landed files with their file: (value, source_file)."""
    return spark.read.text(path).withColumn("source_file", F.input_file_name())
