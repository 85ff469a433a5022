"""Places and stations for whole tables of texts, through an index of name prefixes.

A place's name is cut at each end of a word: "new york city" is found under "new", "new york" and itself.
A text is read in a few ways, each a name and what qualifies it, and readings meet the index by equality, so
there is no search through all places for a text and no loop over texts. Per prefix and qualifier the
index keeps the one place that would be taken, so a name that very many places share is one row. Equal texts
are folded and resolved once, and only prefixes that a text reads are indexed.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import miles
from ..functions.vocabulary import CHOICES, CHOICE_SHARE, COUNTRY_CODES, NEAR_MILES, NO_PLACE_WORDS, PROVINCES, QUALIFIER_WORDS
from .stations import choose, lookup_key
from .work import kept

REQUEST = "text string, latitude double, longitude double"
PLACE = ("geonameid", "place_name", "latitude", "longitude", "population")


@cache
def _plain_letters() -> tuple[str, str, dict[str, str]]:
    """Characters that stand for one ASCII character, these, and those that stand for several: by compatibility decomposition."""
    one, as_one, several = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if 0xD800 <= code <= 0xDFFF or not unicodedata.decomposition(c):
            continue
        plain = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one.append(c)
            as_one.append(plain)
        elif plain:
            several[c] = plain
    return "".join(one), "".join(as_one), several


def fold_column(text: Column) -> Column:
    """As :func:`stations.fold`, in the JVM: ASCII lower case with single spaces."""
    one, as_one, several = _plain_letters()
    table = F.from_json(F.lit(json.dumps(several)), "map<string,string>")  # one literal once the plan is optimised
    spelled = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    known = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in several) + "]"
    flat = F.translate(F.when(text.rlike(known), spelled).otherwise(text), one, as_one)
    other = "[^\\x00-\\x7F]"
    # The class of known characters is long: plain texts, the most, don't meet it.
    plain = F.when(text.rlike(other), F.regexp_replace(flat, other + "+", "")).otherwise(text)
    return F.trim(F.regexp_replace(F.lower(plain), "[\\s\\x0B\\x1C-\\x1F]+", " "))


def names_no_place(folded: Column) -> Column:
    """What people or programs write where no place is known."""
    return folded.isNull() | folded.isin(*NO_PLACE_WORDS) | (F.translate(folded, "? ", "") == "") | (folded.startswith("<") & folded.endswith(">"))


def _marks() -> Column:
    """What can qualify a place: its state or province and its country, by code, name, or a common other name."""
    state, country = F.lower("admin1_name"), F.lower("country_code")
    other = F.array().cast("array<string>")
    for code in sorted(set(COUNTRY_CODES.values())):
        names = sorted(n for n, c in COUNTRY_CODES.items() if c == code)
        other = F.when(country == code, F.array(*[F.lit(n) for n in names])).otherwise(other)
    province = F.lit(None).cast("string")
    for code, name in PROVINCES.items():
        province = F.when(state == name, F.lit(code)).otherwise(province)
    own = F.array(F.lower("admin1_code"), state, province, F.when(~country.isin(*COUNTRY_CODES), country), F.lower("country_name"))
    return F.array_distinct(F.filter(F.concat(own, other), lambda x: x.isNotNull() & (x != "")))


def index(places: DataFrame, names: DataFrame) -> DataFrame:
    """(prefix, rank, place, marks): a row for each word's end of each place's name that is one of ``names`` (name)."""
    key = F.col("name_key")
    ends = F.filter(F.sequence(F.lit(1), F.length(key)), lambda i: (i == F.length(key)) | F.substring(key, i + 1, F.lit(1)).isin(" ", ","))
    rows = places.filter(key != "").withColumn("end", F.explode(ends)).withColumn("prefix", F.substring(key, F.lit(1), F.col("end")))
    rows = rows.join(names.select(F.col("name").alias("prefix")).distinct(), "prefix", "left_semi")
    rank = F.struct((F.col("end") == F.length(key)).alias("exact"), F.coalesce("population", F.lit(-1).cast("long")).alias("people"), (-F.col("geonameid")).alias("id"))
    return rows.select("prefix", rank.alias("rank"), F.struct(*PLACE).alias("place"), _marks().alias("marks"))


def readings(texts: DataFrame) -> DataFrame:
    """(text, reading, name, marks) of texts with their folded form: up to the first comma is the name and the
    rest qualifies it; without commas, the whole text, then all but its last one to three words."""
    parts = F.transform(F.split("folded", ","), lambda p: F.trim(p))
    rest = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p != "")
    words = F.split("folded", " ")
    n = F.size(words)
    read = lambda k, name, marks: F.struct(k.cast("int").alias("reading"), name.alias("name"), marks.alias("marks"))
    none = F.array().cast("array<string>")
    cut = F.transform(F.sequence(F.lit(0), F.least(F.lit(QUALIFIER_WORDS), n - 1)), lambda k: read(k, F.array_join(F.slice(words, F.lit(1), n - k), " "), F.when(k == 0, none).otherwise(F.array(F.array_join(F.slice(words, n - k + 1, k), " ")))))
    every = F.when(F.col("folded").contains(","), F.array(read(F.lit(0), F.get(parts, F.lit(0)), rest))).otherwise(cut)
    return texts.select("text", F.explode(every).alias("r")).select("text", "r.*").filter("name <> ''")


def _met(texts: DataFrame, places: DataFrame) -> DataFrame:
    """(text, reading, rank, place) of each text (distinct, with folded) that means a place."""
    read = readings(texts)
    found = index(places, read)
    best = F.max_by(F.struct("rank", "place"), "rank").alias("b")
    by_mark = found.select("prefix", F.explode("marks").alias("mark"), "rank", "place", "marks")
    top = found.groupBy("prefix").agg(best).withColumn("mark", F.lit("")).unionByName(by_mark.groupBy("prefix", "mark").agg(best))
    one = read.filter(F.size("marks") <= 1).withColumn("m", F.coalesce(F.get("marks", F.lit(0)), F.lit(""))).join(top, (F.col("name") == F.col("prefix")) & (F.col("m") == F.col("mark")))
    more = read.filter(F.size("marks") > 1).withColumnRenamed("marks", "wanted").withColumn("m", F.get("wanted", F.lit(0))).join(by_mark, (F.col("name") == F.col("prefix")) & (F.col("m") == F.col("mark")))
    more = more.filter(F.size(F.array_except("wanted", "marks")) == 0)
    each = one.select("text", "reading", "b.rank", "b.place").unionByName(more.select("text", "reading", "rank", "place"))
    first = F.max_by(F.struct("reading", "rank", "place"), F.struct(-F.col("reading"), "rank")).alias("f")
    return each.groupBy("text").agg(first).select("text", "f.*")


def _distinct(texts: DataFrame, text_col: str) -> DataFrame:
    # Folded above the aggregation: a fold costs far more than a row. Nothing above filters by the folded
    # text, which would bring the fold down again.
    each = texts.filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")).distinct()
    return each.withColumn("folded", fold_column(F.col("text")))


def resolve_places(texts: DataFrame, places: DataFrame, text_col: str = "text") -> DataFrame:
    """``texts`` with geonameid, place_name, reading and exact of the place that each text means ("Portland, OR",
    "Paris France"): the first reading that any place meets, an exact name before a longer one, then the largest,
    then the smallest id. Null where there is none.

    ``places``: geonameid, place_name, name_key (folded), latitude, longitude, population, and codes and names of state and country.
    """
    found = _met(_distinct(texts, text_col), places).select(F.col("text").alias("_text"), "place.geonameid", "place.place_name", "reading", "rank.exact")
    return texts.join(found, F.col(text_col) == F.col("_text"), "left").drop("_text")


def find_place(places: DataFrame, text: str) -> DataFrame:
    """The row of ``places`` that one text means; no row if there is none."""
    one = resolve_places(places.sparkSession.createDataFrame([(text,)], "text string"), places).select("geonameid")
    return places.join(F.broadcast(one), "geonameid", "left_semi")  # one row


def station_keys(stations: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, ghcn_id, city): the station that each code, alias, city and name stands for, in this order, then by id."""
    key = lambda n, k: F.struct(F.lit(n).alias("match"), k.alias("key"))
    own = stations.select("ghcn_id", "city", F.explode(F.array(*[key(1, F.lower(c)) for c in ("icao", "iata", "ghcn_id")], key(3, lookup_key(F.col("city"))), key(4, lookup_key(F.col("name"))))).alias("k"))
    other = aliases.join(stations.select("ghcn_id", "city"), "ghcn_id").select("ghcn_id", "city", key(2, lookup_key(F.col("alias"))).alias("k"))
    rows = own.unionByName(other).select("k.*", "ghcn_id", "city").filter("key <> ''")
    return rows.groupBy("key").agg(F.min(F.struct("match", "ghcn_id", "city")).alias("s")).select("key", "s.ghcn_id", "s.city")


def _shared(wanted: DataFrame, places: DataFrame) -> DataFrame:
    """(rid, geonameid, place_name, latitude, longitude, population) for texts without qualifiers whose name several large places have."""
    texts = wanted.filter(~F.col("folded").contains(",")).select("rid", "folded")
    named = places.join(texts.select(F.col("folded").alias("name_key")).distinct(), "name_key", "left_semi")
    own = Window.partitionBy("name_key")
    n = F.row_number().over(own.orderBy(F.desc_nulls_last("population"), "geonameid"))
    some = named.withColumn("n", n).filter(F.col("n") <= CHOICES).withColumn("top", F.max("population").over(own)).filter(F.col("population") >= CHOICE_SHARE * F.col("top"))
    several = some.withColumn("of", F.count("*").over(own)).filter("of > 1")
    return several.join(texts, F.col("name_key") == F.col("folded")).select("rid", *PLACE)


def resolve_stations(requests: DataFrame, stations: DataFrame, aliases: DataFrame, places: DataFrame) -> DataFrame:
    """The station for each request (text, latitude, longitude), a row for each station that it may mean: the request's
    columns, how, ghcn_id, miles, offers, far, place.

    how: "named" for a code, alias, city or name of a station; else what :func:`stations.choose` says of the
    place that the text means, or of each place that shares the name unless all lead to one station; "none" if no place
    is found; "no place" if the text names none. Coordinates, where given, tell which of several places is
    meant; where no place of that name is within ``NEAR_MILES`` of them they mean another place, and count if a
    station is near them. Equal requests give rows once; nothing is collected, and four work tables are written.
    """
    rid = F.sha2(F.to_json(F.struct("text", "latitude", "longitude")), 256)
    asked = requests.select("text", F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"))
    asked = asked.distinct().withColumns({"rid": rid, "folded": fold_column(F.col("text"))})
    empty = {"miles": F.lit(None).cast("long"), "offers": F.lit(None).cast("array<string>"), "far": F.lit(None).cast("boolean")}
    out = ["text", "latitude", "longitude", "how", "ghcn_id", "miles", "offers", "far", "place"]

    known = station_keys(stations, aliases).withColumnRenamed("city", "place")
    # Written, since much follows from it: each use would plan and do all this again. A filter by the folded text before
    # that would go below the aggregation, and fold every row.
    keyed = asked.withColumn("lost", names_no_place(F.col("folded"))).withColumn("key", F.when(~F.col("lost"), lookup_key(F.col("text"))))
    met = kept(keyed.join(known, "key", "left"), "requests")
    nothing = met.filter("lost").drop("ghcn_id", "place").withColumns({"how": F.lit("no place"), "ghcn_id": F.lit(None).cast("string"), "place": F.lit(None).cast("string"), **empty}).select(*out)

    named = met.filter("ghcn_id IS NOT NULL").withColumns({"how": F.lit("named"), **empty}).select(*out)
    wanted = met.filter("NOT lost AND ghcn_id IS NULL").select("rid", "text", "latitude", "longitude", "folded")

    several = _shared(wanted, places)
    single = _met(wanted.select("text", "folded").distinct(), places).select("text", "place.*")
    one = wanted.select("rid", "text").join(single, "text").join(several.select("rid").distinct(), "rid", "left_anti").select("rid", *PLACE)
    meant = kept(several.withColumn("shared", F.lit(True)).unionByName(one.withColumn("shared", F.lit(False))), "meant")

    # Coordinates.
    here = wanted.filter("latitude IS NOT NULL AND longitude IS NOT NULL").select("rid", F.col("latitude").alias("h_lat"), F.col("longitude").alias("h_lon"))
    away = miles(F.col("latitude"), F.col("longitude"), F.col("h_lat"), F.col("h_lon"))
    near = meant.join(here, "rid").withColumn("d", away).filter(F.col("d") <= NEAR_MILES)
    close = near.groupBy("rid").agg(F.min_by(F.struct(*PLACE), F.struct("d", "geonameid")).alias("p")).select("rid", "p.*").withColumn("shared", F.lit(False))
    alone = here.join(close.select("rid"), "rid", "left_anti").join(wanted.select("rid", "text"), "rid")
    spot = choose(alone.select(F.col("rid").alias("geonameid"), F.col("text").alias("place_name"), F.col("h_lat").alias("latitude"), F.col("h_lon").alias("longitude")), stations)
    spot = spot.withColumnRenamed("geonameid", "rid").join(meant.select("rid").distinct().withColumn("known", F.lit(True)), "rid", "left").filter("how <> 'none' OR known IS NULL").drop("known")
    spot = kept(spot, "spots")
    others = close.select("rid").unionByName(spot.select("rid"))
    meant = kept(close.unionByName(meant.join(others, "rid", "left_anti")), "meant")

    chosen = choose(meant.select(*[c for c in PLACE if c != "population"]).distinct(), stations)
    found = meant.select("rid", "geonameid", F.col("place_name").alias("place"), "population", "shared").join(chosen, "geonameid")
    own = Window.partitionBy("rid")
    leads = F.size(F.collect_set(F.coalesce("ghcn_id", F.get("offers", F.lit(0)), F.lit(""))).over(own))
    first = F.row_number().over(own.orderBy(F.desc_nulls_last("population"), "geonameid"))
    found = found.withColumn("leads", leads).withColumn("n", first).filter("leads > 1 OR n = 1")
    placed = found.select("rid", "how", "ghcn_id", "miles", "offers", "far", "place").unionByName(spot.join(wanted.select("rid", F.col("text").alias("place")), "rid").select("rid", "how", "ghcn_id", "miles", "offers", "far", "place"))
    rest = wanted.drop("folded").join(placed, "rid", "left").withColumn("how", F.coalesce("how", F.lit("none"))).select(*out)
    return nothing.unionByName(named).unionByName(rest)


def station_for(stations: DataFrame, aliases: DataFrame, places: DataFrame, text: str | None, near: tuple[float, float] | None = None) -> DataFrame:
    """:func:`resolve_stations` of one text; no row if it means no place."""
    lat, lon = near or (None, None)
    asked = stations.sparkSession.createDataFrame([(text, lat, lon)], REQUEST)
    return resolve_stations(asked, stations, aliases, places).filter("place IS NOT NULL OR how = 'no place'").drop("text", "latitude", "longitude")
