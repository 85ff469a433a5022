"""What filters remove, alone and behind one another, in every order of five filters.

Each document's failures are computed once, as a bit a filter. Every order is then replayed
on every document: the flags are crossed with the 120 orders (a broadcast table of that
fixed size), the first filter of the order that the document fails is found, the order's
five steps are exploded, and conditional sums by (part, order, step) are formed within
each task before anything is shuffled: a task sends 600 rows a part at most. A filter's
Shapley sum is what it removes over all orders, a window over the summed rows.

A copy is a document whose text (by its SHA-256) a smaller id has anywhere in the table. The
smallest id of each text is one aggregation with partial sums. Texts that over one row in
``HOT`` has are fewer than ``HOT``, so they are broadcast; all other texts meet their rows in a shuffle
whose largest group is one row in ``HOT``.

Defined cases: a null or empty text has no words, fails A alone of A to D, and is a copy like any
other; a null part is the part with the empty name; a row without an id is no copy, nobody's
original and has no labels; repeated rows count apart and aren't copies of one another, since their
ids are equal; an id with several labels has each mark that any of them gives; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialise

FILTERS = "ABCDE"
MIN_WORDS = 100
DISTINCT_PERCENT = 80
UPPER_PERCENT = 10
SYMBOLS = "[#$%&*|]"
SPACE = " \t\n\x0b\x0c\r"
SPACES = "[ \\t\\n\\x0B\\f\\r]+"
HOT = 10_000
COPY = 1 << FILTERS.index("E")
BITS = ("b1", "b2", "b3", "b4", "b5")


def bit(letter: str, fails: Column) -> Column:
    return F.when(fails, 1 << FILTERS.index(letter)).otherwise(0)


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, fails (bits of A to D) and same (the text's SHA-256) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("inner", F.btrim("text", F.lit(SPACE)))
    rows = rows.withColumn("words", F.when(F.col("inner") == "", F.array().cast("array<string>")).otherwise(F.split("inner", SPACES)))
    n, upper = F.size("words"), F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    fails = bit("A", n < MIN_WORDS) + bit("B", 100 * F.size(F.array_distinct("words")) < DISTINCT_PERCENT * n) + bit("C", 100 * upper > UPPER_PERCENT * F.length("text")) + bit("D", F.col("text").rlike(SYMBOLS))
    return rows.select("doc_id", "part", fails.alias("fails"), F.unhex(F.sha2("text", 256)).alias("same"))


def with_copies(rows: DataFrame) -> DataFrame:
    """:func:`failures` with the bit of E set where a smaller id has the same text; ``same`` goes."""
    total = rows.count()
    texts = materialise(rows.groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "audit-texts")
    often = F.col("n") > total // HOT
    hot = texts.filter(often).select(F.col("same").alias("h_same"), F.col("first").alias("h_first"))
    rest = texts.filter(~often).select(F.col("same").alias("r_same"), F.col("first").alias("r_first"))
    # Fewer than HOT texts can each have over one row in HOT.
    found = rows.join(F.broadcast(hot), F.col("same") == F.col("h_same"), "left")
    # Rows of hot texts are settled; they spread by their ids instead of meeting at their text.
    alone = F.unhex(F.sha2(F.concat_ws("-", F.lit("settled"), F.col("doc_id").cast("string")), 256))
    found = found.withColumn("key", F.when(F.col("h_same").isNotNull(), alone).otherwise(F.col("same")))
    found = found.join(rest, F.col("key") == F.col("r_same"), "left")
    copy = F.coalesce(F.col("doc_id") > F.coalesce("h_first", "r_first"), F.lit(False))
    return found.select("doc_id", "part", (F.col("fails") + F.when(copy, COPY).otherwise(0)).alias("fails"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good and toxic (0 or 1) by id."""
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("l_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    named = rows.filter("doc_id IS NOT NULL").join(marks, F.col("doc_id") == F.col("l_id"), "left").select("part", "fails", zero("good"), zero("toxic"))
    return named.unionByName(rows.filter("doc_id IS NULL").select("part", "fails", F.lit(0).alias("good"), F.lit(0).alias("toxic")))


def orders(spark: SparkSession) -> DataFrame:
    """The 120 orders: order (a number), filter_order and the bits of its filters, b1 to b5."""
    rows = [(k, "".join(p), *(1 << FILTERS.index(c) for c in p)) for k, p in enumerate(permutations(FILTERS))]
    return spark.createDataFrame(rows, "order int, filter_order string, " + ", ".join(f"{b} int" for b in BITS)).coalesce(1)


def replayed(flags: DataFrame) -> DataFrame:
    """The counts of every (part, filter_order, step) over rows of (part, fails, good, toxic)."""
    every = orders(flags.sparkSession)
    fails, first, bit = F.col("fails"), F.lit(len(FILTERS) + 1), F.lit(0)
    for k, b in reversed(list(enumerate(BITS, 1))):
        first = F.when(fails.bitwiseAND(F.col(b)) != 0, k).otherwise(first)
        bit = F.when(F.col("step") == k, F.col(b)).otherwise(bit)
    runs = flags.crossJoin(F.broadcast(every.drop("filter_order"))).withColumn("first", first)
    steps = runs.withColumn("step", F.explode(F.array(*[F.lit(k) for k in range(1, len(BITS) + 1)])))
    step = F.col("step")
    here, gone = F.col("first") == step, F.col("first") < step
    count = lambda met, name: F.sum(F.when(met, 1).otherwise(0)).cast("long").alias(name)
    made = steps.groupBy("part", "order", "step").agg(
        count(F.col("first") > step, "kept"), count(here, "removed"), count(gone & (fails.bitwiseAND(bit) != 0), "redundant"),
        count(fails == bit, "unique_fails"), count(here & (F.col("good") == 1), "good_lost"), count(here & (F.col("toxic") == 1), "toxic_lost"),
    )
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    named = made.join(F.broadcast(every.select("order", "filter_order")), "order").drop("order")
    return named.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter)))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The whole audit of ``docs`` by part."""
    rows = materialise(failures(docs), "audit-flags")
    return replayed(labelled(with_copies(rows), labels))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` by language, with the marks of ``labels``."""
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""
WITH f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || x.c || y.c || z.c AS filter_order FROM f a, f b, f x, f y, f z WHERE len(list_distinct([a.c, b.c, x.c, y.c, z.c])) = 5),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT part, coalesce(good, false) AS good, coalesce(l.toxic, false) AS toxic,
    CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false) THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
r AS (SELECT c.*, filter_order, CASE WHEN contains(fails, filter_order[1]) THEN 1 WHEN contains(fails, filter_order[2]) THEN 2 WHEN contains(fails, filter_order[3]) THEN 3 WHEN contains(fails, filter_order[4]) THEN 4 WHEN contains(fails, filter_order[5]) THEN 5 ELSE 6 END AS fell FROM c, o),
s AS (SELECT part, filter_order, step, filter_order[step] AS letter, count(*) FILTER (fell > step) AS kept, count(*) FILTER (fell = step) AS removed, count(*) FILTER (fell < step AND contains(fails, filter_order[step])) AS redundant,
    count(*) FILTER (fails = filter_order[step]) AS unique_fails, count(*) FILTER (fell = step AND good) AS good_lost, count(*) FILTER (fell = step AND toxic) AS toxic_lost
  FROM r, (SELECT unnest([1, 2, 3, 4, 5]) AS step) GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM s
"""
