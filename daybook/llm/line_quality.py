"""Quality by cross-document line frequency, in DataFrame functions alone.

Per document: word and symbol counts, repeated lines and repeated five-word windows
(all within the row, no shuffle). Across documents: lines are normalised (A-Z to
lower case, digits to 0, white space runs to one space) and hashed, and the
documents of a host (column ``source``) that have a line are counted, a line once a
document. A line that over ``MOST_DOCS`` documents of the host have is over the limit,
whatever the host's size, and is removed from all of them (:func:`judge` can spare the
host's first document, that of the smallest id). A document that loses over ``LOSS``
percent of its words is depleted and rejected.

Rows move three times, as (host, hash) and small numbers, never as text: a count
with partial sums, a join of lines to the few that are over the limit, and a sum
by row. A line that a third of all documents have is one row a partition in the
count, and its rows in the join can be split by adaptive execution.

Defined cases: a null text is an empty text, which fails the base rule; a null
host is a host of its own; each row is a document, so repeated rows count apart; a
null id is never the first document unless no other has the line; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, materialise

MOST_DOCS = 20
LOSS = 70
WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
SPACE = " \t\n\x0b\x0c\r"
SPACES = "[ \\t\\n\\x0B\\f\\r]+"
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0000000000"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeated_words(found: Column) -> Column:
    """Words in windows of ``WINDOW`` words that the text has twice or more."""

    def cover(windows: Column) -> Column:
        at = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def same(s: Column) -> Column:
            return F.filter(s, lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)))

        places = F.sort_array(F.transform(let(at, same), lambda e: e["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(cover(w)))

    hashes = F.transform(found, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.when(F.size(h) <= WINDOW, 0).otherwise(of_hashes(h)))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), SPACES, " "))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: row (a number of its own), doc_id, host, the counts, and lines: (hash, words) each."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("text"))

    def summary(found: Column) -> Column:
        return F.struct(F.size(found).cast("long").alias("n_words"), repeated_words(found).cast("long").alias("n_repeat_words"))

    def lined(found: Column) -> Column:
        line = lambda z: F.struct(F.xxhash64(z).alias("h"), (F.length(z) - F.length(F.replace(z, F.lit(" "), F.lit(""))) + 1).alias("w"))
        return F.struct(
            (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
            F.transform(F.transform(found, normalised), line).alias("lines"),
        )

    with_word = F.filter(F.split(F.col("text"), "\n"), lambda x: F.length(without(x, SPACE)) > 0)
    return rows.select(
        "row", "doc_id", "host",
        F.length(without(F.col("text"), SPACE)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        let(words(F.col("text")), summary).alias("a"),
        let(with_word, lined).alias("b"),
    ).select("row", "doc_id", "host", "a.n_words", "word_chars", "n_symbols", "b.n_dup_lines", "a.n_repeat_words", "b.lines")


def over_limit(rows: DataFrame, most_docs: int = MOST_DOCS) -> DataFrame:
    """(host, h, first_doc, n_docs) of the lines that too many documents of a host have."""
    once = rows.select("host", "doc_id", F.explode(F.array_distinct(F.col("lines.h"))).alias("h"))
    return once.groupBy("host", "h").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).filter(F.col("n_docs") > most_docs)


def judge(docs: DataFrame, most_docs: int = MOST_DOCS, spare_first: bool = False) -> DataFrame:
    """Per row: the base counts, base_failed, kept, n_removed_words and n_removed_lines."""
    rows = materialise(measured(docs), "line-counts")
    over = over_limit(rows, most_docs).select(F.col("host").alias("of"), F.col("h").alias("hash"), "first_doc")
    lines = rows.select("row", "doc_id", "host", F.explode("lines").alias("line")).select("row", "doc_id", "host", "line.h", "line.w")
    cut = lines.join(over, (F.col("h") == F.col("hash")) & F.col("host").eqNullSafe(F.col("of")))
    if spare_first:
        cut = cut.filter(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    lost = cut.groupBy("row").agg(F.sum("w").cast("long").alias("gone"), F.count("*").alias("gone_lines"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    gone = F.coalesce("gone", F.lit(0)).cast("long")
    return rows.drop("lines").join(lost, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (100 * gone <= LOSS * F.col("n_words"))).alias("kept"),
        gone.alias("n_removed_words"), F.coalesce("gone_lines", F.lit(0)).cast("long").alias("n_removed_lines"),
    )


def op5(spark, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict."""
    return judge(documents(spark, sf_dir))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT r, unnest(range(0, len(ws) - 4)) AS i, ws FROM w WHERE len(ws) >= 5),
keyed AS (SELECT r, i, array_to_string(ws[i + 1 : i + 5], ' ') AS k FROM win),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM keyed) WHERE n > 1),
rep AS (SELECT r, sum(least(5, i - prev)) AS n FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -5) AS prev FROM twice) GROUP BY r),
ln AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT r, line, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS z
  FROM ln WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY r),
over_limit AS (SELECT host AS of, z FROM (SELECT DISTINCT r, z FROM lw) JOIN d USING (r) GROUP BY host, z HAVING count(*) > 20),
lost AS (SELECT lw.r, sum(length(lw.z) - length(replace(lw.z, ' ', '')) + 1) AS gone, count(*) AS gone_lines
  FROM lw JOIN d USING (r) JOIN over_limit o ON o.z = lw.z AND o.of IS NOT DISTINCT FROM d.host GROUP BY lw.r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[ \t\n\x0B\f\r]+', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  coalesce(gone, 0)::BIGINT AS n_removed_words, coalesce(gone_lines, 0)::BIGINT AS n_removed_lines
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  (NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * n_removed_words <= 70 * n_words) AS kept, n_removed_words, n_removed_lines FROM m
"""
