"""Small tables with the cases that every operator must take."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def hard_rows():
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, odd characters."""
    long = " ".join(f"word{k % 997}" for k in range(40_000))
    rows = [(0, "", "en", "a", 0), (1, None, None, None, None), (2, " \t\n ", "en", "a", 4), (3, long, "en", "b", len(long)), (None, "no id here", "en", "a", 10), (None, None, None, "b", None)]
    rows += [(4, "same text again and again to be sure", "en", "b", 5)] * 3
    rows += [(5, "same text again and again to be sure", "fr", None, 5), (6, "Ünïcödé 漢字 😀 é à ſ K İ", "de", "c", 9), (7, "A" * 5000 + "1" * 5000 + "a@" * 2000, "en", "c", 1), (-8, "x\x00y\x1cz\x85w v", "en", "c", 3)]
    return rows


def table(spark, rows=None):
    return spark.createDataFrame(hard_rows() if rows is None else rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def crowded(spark, rows=None):
    """The same with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    df = table(spark, rows)
    for name in ("score", "_score", "fp", "_fp", "_row", "row", "root", "slot", "shard", "part", "n", "h", "host", "bucket", "_mix_n", "_mix_bucket", "block", "ids", "n_tokens", "toxic", "label_id", "_text_"):
        df = df.withColumn(name, F.lit("x"))
    return df


def put(df, tmp_path, name="documents"):
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
