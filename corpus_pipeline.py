"""A corpus pipeline: toxic documents go, near duplicates are thinned to one, secrets
are replaced, sources are mixed to target weights, and texts become token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep
the columns of ``docs``. The stages accept nulls in any column, empty and very long
texts, repeated rows, empty tables and columns of other names.

ORACLE_SQL is None: a trained network and the tokenizer's vocabulary are outside SQL.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm import bpe, mixing, secret_scan, simhash, toxicity
from daybook.llm.common import documents, fresh, materialise, ready, sweep, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the network, trained on the labels of ``sf_dir``, doesn't reject."""
    ready(spark)
    net = toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "score")
    return toxicity.scored(docs, net, into=score).filter(F.col(score) < toxicity.REJECT).drop(score)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component."""
    ready(spark)
    return simhash.keep_one(docs)


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; secrets in texts are replaced by a mark."""
    ready(spark)
    return secret_scan.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the Pfair schedule of their sources."""
    ready(spark)
    return mixing.mixed(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, slot, place, n_tokens, ids and digests of every row, in the schedule's order.

    Stored rows lose their order when they are read, so it is derived again here, and
    slot and place stay in the result.
    """
    ready(spark)
    rows, slot, place = mixing.ordered(docs)
    made = bpe.encode(rows, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=["lang", "source", slot, place])
    return made.withColumnsRenamed({slot: "slot", place: "place"})


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("secret_scan", replace_secrets),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode_bytes),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again.

    Once it is written, the tables that the stage worked with, its input among them, go.
    """
    docs, before = documents(spark, sf_dir), written()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
            sweep(before, docs)
    return docs
