"""The corpus queries, one an operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, filter_audit, line_dedup, line_quality, mixing, pii, runs, secret_scan, sharding, simhash, tiff, token_blocks, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_blocks": token_blocks.op1,
    "op2_pii": pii.op2,
    "op3_tiff": tiff.op3,
    "op4_secrets": secret_scan.op4,
    "op5_line_quality": line_quality.op5,
    "op6_toxicity": toxicity.op6,
    "op7_byte_bpe": bpe.op7,
    "op8_virtual_slots": sharding.op8,
    "op9_pfair_mix": mixing.op9,
    "op10_simhash": simhash.op10,
    "op11_filter_audit": filter_audit.op11,
    "op12_word_runs": runs.op12,
    "op13_line_dedup": line_dedup.op13,
}

SQL: dict[str, str] = {"op5_line_quality": line_quality.SQL, "op9_pfair_mix": mixing.SQL, "op11_filter_audit": filter_audit.SQL, "op12_word_runs": runs.SQL, "op13_line_dedup": line_dedup.SQL}
