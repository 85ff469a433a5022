"""The edge where files land: tails of growing files, archives, and what came before Spark."""

from __future__ import annotations

import io
import time
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tail_lines(read: Callable[[int], bytes], size: int) -> list[str]:
    """Whole lines in the last ``size`` bytes; the first line is dropped unless the answer is the whole file."""
    data = read(size)
    lines = data.decode("latin-1").splitlines()
    return lines[1:] if len(data) >= size else lines


def unzip_lines(data: bytes, member: str) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        return archive.read(member).decode("utf-8").splitlines()


def retried(call: Callable[[], bytes], attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> bytes:
    """The call's answer; on an OSError again after 1, 2 and 4 seconds."""
    for k in range(attempts):
        try:
            return call()
        except OSError:
            wait(2.0**k)
    return call()


def landed(spark: SparkSession, lines: list[str], source_file: str, ingested_at: str) -> DataFrame:
    """Lines fetched on the driver as (raw_line, source_file, ingested_at); for lists of bounded size."""
    rows = spark.createDataFrame([(x,) for x in lines], "raw_line string")
    return rows.withColumn("source_file", F.lit(source_file)).withColumn("ingested_at", F.to_timestamp(F.lit(ingested_at)))
