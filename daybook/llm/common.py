"""Helpers that every corpus operator shares: shared storage, workers, names, readers."""

from __future__ import annotations

import ctypes
import zipfile
from collections.abc import Callable, Hashable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.work import delete, discard, is_local, kept, sweep, work_path, written  # noqa: F401  operators and the pipeline take them from here

PACKAGE = Path(__file__).resolve().parents[1]
#: Texts are long rows: fewer of them at a time, between JVM and workers and from files.
SMALL = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.parquet.columnarReaderBatchSize": "1024"}
#: Row groups of written texts: what a task holds while it writes.
ROW_GROUP_BYTES = 16 << 20

_ready: set[str] = set()


def materialise(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back.

    This cuts the lineage: later stages, and retries after a lost executor,
    start from the written table. ``instead_of`` is a materialised table that nothing
    reads once this one stands; it is deleted.
    """
    made = kept(df, name, **{"parquet.block.size": ROW_GROUP_BYTES})
    if instead_of is not None:
        discard(instead_of)
    return made


def ready(spark: SparkSession) -> None:
    """Workers can import this package, and batches stay small unless the session sets their size.

    A cluster gets the package as a zip file, once a context, by way of the shared folder.
    """
    for key, value in SMALL.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    sc = spark.sparkContext
    if is_local(spark) or sc.applicationId in _ready:
        return
    _ready.add(sc.applicationId)
    folder = work_path(spark, "package", lasting=True)
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{PACKAGE.name}.zip")
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(_zipped()))
    out.close()
    sc.addPyFile(f"{folder}/{PACKAGE.name}.zip")


def _zipped() -> bytes:
    import io

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, str(f.relative_to(PACKAGE.parent)))
    return data.getvalue()


_held: list[tuple[Hashable, object]] = []


def held(key: Hashable = None, make: Callable[[], object] | None = None):
    """What a worker keeps from task to task: one thing, made at its first use.

    Workers are used again by other stages. Asking for another key, or none, lets go of
    what was held, so an encoder's tables don't stay in memory beside the next stage's.
    """
    if not _held or _held[0][0] != key:
        let_go = bool(_held) and _held[0][0] is not None
        _held.clear()
        if let_go:
            trim()
        _held.append((key, make() if make else None))
    return _held[0][1]


def trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table ``documents``."""
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id and the text; a null text becomes an empty one."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have in any letter case."""
    have = {c.lower() for c in df.columns}
    name = f"_{base}"
    while name.lower() in have:
        name = f"_{name}"
    return name
