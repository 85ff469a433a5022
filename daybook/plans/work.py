"""Work tables: written to the folder that driver and executors share, read back, and deleted after use."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
import weakref
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}
_lasting: set[str] = set()
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def is_local(spark: SparkSession) -> bool:
    """One JVM on one machine, as in tests."""
    master = spark.sparkContext.master
    return master.startswith("local") and "cluster" not in master


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, which doesn't depend on whose default is asked."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, with its file system.

    Where it is unset, a local session (one machine, as in tests) gets a folder of its own,
    removed at exit; a cluster session is refused, since no other folder is known to be shared.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return qualified(spark, named)
    if not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"/tmp/checkpoints/{uuid.uuid4().hex}"
    os.makedirs(own)
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    return qualified(spark, sc.getCheckpointDir())


def work_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A fresh path in the shared folder, for :func:`sweep` to delete; a ``lasting`` one stands until the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if not _written:
        atexit.register(sweep, everything=True)
    _written[path] = spark
    if lasting:
        _lasting.add(path)
    return path


def kept(df: DataFrame, name: str = "table", **options) -> DataFrame:
    """The table written once; its readers, and retries after a lost executor, start from the files. ``options``: of the writer."""
    path = work_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[made] = path
    return made


def discard(table: DataFrame) -> None:
    """Deletes what :func:`kept` wrote for this table; other tables are left alone."""
    path = _paths.pop(table, None)
    if path:
        delete(table.sparkSession, path)


def written() -> frozenset[str]:
    """The work paths that stand now, for :func:`sweep`."""
    return frozenset(_written)


def sweep(before: frozenset[str] = frozenset(), but: DataFrame | None = None, everything: bool = False) -> None:
    """Deletes the work paths that were given out since ``before``, except ``but``'s own and, unless ``everything`` goes, lasting ones.

    For whoever has stored what was made from them; runs over all at the end of the driver.
    """
    spared = _paths.get(but) if but is not None else None
    for path, spark in list(_written.items()):
        if path not in before and path != spared and (everything or path not in _lasting):
            try:
                delete(spark, path)
            except Exception:  # noqa: BLE001  the session is gone, or goes: local files still can be deleted, others are left to the folder's owner
                if path.startswith("file:"):
                    shutil.rmtree(unquote(urlparse(path).path), ignore_errors=True)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder through Spark's own file systems."""
    _written.pop(path, None)
    _lasting.discard(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
