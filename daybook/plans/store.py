"""Stored tables: Parquet files under numbered commits that are created once.

A table is a folder. ``data/_v=<id>/...`` holds files, a folder a write and, below it, one a partition;
``commits/<number>.json`` holds a version: the schema, how rows are partitioned, and which folders each
partition consists of. The commit with the highest number is the table. A commit is written under another
name and then takes its number by an operation that fails if the number is taken, so it is there whole
or not at all and is never written again; whoever comes second looks at the new version and tries again. Files of a
version aren't touched while it or a later one names them. A writer that dies leaves files that no
commit names, which :meth:`Store.purge` removes later.

An upsert reads and writes the partitions alone that the source's keys fall into. Partitions follow from
key columns by SQL expressions that are stored with the table, so a key is always in the same one.

The number is taken by a hard link on a local file system and by a rename without overwriting elsewhere, which is
atomic on HDFS. An object store without such a rename needs a file system layer that has one.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .elt import KEY, REVISED, revised, upsert

ATTEMPTS = 50
ORPHAN_HOURS = 24.0
WHOLE = ""  # the one partition of a table without partition expressions


class Conflict(RuntimeError):
    """Another writer took the number or changed the same partitions; the write is tried again."""


class Stale(RuntimeError):
    """The rows to write were made from another version than the newest."""


@dataclass(frozen=True)
class Version:
    """What a commit says. ``parts``: a partition's folders, relative to the table; ``streams``: a stream's last batch."""

    number: int
    schema: str
    by: dict[str, str] = field(default_factory=dict)
    parts: dict[str, list[str]] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)

    def folders(self) -> set[str]:
        return {f for some in self.parts.values() for f in some}


class Store:
    """Tables below ``root``. ``by`` maps names of partition columns to SQL expressions over key columns, for
    example ``{"p_year": "year(obs_date)", "p_group": "pmod(xxhash64(station_id), 16)"}``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- files

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _files(self, name: str):
        return self._path(name).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, name: str, folder: str) -> list:
        at = self._path(name, folder)
        files = self._files(name)
        return list(files.listStatus(at)) if files.exists(at) else []

    def _numbers(self, name: str) -> list[int]:
        return sorted(int(m[1]) for f in self._listed(name, "commits") if (m := re.fullmatch(r"(\d{12})\.json", f.getPath().getName())))

    def _links(self, files) -> bool:
        """Whether the files are this machine's own."""
        return files.getUri().getScheme() == "file"

    def _create(self, name: str, number: int, text: str) -> None:
        """Creates a commit, whole; :class:`Conflict` if its number is taken."""
        files, final = self._files(name), self._path(name, "commits", f"{number:012d}.json")
        draft = self._path(name, "drafts", uuid.uuid4().hex)
        out = files.create(draft, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        files.mkdirs(final.getParent())
        try:
            if self._links(files):
                os.link(_local(draft), _local(final))
            else:
                jvm = self.spark._jvm
                none = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, none)
        except FileExistsError as e:
            raise Conflict(str(final)) from e
        except Exception as e:  # the gateway's own kind of error, which names the Java class
            if "FileAlreadyExists" in str(e):
                raise Conflict(str(final)) from e
            raise
        finally:
            files.delete(draft, False)

    # --- versions

    def version(self, name: str, number: int | None = None) -> Version | None:
        """The newest version, or a given one; None if there is none."""
        numbers = self._numbers(name)
        if number is None and not numbers:
            return None
        at = self._path(name, "commits", f"{numbers[-1] if number is None else number:012d}.json")
        files = self._files(name)
        stream = files.open(at)
        try:
            data = bytes(self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream))
        finally:
            stream.close()
        return Version(**json.loads(data))

    def exists(self, name: str) -> bool:
        return bool(self._numbers(name))

    def _commit(self, name: str, change: Callable[[Version | None], Version | None]) -> Version | None:
        """Commits what ``change`` makes of the newest version, and again of a newer one if another writer was
        first. None: nothing to do."""
        for _ in range(ATTEMPTS):
            before = self.version(name)
            made = change(before)
            if made is None:
                return before
            made = replace(made, number=before.number + 1 if before else 1)
            try:
                self._create(name, made.number, json.dumps(asdict(made)))
            except Conflict:
                time.sleep(0.05)
            else:
                return made
        raise Conflict(f"{name}: other writers were always first")

    # --- reading

    def read(self, name: str, number: int | None = None, parts: list[str] | None = None) -> DataFrame:
        """The table, an earlier version of it, or some partitions alone.

        Filters on the key columns reach the files; to leave out folders as well, filter with :meth:`where`.
        """
        version = self.version(name, number)
        if version is None:
            raise LookupError(f"there is no table {name}")
        return self._rows(name, version, parts)

    def _rows(self, name: str, version: Version, parts: list[str] | None = None) -> DataFrame:
        own = version.parts if parts is None else {p: version.parts.get(p, []) for p in parts}
        folders = sorted(f for some in own.values() for f in some)
        schema = StructType.fromJson(json.loads(version.schema))
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}/data").parquet(*[f"{self.root}/{name}/{f}" for f in folders])
        return rows.select(*[f"`{c}`" for c in schema.names])

    def where(self, name: str, met: Callable[[dict[str, str]], bool]) -> DataFrame:
        """The rows of the partitions whose values (as text) ``met`` takes: other folders aren't listed or read."""
        version = self.version(name)
        if version is None:
            raise LookupError(f"there is no table {name}")
        return self._rows(name, version, [p for p in version.parts if met(_values(p))])

    # --- writing

    def _write(self, name: str, df: DataFrame, by: dict[str, str]) -> dict[str, list[str]]:
        """Writes rows as files of their own: folders by partition, still without a commit."""
        folder = f"data/_v={uuid.uuid4().hex[:16]}"
        path = f"{self.root}/{name}/{folder}"
        if not by:
            df.write.parquet(path)
            return {WHOLE: [folder]}
        columns = list(by)
        if clash := {c.lower() for c in columns} & {c.lower() for c in df.columns}:
            raise ValueError(f"columns have the names of partition columns: {sorted(clash)}")
        rows = df.withColumns({c: F.expr(e) for c, e in by.items()})
        # A partition's rows go to few files, and adaptive execution splits those of a large one.
        rows.hint("rebalance", *columns).write.partitionBy(*columns).parquet(path)
        found, level = [folder], 0
        while level < len(columns):
            found = [f"{f}/{s.getPath().getName()}" for f in found for s in self._listed(name, f) if s.isDirectory() and "=" in s.getPath().getName()]
            level += 1
        return {f.removeprefix(folder + "/"): [f] for f in found}

    def overwrite(self, name: str, df: DataFrame, by: dict[str, str] | None = None) -> None:
        """The table is these rows from now on; ``by`` None keeps the table's own partitions."""
        before = self.version(name)
        by = (before.by if before else {}) if by is None else by
        parts, schema = self._write(name, df, by), df.schema.json()
        self._commit(name, lambda v: Version(0, schema, by, parts, v.streams if v else {}))

    def append(self, name: str, df: DataFrame, by: dict[str, str] | None = None) -> None:
        """Adds rows as files of their own; nothing that is there is read or written. Creates the table."""
        before = self.version(name)
        by = before.by if before else by or {}
        schema = df.schema.json()
        if before and StructType.fromJson(json.loads(before.schema)).names != df.columns:
            raise ValueError(f"{name} has other columns")
        parts = self._write(name, df, by)

        def change(v: Version | None) -> Version:
            if v is None:
                return Version(0, schema, by, parts)
            if v.by != by:
                raise ValueError(f"{name} is partitioned anew")
            return replace(v, parts={p: v.parts.get(p, []) + parts.get(p, []) for p in {**v.parts, **parts}})

        self._commit(name, change)

    def upsert(self, name: str, df: DataFrame, keys: list[str], update: Column | None = None, keep: tuple[str, ...] = (), by: dict[str, str] | None = None, stream: tuple[str, int] | None = None, expect: int | None = None, insert: bool = True) -> None:
        """Creates the table or merges into it (:func:`elt.upsert`); a key that the source repeats is refused.

        Reads and writes the partitions that the source falls into. ``stream``, a stream's name and a batch's number, is
        stored with the version; a batch that is stored already changes nothing. So does an empty source.
        ``expect``: the version that the source was made from (0: none); :class:`Stale` if the newest one is another.
        """
        staged = f"{self.root}/{name}/staged/{uuid.uuid4().hex}"
        df.write.parquet(staged)
        try:
            source = self.spark.read.schema(df.schema).parquet(staged)
            for _ in range(ATTEMPTS):
                if expect is not None and (v.number if (v := self.version(name)) else 0) != expect:
                    raise Stale(f"{name} is at another version than {expect}")
                try:
                    return self._merge(name, source, keys, update, keep, by, stream, insert)
                except Conflict:
                    time.sleep(0.05)
            raise Conflict(f"{name}: other writers were always first")
        finally:
            at = self._path(name, "staged", staged.rsplit("/", 1)[1])
            self._files(name).delete(at, True)

    def _merge(self, name, source, keys, update, keep, by, stream, insert) -> None:
        before = self.version(name)
        if before and stream and before.streams.get(stream[0], -1) >= stream[1]:
            return
        if source.isEmpty():
            if before is None:
                self._first(name, source, keys, by or {}, stream)
            elif stream:
                self._commit(name, lambda v: _named(v, stream))
            return
        if before is None:
            return self._first(name, source, keys, by or {}, stream)
        by = before.by
        touched = self._partitions(source, keys, by)
        if not insert:
            touched = [p for p in touched if p in before.parts]
            if not touched:
                return
        parts = self._write(name, upsert(self._rows(name, before, touched), source, keys, update, keep, insert), by)
        schema = upsert(self._rows(name, before, []), source.limit(0), keys, update, keep).schema.json()

        def change(v: Version | None) -> Version | None:
            if v is None or v.by != by or any(v.parts.get(p) != before.parts.get(p) for p in touched) or v.schema != before.schema:
                raise Conflict(name)
            if stream and v.streams.get(stream[0], -1) >= stream[1]:
                return None
            return _named(replace(v, schema=schema, parts={**{p: f for p, f in v.parts.items() if p not in touched}, **parts}), stream)

        self._commit(name, change)

    def _first(self, name, source, keys, by, stream) -> None:
        self._partitions(source.limit(0), keys, by)
        none = self.spark.createDataFrame([], source.schema)
        parts = self._write(name, upsert(none, source, keys), by)

        def change(v: Version | None) -> Version:
            if v is not None:
                raise Conflict(name)
            return _named(Version(0, source.schema.json(), by, parts), stream)

        self._commit(name, change)

    def _partitions(self, source: DataFrame, keys: list[str], by: dict[str, str]) -> list[str]:
        """The partitions that a source falls into, as folder names; their number is bounded by the table's partitions."""
        if not by:
            return [WHOLE]
        found = source.select(*keys).select(*[F.expr(e).cast("string").alias(c) for c, e in by.items()]).distinct().collect()
        return ["/".join(f"{c}={_escaped(r[c])}" for c in by) for r in found]

    def compact(self, name: str, over: int = 8) -> int:
        """Writes the partitions anew that have over ``over`` folders; gives their number."""
        before = self.version(name)
        many = [p for p, f in before.parts.items() if len(f) > over] if before else []
        if many:
            parts = self._write(name, self._rows(name, before, many), before.by)

            def change(v: Version | None) -> Version:
                if v is None or any(v.parts.get(p) != before.parts[p] for p in many):
                    raise Conflict(name)
                return replace(v, parts={**v.parts, **parts})

            self._commit(name, change)
        return len(many)

    def purge(self, name: str, spare: int = 1, orphan_hours: float = ORPHAN_HOURS) -> int:
        """Deletes versions before the newest one and the ``spare`` before it, which late readers may still
        hold, and files that no version names and nobody has written for ``orphan_hours``; gives the number of versions deleted."""
        numbers, files = self._numbers(name), self._files(name)
        old, kept = numbers[: -1 - spare], numbers[-1 - spare :]
        named = {n: {f.split("/")[1] for f in self.version(name, n).folders()} for n in numbers}
        in_use, retired = set().union(*[named[n] for n in kept]), set().union(*[named[n] for n in old])
        late = (time.time() - orphan_hours * 3600) * 1000
        for f in self._listed(name, "data"):
            folder = f.getPath().getName()
            if folder not in in_use and (folder in retired or f.getModificationTime() < late):
                files.delete(f.getPath(), True)
        for f in [*self._listed(name, "drafts"), *self._listed(name, "staged")]:
            if f.getModificationTime() < late:
                files.delete(f.getPath(), True)
        for n in old:
            files.delete(self._path(name, "commits", f"{n:012d}.json"), False)
        return len(old)


def _local(path) -> str:
    return unquote(urlparse(path.toUri().toString()).path)


def _named(v: Version, stream: tuple[str, int] | None) -> Version:
    return v if stream is None else replace(v, streams={**v.streams, stream[0]: stream[1]})


def _values(part: str) -> dict[str, str]:
    return dict(p.split("=", 1) for p in part.split("/")) if part else {}


def _escaped(value: str | None) -> str:
    """A partition's value as Spark names its folder."""
    if value is None or value == "":
        return "__HIVE_DEFAULT_PARTITION__"
    return "".join(c if c > "\x1f" and c not in "\"#%'*/:=?\\\x7f{[]^" else f"%{ord(c):02X}" for c in value)


def revise_stored(store: Store, name: str, converted: DataFrame) -> None:
    """Stored archive rows take the archive's present values and flags where these differ: of ``converted`` only rows that were
    ingested after the stored archive rows' newest are looked at, and only their partitions are read and written."""
    since = store.read(name).filter("source = 'GHCN'").agg(F.max("ingested_at")).first()[0]
    news = converted if since is None else converted.filter(F.col("ingested_at") > F.lit(since))
    store.upsert(name, news.select(*KEY, *REVISED, "ingested_at"), KEY, revised(), insert=False)
