"""Readers of landed files that Spark has no format for: the ends of growing files, and members of zip archives.

Both are data sources of Python: a partition is a file (or an archive's member), read by an executor in pieces; the
driver lists names and sizes alone. Files are found through Arrow's file systems (local folders, HDFS, S3, GCS).

    files.register(spark)
    spark.read.format("tail_lines").option("tail_bytes", 4096).load("/landing/daily")
    spark.read.format("zip_lines").option("member", "cities.txt").load("/landing/places.zip")
"""

from __future__ import annotations

import fnmatch
import io
import sys
import time
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ATTEMPTS = 4
PIECE = 1 << 20


def file_system(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def listed(path: str, pattern: str = "*") -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files below a folder whose names fit the pattern; hidden ones are left out."""
    from pyarrow import fs

    where, base = file_system(path)
    info = where.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else where.get_file_info(fs.FileSelector(base, recursive=True))
    prefix = path.split(base)[0] if base in path else ""
    return sorted((prefix + f.path, f.size) for f in found if f.is_file and not f.base_name.startswith((".", "_")) and fnmatch.fnmatch(f.base_name, pattern))


def retried(call, attempts: int = ATTEMPTS, wait=time.sleep):
    """The call's answer; on an OSError again after 1, 2, 4 ... tenths of a second."""
    for k in range(attempts - 1):
        try:
            return call()
        except OSError:
            wait(0.1 * 2**k)
    return call()


def lines_from(read, start: int, end: int, encoding: str) -> Iterator[str]:
    """Whole lines of the bytes from ``start`` to ``end``, read in pieces; the first line is left out if it was begun before.

    ``read(at, n)`` gives n bytes; it may be called again for the same piece.
    """
    at, rest, skip = start, b"", start > 0
    if skip:  # a line that begins just here is whole: look at the byte before
        skip = read(start - 1, 1) != b"\n"
    while at < end:
        data = rest + read(at, min(PIECE, end - at))
        at += min(PIECE, end - at)
        *whole, rest = data.split(b"\n")
        for line in whole:
            if skip:
                skip = False
                continue
            yield line.removesuffix(b"\r").decode(encoding)
    if rest and not skip:
        yield rest.removesuffix(b"\r").decode(encoding)


@dataclass
class Piece(InputPartition):
    path: str
    start: int
    end: int
    member: str = ""


class _Lines(DataSource):
    def schema(self) -> str:
        return "value string, source_file string"

    def files(self) -> list[tuple[str, int]]:
        path = self.options.get("path")
        if not path:
            raise ValueError("a path is needed")
        return listed(path, self.options.get("pathglobfilter", "*"))


class TailLines(_Lines):
    """The last ``tail_bytes`` bytes of each file (all of it without that option), as whole lines."""

    @classmethod
    def name(cls) -> str:
        return "tail_lines"

    def reader(self, schema) -> DataSourceReader:
        size = int(self.options.get("tail_bytes", 0))
        return TailReader([Piece(p, max(0, n - size) if size > 0 else 0, n) for p, n in self.files()], self.options.get("encoding", "latin-1"))


class TailReader(DataSourceReader):
    def __init__(self, pieces: list[Piece], encoding: str):
        self.pieces, self.encoding = pieces, encoding

    def partitions(self) -> list[Piece]:
        return self.pieces or [Piece("", 0, 0)]

    def read(self, piece: Piece) -> Iterator[tuple[str, str]]:
        if piece.path:
            where, base = file_system(piece.path)

            def read(at: int, n: int) -> bytes:
                def once() -> bytes:
                    with where.open_input_file(base) as f:
                        f.seek(at)
                        return f.read(n)

                return retried(once)

            for line in lines_from(read, piece.start, piece.end, self.encoding):
                yield line, piece.path


class ZipLines(_Lines):
    """Lines of the members of zip archives, or of those whose name fits ``member``; inflated as they are read."""

    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def reader(self, schema) -> DataSourceReader:
        return ZipReader([Piece(p, 0, n) for p, n in self.files()], self.options.get("member", "*"), self.options.get("encoding", "utf-8"))


class ZipReader(DataSourceReader):
    def __init__(self, pieces: list[Piece], member: str, encoding: str):
        self.pieces, self.member, self.encoding = pieces, member, encoding

    def partitions(self) -> list[Piece]:
        return self.pieces or [Piece("", 0, 0)]

    def read(self, piece: Piece) -> Iterator[tuple[str, str]]:
        if not piece.path:
            return
        where, base = file_system(piece.path)
        with retried(lambda: where.open_input_file(base)) as f, zipfile.ZipFile(f) as archive:
            for member in archive.namelist():
                if not member.endswith("/") and fnmatch.fnmatch(member, self.member):
                    with archive.open(member) as data:
                        for line in io.TextIOWrapper(data, self.encoding, newline="\n"):
                            yield line.rstrip("\n").removesuffix("\r"), f"{piece.path}!{member}"


def register(spark) -> None:
    """Makes both formats known to the session. Executors get this module's code with them: they need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    for source in (TailLines, ZipLines):
        spark.dataSource.register(source)
