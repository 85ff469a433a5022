"""Lines that several documents share stay in one of them: range-partitioned hashes, streamed in order.

A line's key is the line without white space at both ends, A-Z in lower case. Keys of ``MIN_CHARS`` code points
or more are hashed to 128 bits. A key that ``MIN_DOCS`` documents or more hold keeps its lines in the document of
the largest id alone. Each text gives one row a key: (hash, id, mark of the text, places of the lines). Rows
are partitioned by range of (hash, id descending, mark) and sorted so within a partition; so a key that a
third of all documents have spreads over as many partitions as its rows fill. A task streams its
rows and decides each key that begins in its partition and ends there, or that reaches ``MIN_DOCS`` in it. What it
can't decide are rows of the partition's first key, which may have begun before, and of its last one, if that hasn't
reached ``MIN_DOCS``. These rows are passed on with their hash, and the two keys' documents are counted over
all partitions: two keys a partition, so that table's size is bounded by the number of partitions.

The result is a bitmap of kept lines for each text that loses some, compressed with zlib, not a text:
:func:`keep_bitmaps`. :func:`without_repeats` applies bitmaps.

Defined cases: a null or empty text is one empty line; a document is an id, so repeated rows of one id count
once and lose the same lines (a task sends equal rows once); a row without an id counts for no document and
loses no line; lines of the largest id all stay, as often as it has them; an empty table gives an
empty table; extra columns are kept by :func:`without_repeats` unless their names are those that it makes.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fresh, materialise, trim

MIN_CHARS = 40
MIN_DOCS = 5
#: Texts that a task remembers to have sent.
SENT = 100_000
#: Rows that a task gives at once.
ROWS = 20_000
KEYED = "h binary, doc_id bigint, mark bigint, n_lines int, at binary"


def line_keys(data: bytes, min_chars: int = MIN_CHARS) -> dict[bytes, list[int]]:
    """Places of a text's lines by the hash of their key, for keys that are long enough."""
    out: dict[bytes, list[int]] = {}
    for k, line in enumerate(data.split(b"\n")):
        key = line.strip()  # bytes lose ASCII white space alone, and lower() changes A-Z alone
        if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
            out.setdefault(xxhash.xxh3_128_digest(key.lower()), []).append(k)
    return out


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """A row for each text and key: h, doc_id, mark, n_lines and at (places, little-endian unsigned 32-bit)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    rows = rows.filter(F.length("text") >= min_chars)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: OrderedDict[tuple[int, int], None] = OrderedDict()
        made: list[tuple] = []
        for batch in batches:
            for doc, mark, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (doc, mark) in sent:
                    sent.move_to_end((doc, mark))
                    continue
                sent[doc, mark] = None
                if len(sent) > SENT:
                    sent.popitem(last=False)
                data = text.encode("utf-8", "surrogatepass")
                n = data.count(b"\n") + 1
                made += [(h, doc, mark, n, np.array(at, "<u4").tobytes()) for h, at in line_keys(data, min_chars).items()]
                if len(made) >= ROWS:
                    yield _batch(made)
                    made = []
        if made:
            yield _batch(made)
        trim()

    return rows.mapInArrow(find, KEYED)


def _batch(made: list[tuple]) -> pa.RecordBatch:
    h, doc, mark, n, at = zip(*made, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array(doc, pa.int64()), pa.array(mark, pa.int64()), pa.array(n, pa.int32()), pa.array(at, pa.binary())], ["h", "doc_id", "mark", "n_lines", "at"])


class Stream:
    """One partition's rows in order of (hash, id descending, mark), and what is to be said of them.

    Rows given out: with a null ``h``, lines that go; with ``h`` and ``at``, rows that this partition can't decide;
    with ``h`` alone, documents of the last key, for the count. What is held is the last key's
    rows while it has fewer than ``min_docs`` documents, at most a partition.
    """

    def __init__(self, min_docs: int):
        self.min_docs = min_docs
        self.first: bytes | None = None
        self.held: pa.Table | None = None
        self.last: tuple[bytes, int, list[int]] | None = None  # a decided key: hash, largest id, its first ids

    def feed(self, batch: pa.Table) -> pa.Table | None:
        rows = batch if self.held is None else pa.concat_tables([self.held, batch])
        self.held = None
        rows = rows.combine_chunks()
        h = np.frombuffer(b"".join(rows["h"].to_pylist()), np.uint64).reshape(-1, 2)
        doc = rows["doc_id"].to_numpy()
        new = np.concatenate(([True], (h[1:] != h[:-1]).any(axis=1)))
        start = np.flatnonzero(new)
        size = np.diff(start, append=len(doc))
        other = new | np.concatenate(([True], doc[1:] != doc[:-1]))
        n_docs = np.add.reduceat(other.astype(np.int64), start)
        top, enough = doc[start].copy(), n_docs >= self.min_docs
        name = lambda g: h[start[g]].tobytes()
        if self.first is None:
            self.first = name(0)
        open_ = np.zeros(len(start), bool)
        open_[0] = name(0) == self.first
        going = self.last is not None and self.last[0] == name(0)
        if going:
            top[0], enough[0] = self.last[1], True
        g = len(start) - 1
        undecided = not open_[g] and not enough[g]
        if undecided:
            self.held, self.last = rows.slice(int(start[g])), None
        elif open_[g]:
            self.last = None
        elif not (going and g == 0):
            own = np.arange(start[g], len(doc))
            self.last = (name(g), int(top[g]), doc[own[other[own]]][: self.min_docs].tolist())
        goes = np.repeat(enough & ~open_, size) & (doc != np.repeat(top, size))
        passed = np.repeat(open_, size)
        if undecided:
            goes[start[g] :] = False
        out = [_without_hash(rows.filter(pa.array(goes))), rows.filter(pa.array(passed))]
        return pa.concat_tables(out)

    def end(self) -> pa.Table | None:
        if self.held is not None:
            return self.held
        if self.last is None:
            return None
        h, _, docs = self.last
        n = len(docs)
        return pa.table([pa.array([h] * n, pa.binary()), pa.array(docs, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["h", "doc_id", "mark", "n_lines", "at"])


def _without_hash(rows: pa.Table) -> pa.Table:
    return rows.set_column(0, "h", pa.nulls(len(rows), pa.binary()))


def streamed(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Range partitions of :func:`keyed` rows, each streamed once: the rows that :class:`Stream` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(min_docs)
        for batch in batches:
            if batch.num_rows:
                yield from stream.feed(pa.Table.from_batches([batch])).to_batches()
        rest = stream.end()
        if rest is not None:
            yield from rest.to_batches()
        trim()

    order = [F.col("h"), F.desc("doc_id"), F.col("mark")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, KEYED)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, mark (xxhash64 of the text), n_lines, n_dropped and keep (zlib of a bit a line, 1 for lines that
    stay) of each text that loses lines; texts that aren't listed keep all."""
    rows = materialise(keyed(docs, id_col, text_col, min_chars), "line-keys")
    told = materialise(streamed(rows, min_docs), "line-decisions", instead_of=rows)
    edge = told.filter("h IS NOT NULL")
    # Two keys a partition at most.
    over = edge.groupBy(F.col("h").alias("e_h")).agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("top")).filter(F.col("n") >= min_docs)
    late = edge.filter("at IS NOT NULL").join(F.broadcast(over), F.col("h") == F.col("e_h")).filter(F.col("doc_id") < F.col("top"))
    gone = told.filter("h IS NULL").select("doc_id", "mark", "n_lines", "at").unionByName(late.select("doc_id", "mark", "n_lines", "at"))
    by_text = gone.groupBy("doc_id", "mark").agg(F.first("n_lines").alias("n_lines"), F.collect_set("at").alias("at"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dropped, kept = [], []
            for n, some in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                keep = np.ones(n, bool)
                keep[np.frombuffer(b"".join(some), "<u4")] = False
                dropped.append(n - int(keep.sum()))
                kept.append(zlib.compress(np.packbits(keep).tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(2), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "mark", "n_lines", "n_dropped", "keep"])

    return by_text.mapInArrow(pack, "doc_id bigint, mark bigint, n_lines int, n_dropped bigint, keep binary")


def kept_lines(text: str, keep: bytes) -> str:
    """The lines whose bit is set, joined again."""
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join(line for line, ok in zip(lines, bits.tolist(), strict=True) if ok)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept (the text without its repeated lines)."""
    made_up = ("n_lines", "n_dropped", "kept")
    maps = materialise(keep_bitmaps(docs, id_col, text_col, min_chars, min_docs), "line-bitmaps")
    maps = maps.select(F.col("doc_id").alias("_m_id"), F.col("mark").alias("_m_mark"), F.col("n_dropped").alias("_m_gone"), F.col("keep").alias("_m_keep"))
    text = fresh(docs, "text")
    rows = docs.drop(*[c for c in docs.columns if c.lower() in made_up or c.lower().startswith("_m_")]).withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    kept = rows.columns[:-1]
    met = rows.join(maps, (F.col(id_col).cast("long") == F.col("_m_id")) & (F.xxhash64(text) == F.col("_m_mark")), "left")
    met = met.select(*kept, (F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), F.coalesce("_m_gone", F.lit(0)).cast("long").alias("n_dropped"), F.col("_m_keep").alias("_m_keep"), F.col(text).alias("kept"))
    schema = ", ".join(f"`{n}` {t}" for n, t in met.dtypes if n != "_m_keep")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, full = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            if keep.null_count < len(keep):
                made = pa.array([None if k is None else kept_lines(t, k) for k, t in zip(keep.to_pylist(), full.to_pylist(), strict=True)], pa.string())
                full = pc.coalesce(made, full)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], full], [*batch.schema.names[:-2], "kept"])

    return met.mapInArrow(cut, schema)


def op13(spark, sf_dir: str) -> DataFrame:
    """Every document's lines, how many go, and the digest of what stays."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
over_limit AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT r, i, line, coalesce(k.doc_id < top, false) AS goes FROM k LEFT JOIN over_limit o ON o.key = k.key),
t AS (SELECT r, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (NOT goes) AS kept FROM j GROUP BY r)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN t USING (r)
"""
