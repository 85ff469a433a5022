"""Token ids in files of patched frame-of-reference (PFOR) blocks.

A file holds the ids of consecutive documents, ``BLOCK`` ids a block. A block
stores its minimum, a bit width and the differences from the minimum packed at
that width. The width is the smallest one that holds ``PERCENTILE`` of the
block's differences; larger ones are exceptions: their position and the bits
above the width stand in the file's exception lists. An index gives where each
block's bits start, so any range of ids is read without what precedes it.

Layout, little-endian: magic ``PFOR0001``; u64 counts: documents, ids, blocks,
exceptions, packed bytes, first id's place in the partition's run; per block:
u32 minimum, u8 width, u16 exceptions, u64 start of its bits; per exception:
u16 position, u32 high bits; packed bits; per document: i64 id, u8 null flag,
u64 ids; crc32 of all that precedes.

Writing: rows are range-partitioned and sorted by the id, a null id first; rows
with equal ids are ordered by the hash of the text. A task streams its rows into
files of about ``FILE_IDS`` ids (a document is never cut), each written under a
temporary name and renamed, so a task that runs again replaces its own files
with equal ones. Reading: Spark's ``binaryFile`` source lists and reads the
files, one file in memory at a time. The place of a partition's first id comes
from one sum per partition, bounded by the number of partitions.

Defined cases: null and empty texts are documents with the end id alone; an empty
table writes no file and reads as an empty table; columns other than the id and
the text are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from codecs import charmap_decode
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, held, trim, work_path

MAGIC = b"PFOR0001"
BLOCK = 128
PERCENTILE = 0.9
FILE_IDS = 1 << 21
#: Blocks that are packed or unpacked at a time, which bounds the memory for their bits.
STEP_BLOCKS = 1024
#: Of a worker's memo of words; words of over ``MEMO_CHARS`` bytes aren't kept.
MEMO_BYTES = 96 << 20
MEMO_CHARS = 32


def pack(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> tuple[np.ndarray, ...]:
    """Blocks of u32 ids: minima, widths, exceptions a block, starts, positions, high bits, packed bytes."""
    step = block * STEP_BLOCKS
    parts = [_pack(ids[k : k + step], block, percentile) for k in range(0, max(1, len(ids)), step)]
    before = 0
    for part in parts:
        part[3][:] += np.uint64(before)
        before += len(part[6])
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _eights_packed(values: np.ndarray, w: int) -> np.ndarray:
    """The low ``w`` bits of rows of values, eight at a time: these are ``w`` bytes, made in two 64-bit words."""
    n, block = values.shape
    eights = (values.astype("<u8") & np.uint64((1 << w) - 1)).reshape(n, block // 8, 8)
    half = [np.zeros((n, block // 8), "<u8") for _ in range(2)]
    for k in range(8):
        half[k // 4] |= eights[:, :, k] << np.uint64(k % 4 * w)
    words = np.empty((n, block // 8, 2), "<u8")
    if w == 16:
        words[:, :, 0], words[:, :, 1] = half
    else:
        words[:, :, 0], words[:, :, 1] = half[0] | half[1] << np.uint64(4 * w), half[1] >> np.uint64(64 - 4 * w)
    return np.ascontiguousarray(words.view(np.uint8).reshape(n, block // 8, 16)[:, :, :w]).reshape(n, -1)


def _eights_unpacked(rows: np.ndarray, w: int) -> np.ndarray:
    """The values of which :func:`_eights_packed` made rows of bytes."""
    n, groups = len(rows), rows.shape[1] // w
    wide = np.zeros((n, groups, 16), np.uint8)
    wide[:, :, :w] = rows.reshape(n, groups, w)
    low, high = np.moveaxis(wide.view("<u8"), 2, 0)
    mask = np.uint64((1 << w) - 1)
    half = (low, high) if w == 16 else (low, low >> np.uint64(4 * w) | high << np.uint64(64 - 4 * w))
    out = np.empty((n, groups, 8), np.uint32)
    for k in range(8):
        out[:, :, k] = half[k // 4] >> np.uint64(k % 4 * w) & mask
    return out.reshape(n, -1)


def _pack(ids: np.ndarray, block: int, percentile: float) -> tuple[np.ndarray, ...]:
    n = len(ids)
    blocks = -(-n // block)
    full = np.full(blocks * block, ids[-1] if n else 0, np.uint32)
    full[:n] = ids
    grid = full.reshape(blocks, block)
    low = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    diff = grid - low[:, None]
    kth = min(block - 1, max(0, int(np.ceil(percentile * block)) - 1))
    at = np.partition(diff, kth, axis=1)[:, kth] if blocks else low
    width = np.ceil(np.log2(at.astype(np.float64) + 1)).astype(np.uint8)
    high = (diff.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    row, col = np.nonzero(high)
    starts, packed, place = np.zeros(blocks, np.uint64), [], 0
    size = (width.astype(np.int64) * block + 7) // 8
    ends = np.cumsum(size)
    starts[:] = ends - size
    out = np.zeros(int(ends[-1]) if blocks else 0, np.uint8)
    for w in np.unique(width):
        if w:
            own = np.nonzero(width == w)[0]
            if w <= EIGHTS and block % 8 == 0:
                rows = _eights_packed(diff[own], int(w))
                out[starts[own].astype(np.int64)[:, None] + np.arange(rows.shape[1])] = rows
                continue
            narrow = diff[own].astype("u1" if w <= 8 else "<u2" if w <= 16 else "<u4")  # the low bits are all that is packed
            bits = np.unpackbits(narrow.view(np.uint8).reshape(len(own), block, narrow.itemsize), axis=2, bitorder="little")[:, :, :w]
            rows = np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little")
            out[starts[own].astype(np.int64)[:, None] + np.arange(rows.shape[1])] = rows
    return low, width, np.bincount(row, minlength=blocks).astype(np.uint16), starts, col.astype(np.uint16), high[row, col], out


def unpack(n: int, low: np.ndarray, width: np.ndarray, counts: np.ndarray, starts: np.ndarray, positions: np.ndarray, high: np.ndarray, packed: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The ids that :func:`pack` packed."""
    ends = np.cumsum(counts, dtype=np.int64)
    out = [np.zeros(0, np.uint32)]
    for k in range(0, len(low), STEP_BLOCKS):
        at = slice(k, k + STEP_BLOCKS)
        own = slice(int(ends[k - 1]) if k else 0, int(ends[at][-1]))
        out.append(_unpack(low[at], width[at], counts[at], starts[at], positions[own], high[own], packed, block))
    return np.concatenate(out)[:n]


def _unpack(low: np.ndarray, width: np.ndarray, counts: np.ndarray, starts: np.ndarray, positions: np.ndarray, high: np.ndarray, packed: np.ndarray, block: int) -> np.ndarray:
    grid = np.zeros((len(low), block), np.uint32)
    for w in np.unique(width):
        if w:
            own = np.nonzero(width == w)[0]
            size = (int(w) * block + 7) // 8
            rows = packed[starts[own].astype(np.int64)[:, None] + np.arange(size)]
            if w <= EIGHTS and block % 8 == 0:
                grid[own] = _eights_unpacked(rows, int(w))
                continue
            bits = np.unpackbits(rows, axis=1, bitorder="little", count=int(w) * block).reshape(len(own), block, int(w))
            wide = np.zeros((len(own), block, 8 * (1 + (int(w) - 1) // 8)), np.uint8)
            wide[:, :, : int(w)] = bits
            as_bytes = np.packbits(wide, axis=2, bitorder="little")
            word = np.zeros((len(own), block, 4), np.uint8)
            word[:, :, : as_bytes.shape[2]] = as_bytes
            grid[own] = word.view("<u4")[:, :, 0]
    row = np.repeat(np.arange(len(low)), counts)
    grid[row, positions] |= (high.astype(np.uint64) << width[row].astype(np.uint64)).astype(np.uint32)
    return (grid + low[:, None]).reshape(-1)


def file_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, first: int) -> bytes:
    """One file of the layout above."""
    low, width, counts, starts, positions, high, packed = pack(ids)
    body = b"".join([
        MAGIC, struct.pack("<6Q", len(doc_ids), len(ids), len(low), len(positions), len(packed), first),
        low.astype("<u4").tobytes(), width.tobytes(), counts.astype("<u2").tobytes(), starts.astype("<u8").tobytes(),
        positions.astype("<u2").tobytes(), high.astype("<u4").tobytes(), packed.tobytes(),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], np.uint8).tobytes(), np.array(lengths, "<u8").tobytes(),
    ])
    return body + struct.pack("<I", zlib.crc32(body))


def read_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """Document ids, their numbers of ids, all ids, and the first id's place in its partition."""
    if data[:8] != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("not a whole PFOR file")
    docs, n, blocks, exceptions, packed, first = struct.unpack_from("<6Q", data, 8)
    at, got = 56, []
    for kind, count in (("<u4", blocks), ("u1", blocks), ("<u2", blocks), ("<u8", blocks), ("<u2", exceptions), ("<u4", exceptions), ("u1", packed), ("<i8", docs), ("u1", docs), ("<u8", docs)):
        got.append(np.frombuffer(data, kind, count, at))
        at += got[-1].nbytes
    ids = [None if null else x for x, null in zip(got[7].tolist(), got[8].tolist(), strict=True)]
    return ids, got[9].astype(np.int64), unpack(n, *got[:7]), first


#: Widths up to this are packed eight values at a time.
EIGHTS = 16
#: The split pattern over printable text below U+0250 without the numbers of ODD, in lower case.
PLAIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|[\W_]+")
ODD = re.compile("[\xb2\xb3\xb9\xbc-\xbe]")
#: From U+0250 on, or in lower case so.
NOT_PLAIN = re.compile("[^\x00-\u012f\u0131-\u0239\u023b-\u023d\u023f-\u024f]")
#: Pieces without a letter are kept apart while there are at most so many.
MARKS = 4096
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
BYTE_CHARS = {b: b for b in _SELF} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(_SELF))}
BYTE_TABLE = "".join(chr(BYTE_CHARS[b]) for b in range(256))


class Encoder(dict):
    """Texts to ids by the tokenizers library.

    Where the tokenizer drops white space and splits at it, a text's ids are the ids
    of its words in turn; each distinct word then goes through the library's
    normalizer, splitter and model once a worker (this dictionary, from a word to its
    packed ids, and the half that it replaced when it was full are bounded in bytes; a rare
    word and the comma or stop behind it are looked up apart). For printable text below U+0250 the
    normalizer only lowers letters, and the split is that of ``PLAIN_PIECES``, so such texts are
    lowered whole, which leaves fewer distinct words, and the
    pieces of such words go straight to the model. Words that hold a special token's opening, and all texts of other
    tokenizers, are encoded by the library in one call.
    """

    #: Of an entry in a dictionary, besides the bytes of its key and value.
    SLOT = 140

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES):
        from tokenizers import Tokenizer

        self.most, self.size, self.old = memo_bytes // 2, 0, {}

        self.library = Tokenizer.from_file(path)
        self.packed = [struct.pack("<I", k) for k in range(max(self.library.get_vocab().values()) + 1)]
        with open(path) as f:
            config = json.load(f)
        self.by_word = splits_at_space(config)
        special = [re.escape(t["content"].encode()) for t in config.get("added_tokens", [])]
        self.special = re.compile(b"|".join(special) or b"(?!)").search
        self.special_lower = [t["content"].lower() for t in config.get("added_tokens", [])]
        self.lowers = lowers(config)
        self.marks = {}
        self.letters_are_plain = not any(t["content"].isalpha() for t in config.get("added_tokens", []))
        # A mark of these after a letter is a piece of its own, and no special token holds one.
        self.trail = frozenset(b",.;:!?") - frozenset(b"".join(t["content"].encode() for t in config.get("added_tokens", [])))

    def piece(self, piece: str) -> bytes:
        """The ids of what the splitter gave, before the byte-level alphabet."""
        if not piece[0].isalpha():
            ids = self.marks.get(piece)
            if ids is None:
                ids = self.by_model(piece)
                if len(self.marks) < MARKS and len(piece) <= MEMO_CHARS:
                    self.marks[piece] = ids
            return ids
        # Letters in lower case have the ids of the word that they would be alone.
        ids = self.get(piece.encode()) if self.letters_are_plain else None
        return self.by_model(piece) if ids is None else ids

    def by_model(self, piece: str) -> bytes:
        known = self.library.model.tokenize(piece if piece.isascii() else charmap_decode(piece.encode(), "strict", BYTE_TABLE)[0])
        return b"".join([self.packed[t.id] for t in known])

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if word[-1] in self.trail and len(word) > 1 and 97 <= word[-2] | 32 <= 122:
                ids = self.get(word[:-1])
                if ids is None:
                    return self[word[:-1]] + self[word[-1:]]  # not kept yet: its parts are
                ids += self[word[-1:]]
            else:
                ids = self.made(word)
        if len(word) <= MEMO_CHARS:
            self.size += len(word) + len(ids) + self.SLOT
            if self.size > self.most:
                self.old, self.size = dict(self), 0
                self.clear()
            self[word] = ids
        return ids

    def made(self, word: bytes) -> bytes:
        """The ids of a word by the library."""
        text = word.decode()
        lower = text.lower()
        low = word.isascii() or not NOT_PLAIN.search(text)
        if low and lower.isalpha() and self.letters_are_plain:
            ids = self.piece(lower)
        elif self.special(word):
            ids = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        elif low and text.isprintable() and not ODD.search(text):
            ids = b"".join(map(self.piece, PLAIN_PIECES.findall(lower)))
        else:
            found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            ids = b"".join(struct.pack("<I", t.id) for p, _ in found for t in self.library.model.tokenize(p))
        return ids

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        last = np.array([end], "<u4").tobytes()
        if not self.by_word:
            found = self.library.encode_batch(texts, add_special_tokens=False)
            return [np.array(x.ids, "<u4").tobytes() + last for x in found]
        # Split at ASCII white space; the library splits at the rest.
        return [b"".join(map(self.__getitem__, self.lowered(t).encode().split())) + last for t in texts]

    def lowered(self, text: str) -> str:
        """The text in lower case where that changes none of its ids, else as it is."""
        if not self.lowers or not (text.isascii() or not NOT_PLAIN.search(text)):
            return text
        lower = text.lower()
        return text if any(t in lower for t in self.special_lower) else lower


def splits_at_space(config: dict) -> bool:
    """Whether the tokenizer file says that no token and no rule sees across white space."""
    normal = config.get("normalizer") or {}
    steps = normal.get("normalizers", [normal] if normal else [])
    plain = all(s["type"] in ("NFC", "Lowercase") or (s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " ") for s in steps)
    pre = config.get("pre_tokenizer") or {}
    parts = pre.get("pretokenizers", [pre] if pre else [])
    words = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"  # fixed value: the only split pattern known to drop white space
    split = bool(parts) and parts[0]["type"] == "Split" and parts[0]["pattern"] == {"Regex": words} and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
    rest = all(p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p["use_regex"] for p in parts[1:])
    model = config.get("model", {}).get("type") == "BPE" and not config["model"].get("dropout")
    added = all(not any(c.isspace() for c in t["content"]) and not t["lstrip"] and not t["rstrip"] for t in config.get("added_tokens", []))
    return plain and split and rest and model and added


def lowers(config: dict) -> bool:
    """Whether the tokenizer file says that letters are lowered."""
    normal = config.get("normalizer") or {}
    return any(s["type"] == "Lowercase" for s in normal.get("normalizers", [normal] if normal else []))


def encoder(path: str) -> Encoder:
    """The tokenizer at ``path``, kept in a worker until another stage wants something else."""
    return held(("words", path), lambda: Encoder(path))


#: Spark's names of file systems that Arrow knows by another one.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}


def file_system(directory: str):
    """Arrow's file system of a folder that Spark names, and the folder's path in it."""
    from pyarrow import fs

    scheme, found, rest = directory.partition(":")
    if not found or not re.fullmatch("[A-Za-z][A-Za-z0-9+.-]*", scheme):
        return fs.LocalFileSystem(), directory
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def put(directory: str, name: str, data: bytes, attempt: str) -> None:
    """Writes a file whole: under a name of this attempt's own, then renamed."""
    where, base = file_system(directory)
    where.create_dir(base, recursive=True)
    with where.open_output_stream(f"{base}/.{name}.{attempt}") as out:
        out.write(data)
    where.move(f"{base}/.{name}.{attempt}", f"{base}/{name}")


def write(docs: DataFrame, directory: str, make_encoder: Callable[[], Encoder], end: int, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of ``docs`` in ascending order of ``id_col``.

    Returns a manifest, one row a file: part, file, n_docs, n_ids. The rows are
    range-partitioned before they are encoded, so each text is encoded once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Rows of one id may be many: the hash, then the row's own number, let ranges split them.
    ordered = (
        rows.withColumn("h", F.xxhash64("text"))
        .withColumn("k", F.monotonically_increasing_id())
        .repartitionByRange("doc_id", "h", "k")
        .sortWithinPartitions("doc_id", "h", "k")
        .select("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt, made = task.partitionId(), f"{task.taskAttemptId()}", make_encoder()
        ids, chunks, lengths, held, first, number = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal ids, chunks, lengths, held, first, number
            name = f"part-{part:06d}-{number:06d}.pfor"
            put(directory, name, file_bytes(ids, lengths, np.frombuffer(b"".join(chunks), "<u4"), first), attempt)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "n_docs": pa.array([len(ids)], pa.int64()), "n_ids": pa.array([held], pa.int64())})
            ids, chunks, lengths, held, first, number = [], [], [], 0, first + held, number + 1
            return row

        for batch in batches:
            for doc_id, found in zip(batch.column(0).to_pylist(), made.encode(batch.column(1).to_pylist(), end), strict=True):
                ids.append(doc_id)
                chunks.append(found)
                lengths.append(len(found) // 4)
                held += lengths[-1]
                if held >= file_ids:
                    yield close()
        if ids:
            yield close()
        del made
        trim()

    return ordered.mapInArrow(run, "part int, file string, n_docs bigint, n_ids bigint")


def read(spark: SparkSession, directory: str, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of its ids as little-endian u32), and ids (binary) if ``with_ids``."""
    if not manifest.take(1):
        empty = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
        return spark.createDataFrame([], empty)
    # One row per partition that wrote: partitions are bounded, documents aren't collected.
    base, before = {}, 0
    for part, n in sorted((r.part, r.n) for r in manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        base[part], before = before, before + n
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(directory).select("path", "content")
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held()  # a worker that wrote lets go of its encoder
        for batch in batches:
            for k in range(batch.num_rows):
                part = int(batch.column(0)[k].as_py().rsplit("/", 1)[1].split("-")[1])
                doc_ids, lengths, ids, first = read_file(batch.column(1)[k].as_buffer().to_pybytes())
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                cut = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(ends - lengths + (first + base[part])), pa.array(lengths), pa.array([zlib.crc32(x) for x in cut], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([bytes(x) for x in cut], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)
        trim()

    # Spark packs files into tasks by size; a file is bounded by FILE_IDS and one document.
    return files.mapInArrow(run, schema)


def op1(spark, sf_dir: str) -> DataFrame:
    """``documents`` in PFOR files by the public word-end vocabulary, read back."""
    import public_tokenizers

    docs, directory = documents(spark, sf_dir), work_path(spark, "pfor")
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    listed = work_path(spark, "pfor-manifest")
    write(docs, directory, lambda: encoder(vocabulary), end=2).write.parquet(listed)
    return read(spark, directory, spark.read.parquet(listed))
