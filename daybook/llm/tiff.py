"""TIFF as a media column: encode samples, walk directories, decode strips and tiles.

:func:`pages` takes a binary column of TIFF files and gives one row per page
(image directory). The walker follows the chain of directories in either byte
order and stops at a loop; a page's strips or tiles are decoded (none, PackBits,
LZW, deflate), predictor 2 is undone, and the samples are put in row order.

:func:`store` writes texts as such files. A text's own bytes choose the compression, byte
order, strips or tiles, predictor and number of pages, so all of these occur in a
corpus, and equal texts give equal files.

Files are not trusted: a part's samples are bounded by what its bytes can unpack to, and
unpacking stops there; parts that lie outside the file or add up to more than it are
errors.

Defined cases: a null or empty file has no pages; a broken file or page (also one
without rows or columns, or with parts of no size) gives one row with ``error`` set
and null samples, the pages before it stay; repeated rows give repeated rows; an empty
table gives an empty table; other columns are ignored unless named in ``keep``, where a
name that is also a result's is left out.
"""

from __future__ import annotations

import hashlib
import struct
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, texts, trim

WIDTH = 64
ROWS_A_STRIP = 1024
TILE = 32
MOST_PAGES = 3
BATCH_BYTES = 4 << 20
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773  # fixed values of the format
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}  # bytes of each field type
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
TAGS = frozenset((256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325))  # the fields that are read
#: Bytes that a packed byte can become at most, by compression.
GROWTH = {NONE: 1, PACKBITS: 64, LZW: 2800, DEFLATE: 1040, OLD_DEFLATE: 1040}
BROKEN = (ValueError, KeyError, IndexError, TypeError, ArithmeticError, MemoryError, zlib.error, struct.error)
#: What a text is stored with: one of eight by its bytes.
STORED_AS = (DEFLATE, PACKBITS, DEFLATE, LZW, OLD_DEFLATE, NONE, DEFLATE, PACKBITS)


def packbits_decode(data: bytes, most: int = 1 << 62) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n and len(out) < most:
        c = data[at]
        at += 1
        if c < 128:
            out += data[at : at + c + 1]
            at += c + 1
        elif c > 128:
            out += data[at : at + 1] * (257 - c)
            at += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more as repeats, what stands between them as literals."""
    out, a = bytearray(), np.frombuffer(data, np.uint8)
    edges = np.concatenate(([0], np.nonzero(np.diff(a))[0] + 1, [len(a)])) if len(a) else np.zeros(1, int)
    runs = np.nonzero(np.diff(edges) >= 3)[0]
    literal = 0  # where the open literal begins
    for s, e in zip(edges[runs].tolist(), edges[runs + 1].tolist(), strict=True):
        _literals(out, data, literal, s)
        for k in range(s, e, 128):
            m = min(128, e - k)
            out += bytes([257 - m if m > 1 else 0, data[k]])
        literal = e
    _literals(out, data, literal, len(data))
    return bytes(out)


def _literals(out: bytearray, data: bytes, start: int, end: int) -> None:
    for k in range(start, end, 128):
        part = data[k : min(end, k + 128)]
        out.append(len(part) - 1)
        out += part


def _widths(encoder: bool) -> np.ndarray:
    """Bits of each code after a clear code: they depend on its number alone. A decoder's table is one entry behind and codes widen one early."""
    entries = 258 + np.arange(SEGMENT)
    if not encoder:
        entries = np.concatenate([[258], entries[:-1]]) + 1
    return np.searchsorted(1 << np.arange(9, 12), entries, side="right") + 9


SEGMENT = 4100  # more codes than stand between two clear codes
DECODED, ENCODED = _widths(False), _widths(True)
STARTS = np.cumsum(DECODED) - DECODED


def lzw_decode(data: bytes, most: int = 1 << 62) -> bytes:
    """Most significant bit first, codes of 9 to 12 bits that widen one early."""
    octets, end, at = np.frombuffer(data + bytes(3), np.uint8).astype(np.int64), 8 * len(data), 0
    out, size, first, last = [], 0, True, None
    table = [bytes([k]) for k in range(256)] + [b"", b""]
    while size < most:
        cap = min(SEGMENT, (end - at) // 9)
        starts, widths = at + (STARTS[:cap] if first else 12 * np.arange(cap)), DECODED[:cap] if first else np.full(cap, 12)
        n = int((starts + widths <= end).sum())
        starts, widths = starts[:n], widths[:n]
        place = starts >> 3
        codes = (octets[place] << 16 | octets[place + 1] << 8 | octets[place + 2]) >> (24 - (starts & 7) - widths) & (1 << widths) - 1
        marks = np.nonzero(codes >> 1 == 128)[0]
        for code in codes[: marks[0] if len(marks) else n].tolist():
            if last is None:
                entry = table[code]
            else:
                if code > len(table):
                    raise ValueError("LZW code out of range")
                entry = table[code] if code < len(table) else last + last[:1]
                if len(table) < 4096:
                    table.append(last + entry[:1])
            out.append(entry)
            last = entry
            size += len(entry)
            if size >= most:
                break
        if len(marks) and codes[marks[0]] == 256:
            at, first, last = int(starts[marks[0]] + widths[marks[0]]), True, None
            del table[258:]
        elif len(marks) or n < SEGMENT:
            break
        else:
            at, first = int(starts[-1] + 12), False
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    codes, widths, table, size, word = [256], [9], {}, 258, -1
    began = 1  # the first code since the last clear code
    for octet in data:
        key = word << 8 | octet
        if word < 0:
            word = octet
        elif key in table:
            word = table[key]
        else:
            codes.append(word)
            table[key] = size
            size += 1
            word = octet
            if size >= 4094:
                codes.append(256)
                widths += ENCODED[: len(codes) - began].tolist()
                table, size, began = {}, 258, len(codes)
    if word >= 0:
        codes.append(word)
    codes.append(257)
    widths += ENCODED[: len(codes) - began].tolist()
    bits = np.unpackbits(np.array(codes, ">u2").view(np.uint8).reshape(-1, 2), axis=1)
    return np.packbits(bits[np.arange(16) >= 16 - np.array(widths)[:, None]]).tobytes()


def compress(data: bytes, how: int) -> bytes:
    return {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 6), OLD_DEFLATE: lambda x: zlib.compress(x, 6)}[how](data)


def decompress(data: bytes, how: int, most: int = 1 << 62) -> bytes:
    """What ``data`` unpacks to; unpacking stops once there are ``most`` bytes."""
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, min(most, sys.maxsize)) if most else b""
    return {NONE: lambda x, _: bytes(x), PACKBITS: packbits_decode, LZW: lzw_decode}[how](data, most)


def encode_page(image: np.ndarray, how: int = DEFLATE, predictor: int = 1, tile: int = 0, order: str = "<", rows_a_strip: int = ROWS_A_STRIP) -> tuple[list[bytes], dict[int, tuple[int, list[int]]]]:
    """The parts and the fields of one page of 8- or 16-bit samples (rows, columns[, samples])."""
    grid = image if image.ndim == 3 else image[:, :, None]
    h, w, samples = grid.shape

    def part(x: np.ndarray) -> bytes:
        if predictor == 2:
            x = np.concatenate([x[:, :1], np.diff(x, axis=1)], axis=1)
        return compress(np.ascontiguousarray(x).astype(x.dtype.newbyteorder(order)).tobytes(), how)

    fields = {256: (4, [w]), 257: (4, [h]), 258: (3, [image.itemsize * 8] * samples), 259: (3, [how]), 262: (3, [2 if samples == 3 else 1]), 277: (3, [samples]), 284: (3, [1]), 317: (3, [predictor])}
    if tile:
        parts = []
        for y in range(0, h, tile):
            for x in range(0, w, tile):
                full = np.zeros((tile, tile, samples), grid.dtype)
                cut = grid[y : y + tile, x : x + tile]
                full[: cut.shape[0], : cut.shape[1]] = cut
                parts.append(part(full))
        fields |= {322: (4, [tile]), 323: (4, [tile]), 324: (4, []), 325: (4, [len(p) for p in parts])}
    else:
        parts = [part(grid[y : y + rows_a_strip]) for y in range(0, h, rows_a_strip)]
        fields |= {278: (4, [rows_a_strip]), 273: (4, []), 279: (4, [len(p) for p in parts])}
    return parts, fields


def encode(images: list[np.ndarray], order: str = "<", **options: int) -> bytes:
    """A TIFF file with one directory per image."""
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for image in images:
        parts, fields = encode_page(image, order=order, **options)
        places = []
        for p in parts:
            places.append(len(out))
            out += p + b"\0" * (len(p) % 2)
        fields[324 if 324 in fields else 273] = (4, places)
        spilled = {}
        for tag, (kind, values) in fields.items():
            raw = struct.pack(f"{order}{len(values)}{CODES[kind]}", *values)
            if len(raw) > 4:
                spilled[tag] = struct.pack(order + "I", len(out))
                out += raw + b"\0" * (len(raw) % 2)
            else:
                spilled[tag] = raw.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields))
        for tag in sorted(fields):
            out += struct.pack(order + "HHI", tag, fields[tag][0], len(fields[tag][1])) + spilled[tag]
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    """Byte order and integer fields of each image directory in turn."""
    if len(data) < 8 or data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF file")
    order = "<" if data[:2] == b"II" else ">"
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        fields = {}
        (n,) = struct.unpack_from(order + "H", data, at)
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind not in CODES or tag not in TAGS:
                continue
            size = SIZES[kind] * count
            place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            if place + size > len(data):
                raise ValueError(f"field {tag} lies outside the file")
            fields[tag] = list(struct.unpack_from(f"{order}{count}{CODES[kind]}", data, place))
        yield order, fields
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def decode_page(data: bytes, order: str, fields: dict[int, list[int]]) -> np.ndarray:
    """Samples of one page: (rows, columns, samples)."""
    w, h = fields[256][0], fields[257][0]
    how, predictor, samples = fields.get(259, [1])[0], fields.get(317, [1])[0], fields.get(277, [1])[0]
    bits = fields.get(258, [1])
    if how not in GROWTH:
        raise ValueError(f"compression {how} isn't supported")
    if set(bits) - {8, 16} or len(set(bits)) != 1:
        raise ValueError(f"{bits[:8]} bits a sample aren't supported")
    if predictor not in (1, 2) or fields.get(284, [1])[0] != 1 and samples > 1:
        raise ValueError("this predictor or planar layout isn't supported")
    kind = np.dtype(f"{order}u{bits[0] // 8}")
    tiled = 324 in fields
    places, sizes = fields[324 if tiled else 273], fields[325 if tiled else 279]
    if len(places) != len(sizes):
        raise ValueError("offsets and sizes differ in number")
    pw, ph = (fields[322][0], fields[323][0]) if tiled else (w, min(fields.get(278, [h])[0], h))
    if min(w, h, samples, pw, ph) < 1:
        raise ValueError("a page or part without rows, columns or samples")
    across, down = -(-w // pw), -(-h // ph)
    if across * down > len(places):
        raise ValueError("parts are missing")
    if any(p < 0 or n < 0 or p + n > len(data) for p, n in zip(places, sizes, strict=True)) or sum(sizes[: across * down]) > len(data):
        raise ValueError("parts lie outside the file or overlap")
    need = [(ph if tiled else min(ph, h - k // across * ph)) * pw * samples for k in range(across * down)]
    if any(n * kind.itemsize > GROWTH[how] * size for n, size in zip(need, sizes, strict=False)):
        raise ValueError("a part is too short for its samples")
    out = np.zeros((h, w, samples), kind.newbyteorder("="))
    for k, (place, size, n) in enumerate(zip(places, sizes, need, strict=False)):
        y, x = k // across * ph, k % across * pw
        raw = decompress(data[place : place + size], how, n * kind.itemsize)
        part = np.frombuffer(raw, kind, n).reshape(-1, pw, samples).astype(out.dtype)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=out.dtype)
        cut = part[: h - y, : w - x]
        out[y : y + cut.shape[0], x : x + cut.shape[1]] = cut
    return out


def decode(data: bytes) -> Iterator[tuple[int, dict[int, list[int]], np.ndarray | None, str | None]]:
    """(page, fields, samples, error) of each page; the first broken directory ends the file."""
    page = 0
    try:
        for order, fields in directories(data):
            try:
                image, error = decode_page(data, order, fields), None
            except BROKEN as e:
                image, error = None, f"{type(e).__name__}: {e}"[:200]
            yield page, fields, image, error
            page += 1
    except BROKEN as e:
        yield page, {}, None, f"{type(e).__name__}: {e}"[:200]


def feature(image: np.ndarray) -> str:
    """Size, mean and spread in thousandths, distinct samples and an 8 by 8 difference hash."""
    grid = image.reshape(image.shape[0], -1)
    total, square, n = int(grid.sum(dtype=np.uint64)), int((grid.astype(np.uint32) ** 2).sum(dtype=np.uint64)), grid.size
    mean = total * 1000 // max(n, 1)
    variance = (square * n - total * total) * 1000 // max(n * n, 1)
    rows, columns = np.linspace(0, grid.shape[0], 9).astype(int)[:8], np.linspace(0, grid.shape[1], 10).astype(int)[:9]
    small = np.add.reduceat(np.add.reduceat(grid.astype(np.uint64), rows, axis=0), columns, axis=1) if n else np.zeros((8, 9), np.uint64)
    bits = (small[:, 1:] > small[:, :-1]).reshape(-1)
    return f"{grid.shape[1]}x{grid.shape[0]};mean={mean};var={variance};levels={len(np.unique(grid)) if grid.itemsize > 1 else int((np.bincount(grid.reshape(-1), minlength=256) > 0).sum())};dhash={np.packbits(bits).tobytes().hex()}"


PAGE = {"page": pa.int32(), "width": pa.int64(), "height": pa.int64(), "samples": pa.int64(), "bits": pa.int64(), "compression": pa.int64(), "feature": pa.string(), "pixels": pa.binary(), "error": pa.string()}


def pages(files: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """One row per page of the TIFF files in ``content``: ``keep``, page, width, height,
    samples, bits, compression, feature, pixels (binary) and error, a file's pages in turn."""
    rows = files.select(*[c for c in keep or [] if c.lower() not in PAGE], F.col(content))
    kinds = "page int, width bigint, height bigint, samples bigint, bits bigint, compression bigint, feature string, pixels binary, error string"
    schema = ", ".join([f"`{n}` {t}" for n, t in rows.dtypes[:-1]] + [kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, of, made, size = batch.select(list(range(batch.num_columns - 1))), [], [], 0

            def flush(kept=kept) -> pa.RecordBatch:
                columns = kept.take(pa.array(of, pa.int32())).columns if kept.num_columns else []
                new = [pa.array(v, t) for v, t in zip(zip(*made, strict=True), PAGE.values(), strict=True)]
                return pa.RecordBatch.from_arrays([*columns, *new], [*kept.schema.names, *PAGE])

            for k in range(batch.num_rows):
                data = batch.column(batch.num_columns - 1)[k].as_py()
                for page, fields, image, error in decode(data) if data else ():
                    one = lambda tag, least=None: (fields.get(tag) or [least])[0]  # noqa: B023, E731
                    pixels = None if image is None else image.tobytes()
                    of.append(k)
                    made.append((page, one(256), one(257), one(277, 1), one(258), one(259, 1), None if image is None else feature(image), pixels, error))
                    size += len(pixels or b"")
                    if size >= BATCH_BYTES:
                        yield flush()
                        of, made, size = [], [], 0
            if made:
                yield flush()
        trim()

    return rows.mapInArrow(run, schema)


def payload(text: str) -> bytes:
    """UTF-8 and bytes 0 up to a positive multiple of ``WIDTH``."""
    raw = text.encode()
    return raw + b"\0" * (WIDTH - len(raw) % WIDTH if not raw or len(raw) % WIDTH else 0)


def stored(raw: bytes) -> bytes:
    """A payload as a TIFF file of 64 columns; its checksum chooses how."""
    grid, by = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH), zlib.crc32(raw)
    parts = min(len(grid), 1 + (by >> 8) % MOST_PAGES)
    return encode(np.array_split(grid, parts), "<>"[by >> 3 & 1], how=STORED_AS[by & 7], predictor=2 if by >> 4 & 3 == 0 else 1, tile=TILE if by >> 6 & 3 == 0 else 0)


def store(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): the payload as a TIFF of 64 columns."""
    schema = "doc_id bigint, n_bytes bigint, content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(1).to_pylist()
            sizes, files = pa.array([len(t.encode()) for t in found], pa.int64()), pa.array([stored(payload(t)) for t in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), sizes, files], ["doc_id", "n_bytes", "content"])
        trim()

    return docs.mapInArrow(run, schema)


def digest(files: DataFrame) -> DataFrame:
    """Per file of :func:`store`: digests of the samples read back from its pages, and its own."""
    named = files.select("doc_id", "n_bytes", F.length("content").cast("long").alias("media_bytes"), F.sha2("content", 256).alias("media_sha256"), "content")
    read = pages(named, keep=["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, pages int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
        now, rows = None, []

        def close() -> None:
            whole, (doc_id, n_bytes, media_bytes, media_sha256) = now["hash"], now["own"]
            rows.append((doc_id, n_bytes, now["n"], whole.hexdigest(), zlib.crc32(now["tail"]), media_bytes, media_sha256, "|".join(now["features"]), len(now["features"])))

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        # The pages of a file follow one another, from page 0 on, in the partition in which it was read.
        for batch in batches:
            for row in batch.to_pylist():
                if row["error"]:
                    raise ValueError(row["error"])
                if row["page"] == 0:
                    if now:
                        close()
                    now = {"hash": hashlib.sha256(), "n": 0, "tail": b"", "features": [], "own": (row["doc_id"], row["n_bytes"], row["media_bytes"], row["media_sha256"])}
                pixels = row["pixels"]
                now["hash"].update(pixels)
                now["n"] += len(pixels)
                now["tail"] = (now["tail"] + pixels[-64:])[-64:]
                now["features"].append(row["feature"])
            if rows:
                yield flush()
                rows.clear()
        if now:
            close()
            yield flush()

    return read.mapInArrow(run, schema)


def op3(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` stored as TIFF pages and read back by the page walker."""
    return digest(store(texts(documents(spark, sf_dir))))
