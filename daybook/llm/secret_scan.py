"""Secrets: fixed rules, and novelty under a dictionary-primed zstandard compressor.

Base spans (assign, access, hex) are found by fixed rules and always stay. A
further candidate is a string of ``MIN_CHARS`` or more token characters, in quotes also of symbols, that stands within ``REACH`` characters before or after a sensitive
word and touches no base span. It is measured unless it is made as words, names and counts are: letters alone,
under ``MIN_LETTERS`` or seldom changing case, under ``MIN_DIGITS`` digits alone, a part of a mail address, or an address's host. The name that holds the
word (``TOKEN_PROD``, ``password2``) is skipped, and ``=`` parts a name from its value. Its novelty is the
marginal cost: the compressed size of its surroundings with it, less that of the
surroundings alone, by a compressor primed with a dictionary of identifiers; the mean
over ``AROUND``'s reaches of surroundings, since one alone jumps with the
compressor's choice of how to write literals. What code and prose repeat costs few
bytes; a random key can't be compressed. A candidate that costs ``MIN_BITS`` or more
bits a character is reported as ``novel``.

Defined cases: a null text is an empty text and has no spans; a null id stays
null; repeated rows give repeated rows; an empty table gives an empty table;
:func:`scan` ignores other columns.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import documents, held, texts, trim

KINDS = ("assign", "access", "hex", "novel")
MIN_CHARS = 10
MIN_DIGITS = 18
MIN_LETTERS = 16
#: Letters alone are measured if so many in a hundred neighbours differ in case.
CASE_PERCENT = 30
MIN_BITS = 6.2
REACH = 32
AROUND = (32, 96, 160, 256)
LEVEL = 3

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
SENSITIVE_WORDS = ("pass", "secret", "token", "key", "auth", "bearer", "credential", "private", "signature", "pwd", "salt")
SENSITIVE = re.compile(r"pass(?:word|wd|phrase)?|secret|token|\bkey|key\b|api_?key|_key|key_|(?-i:(?<=[a-z0-9])Key(?![a-z]))|auth|bearer|credential|private|signature|\bpwd|\bsalt\b", re.I | re.A)
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % MIN_CHARS)
QUOTED = re.compile(r"""(["'`])([A-Za-z0-9+/_=.!@#$%%^&*-]{%d,128})\1""" % MIN_CHARS)
VALUE = re.compile(r"[A-Za-z0-9+/_.-]+(?:=+(?![A-Za-z0-9+/_.-]))?")
NAME = re.compile(r"[A-Za-z0-9_]+")
#: What code and configuration are full of; a candidate made of these costs little.
IDENTIFIERS = """abstract access account action address algorithm amount append application argument array async attribute authorization await boolean break buffer builder bytes cache callback category certificate channel character class client collection column command comment component config configuration connection constant constructor container content context control controller cookie count create credential current database dataset date debug decode decrypt default define delete dependency description destination development directory document domain double element email enable encode encrypt endpoint entity entry environment error event example exception execute export expression extension factory false feature field file filter final float folder format function gateway generate group handler hash header helper host html http https identifier image implement import include index input insert instance integer interface internal item iterator json keyword label language length library list listener local location login logger manager mapping master match memory message metadata method model module monitor name namespace network number object operation option output package page parameter parent parse password path pattern payload permission pipeline pointer policy port prefix primary private process production project property protocol provider proxy public query queue random range record reference register release remote remove replace repository request require resource response result return role route row schema scope script search secret secure select sequence server service session setting signature size source stack start state static status storage stream string struct style submit suffix switch system table target template test text thread timeout timestamp title token total transaction transform true type undefined unique update upload user username utility validate value variable vector verify version view warning window worker wrapper""".split()


@lru_cache(maxsize=1)
def compressor() -> zstandard.ZstdCompressor:
    words = [w for x in IDENTIFIERS for w in (x, x.capitalize(), x.upper())]
    primed = zstandard.ZstdCompressionDict(" ".join([*words, "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"]).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)


def novelty(text: str, start: int, end: int) -> float:
    """Marginal compressed bits a character of ``text[start:end]`` in its surroundings, without copies of itself there."""
    value, packed, cost = text[start:end], compressor(), 0
    for reach in AROUND:
        before, after = text[max(0, start - reach) : start].replace(value, ""), text[end : end + reach].replace(value, "")
        cost += len(packed.compress((before + value + after).encode())) - len(packed.compress((before + after).encode()))
    return 8 * cost / len(AROUND) / (end - start)


def measured(text: str, start: int, end: int) -> bool:
    """Whether the string could be a key by its make; novelty decides then."""
    value = text[start:end]
    if len(value) < MIN_CHARS or value.startswith("//") or text[start - 1 : start] == "@" or text[end : end + 1] == "@" or text[max(0, start - 3) : start] == "://":
        return False
    digits, letters = sum(x.isdigit() for x in value), [x for x in value if x.isalpha()]
    if not letters:
        return digits >= MIN_DIGITS
    if digits:
        return True
    return len(value) >= MIN_LETTERS and 100 * sum(a.isupper() != b.isupper() for a, b in zip(letters, letters[1:], strict=False)) >= CASE_PERCENT * len(letters)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules, sorted."""
    out = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def pieces(text: str, start: int, end: int, words: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of a run of token characters: what ``=`` parts, and what is left of such a part without the names that hold ``words``."""
    k = 0
    for m in VALUE.finditer(text, start, end):
        yield m.span()
        at = m.start()
        for name in NAME.finditer(text, m.start(), m.end()):
            while k < len(words) and words[k][1] <= name.start():
                k += 1
            if k < len(words) and words[k][0] < name.end():
                yield at, name.start()
                at = name.end()
        if at > m.start():
            yield at, m.end()


def novel_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Incompressible strings in sensitive context that touch no base span."""
    lower = text.lower()
    if not any(w in lower for w in SENSITIVE_WORDS):
        return []
    words = [m.span() for m in SENSITIVE.finditer(text)]
    starts, ends = [s for s, _ in words], [e for _, e in words]
    fixed = sorted((s, e) for s, _, e in base)
    reach, far = [], 0
    for _, e in fixed:
        far = max(far, e)
        reach.append(far)

    def near(s: int, e: int) -> bool:
        # A word that lies inside the string itself says nothing about it.
        before, after = bisect.bisect_right(ends, s) - 1, bisect.bisect_left(starts, e)
        return (before >= 0 and s - ends[before] <= REACH) or (after < len(words) and starts[after] - e <= REACH)

    def novel(s: int, e: int) -> bool:
        if not measured(text, s, e) or not near(s, e):
            return False
        k = bisect.bisect_left(fixed, (e, -1))
        return not (k and reach[k - 1] > s) and novelty(text, s, e) >= MIN_BITS

    out = []
    for m in RUN.finditer(text):
        s, e = m.span()
        inside = words[bisect.bisect_right(ends, s) : bisect.bisect_left(starts, e)]
        if not inside and not near(s, e):
            continue
        at = s
        for a, b in [*pieces(text, s, e, inside), (s, e)]:
            while a < b and text[a] in "=-":
                a += 1
            if a >= at and novel(a, b):
                out.append((a, 3, b))
                at = b
    taken = [(s, e) for s, _, e in out]
    for m in QUOTED.finditer(text):
        s, e = m.span(2)
        k = bisect.bisect_left(taken, (e, -1))
        if not (k and taken[k - 1][1] > s) and not RUN.fullmatch(text, s, e) and novel(s, e):
            out.append((s, 3, e))
    return out


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those with the added ones."""
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base))


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with each secret, or overlapping group of them, replaced by a mark."""
    if not text:
        return text
    out, at = [], 0
    for s, _, e in spans(text)[1]:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def scan(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): counts by kind, the base digest, all spans and their number."""
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_novel bigint, n_spans bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held()
        for batch in batches:
            found = [spans(t) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(x[1] == k for x in every) for _, every in found], pa.int64()) for k in range(4)]
            shas = pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in found], pa.string())
            sizes = pa.array([len(x) for _, x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *counts[:3], shas, pa.array([listed(x) for _, x in found], pa.string()), counts[3], sizes], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel", "n_spans"])
        trim()

    return docs.mapInArrow(run, schema)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with secrets replaced in ``text_col``; a null text stays null."""
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held()
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([redact(t) for t in columns[at].to_pylist()], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        trim()

    return docs.mapInArrow(run, schema)


def op4(spark, sf_dir: str) -> DataFrame:
    """Secrets in every text of ``documents``."""
    return scan(texts(documents(spark, sf_dir)))
