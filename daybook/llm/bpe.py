"""Byte-level BPE: exact encoding by backtracking over longest matches, and decoding.

The vocabulary's byte strings are mapped to Latin-1 text, one character a byte,
and put in an Aho-Corasick automaton. One pass over a piece gives the longest
token at each position. The encoder takes the longest token and, where it can't
stand beside the token before it, the next shorter one; positions from which no
valid encoding continues are marked, so each is left once and the work is linear
in the piece. Two tokens may stand side by side if merging by rank would never
have joined bytes across their border; these answers are memoised.

Whole texts are encoded. Where the split pattern is ``SPLITS_AT_SPACE``, a text is cut at
white space into segments that it never crosses, so that equal segments are encoded
once a worker; for any other pattern a segment is a match of the pattern on the whole
text. Both memos are bounded in bytes and halve when full, which changes no result.

Defined cases: a null text is an empty text; an empty text has no tokens (the
hashes are those of no bytes); repeated rows give repeated rows; a null id stays
null; an empty table gives an empty table; other columns are ignored by
:func:`encode` unless named in ``keep``, where a name that is also a result's is left out.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from sys import getsizeof

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fresh, held, trim

#: Unicode White_Space, which is what ``\s`` means in the split pattern.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: a pattern whose matches never hold white space followed by something else, but for one leading space.
SPLITS_AT_SPACE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO_BYTES = 96 << 20
MEMO_CHARS = 32
PAIR_ENTRIES = 600_000
#: Behind a letter and before white space, each is a match of its own of ``SPLITS_AT_SPACE``.
TRAIL = frozenset(",.;:!?")


def load_ranks(path: str) -> dict[bytes, int]:
    """Reads a rank file: base64 of the token's bytes, then its id, a line each."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Memo:
    """Answers by key, bounded in bytes: a young and an old half. A full young half becomes the
    old one, so what is asked often stays."""

    #: Of an entry in a dictionary, besides its key and value.
    SLOT = 60

    def __init__(self, most: int):
        self.most, self.young, self.old, self.size = most // 2, {}, {}, 0
        self.get = self.young.get

    def older(self, key):
        """The answer of the old half, if there is one; for keys that the young half lacks."""
        return self.old.get(key)

    def put(self, key, value) -> None:
        self.size += getsizeof(key) + getsizeof(value) + self.SLOT
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {}, 0
            self.get = self.young.get
        self.young[key] = value


class ByteBPE:
    """Encoder and decoder of one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks single bytes, first {missing[0]}")
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.length = [len(x) for x in self.bytes_of]
        # halves[i]: the two tokens whose merge makes token i; a single byte is its own half.
        self.halves: list[tuple[int, int] | None] = [None] * size
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            if half := self._halves(token, i):
                self.halves[i] = half
                self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [-1] * size
        for token, i in ranks.items():
            for n in range(len(token) - 1, 0, -1):
                j = ranks.get(token[:n], -1)
                if j >= 0 and self.halves[j]:
                    self.shorter[i] = j
                    break
        self.pairs: dict[int, bool] = {}
        self.memo = Memo(MEMO_BYTES)
        # Sets within sets: version 1 of the expressions, so both also stand inside brackets.
        spelled = pattern.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
        whole = regex.compile(spelled, regex.V1)
        self.pieces = (lambda text: [m[0] for m in whole.finditer(text)]) if whole.groups else whole.findall
        at_space = regex.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]").findall
        self.segments, self.alone = (at_space, False) if pattern == SPLITS_AT_SPACE else (self.pieces, True)

    def _halves(self, token: bytes, i: int) -> tuple[int, int] | None:
        """The last merge that makes the token, or None if merging by rank never makes it."""
        if len(token) == 1:
            return i, i
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
            if rank == 1 << 60:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves this border between the two tokens."""
        pair = left << 32 | right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs.clear()
            known = self.pairs[pair] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        # Undo merges from the latest back: at each moment in that history the two
        # tokens that touch the border must have no merge earlier than the next one done.
        limit = 1 << 60
        while True:
            if self.ranks.get(self.bytes_of[left] + self.bytes_of[right], 1 << 60) < limit:
                return False
            open_left, open_right = self.length[left] > 1, self.length[right] > 1
            if open_left and (left > right or not open_right):
                limit, left = left, self.halves[left][1]
            elif open_right:
                # Of two merges with one rank the left one is done first.
                limit, right = right + 1, self.halves[right][0]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """The tokens of one match of the split pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, length, shorter, compatible = len(piece), self.length, self.shorter, self.compatible
        longest = [0] * n
        for end, i in self.automaton.iter(piece.decode("latin-1")):
            longest[end - length[i] + 1] = i  # later ends are longer
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0] if n else -1
        while at < n:
            while token >= 0 and (dead[at + length[token]] or (out and not compatible(out[-1], token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                if not out:
                    raise ValueError("no encoding by merges exists; the ranks are inconsistent")
                dead[at] = 1
                token = out.pop()
                at -= length[token]
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        out = []
        get = self.memo.get
        for segment in self.segments(text):
            ids = get(segment)
            if ids is None:
                ids = self._segment(segment)
                get = self.memo.get
            out.append(ids)
        return b"".join(out)

    def _segment(self, segment: str) -> bytes:
        ids = self.memo.older(segment)
        if ids is None and not self.alone and segment[-1] in TRAIL and segment[-2:-1].isascii() and segment[-2:-1].isalpha():
            ids, rest = self.memo.get(segment[:-1]), self.encode(segment[-1])
            if ids is None:
                return self._segment(segment[:-1]) + rest  # not kept yet: its parts are
            ids += rest
        if ids is None:
            pieces = [segment] if self.alone else self.pieces(segment)
            tokens = [i for piece in pieces for i in self.encode_piece(piece.encode())]
            ids = struct.pack(f"<{len(tokens)}I", *tokens)
        if len(segment) <= MEMO_CHARS:
            self.memo.put(segment, ids)
        return ids

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids that are packed as :meth:`encode` gives them."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(path: str, pattern: str) -> ByteBPE:
    """The vocabulary at ``path``, built once a worker and kept until another stage wants something else."""
    return held(("bpe", path, pattern), lambda: ByteBPE(load_ranks(path), pattern))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: the id, ``keep``, n_tokens, ids (binary, little-endian
    unsigned 32-bit; only ``with_ids``), ids_sha256 and decoded_sha256 (of the decoded bytes).

    A map without a shuffle; a task holds one Arrow batch.
    """
    made_up = ["n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"]
    # A kept column of a name that is made here, or that is the id, isn't kept twice.
    keep = [c for c in keep or [] if c.lower() not in (*made_up, id_col.lower())]
    rows = docs.select(F.col(id_col), *keep, F.coalesce(F.col(text_col), F.lit("")).alias(fresh(docs, "text")))
    schema = ", ".join([f"`{n}` {t}" for n, t in rows.dtypes[:-1]] + ["n_tokens bigint", *["ids binary"] * with_ids, "ids_sha256 string", "decoded_sha256 string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            made = [pa.array([len(x) // 4 for x in ids], pa.int64())]
            if with_ids:
                made.append(pa.array(ids, pa.binary()))
            made.append(pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()))
            made.append(pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], *made_up])
        trim()

    return rows.mapInArrow(run, schema)


def op7(spark, sf_dir: str) -> DataFrame:
    """``documents`` by the multilingual byte-level ranks, encoded and decoded."""
    import public_tokenizers

    return encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
