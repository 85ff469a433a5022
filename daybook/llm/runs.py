"""Periodic runs of words by Crochemore's partition refinement.

Words are numbered from 0. Positions whose factors of length l are equal form a class. Classes
start from equal words (l = 1) and are refined length by length: a class splits by the classes of
the positions behind its own, and of a class's parts only the smaller ones are looked at again
(the smaller-half strategy), so a position is moved at most log n times. A class keeps its positions
linked in order. Two neighbours of a class at a distance that equals the length are a square with
a primitive root; squares of one period at consecutive positions are one run.

A run with exponent ``exponent`` or more leaves at least ``exponent - 1`` members in each of its classes, so smaller
classes are dropped on the way, and a text is left once the length passes its words over ``exponent``.
Both lose nothing. An Arrow batch of texts is refined at once, each level in a few array
operations over the moved positions alone; texts never share a class. A task holds one batch.

Defined cases: a null, empty or blank text has no word and no run; each row is judged by itself, so ties, repeated
rows and null ids need no rule; an empty table gives an empty table; other columns are ignored unless they are kept.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, fresh, trim
from .line_quality import let

EXPONENT = 4
LEAST = 6
SPACE = " \t\n\x0b\x0c\r"
SPACES = "[ \\t\\n\\x0B\\f\\r]+"
NONE = -1


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``starts``, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Partition:
    """Classes of equal factors. A class is named by where its members begin in ``member``; ``of`` gives
    a position's class, or ``NONE`` once it is in a class too small for any run."""

    def __init__(self, codes: np.ndarray, limit: np.ndarray, need: int):
        """``codes`` by position (negative: a border between texts); ``limit``: the longest period to look for."""
        n = len(codes)
        self.need, self.limit, self.level = need, limit, 1
        self.of = np.full(n, NONE, np.int64)
        self.next, self.last = np.full(n, NONE, np.int64), np.full(n, NONE, np.int64)
        self.size, self.slot, self.moving = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        self.pairs: dict[int, list[np.ndarray]] = defaultdict(list)
        at = np.argsort(codes, kind="stable")
        at = at[np.searchsorted(codes[at], 0) :]
        new = np.diff(codes[at], prepend=-1) != 0
        first = np.flatnonzero(new)
        sizes = np.diff(first, append=len(at))
        live = np.repeat((sizes >= need), sizes) & (limit[at] >= 1)
        at, new = at[live], new[live]
        self.member = at.copy()
        first = np.flatnonzero(new)
        self._settle(at, first, np.diff(first, append=len(at)), first)
        self.small, gone = at, np.ones(n, bool)  # at first every class is looked at, and so is every position that is in none
        gone[at] = False
        self.gone = np.flatnonzero(gone)

    def _settle(self, at: np.ndarray, first: np.ndarray, sizes: np.ndarray, start: np.ndarray) -> None:
        """Makes classes of consecutive groups of ``at``, ascending within a group; ``start``: their places in ``member``."""
        self.size[start] = sizes
        self.of[at] = np.repeat(start, sizes)
        self.slot[at] = spread(start, sizes)
        inner = np.ones(len(at), bool)
        inner[first] = False
        k = np.flatnonzero(inner)
        self.last[at[first]], self.next[at[first + sizes - 1]] = NONE, NONE
        self.last[at[k]], self.next[at[k - 1]] = at[k - 1], at[k]
        self._note(at[k - 1], at[k])

    def _note(self, a: np.ndarray, b: np.ndarray) -> None:
        """Remembers neighbours whose distance can still be a period."""
        gap = b - a
        use = (gap >= self.level) & (gap <= self.limit[a])
        a, gap = a[use], gap[use]
        if not len(a):
            return
        if len(a) > 1:
            order = np.argsort(gap, kind="stable")
            a, gap = a[order], gap[order]
        cut = np.flatnonzero(np.diff(gap)) + 1
        for g, some in zip(gap[np.concatenate(([0], cut))].tolist(), np.split(a, cut), strict=True):
            self.pairs[g].append(some)

    def squares(self) -> np.ndarray:
        """Where squares of the present length begin, ascending."""
        found = self.pairs.pop(self.level, None)
        if found is None:
            return np.zeros(0, np.int64)
        a = np.unique(np.concatenate(found))
        return a[(self.of[a] != NONE) & (self.next[a] - a == self.level)]

    def refine(self) -> bool:
        """Goes to the next length; False if nothing is left to look at."""
        before, tag = np.concatenate((self.gone, self.small)) - 1, np.concatenate((np.full(len(self.gone), NONE), self.of[self.small]))
        self.level += 1
        ok = (before >= 0) & (self.of[before] != NONE) & (self.limit[before] >= self.level)
        at, tag = before[ok], tag[ok]
        if not len(at):
            self.small = self.gone = at
            return False
        cls = self.of[at]
        order = np.lexsort((at, tag, cls))
        at, tag, cls = at[order], tag[order], cls[order]
        group = np.flatnonzero(np.concatenate(([True], (np.diff(cls) != 0) | (np.diff(tag) != 0))))
        # A class that moves as a whole behind one class isn't split.
        sizes = np.diff(group, append=len(at))
        whole = (sizes == self.size[cls[group]]) & (tag[group] != NONE)
        if whole.any():
            stay = np.repeat(~whole, sizes)
            at, tag, cls, sizes, whole = at[stay], tag[stay], cls[stay], sizes[~whole], None
            if not len(at):
                self.small = self.gone = at
                return False
            group = np.cumsum(sizes) - sizes
        parent = cls[group]
        fam = np.flatnonzero(np.concatenate(([True], np.diff(parent) != 0)))
        start = parent[fam]
        moved = np.add.reduceat(sizes, fam)
        left = self.size[start] - moved
        self._unlink(at, cls)
        tail = spread(start + left, moved)
        self._to_the_tail(at, tail, np.repeat(start + left, moved))
        live = (sizes >= self.need) & (tag[group] != NONE)
        self.of[at] = NONE
        self.size[start] = left
        keep = np.repeat(live, sizes)
        kept = at[keep]
        if len(kept):
            first = np.cumsum(sizes[live]) - sizes[live]
            self._settle(kept, first, sizes[live], tail[group[live]])
        gone = [at[~keep]]
        die = (left > 0) & (left < self.need)
        if die.any():
            rest = self.member[spread(start[die], left[die])]
            self.of[rest] = NONE
            gone.append(rest)
        # The largest live part of each class isn't looked at again.
        weight = np.where(live, sizes, 0)
        best = np.maximum.reduceat(weight, fam)
        stays = (left >= self.need) & (left >= best)
        own = np.repeat(np.arange(len(fam)), np.diff(fam, append=len(group)))
        top = live & (weight == best[own])
        at_top = np.flatnonzero(top)
        once = at_top[np.unique(own[at_top], return_index=True)[1]]
        largest = np.zeros(len(group), bool)
        largest[once] = ~stays[own[once]]
        small = [at[np.repeat(live & ~largest, sizes)]]
        listed = (left >= self.need) & ~stays
        if listed.any():
            small.append(self.member[spread(start[listed], left[listed])])
        self.gone, self.small = np.concatenate(gone), np.concatenate(small)
        return True

    def _unlink(self, at: np.ndarray, cls: np.ndarray) -> None:
        """Takes positions out of their classes' links: each chain of them is bridged."""
        self.moving[at] = True
        p, q = self.last[at], self.next[at]
        head, foot = (p == NONE) | ~self.moving[p], (q == NONE) | ~self.moving[q]

        def ordered(some: np.ndarray) -> np.ndarray:
            k = np.flatnonzero(some)
            return k[np.lexsort((at[k], cls[k]))]

        a, b = p[ordered(head)], q[ordered(foot)]
        left, right = a != NONE, b != NONE
        self.next[a[left]] = b[left]
        self.last[b[right]] = a[right]
        both = left & right
        self._note(a[both], b[both])

    def _to_the_tail(self, at: np.ndarray, tail: np.ndarray, border: np.ndarray) -> None:
        """Puts moved members behind those of their class that stay."""
        stay = self.member[tail]
        stay = stay[~self.moving[stay]]
        free = self.slot[at]
        free = free[free < border]
        self.member[free], self.slot[stay] = stay, free
        self.member[tail], self.slot[at] = at, tail
        self.moving[at] = False


def runs_of(codes: np.ndarray, lengths: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """Runs of several sequences that lie one after the other: (sequence, start, length, period), sorted by these but for the length.

    ``codes``: words as numbers from 0. A run has length ``exponent`` periods and ``least`` words or more.
    """
    if exponent < 2:
        raise ValueError("a run has at least two periods")
    lengths = np.asarray(lengths, np.int64)
    k = np.arange(len(lengths))
    begin = np.cumsum(lengths) - lengths + k  # a border stands behind each sequence
    n = int(lengths.sum()) + len(lengths)
    own = np.repeat(k, lengths + 1)
    keyed = np.full(n, -1, np.int64)
    inside = np.ones(n, bool)
    inside[begin + lengths] = False
    keyed[inside] = own[inside] * (int(codes.max(initial=0)) + 1) + codes
    limit = lengths[own] // exponent
    part = Partition(keyed, limit, max(2, exponent - 1))
    out = []
    for level in range(1, int(limit.max(initial=0)) + 1):
        at = part.squares()
        if len(at):
            cut = np.flatnonzero(np.diff(at) != 1) + 1
            first, end = at[np.concatenate(([0], cut))], at[np.concatenate((cut - 1, [len(at) - 1]))]
            length = end - first + 2 * level
            ok = length >= max(least, exponent * level)
            out.append((first[ok], length[ok], np.full(int(ok.sum()), level)))
        if not part.refine():
            break
    start, length, period = (np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else [()] * 3))
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    text = own[start]
    return text, start - begin[text], length, period


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split()


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT, least: int = LEAST, keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: the id, ``keep``, n_words, runs (start, length, period; by start, then period) and
    collapsed: the words, joined by a space, without those that a run repeats (all but its first period).

    A map without a shuffle.
    """
    made_up = ("n_words", "runs", "collapsed")
    keep = [c for c in keep or [] if c.lower() not in (*made_up, id_col.lower())]
    rows = docs.select(F.col(id_col), *keep, F.coalesce(F.col(text_col), F.lit("")).alias(fresh(docs, "text")))
    run = "struct<start:bigint,length:bigint,period:bigint>"
    schema = ", ".join([f"`{n}` {t}" for n, t in rows.dtypes[:-1]] + ["n_words bigint", f"runs array<{run}>", "collapsed string"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [words_of(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            number: dict[bytes, int] = {}
            codes = np.fromiter((number.setdefault(w, len(number)) for words in texts for w in words), np.int64)
            lengths = np.array([len(words) for words in texts], np.int64)
            text, start, length, period = runs_of(codes, lengths, exponent, least)
            kept = np.ones(len(codes) + 1, np.int64)
            if len(text):
                at = (np.cumsum(lengths) - lengths)[text] + start
                edge = np.zeros(len(codes) + 1, np.int64)
                np.add.at(edge, at + period, 1)
                np.add.at(edge, at + length, -1)
                kept = np.cumsum(edge) == 0
            joined, at = [], 0
            for words in texts:
                own = kept[at : at + len(words)]
                joined.append(b" ".join(words if own.all() else [w for w, ok in zip(words, own.tolist(), strict=True) if ok]).decode("utf-8", "surrogatepass"))
                at += len(words)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(texts))))).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lengths), found, pa.array(joined, pa.string())], [*batch.schema.names[:-1], *made_up])
        trim()

    return rows.mapInArrow(find, schema)


def repeating(id_: Column, text: Column) -> Column:
    """One text in ten, by the crc32 of its id, with a passage to its end that repeats: what the query is asked
    to look into. Without an id a text stays as it is."""
    h = F.crc32(id_.cast("string").cast("binary"))
    g = F.floor(h / 10)
    inner = F.btrim(text, F.lit(SPACE))

    def again(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        place = F.struct(n.alias("n"), a.alias("a"), (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).alias("p"))
        return let(place, lambda x: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), x["n"] - 1), lambda i: F.get(words, F.when(i < x["a"], i).otherwise(x["a"] + F.pmod(i - x["a"], x["p"])).cast("int"))), " "))

    return F.when((F.pmod(h, F.lit(10)) == 0) & (inner != ""), let(F.split(inner, SPACES), again)).otherwise(text)


def op12(spark, sf_dir: str) -> DataFrame:
    """The runs of every document, as numbers and digests."""
    docs = documents(spark, sf_dir)
    text = F.coalesce("text", F.lit(""))
    found = find_runs(docs.select("doc_id", repeating(F.col("doc_id"), text).alias("text")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    # The ratios are compared as fractions; runs come by start, then period, and an equal one doesn't replace the first.
    best = F.reduce(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)), lambda x, r: F.when(r["length"] * x["period"] > x["length"] * r["period"], r).otherwise(x))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
-- crc32 of the decimal id, eight bit steps a character
h AS (SELECT r, doc_id, ws, len(ws)::BIGINT AS n, CASE WHEN doc_id IS NOT NULL THEN xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda acc, b: xor(xor(acc, b) >> 1, 3988292384 * (xor(acc, b) & 1)))) END AS h FROM d),
q AS (SELECT *, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p FROM h WHERE n > 0),
w AS (SELECT r, CASE WHEN h % 10 = 0 THEN list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE ws END AS ws, n FROM q),
tok AS (SELECT r, n, i, ws[i + 1] AS word FROM (SELECT r, n, ws, unnest(range(0, n)) AS i FROM w)),
-- equal words at distance p, in stretches; a stretch of m of them from s is a period p from s to s + m + p
eq AS (SELECT x.r, x.i, y.i - x.i AS p FROM tok x JOIN tok y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4),
st AS (SELECT r, p, min(i) AS start, count(*) + p AS length FROM (SELECT r, i, p, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS g FROM eq) GROUP BY r, p, g HAVING count(*) >= 3 * p),
run AS (SELECT r, start, length, min(p) AS period FROM st WHERE length >= greatest(6, 4 * p) GROUP BY r, start, length),
text_runs AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM run GROUP BY r),
best AS (SELECT r, start, length, period FROM run QUALIFY row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) = 1),
cut AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run),
col AS (SELECT tok.r, string_agg(word, ' ' ORDER BY tok.i) AS collapsed FROM tok LEFT JOIN cut ON cut.r = tok.r AND cut.i = tok.i WHERE cut.i IS NULL GROUP BY tok.r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256, len(d.ws)::BIGINT AS n_words
FROM d LEFT JOIN text_runs USING (r) LEFT JOIN best USING (r) LEFT JOIN col USING (r)
"""
