"""Mixing sources to target weights by a Pfair schedule, in DataFrame functions alone up to ``FOLDED`` sources.

A source's documents are numbered and cut into blocks of ``BLOCK_DOCS``. Among the
active sources, a source of target weight w (integer weights over their sum K) must
run its block j in the window from floor(j / w) to ceil((j + 1) / w); each time slot
goes to the released block with the earliest deadline (ties: the source that sorts
first). Every block then meets its window, so a source's blocks never deviate from
its target by a whole block. The schedule repeats every K slots, and K depends on the
weights alone; so one period is simulated, by a fold over K slots on one row a corpus,
and block j's slot follows by arithmetic. When a source's next block is due but it has
none left, a new phase starts there with the remaining sources and renormalised
weights; within each phase the deviation is again less than a block. No row is lost
or repeated.

Default weights are proportional to the square root of a source's documents, in
integers of at least 1, rounded down from shares of ``SLOTS_A_SOURCE`` slots a source,
``SLOTS`` at least, so weights stay in proportion for any number of sources. Explicit
integer weights can be given.

Numbering: rows get one of ``BUCKETS`` hash buckets of their id, a source's buckets are
numbered in turn, and rows within (source, bucket) by id; so a source with a third of
all rows is spread over ``BUCKETS`` groups. The schedule is a table with one row a source
and phase. Sources are counted first. Up to ``FOLDED`` of them it is folded in Spark and
broadcast. Beyond, the driver runs the same rule with heaps, over one row a source and never
more slots than there are blocks; the schedule is then spread to one row a block and joined
by (source, block), which needs no broadcast and splits a large source.

Defined cases: a null source is a source of its own, sorted first; rows with a null id are
spread over buckets by their row number; repeated rows are numbered apart; an empty
table gives an empty table; texts aren't read; :func:`mixed` keeps all columns, also
those whose names clash with this module's.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, fresh, materialise

BLOCK_DOCS = 16
SLOTS = 360
BUCKETS = 4096
SLOTS_A_SOURCE = 16
FOLDED = 64
#: Rows of a long schedule that the driver holds unpacked.
PACKED = 50_000

#: One row (names, k, m: arrays by source; weights and blocks) to one row a phase.
#: p.kk: weights of the phase's active sources, else 0; p.period: their sum;
#: p.order: the source of each slot of a period; p.base, p.used: blocks before and in it.
PLAN = """
aggregate(
  sequence(1, size(k)),
  named_struct('rem', m, 'start', 0L, 'phases', cast(array() as array<struct<start:bigint,period:bigint,kk:array<bigint>,order:array<int>,base:array<bigint>,used:array<bigint>>>)),
  (s, step) -> if(array_max(s.rem) = 0, s,
    transform(array(zip_with(k, s.rem, (a, b) -> if(b > 0, a, 0L))), kk ->
    transform(array(aggregate(kk, 0L, (x, y) -> x + y)), period ->
    transform(array({edf}), pat ->
    transform(array(array_min(zip_with(kk, s.rem, (a, b) -> if(a > 0, b div a, null)))), rounds ->
    transform(array(zip_with(kk, s.rem, (a, b) -> if(a > 0, b - rounds * a, 0L))), rest ->
    transform(array(array_min(transform(sequence(0, size(k) - 1), i -> if(kk[i] > 0 and rest[i] < kk[i],
        element_at(filter(transform(pat, (x, t) -> if(x = i, t, null)), t -> t is not null), cast(rest[i] + 1 as int)), null)))), cut ->
    transform(array(transform(sequence(0, size(k) - 1), i -> rounds * kk[i] + size(filter(slice(pat, 1, cut), x -> x = i)))), used ->
      named_struct('rem', zip_with(s.rem, used, (a, b) -> a - b), 'start', s.start + rounds * period + cut,
        'phases', concat(s.phases, array(named_struct('start', s.start, 'period', period, 'kk', kk, 'order', pat, 'base', zip_with(m, s.rem, (a, b) -> a - b), 'used', used))))
    )[0])[0])[0])[0])[0])[0])[0]
  ),
  s -> s.phases)
"""
#: The source of each slot of one period by earliest deadline first.
EDF = """
aggregate(sequence(0L, period - 1), named_struct('a', transform(k, x -> 0L), 'pat', cast(array() as array<int>)),
  (z, t) -> transform(array(array_min(transform(sequence(0, size(k) - 1), i ->
      if(kk[i] > 0 and z.a[i] * period < (t + 1) * kk[i], named_struct('due', ((z.a[i] + 1) * period + kk[i] - 1) div kk[i], 'i', i), null))).i),
    best -> named_struct('a', transform(z.a, (x, j) -> if(j = best, x + 1, x)), 'pat', concat(z.pat, array(best))))[0],
  z -> z.pat)
"""


def numbered(docs: DataFrame, id_col: str, source_col: str, names: dict[str, str]) -> DataFrame:
    """Adds each row's number in its source, without gaps (``names['n']``)."""
    bucket, n, first, rows, key = (names[x] for x in ("bucket", "n", "first", "rows", "key"))
    hashed = F.conv(F.substring(F.md5(F.col(id_col).cast("string").cast("binary")), 1, 3), 16, 10).cast("int")
    spread = docs.withColumn(bucket, F.coalesce(hashed, F.pmod(F.monotonically_increasing_id(), F.lit(BUCKETS)).cast("int")))
    # A key that is never null: the window and the join then share one shuffle of the rows.
    spread = spread.withColumn(key, F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")))
    sizes = spread.groupBy(key, bucket).agg(F.count("*").alias(rows))
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(key, bucket, F.coalesce(F.sum(rows).over(before), F.lit(0)).alias(first))
    own = Window.partitionBy(key, bucket).orderBy(F.col(id_col).asc_nulls_first())
    ranked = spread.withColumn(n, F.row_number().over(own) - 1)
    return ranked.join(starts, [key, bucket]).withColumn(n, F.col(n) + F.col(first)).drop(first, bucket, key)


def phases_of(k: list[int], m: list[int]) -> Iterator[tuple[int, int, int, list[int], list[int], list[int], list[list[int]]]]:
    """What ``PLAN`` gives for weights ``k`` and blocks ``m``, a phase at a time: its number, start and period, and by
    source that runs in it: the source, blocks before, blocks in it, and its slots of a period as far as they are used.

    A phase of whole periods costs its sources and slots. One that ends within its first period costs its slots and one step a
    distinct weight: sources of one weight wait in a list, and only the first of them stands in the heap. So
    the cost is that of the blocks, also where very many sources end one by one.
    """
    rem, start, phase = list(m), 0, 0
    waiting: dict[int, list[int]] = {}
    for i, x in enumerate(rem):
        if x > 0:
            waiting.setdefault(k[i], []).append(i)
    period = sum(w * len(some) for w, some in waiting.items())
    short = {i for i, x in enumerate(rem) if 0 < x < k[i]}
    while period:
        rounds = 0 if short else min(rem[i] // w for w, some in waiting.items() for i in some)
        rest = {i: rem[i] - rounds * w for w, some in waiting.items() for i in some} if rounds else rem
        slots: dict[int, list[int]] = {i: [] for some in waiting.values() for i in some} if rounds else {}
        due = [(-(-period // w), some[0], w, 0) for w, some in waiting.items()]
        heapq.heapify(due)
        later: list[tuple[int, int]] = []
        cut = period
        for t in range(period):
            while later and later[0][0] <= t:
                _, i = heapq.heappop(later)
                heapq.heappush(due, (-(-(len(slots[i]) + 1) * period // k[i]), i, 0, 0))
            deadline, i, w, at = heapq.heappop(due)
            if w and at + 1 < len(waiting[w]):
                heapq.heappush(due, (deadline, waiting[w][at + 1], w, at + 1))
            own = slots.setdefault(i, [])
            if cut == period and len(own) == rest[i]:
                cut = t
                if not rounds:
                    break
            own.append(t)
            heapq.heappush(later, (len(own) * period // k[i], i))
        ran = sorted(i for i, own in slots.items() if own)
        used = [rounds * k[i] + (sum(t < cut for t in slots[i]) if rounds else len(slots[i])) for i in ran]
        yield phase, start, period, ran, [m[i] - rem[i] for i in ran], used, [slots[i] for i in ran]
        start, phase = start + rounds * period + cut, phase + 1
        for i, x in zip(ran, used, strict=True):
            rem[i] -= x
            if rem[i] < k[i]:
                short.add(i)
            if not rem[i]:
                short.discard(i)
                period -= k[i]
                some = waiting[k[i]]
                del some[bisect.bisect_left(some, i)]
                if not some:
                    del waiting[k[i]]


def weighted(sizes: DataFrame, weights: dict[str | None, int] | None, block_docs: int, slots: int) -> DataFrame:
    """From (source, docs): with each source's blocks m and weight k."""
    blocks = sizes.select("source", "docs", F.ceil(F.col("docs") / block_docs).cast("long").alias("m"))
    if weights is None:
        every = Window.partitionBy(F.lit(0))
        unit = F.floor(F.sqrt(F.col("docs").cast("double")) * 1000).cast("long")
        blocks = blocks.withColumn("u", unit).withColumn("total", F.sum("u").over(every)).withColumn("k", F.expr(f"greatest(1L, u * {slots}L div total)"))
    else:
        given = sizes.sparkSession.createDataFrame([(s, int(w)) for s, w in weights.items()], "name string, given bigint")
        blocks = blocks.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("name")), "left").withColumn("k", F.greatest(F.lit(1), F.coalesce("given", F.lit(1))).cast("long"))
    return blocks


def long_schedule(sizes: DataFrame, weights: dict[str | None, int] | None = None, block_docs: int = BLOCK_DOCS, slots: int = SLOTS) -> DataFrame:
    """The rows of :func:`schedule` for any number of sources, made by the driver."""
    rows = weighted(sizes, weights, block_docs, slots).orderBy(F.col("source").asc_nulls_first()).select("source", "k", "m").toArrow()
    names, k, m = rows.column(0), rows.column(1).to_pylist(), rows.column(2).to_pylist()
    types = {"phase": pa.int32(), "slots": pa.list_(pa.int32())}
    columns: dict[str, list] = {c: [] for c in ("of", "phase", "start", "period", "weight", "base", "used", "slots")}
    parts = []

    def pack() -> None:
        made = {c: pa.array(x, types.get(c, pa.int64())) for c, x in columns.items()}
        parts.append(pa.table({"source": names.take(made.pop("of")), **made}))
        for x in columns.values():
            x.clear()

    for phase, start, period, ran, base, used, own in phases_of(k, m):
        for row in zip(ran, base, used, own, strict=True):
            i, before, n, slots_ = row
            for c, x in zip(columns, (i, phase, start, period, k[i], before, n, slots_), strict=True):
                columns[c].append(x)
        if len(columns["of"]) >= PACKED:
            pack()
    pack()
    return sizes.sparkSession.createDataFrame(pa.concat_tables(parts))


def schedule(sizes: DataFrame, weights: dict[str | None, int] | None = None, block_docs: int = BLOCK_DOCS, slots: int = SLOTS) -> DataFrame:
    """From (source, docs): a row a source and phase: source, phase, start, period, weight, base, used, slots (its slots in a period)."""
    blocks = weighted(sizes, weights, block_docs, slots)
    corpus = blocks.agg(F.sort_array(F.collect_list(F.struct("source", "k", "m"))).alias("s")).filter(F.size("s") > 0)
    corpus = corpus.select(F.col("s.source").alias("names"), F.col("s.k").alias("k"), F.col("s.m").alias("m"))
    phases = corpus.select("names", F.posexplode(F.expr(PLAN.format(edf=EDF))).alias("phase", "p"))
    each = phases.select("phase", "p", F.posexplode("names").alias("i", "source")).filter(F.expr("p.used[i] > 0"))
    return each.select("source", "phase", F.col("p.start").alias("start"), F.col("p.period").alias("period"), F.expr("p.kk[i]").alias("weight"), F.expr("p.base[i]").alias("base"), F.expr("p.used[i]").alias("used"),
                       F.expr("filter(transform(p.order, (x, t) -> if(x = i, t, null)), t -> t is not null)").alias("slots"))


def _placed(docs: DataFrame, id_col: str, source_col: str, weights: dict[str | None, int] | None, block_docs: int) -> tuple[DataFrame, dict[str, str]]:
    names = {x: fresh(docs, f"mix_{x}") for x in ("bucket", "n", "first", "rows", "key", "block", "phase", "slot", "place", "weight", "period")}
    sizes = materialise(docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("docs")), "mix-sizes")
    sources = sizes.count()
    make = schedule if sources <= FOLDED else long_schedule
    plan = materialise(make(sizes, weights, block_docs, max(SLOTS, SLOTS_A_SOURCE * sources)), "mix-plan", instead_of=sizes)
    if sources > FOLDED:
        plan = plan.withColumn("block", F.explode(F.expr("sequence(base, base + used - 1)")))
        plan = plan.select("source", "block", "phase", "weight", "period", F.expr("start + (block - base) div weight * period + get(slots, cast((block - base) % weight as int))").alias("at"))
    renamed = plan.select([F.col(c).alias(f"{names['slot']}_{c}") for c in plan.columns])
    p = lambda c: F.col(f"{names['slot']}_{c}")
    rows = numbered(docs, id_col, source_col, names).withColumn(names["block"], F.floor(F.col(names["n"]) / block_docs).cast("long"))
    same = F.col(source_col).eqNullSafe(p("source"))
    if sources > FOLDED:
        joined = rows.join(renamed, same & (F.col(names["block"]) == p("block")))
        slot = p("at")
    else:
        # A phase ends with a source, so at most FOLDED * (FOLDED + 1) / 2 rows: a broadcast of a proven size.
        joined = rows.join(F.broadcast(renamed), same & (F.col(names["block"]) >= p("base")) & (F.col(names["block"]) < p("base") + p("used")))
        local = F.col(names["block"]) - p("base")
        slot = p("start") + F.floor(local / p("weight")) * p("period") + F.get(p("slots"), (local % p("weight")).cast("int"))
    placed = joined.withColumn(names["slot"], slot.cast("long")).withColumn(names["place"], (F.col(names["n"]) % block_docs).cast("long")).withColumn(names["phase"], p("phase").cast("long")).withColumn(names["weight"], p("weight")).withColumn(names["period"], p("period"))
    return placed, names


def positions(docs: DataFrame, weights: dict[str | None, int] | None = None, id_col: str = "doc_id", source_col: str = "source", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """doc_id, source, block, phase, slot (of the block in the schedule), place (in the block),
    and the phase's target as weight of period."""
    placed, names = _placed(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source")), "doc_id", "source", weights, block_docs)
    return placed.select("doc_id", "source", *[F.col(names[c]).alias(c) for c in ("block", "phase", "slot", "place", "weight", "period")])


def mixed(docs: DataFrame, weights: dict[str | None, int] | None = None, id_col: str = "doc_id", source_col: str = "source", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """All rows and columns of ``docs`` in the schedule's order: range-partitioned and sorted by slot and place."""
    return ordered(docs, weights, id_col, source_col, block_docs)[0].select(*[F.col(f"`{c}`") for c in docs.columns])


def ordered(docs: DataFrame, weights: dict[str | None, int] | None = None, id_col: str = "doc_id", source_col: str = "source", block_docs: int = BLOCK_DOCS) -> tuple[DataFrame, str, str]:
    """The rows of :func:`mixed` with their slot and place, and the names of these two columns.

    A stored table is read in no set order, so whoever stores rows must store these too.
    They follow from ids and sources alone: for ids that are neither null nor repeated, any
    order or partitioning of the rows gives the same ones.
    """
    placed, names = _placed(docs, id_col, source_col, weights, block_docs)
    at = names["slot"], names["place"]
    return placed.repartitionByRange(*at).sortWithinPartitions(*at).select(*[F.col(f"`{c}`") for c in docs.columns], *at), *at


def op9(spark, sf_dir: str) -> DataFrame:
    """The schedule of all of ``documents``."""
    return positions(documents(spark, sf_dir))


SQL = """
WITH RECURSIVE d AS (SELECT doc_id, source, ('0x' || substr(md5(doc_id::VARCHAR), 1, 3))::INT AS bucket FROM documents),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY bucket, doc_id) - 1 AS n FROM d),
s AS (SELECT source, count(*) AS docs, floor(sqrt(count(*)::DOUBLE) * 1000)::BIGINT AS u FROM d GROUP BY source),
t AS (SELECT source, ((docs + 15) // 16)::BIGINT AS m, greatest(1, u * (SELECT greatest(360, 16 * count(*)) FROM s) // (SELECT sum(u)::BIGINT FROM s))::BIGINT AS k FROM s),
c AS (SELECT list(source ORDER BY source NULLS FIRST) AS names, list(k ORDER BY source NULLS FIRST) AS k, list(m ORDER BY source NULLS FIRST) AS m, sum(m)::BIGINT AS total FROM t),
-- One row a slot: done and left by source, the phase's start, its blocks by source and weights; pick is the source that runs.
sim AS (
  SELECT 0::BIGINT AS t, 0::BIGINT AS phase, 0::BIGINT AS start, list_transform(k, lambda x: 0::BIGINT) AS done, k AS kk, list_transform(k, lambda x: 0::BIGINT) AS a,
    0::BIGINT AS pick, 0::BIGINT AS period, k, m, total FROM c
  UNION ALL
  SELECT t + 1, CASE WHEN fresh THEN phase + 1 ELSE phase END, CASE WHEN fresh THEN t ELSE start END,
    list_transform(done, lambda x, i: CASE WHEN i = best THEN x + 1 ELSE x END), nk,
    list_transform(na, lambda x, i: CASE WHEN i = best THEN x + 1 ELSE x END), best, np, k, m, total
  FROM (
    SELECT *, list_min(list_filter(list_transform(range(1, len(k) + 1), lambda i: CASE WHEN nk[i] > 0 AND na[i] * np < (t - ns + 1) * nk[i]
        THEN ((na[i] + 1) * np + nk[i] - 1) // nk[i] * 100000 + i END), lambda x: x IS NOT NULL)) % 100000 AS best
    FROM (
      SELECT *, CASE WHEN fresh THEN list_transform(k, lambda x, i: CASE WHEN done[i] < m[i] THEN x ELSE 0 END) ELSE kk END AS nk,
        CASE WHEN fresh THEN list_transform(k, lambda x: 0::BIGINT) ELSE a END AS na, CASE WHEN fresh THEN t ELSE start END AS ns,
        CASE WHEN fresh THEN list_sum(list_transform(k, lambda x, i: CASE WHEN done[i] < m[i] THEN x ELSE 0 END))::BIGINT ELSE p0 END AS np
      FROM (
        SELECT *, done[first_pick] >= m[first_pick] AS fresh
        FROM (
          SELECT *, list_min(list_filter(list_transform(range(1, len(k) + 1), lambda i: CASE WHEN kk[i] > 0 AND a[i] * p0 < (t - start + 1) * kk[i]
              THEN ((a[i] + 1) * p0 + kk[i] - 1) // kk[i] * 100000 + i END), lambda x: x IS NOT NULL)) % 100000 AS first_pick
          FROM (SELECT *, list_sum(kk)::BIGINT AS p0 FROM sim WHERE t < total)
        )
      )
    )
  )
),
slots AS (SELECT t - 1 AS slot, phase, names[pick] AS source, done[pick] - 1 AS block, kk[pick] AS weight, period FROM sim, (SELECT names FROM c) WHERE t > 0)
SELECT r.doc_id, r.source, slots.block::BIGINT AS block, slots.phase::BIGINT AS phase, slots.slot::BIGINT AS slot, (r.n % 16)::BIGINT AS place, slots.weight::BIGINT AS weight, slots.period::BIGINT AS period
FROM r JOIN slots ON slots.source IS NOT DISTINCT FROM r.source AND slots.block = r.n // 16
"""
