"""Near duplicates by SimHash and meet-in-the-middle ball hashing.

Two fingerprints that differ in up to ``2 * HALF`` bits share at least one variant:
flip half the differing bits in each. So every fingerprint emits all its variants
within ``HALF`` bits (2081 for 64 bits and 2), variants are shuffled, and
fingerprints that meet on one are verified by their Hamming distance and linked.

The shuffle is packed. A linear code maps a 64-bit variant to one of ``B`` buckets, and
flipping bits changes the bucket in a known way, so the variants of a fingerprint
that fall in one bucket follow from the fingerprint: a fingerprint is sent once to
each bucket that any of its variants reaches, and the bucket's task expands exactly
those. No variant is lost; with ``B`` = 64 a fingerprint moves 64 times 8 bytes in place
of 2081 times 16. Up to 2081 buckets, every bucket hears of every fingerprint and expands
its share of the variants, in slices of about ``SLICE`` (by a second code): a task holds
some 26 bytes a fingerprint, and more buckets are more tasks at ``8 * B`` bytes moved a
fingerprint. So ``B`` is 64 up to ``FEW_FPS`` distinct fingerprints, 256 up to
``BUCKET_FPS``, and beyond grows until a bucket gets no more than that many.

Equal fingerprints are one node, so copies cost one row each before this step and
one join after it. Inside a bucket, links are contracted to a forest that leads each
node to its smallest one; links between buckets are merged by alternating star
contraction, each round written to the shared folder, until nothing changes.

Defined cases: a null text is an empty text; texts without words have fingerprint
zero and link like any other; a null id never is a component's id unless the
component has no other (then it is null); repeated rows give repeated rows; an
empty table gives an empty table; :func:`components` ignores other columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, documents, fresh, held, materialise, trim

HALF = 2
FEW_FPS = 1 << 22
BUCKET_FPS = 1 << 24
SLICE = 1 << 22
FLUSH = 1 << 16
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str, words_a_shingle: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles, repeats included; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    if len(words) <= words_a_shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    whole = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *stops[: len(words) - words_a_shingle].tolist()]
    ends = (stops[words_a_shingle - 1 :] - 1).tolist()
    n = len(ends)
    h = np.fromiter((xxh64_intdigest(whole[a:b], seed) for a, b in zip(starts, ends, strict=True)), np.uint64, n)
    octets = h.view(np.uint8).reshape(n, 8)
    out = 0
    for k in range(8):  # little-endian: octet k holds bits 8k to 8k + 7
        ones = np.bincount(octets[:, k], minlength=256) @ BYTE_BITS
        out |= int(np.packbits(ones * 2 > n)[0]) << 8 * k
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of each row."""
    schema = "doc_id bigint, fp bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held()
        for batch in batches:
            made = np.fromiter((fingerprint(t) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(made.view(np.int64))], ["doc_id", "fp"])
        trim()

    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, schema)


class Ball:
    """The masks of up to ``half`` flips, by what they do to the bucket and to the slice."""

    def __init__(self, bucket_bits: int, slice_bits: int, half: int = HALF):
        rng = np.random.default_rng(1)
        if bucket_bits == 6:
            self.codes = np.arange(64, dtype=np.uint64)
        else:
            self.codes = rng.integers(0, 1 << bucket_bits, 64, dtype=np.uint64)
        self.slice_codes = rng.integers(0, 1 << slice_bits, 64, dtype=np.uint64) if slice_bits else np.zeros(64, np.uint64)
        bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
        masks = [np.zeros(1, np.uint64)]
        for size in range(1, half + 1):
            masks.append(np.array([np.bitwise_or.reduce(bits[list(c)]) for c in _choose(64, size)], np.uint64))
        every = np.concatenate(masks)
        moves, slices = syndrome(every, self.codes), syndrome(every, self.slice_codes)
        self.moves = np.unique(moves)
        self.by = {}
        for m in self.moves:
            own = moves == m
            for s in np.unique(slices[own]):
                self.by[int(m), int(s)] = every[own & (slices == s)]


def _choose(n: int, k: int) -> Iterator[tuple[int, ...]]:
    from itertools import combinations

    return combinations(range(n), k)


def syndrome(values: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """XOR of the codes of each value's set bits, by byte tables."""
    out = np.zeros(len(values), np.uint64)
    if not codes.any():
        return out
    octets = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)
    for k in range(8):
        table = np.zeros(256, np.uint64)
        for b in range(8):
            table[(np.arange(256) >> b & 1) == 1] ^= codes[8 * k + b]
        out ^= table[octets[:, k]]
    return out


@lru_cache(maxsize=4)
def ball(bucket_bits: int, slice_bits: int, half: int) -> Ball:
    return Ball(bucket_bits, slice_bits, half)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest node reachable, node) for every other node of the links a-b."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[label[other]], nodes[other]


def collide(fps: np.ndarray, bucket: int, bucket_bits: int, half: int = HALF) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among distinct fingerprints that share a variant of this bucket, as a forest."""
    slice_bits = max(0, int(np.ceil(np.log2(max(1, len(fps) * (2081 >> bucket_bits or 1) / SLICE)))))
    masks = ball(bucket_bits, slice_bits, half)
    key = syndrome(fps, masks.codes) ^ np.uint64(bucket)
    key <<= np.uint64(slice_bits)
    key |= syndrome(fps, masks.slice_codes)
    # Narrow keys: their sort needs 8 bytes a fingerprint, and the fingerprints lie in groups after it.
    key = key.astype(np.uint16 if bucket_bits + slice_bits <= 16 else np.uint32)
    order = np.argsort(key, kind="stable")
    fps, key = fps[order], key[order]
    del order
    first = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1]) if len(key) else np.zeros(0, int)
    groups = {int(key[s]): fps[s:e] for s, e in zip(first, [*first[1:], len(fps)], strict=True)}
    left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for part in range(1 << slice_bits):
        variants, owners = [], []
        for k, own in groups.items():
            flips = masks.by.get((k >> slice_bits, (k & (1 << slice_bits) - 1) ^ part))
            if flips is not None:
                variants.append((own[:, None] ^ flips).reshape(-1))
                owners.append(np.repeat(own, len(flips)))
        if not variants:
            continue
        v, o = np.concatenate(variants), np.concatenate(owners)
        by = np.argsort(v)
        v, o = v[by], o[by]
        same = v[1:] == v[:-1]
        if not same.any():
            continue
        member = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        v, o = v[member], o[member]
        heads = np.concatenate([[0], np.nonzero(v[1:] != v[:-1])[0] + 1])
        # All that share a variant are linked to the smallest of them: as connected as all pairs.
        least = np.repeat(np.minimum.reduceat(o, heads), np.diff(np.concatenate([heads, [len(v)]])))
        near = (np.bitwise_count(least ^ o) <= 2 * half) & (least != o)
        a, b = forest(least[near], o[near])
        left.append(a)
        right.append(b)
    return forest(np.concatenate(left), np.concatenate(right))


def bucket_bits_for(n: int, half_ball: int = 2081) -> int:
    """Bits of the bucket code: 6, 8 for more than ``FEW_FPS``, or more if a bucket would get over ``BUCKET_FPS``."""
    bits = 6 if n <= FEW_FPS else 8
    while n * min(1.0, half_ball / (1 << bits)) > BUCKET_FPS:
        bits += 1
    return bits


def links(nodes: DataFrame, half: int = HALF) -> DataFrame:
    """A forest (low, node) a bucket over the distinct fingerprints in ``nodes.fp``, without repeats."""
    bits = bucket_bits_for(nodes.count())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, kept, n = ball(bits, 0, half), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            fps = np.concatenate(kept).view(np.uint64)
            at = syndrome(fps, masks.codes)
            order = np.argsort(at, kind="stable")
            values, first = np.unique(at[order], return_index=True)
            sent: dict[int, list[np.ndarray]] = {}
            for value, s, e in zip(values.tolist(), first.tolist(), [*first[1:].tolist(), len(fps)], strict=True):
                own = fps[order[s:e]]
                for m in masks.moves.tolist():
                    sent.setdefault(value ^ m, []).append(own)
            for bucket, parts in sent.items():
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int64()), "fps": pa.array([np.concatenate(parts).tobytes()], pa.binary())})

        for batch in batches:
            kept.append(batch.column(0).to_numpy())
            n += batch.num_rows
            if n >= FLUSH:
                yield from flush()
                kept, n = [], 0
        if n:
            yield from flush()
        trim()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got = None, []

        def done() -> Iterator[pa.RecordBatch]:
            a, b = collide(np.unique(np.concatenate(got)), now, bits, half)
            for k in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_pydict({"low": pa.array(a[k : k + 100_000].view(np.int64)), "node": pa.array(b[k : k + 100_000].view(np.int64))})

        for batch in batches:
            for k in range(batch.num_rows):
                bucket = batch.column(0)[k].as_py()
                if bucket != now and got:
                    yield from done()
                    got = []
                now = bucket
                got.append(np.frombuffer(batch.column(1)[k].as_py(), np.uint64))
        if got:
            yield from done()
        trim()

    packed = nodes.select("fp").mapInArrow(emit, "bucket bigint, fps binary")
    return packed.repartition(1 << min(bits, 14), "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "low bigint, node bigint").distinct()


def star_contraction(edges: DataFrame) -> DataFrame:
    """(node, low): each node but the smallest of its component, with that smallest one.

    Alternating large-star and small-star rounds over (node > low) edges; nodes are
    compared as signed longs. A round's state is one written table.
    """
    now = materialise(edges.select(F.greatest("low", "node").alias("node"), F.least("low", "node").alias("low")).filter("node <> low").distinct(), "star")
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", "low").cast("decimal(38,0)")).alias("h")).first()
        if seen.n == 0 or (seen.n, seen.h) == mark:
            return now
        mark = (seen.n, seen.h)
        # Large star: each larger neighbour of a node goes to the node's smallest neighbour.
        least = now.select("node", "low").unionByName(now.select(F.col("low").alias("node"), F.col("node").alias("low"))).groupBy("node").agg(F.min("low").alias("m"))
        least = least.select(F.col("node").alias("low"), F.least("m", "node").alias("m"))
        large = now.join(least, "low").select("node", F.col("m").alias("low")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of these.
        low = large.groupBy("node").agg(F.min("low").alias("m"))
        moved = large.join(low, "node").select(F.explode(F.array(F.struct(F.col("node"), F.col("m").alias("low")), F.struct(F.col("low").alias("node"), F.col("m").alias("low")))).alias("e")).select("e.*")
        now = materialise(moved.filter("node <> low").distinct(), "star", instead_of=now)


def components(prints: DataFrame, half: int = HALF) -> DataFrame:
    """fp, root and component_id (smallest id reachable) of each distinct fingerprint in (doc_id, fp) rows."""
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp-nodes")
    stars = star_contraction(links(nodes, half))
    roots = stars.select(F.col("node").alias("fp"), F.col("low").alias("root"))
    known = materialise(nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "fp-roots", instead_of=nodes)
    discard(stars)
    ids = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return known.join(ids, "root").select("fp", "root", "component_id")


def op10(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``."""
    prints = materialise(fingerprints(documents(spark, sf_dir)), "fp")
    return prints.join(components(prints), "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", half: int = HALF) -> DataFrame:
    """The rows of ``docs``, all columns, one of each component: that with the smallest id
    (of several such rows, one). A component whose ids are all null keeps one row."""
    name, number = fresh(docs, "fp"), fresh(docs, "row")
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + f", `{name}` bigint"
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held()
        for batch in batches:
            made = np.fromiter((fingerprint(t or "") for t in batch.column(at).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made.view(np.int64))], [*batch.schema.names, name])
        trim()

    rows = materialise(docs.mapInArrow(run, schema).withColumn(number, F.monotonically_increasing_id()), "fp-rows")
    prints = rows.select(F.col(id_col).alias("doc_id"), F.col(name).alias("fp"), F.col(number).alias("row"))
    # Numbers decide; whole rows move once, in the last join.
    found = prints.join(components(prints, half), "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = found.groupBy("root").agg(F.min("row").alias(number)).select(number)
    return rows.join(kept, number, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
