"""Sharding over fixed virtual slots with a versioned slot-to-shard map.

Records are hashed into ``SLOTS`` slots, by id and text, so that many copies of one text
spread over slots and shards instead of filling one; a record's slot never changes. One row that is
repeated until its copies exceed an average slot is spread by row number as well; fewer than ``SLOTS``
rows can be repeated so often.
Bytes are summed by slot, and a map says which shard owns a slot. Rebalancing edits the
map: it moves, or exchanges, the slots that even out the shards' bytes and stores
the result as a new version; adding a shard moves slots only into the new one.
The map has ``SLOTS`` rows a version, so it is small whatever the data.

Records get gapless numbers within their shard: rows are numbered inside
(input partition, shard) groups, whose size is bounded by a partition, and each
group starts where the shard's groups of earlier partitions end.

The law is of bytes, over all rows: equal texts (the contract's groups) aren't kept together.

Defined cases: a null text has size 1 and the crc32 of no bytes; a null id hashes
by the text alone; repeated rows are rows of their own, with one slot unless they are very many; an empty
table gives an empty table and the map's first version; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialise, work_path

SLOTS = 4096
SHARDS = 16


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot (the virtual slot), part (the input partition), same (equal for repeated rows) and number (of the row)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col), text), F.lit(slots)).cast("int").alias("vslot"),
        F.spark_partition_id().alias("part"),
        F.xxhash64(F.col(id_col), text).alias("same"),
        F.monotonically_increasing_id().alias("number"),
    )


def spread(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Stored :func:`records` in which a row that is repeated beyond an average slot's bytes goes to all slots."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    many = rows.groupBy("same").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).filter((F.col("n") > 1) & (F.col("bytes") > total // slots)).select(F.col("same").alias("m_same"))
    # Fewer than ``slots`` rows can each have over 1 / slots of the bytes.
    met = rows.join(F.broadcast(many), F.col("same") == F.col("m_same"), "left")
    anew = F.pmod(F.xxhash64("same", "number"), F.lit(slots)).cast("int")
    return met.withColumn("vslot", F.when(F.col("m_same").isNotNull(), anew).otherwise(F.col("vslot"))).drop("m_same")


def first_map(shards: int = SHARDS, slots: int = SLOTS) -> np.ndarray:
    """Version 1: slots dealt in turn."""
    return np.arange(slots, dtype=np.int64) % shards


def rebalance(owner: np.ndarray, weight: np.ndarray, shards: int) -> np.ndarray:
    """An edited copy of the map: while it helps, the fullest shard gives the emptiest
    one the slot, or exchanges the pair of slots, that evens the two out best. A shard
    that one huge record keeps over the others is left, and the others go on."""
    owner = owner.copy()
    load = np.bincount(owner, weights=weight, minlength=shards).astype(np.int64)
    open_ = np.ones(shards, bool)
    while True:  # each edit evens out two shards, so this ends
        high, low = int(np.where(open_, load, -1).argmax()), int(load.argmin())
        gap = int(load[high] - load[low])
        if gap <= 1 or not open_[high]:
            break
        ours, theirs = np.nonzero(owner == high)[0], np.nonzero(owner == low)[0]
        give = ours[weight[ours] > 0]
        best, move = gap, None
        if len(give):
            after = np.abs(gap - 2 * weight[give])
            k = int(after.argmin())
            if after[k] < best:
                best, move = int(after[k]), (give[k], None)
        if len(give) and len(theirs):
            order = theirs[np.argsort(weight[theirs], kind="stable")]
            near = np.searchsorted(weight[order], weight[give] - gap // 2)
            for shift in (-1, 0):
                pick = order[np.clip(near + shift, 0, len(order) - 1)]
                after = np.abs(gap - 2 * (weight[give] - weight[pick]))
                k = int(after.argmin())
                if after[k] < best:
                    best, move = int(after[k]), (give[k], pick[k])
        if move is None:
            open_[high] = False
            continue
        owner[move[0]] = low
        if move[1] is not None:
            owner[move[1]] = high
        load = np.bincount(owner, weights=weight, minlength=shards).astype(np.int64)
    return owner


def add_shard(owner: np.ndarray, weight: np.ndarray, shards: int) -> np.ndarray:
    """A map for one more shard: the fullest shards give slots to the new one, none to each other."""
    owner = owner.copy()
    load = np.bincount(owner, weights=weight, minlength=shards + 1).astype(np.int64)
    aim = int(load.sum()) // (shards + 1)
    while load[shards] < aim:
        high = int(load[:shards].argmax())
        ours = np.nonzero((owner == high) & (weight > 0) & (weight <= 2 * (aim - load[shards])))[0]
        if not len(ours) or load[high] <= load[shards]:
            break
        k = ours[int(np.abs(weight[ours] - min(load[high] - aim, aim - load[shards])).argmin())]
        owner[k] = shards
        load[high] -= weight[k]
        load[shards] += weight[k]
    return owner


class SlotMap:
    """The stored map: a Parquet table of (version, slot, shard), a folder a version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def store(self, version: int, owner: np.ndarray) -> None:
        rows = [(k, int(s)) for k, s in enumerate(owner)]
        self.spark.createDataFrame(rows, "slot int, shard int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={version}")

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema("slot int, shard int").parquet(f"{self.path}/version={version}")

    def changes(self, old: int, new: int) -> DataFrame:
        """Slots that another shard owns in the newer version: slot, old_shard, new_shard."""
        a, b = self.load(old).withColumnRenamed("shard", "old_shard"), self.load(new).withColumnRenamed("shard", "new_shard")
        return a.join(b, "slot").filter("old_shard <> new_shard")


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """Bytes by virtual slot: ``slots`` numbers."""
    out = np.zeros(slots, np.int64)
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("b")).collect():
        out[r.vslot] = r.b
    return out


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds shard and slot (the record's number in its shard) to :func:`records`."""
    # A version of the map has SLOTS rows, so a broadcast is bounded.
    owned = rows.join(F.broadcast(slot_map.withColumnRenamed("slot", "vslot")), "vslot")
    group = Window.partitionBy("part", "shard").orderBy(F.col("doc_id").asc_nulls_first(), "vslot", "text_crc32")
    numbered = owned.withColumn("rn", F.row_number().over(group))
    sizes = owned.groupBy("part", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return numbered.join(starts, ["part", "shard"]).withColumn("slot", F.col("first") + F.col("rn") - 1)


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """All rows of ``docs`` in shards of near equal bytes: doc_id, size, text_crc32, law,
    shard, slot, grown_shard (null under this law) and vslot."""
    spark = docs.sparkSession
    rows = spread(materialise(records(docs, slots=slots), "shard-records"), slots)
    weight = slot_bytes(rows, slots)
    versions = SlotMap(spark, work_path(spark, "slot-map"))
    versions.store(1, first_map(shards, slots))
    versions.store(2, rebalance(first_map(shards, slots), weight, shards))
    return place(rows, versions.load(2)).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op8(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` in 16 shards."""
    return shard(documents(spark, sf_dir))
