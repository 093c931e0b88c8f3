"""Sharding over fixed virtual slots with a versioned slot-to-shard map.

Records hash into a fixed number of slots that never changes. A map, small and versioned, says which shard holds a slot.
Bytes are summed per slot, and rebalancing edits the map: it moves whole slots from the heaviest shard to the lightest one
until no move or swap brings the two nearer. Adding shards appends empty ones and rebalances.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import cut, numbered, shared_folder, small, whole

SLOTS = 4096
SHARDS = 16


@dataclass(frozen=True)
class SlotMap:
    """shard_of[slot] is the shard; every edit gives a new version."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @classmethod
    def uniform(cls, shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
        return cls(1, shards, tuple(s * shards // slots for s in range(slots)))

    def grown(self, by: int = 1) -> SlotMap:
        return replace(self, version=self.version + 1, shards=self.shards + by)

    def rebalanced(self, weight: list[int]) -> SlotMap:
        """Moves or swaps slots between the heaviest and the lightest shard while that lowers the larger of the two. As each step
        lowers the sum of the squares of whole numbers, it ends."""
        of, load = list(self.shard_of), [0] * self.shards
        held: list[list[tuple[int, int]]] = [[] for _ in load]
        for s, w in enumerate(weight):
            load[of[s]] += w
            if w:
                held[of[s]].append((w, s))
        for h in held:
            h.sort()
        while True:
            a, b = max(range(self.shards), key=lambda k: (load[k], -k)), min(range(self.shards), key=lambda k: (load[k], k))
            gap = load[a] - load[b]
            if gap <= 1 or not held[a]:
                break
            best = None  # (distance from half the gap, slot of a, slot of b or none)
            for give in (None, *held[b]):
                back = give[0] if give else 0
                k = bisect_left(held[a], (back + gap / 2, -1))
                for x in held[a][max(0, k - 1) : k + 1]:
                    if 0 < x[0] - back < gap and (best is None or (abs(x[0] - back - gap / 2), x, give or ()) < (best[0], best[1], best[2] or ())):
                        best = (abs(x[0] - back - gap / 2), x, give)
                if best and best[0] <= 0.5:
                    break
            if not best:
                break
            _, x, give = best
            for y, src, dst in ((x, a, b), (give, b, a)):
                if y:
                    held[src].remove(y)
                    held[dst].insert(bisect_left(held[dst], y), y)
                    of[y[1]] = dst
                    load[src] -= y[0]
                    load[dst] += y[0]
        return replace(self, version=self.version + 1, shard_of=tuple(of))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.shards, s, k) for s, k in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "version int, shards int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the stored map; earlier versions stay."""
        self.frame(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, or the last one. One row per slot, a fixed number, comes to the driver."""
        df = spark.read.parquet(path)
        version = df.agg(F.max("version")).first()[0] if version is None else version
        rows = df.where(F.col("version") == version).orderBy("virtual_slot").collect()
        return cls(version, rows[0].shards, tuple(r.shard for r in rows))


def size_of(text: Column) -> Column:
    """UTF-8 bytes plus 1; null: 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def crc_of(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null: that of no bytes, 0."""
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def slot_of(*columns: Column | str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


def slot_sums(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows per slot: a fixed number of sums, the only thing that comes to the driver."""
    size, count = [0] * slots, [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r.virtual_slot], count[r.virtual_slot] = r.b, r.n
    return size, count


def edited(spark: SparkSession, size: list[int], shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> tuple[SlotMap, str]:
    """The map for these bytes per slot, as read back from where it is stored: the uniform map, then its rebalanced version."""
    path = path or f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    first = SlotMap.uniform(shards, slots)
    first.save(spark, path)
    first.rebalanced(size).save(spark, path)
    return SlotMap.load(spark, path), path


#: Rows equal in id and checksum are spread over slots of their own if there are more of them.
REPEATS = 8


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """docs with size, text_crc32, virtual_slot, shard and map_version; texts are not shuffled.

    Columns of docs that have one of these names are replaced. The slot depends on id and checksum; rows that repeat more than REPEATS times
    are spread over as many slots as there are of them. The map is stored under path, by default in the shared folder.
    """
    names = ["size", "text_crc32", "virtual_slot", "shard", "map_version"]
    rows = whole(docs.drop(*names), id=F.col("doc_id"), size=size_of(F.col("text")), text_crc32=crc_of(F.col("text")))
    often = cut(rows.groupBy("id", "text_crc32").agg(F.count("*").alias("times")).where(F.col("times") > REPEATS).select(F.col("id").alias("i"), F.col("text_crc32").alias("c"), "times"))
    rows = rows.join(small(often), F.col("id").eqNullSafe(F.col("i")) & (F.col("text_crc32") == F.col("c")), "left")
    spread = slot_of("id", "text_crc32", F.pmod(F.monotonically_increasing_id(), F.col("times")), slots=slots)
    rows = rows.withColumn("virtual_slot", F.when(F.col("times").isNull(), slot_of("id", "text_crc32", slots=slots)).otherwise(spread))
    m, _ = edited(docs.sparkSession, slot_sums(rows, slots)[0], shards, slots, path)
    of = F.element_at(F.array(*map(F.lit, m.shard_of)), F.col("virtual_slot") + 1)
    return rows.select("doc.*", "size", "text_crc32", "virtual_slot", of.cast("int").alias("shard"), F.lit(m.version).alias("map_version"))


def sharded(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    The law is `bytes`: sums of size per shard are near equal, after one rebalancing of the uniform map, which is stored under path (by default in
    the shared folder) and read from there. slot: the row's place in its shard, gapless from 0, by virtual slot, then doc_id, checksum and size.
    Rows equal in these three are numbered, and each has a slot by its number. Null ids and texts are placed like
    any other. An empty table gives an empty result.
    """
    spark, own = docs.sparkSession, ["doc_id", "size", "text_crc32"]
    rows = numbered(docs.select("doc_id", size_of(F.col("text")).alias("size"), crc_of(F.col("text")).alias("text_crc32")), own, "copy")
    rows = cut(rows.withColumn("virtual_slot", F.when(F.col("copy") == 0, slot_of("doc_id", "text_crc32", slots=slots)).otherwise(slot_of(*own[::2], "copy", slots=slots))))
    size, count = slot_sums(rows, slots)
    m, path = edited(spark, size, shards, slots, path)
    at, offset = [0] * shards, []
    for s, k in enumerate(m.shard_of):
        offset.append(at[k])
        at[k] += count[s]
    first = spark.createDataFrame(list(enumerate(offset)), "virtual_slot int, offset long")
    stored = spark.read.parquet(path).where(F.col("version") == m.version).select("virtual_slot", "shard").join(first, "virtual_slot")
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(*own))
    out = rows.withColumn("rank", rank).join(F.broadcast(stored), "virtual_slot")  # as many rows as slots, a fixed number
    return out.select(*own, F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(m.version).alias("map_version"))
