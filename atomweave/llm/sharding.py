"""Shards by fixed virtual slots.

Rows are hashed by their key into thousands of virtual slots. Bytes and rows are added up for each slot, and a small
versioned map says which shard owns each slot. Rebalancing edits the map: only slots that have to move change owner.
What reaches the driver is one row for each virtual slot, a number fixed by a parameter and not by the data.

Edge cases: a null text counts no bytes; a null key is replaced by the checksum of the text; equal keys share a slot, and
a slot isn't divided, so shards are as even as the largest slot allows (ids that don't repeat spread well); an empty table gives a map in which slots are dealt evenly, and no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Virtual slots; fixed for the life of a data set.
N_SLOTS = 4096
#: Bytes counted for each row besides its text.
ROW_OVERHEAD = 8
MAP_SCHEMA = "version int, n_shards int, virtual_slot int, shard int, bytes long, rows long"


@dataclass(frozen=True)
class SlotMap:
    """Which shard owns each virtual slot, with the bytes and rows that each slot held when the map was made."""

    version: int
    n_shards: int
    owner: tuple[int, ...]
    size: tuple[int, ...]
    rows: tuple[int, ...]

    def loads(self) -> list[int]:
        out = [0] * self.n_shards
        for shard, size in zip(self.owner, self.size, strict=True):
            out[shard] += size
        return out

    def offsets(self) -> list[int]:
        """For each virtual slot, how many rows of its shard stand before it."""
        seen, out = [0] * self.n_shards, []
        for shard, rows in zip(self.owner, self.rows, strict=True):
            out.append(seen[shard])
            seen[shard] += rows
        return out

    def rebalanced(self, n_shards: int | None = None, size: tuple[int, ...] | None = None, rows: tuple[int, ...] | None = None) -> SlotMap:
        """The next version, for other sizes or more or fewer shards: slots move one by one from the fullest shard to
        the emptiest, each time the largest slot that narrows the gap, until no move does."""
        n, size = n_shards or self.n_shards, size or self.size
        held: list[set[int]] = [set() for _ in range(n)]
        homeless = []
        for slot, shard in enumerate(self.owner):
            if shard < n:
                held[shard].add(slot)
            else:
                homeless.append(slot)
        load = [sum(size[s] for s in slots) for slots in held]
        for slot in sorted(homeless, key=lambda s: (-size[s], s)):
            to = min(range(n), key=lambda k: (load[k], k))
            held[to].add(slot)
            load[to] += size[slot]
        while True:
            high, low = max(range(n), key=lambda k: (load[k], -k)), min(range(n), key=lambda k: (load[k], k))
            gap = load[high] - load[low]
            # a move of s bytes leaves a gap of |gap - 2 s| between the two shards
            slot = min((s for s in held[high] if 0 < size[s] < gap), key=lambda s: (abs(gap - 2 * size[s]), s), default=None)
            if slot is None:
                break
            held[high].remove(slot)
            held[low].add(slot)
            load[high] -= size[slot]
            load[low] += size[slot]
        owner = [0] * len(self.owner)
        for shard, slots in enumerate(held):
            for slot in slots:
                owner[slot] = shard
        return replace(self, version=self.version + 1, n_shards=n, owner=tuple(owner), size=tuple(size), rows=tuple(rows or self.rows))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.n_shards, s, self.owner[s], self.size[s], self.rows[s]) for s in range(len(self.owner))]
        return spark.createDataFrame(rows, MAP_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the table of maps; earlier versions stay as they are."""
        self.frame(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        maps = spark.read.schema(MAP_SCHEMA).parquet(path)
        if version is None:
            version = maps.agg(F.max("version")).first()[0]
        found = sorted(maps.where(F.col("version") == version).collect(), key=lambda r: r.virtual_slot)  # one row for each virtual slot
        if not found:
            raise ValueError(f"no version {version} of the slot map in {path}")
        return SlotMap(version, found[0].n_shards, *(tuple(r[k] for r in found) for k in ("shard", "bytes", "rows")))


def text_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_OVERHEAD).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def virtual_slot(key: Column, text: Column, n_slots: int = N_SLOTS) -> Column:
    key = F.coalesce(key.cast("string"), F.concat(F.lit("text:"), text_crc32(text).cast("string")))
    return F.pmod(F.xxhash64(key), F.lit(n_slots)).cast("int")


def slot_stats(docs: DataFrame, key: str = "doc_id", text: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    slot = virtual_slot(F.col(key), F.col(text), n_slots).alias("virtual_slot")
    return docs.select(slot, text_bytes(F.col(text)).alias("size")).groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def build_map(docs: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", n_slots: int = N_SLOTS) -> SlotMap:
    """The first version: slots by descending bytes, each to the shard with fewest bytes so far."""
    size, rows = [0] * n_slots, [0] * n_slots
    for r in slot_stats(docs, key, text, n_slots).collect():  # at most n_slots rows
        size[r["virtual_slot"]], rows[r["virtual_slot"]] = r["bytes"], r["rows"]
    heap = [(0, shard) for shard in range(n_shards)]
    owner = [0] * n_slots
    for slot in sorted(range(n_slots), key=lambda s: (-size[s], s)):
        load, owner[slot] = heapq.heappop(heap)
        heapq.heappush(heap, (load + size[slot], owner[slot]))
    first = SlotMap(0, n_shards, tuple(owner), tuple(size), tuple(rows))
    return first.rebalanced()


def assign(docs: DataFrame, slots: SlotMap, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key, size, checksum, virtual slot, shard and gapless place in the shard. Texts aren't shuffled."""
    spark, n_slots, offsets = docs.sparkSession, len(slots.owner), slots.offsets()
    places = spark.createDataFrame([(s, slots.owner[s], offsets[s]) for s in range(n_slots)], "virtual_slot int, shard int, before long")
    slim = docs.select(F.col(key), text_bytes(F.col(text)).alias("size"), text_crc32(F.col(text)).alias("text_crc32"), virtual_slot(F.col(key), F.col(text), n_slots).alias("virtual_slot"))
    in_slot = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(key, "text_crc32", "size")) - 1
    # the map has n_slots rows, whatever the data
    placed = slim.withColumn("in_slot", in_slot).join(F.broadcast(places), "virtual_slot")
    return placed.select(key, "size", "text_crc32", "shard", (F.col("before") + F.col("in_slot")).cast("long").alias("slot"), "virtual_slot", F.lit(slots.version).alias("map_version"))
