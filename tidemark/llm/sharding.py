"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's key hashes to one of thousands of slots, for good. Bytes are summed per slot, and
only the small map from slots to shards is edited when shards are to be evened out: most slots
stay where they are. Every version of the map is kept as a table, so old layouts can be read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.common import text_or_empty
from tidemark.session import scratch_folder, written

SLOTS = 8192
ROW_BYTES = 16
#: A shard keeps slots up to this share of the mean when the map is edited; the rest is dealt anew.
KEPT_SHARE = 0.9


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each slot; ``version`` counts the edits."""

    shards: int
    shard_of: tuple[int, ...]
    version: int = 1

    @classmethod
    def initial(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(shards, tuple(slot % shards for slot in range(slots)))

    def rebalanced(self, weights: dict[int, int], shards: int | None = None) -> SlotMap:
        """The next version: shards near the mean weight, few slots moved.

        Each shard keeps its heaviest slots up to ``KEPT_SHARE`` of the mean. What is left over,
        and every slot of a shard that is no more, goes heaviest first to the lightest shard.
        ``weights`` has one number per slot, so this is bounded by the number of slots.
        """
        shards = shards or self.shards
        mean = sum(weights.values()) / shards
        load, moving, result = [0] * shards, [], list(self.shard_of)
        for slot in sorted(range(len(result)), key=lambda s: (-weights.get(s, 0), s)):
            weight, at = weights.get(slot, 0), result[slot]
            if at < shards and load[at] + weight <= KEPT_SHARE * mean:
                load[at] += weight
            elif at >= shards or weight:
                moving.append((weight, slot))
        lightest = [(w, shard) for shard, w in enumerate(load)]
        heapq.heapify(lightest)
        for weight, slot in moving:
            w, shard = heapq.heappop(lightest)
            result[slot] = shard
            heapq.heappush(lightest, (w + weight, shard))
        return SlotMap(shards, tuple(result), self.version + 1)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(version, virtual_slot, shard), one row per slot."""
        listed = F.lit(",".join(map(str, self.shard_of)))
        one = spark.range(1).select(F.posexplode(F.split(listed, ",")).alias("virtual_slot", "s"))
        return one.select(F.lit(self.version).alias("version"), "virtual_slot", F.col("s").cast("int").alias("shard"))

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version to the table at ``path``; a version that is there is replaced whole."""
        self.frame(spark).drop("version").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        table = spark.read.parquet(path)
        if version is None:
            version = table.agg(F.max("version")).first()[0]
        rows = table.where(F.col("version") == version).orderBy("virtual_slot").collect()
        return cls(max(r["shard"] for r in rows) + 1, tuple(r["shard"] for r in rows), version)


def virtual_slot(*keys: str | Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def shard_records(records: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 40, slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """Put every record into a shard, shards near equal in bytes.

    Returns key, size (UTF-8 bytes of the text plus 16; null text: 16), text_crc32,
    virtual_slot, shard and slot (the record's place in its shard, gapless from 0).
    The slot hashes key, size and checksum, so that rows which only share the key (null
    included) are spread. Rows alike in everything get places of their own next to one
    another. Other columns are left out. An empty table gives no rows.
    ``maps`` is the folder of the versioned map (default: a new one in the shared folder).
    """
    spark = records.sparkSession
    whole = text_or_empty(text)
    narrow = records.select(F.col(key).alias("_key"), (F.octet_length(whole) + ROW_BYTES).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"))
    narrow = written(narrow.withColumn("virtual_slot", virtual_slot("_key", "size", "text_crc32", slots=slots)), "shard-sizes")
    # at most one row per slot comes to the driver, whatever the number of records
    totals = narrow.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    path = maps or scratch_folder(spark, "slot-map")
    first = SlotMap.initial(shards, slots)
    first.save(spark, path)
    edited = first.rebalanced({r["virtual_slot"]: r["bytes"] for r in totals})
    edited.save(spark, path)

    counts, before, filled = {r["virtual_slot"]: r["rows"] for r in totals}, [0] * slots, [0] * shards
    for slot, shard in enumerate(edited.shard_of):
        before[slot] = filled[shard]
        filled[shard] += counts.get(slot, 0)
    starts = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, before))), ",")).alias("virtual_slot", "b"))
    places = edited.frame(spark).join(starts.select("virtual_slot", F.col("b").cast("long").alias("_before")), "virtual_slot")
    inside = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("_key", "size", "text_crc32")) - 1
    # the map is broadcast: one small row per slot, a fixed number
    dealt = narrow.withColumn("_at", inside).join(F.broadcast(places), "virtual_slot")
    return dealt.select(F.col("_key").alias(key), "size", "text_crc32", "virtual_slot", "shard", (F.col("_before") + F.col("_at")).cast("long").alias("slot"))
