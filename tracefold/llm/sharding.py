"""Operator 3: shards of near equal size over fixed virtual slots. DataFrame operations only.

Method: records are hashed into thousands of slots, bytes are summed for each slot, and a versioned
slot-to-shard map, stored as a table, says which shard holds a slot. Rebalancing edits the map: it moves slots,
never rows between slots. The law is ``bytes``: the shards' sizes are near equal.

The map has as many rows as there are slots, a fixed number, so it may be edited on the driver.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.llm.common import shared_path, written

SLOTS = 4096
#: Parts of a slot, in which rows are numbered; with SLOTS this bounds the table of counts.
PARTS = 16
SEED = 20_177

SlotMap = dict[int, int]


def placed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot, part``: a record's slot is a hash of its id and its text's crc32."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), (F.octet_length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
    mixed = F.xxhash64(F.col("doc_id"), F.col("text_crc32"), F.lit(SEED))
    return rows.select("*", F.pmod(mixed, F.lit(slots)).cast("int").alias("virtual_slot"), F.pmod(F.shiftright(mixed, 32), F.lit(PARTS)).cast("int").alias("part"))


def first_map(shards: int, slots: int = SLOTS) -> SlotMap:
    """Version 0: slots dealt in turn, before any byte is known."""
    return {s: s % shards for s in range(slots)}


def rebalance(old: SlotMap, slot_bytes: dict[int, int], shards: int) -> SlotMap:
    """Edit a map: shards above the mean give slots away, largest first, to the lightest shards; then single
    slots move from the heaviest to the lightest shard as long as that narrows their gap. Slots of shards that
    are gone are dealt out first. Deterministic: ties go by number."""
    load = dict.fromkeys(range(shards), 0)
    held: dict[int, list[int]] = {s: [] for s in load}
    pool = []
    for slot in sorted(old, key=lambda s: (slot_bytes.get(s, 0), s)):
        if old[slot] in load:
            held[old[slot]].append(slot)
            load[old[slot]] += slot_bytes.get(slot, 0)
        else:
            pool.append(slot)
    mean = sum(slot_bytes.get(s, 0) for s in old) / shards
    for shard in load:
        for slot in sorted(held[shard], key=lambda s: (-slot_bytes.get(s, 0), s)):
            if load[shard] <= mean:
                break
            if slot_bytes.get(slot, 0):
                held[shard].remove(slot)
                load[shard] -= slot_bytes[slot]
                pool.append(slot)
    heap = [(v, k) for k, v in load.items()]
    heapq.heapify(heap)
    for slot in sorted(pool, key=lambda s: (-slot_bytes.get(s, 0), s)):
        v, shard = heapq.heappop(heap)
        held[shard].append(slot)
        load[shard] = v + slot_bytes.get(slot, 0)
        heapq.heappush(heap, (load[shard], shard))
    while True:
        heavy, light = max(load, key=lambda s: (load[s], -s)), min(load, key=lambda s: (load[s], s))
        gap = load[heavy] - load[light]
        moves = [s for s in held[heavy] if 0 < slot_bytes.get(s, 0) < gap]
        if not moves:
            break
        slot = min(moves, key=lambda s: (abs(gap / 2 - slot_bytes[s]), s))
        held[heavy].remove(slot)
        held[light].append(slot)
        load[heavy] -= slot_bytes[slot]
        load[light] += slot_bytes[slot]
    return {slot: shard for shard, those in held.items() for slot in those}


def store_map(spark: SparkSession, path: str, version: int, slot_map: SlotMap) -> None:
    """Add a version to the stored map; older versions stay."""
    rows = spark.createDataFrame(sorted(slot_map.items()), "virtual_slot int, shard int")
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/version={version}")


def shard_documents(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text",
                    map_path: str | None = None, slots: int = SLOTS) -> DataFrame:
    """Put every row into a shard: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version``.

    ``size`` is the UTF-8 bytes of the text plus 1 (null: 1). ``slot`` numbers the rows of a shard from 0
    without gaps. Rows of one virtual slot stay together, in the order of id (nulls first), crc32 and size.
    Null ids are hashed by their text's crc32; repeated rows share a slot. ``grown_shard`` is null, as the law
    is not ``key``. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    path = map_path or shared_path(spark, "slot-map")
    rows = placed(docs, doc_id, text, slots)
    counts = written(rows.groupBy("virtual_slot", "part").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")), "slot-bytes")
    by_slot = {r[0]: r[1] for r in counts.groupBy("virtual_slot").agg(F.sum("bytes")).collect()}     # SLOTS rows at most
    version0 = first_map(shards, slots)
    store_map(spark, path, 0, version0)
    store_map(spark, path, 1, rebalance(version0, by_slot, shards))
    slot_map = read_map(spark, path, 1)
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part")
    starts = (counts.join(F.broadcast(slot_map), "virtual_slot")
              .select("virtual_slot", "part", "shard", (F.sum("rows").over(before) - F.col("rows")).alias("start")))
    inside = Window.partitionBy("virtual_slot", "part").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    return (rows.withColumn("inside", F.row_number().over(inside))
            .join(F.broadcast(starts), ["virtual_slot", "part"])       # SLOTS * PARTS rows at most
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("start") + F.col("inside") - 1).cast("bigint").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(1).alias("map_version")))
