"""Sharding by fixed virtual slots with a versioned slot-to-shard map.

Every record is hashed into one of a few thousand virtual slots and stays there for
good. Bytes are summed per slot; a small table maps slots to shards. Rebalancing
never touches records: it adds rows (version, slot, shard) for the slots that move,
and the map at a version is, for each slot, the last row up to that version.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir

#: Bounds everything the driver and the broadcast hold: one small row for each slot.
SLOTS = 8192
MAP_SCHEMA = "version int, virtual_slot int, shard int"


def virtual_slot(id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> Column:
    """Slot of a row by its id and text, so that an id that many rows share isn't one slot."""
    return F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(slots)).cast("int")


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: slots dealt out in turn."""
    return spark.range(slots).select(F.lit(0).alias("version"), F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"))


def at_version(slot_map: DataFrame, version: int | None = None) -> DataFrame:
    """(virtual_slot, shard) as of ``version``, or the latest."""
    rows = slot_map if version is None else slot_map.filter(F.col("version") <= version)
    return rows.groupBy("virtual_slot").agg(F.max_by("shard", "version").alias("shard"))


def moves(now: dict[int, int], load: dict[int, int], shards: int) -> dict[int, int]:
    """Slots to move, and where, until no move narrows the gap of the fullest and the emptiest shard.

    ``now`` maps slots to shards, ``load`` slots to bytes. Each step takes from the
    fullest shard the slot whose size comes closest to half of that gap.
    """
    import bisect

    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in now.items():
        if load.get(slot, 0):
            bisect.insort(held[shard], (load[slot], slot))
    total = [sum(b for b, _ in h) for h in held]
    moved: dict[int, int] = {}
    for _ in range(4 * max(1, len(now))):
        full, low = max(range(shards), key=lambda s: (total[s], -s)), min(range(shards), key=lambda s: (total[s], s))
        gap = total[full] - total[low]
        at = bisect.bisect_left(held[full], (gap / 2, -1))
        fits = [x for x in held[full][max(0, at - 1) : at + 1] if x[0] < gap]
        if not fits:
            break
        size, slot = min(fits, key=lambda x: abs(x[0] - gap / 2))
        held[full].remove((size, slot))
        bisect.insort(held[low], (size, slot))
        total[full] -= size
        total[low] += size
        moved[slot] = low
    return {slot: shard for slot, shard in moved.items() if now[slot] != shard}


def rebalanced(slot_map: DataFrame, slot_bytes: DataFrame, shards: int) -> DataFrame:
    """``slot_map`` with one more version: the edits that make shards near equal in bytes.

    ``slot_bytes`` has (virtual_slot, bytes), one row for each slot that holds
    anything. Slots of shards that no longer exist are moved first.
    """
    spark = slot_map.sparkSession
    now = {r.virtual_slot: r.shard for r in at_version(slot_map).collect()}
    load = {r.virtual_slot: r.bytes for r in slot_bytes.select("virtual_slot", "bytes").collect()}
    version = slot_map.agg(F.max("version")).first()[0]
    edits: dict[int, int] = {}
    if homeless := sorted((s for s, shard in now.items() if shard >= shards), key=lambda s: -load.get(s, 0)):
        sums = [0] * shards
        for slot, shard in now.items():
            if shard < shards:
                sums[shard] += load.get(slot, 0)
        heap = [(b, s) for s, b in enumerate(sums)]
        heapq.heapify(heap)
        for slot in homeless:
            size, shard = heapq.heappop(heap)
            edits[slot] = shard
            heapq.heappush(heap, (size + load.get(slot, 0), shard))
    edits |= moves(now | edits, load, shards)
    added = spark.createDataFrame([(version + 1, slot, shard) for slot, shard in sorted(edits.items())], MAP_SCHEMA)
    return slot_map.unionByName(added)


def write_map(slot_map: DataFrame, path: str | None = None) -> str:
    """Store a map as Parquet, one folder for each version; returns the path."""
    path = path or f"{shared_dir(slot_map.sparkSession).rstrip('/')}/slot-map-{uuid.uuid4().hex}"
    slot_map.repartition(1).write.partitionBy("version").parquet(path)
    return path


def read_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("version").cast("int").alias("version"), "virtual_slot", "shard")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, virtual_slot) of every row; size is the text's UTF-8 bytes plus 8."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        virtual_slot(id_col, text_col, slots).alias("virtual_slot"),
    )


def shard(docs: DataFrame, shards: int, slot_map_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Shard and place of every row, by law ``bytes``: shards near equal in bytes.

    Starts from the stored map at ``slot_map_path`` or from version 0, adds the
    version that balances the present bytes, stores the result and assigns by it.
    ``slot`` is the row's place in its shard, gapless from 0: places are counted
    within a virtual slot and shifted by what the shard's earlier slots hold, so no
    window spans a shard. A null text has no bytes. Repeated rows and ids each take a
    place. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = sized(docs, id_col, text_col, slots)
    held = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # At most `slots` rows, whatever the input: kept as a local table for the two uses below.
    held = spark.createDataFrame(held.collect(), "virtual_slot int, bytes long, n long")
    before = read_map(spark, slot_map_path) if slot_map_path else first_map(spark, shards, slots)
    path = write_map(rebalanced(before, held, shards))
    now = at_version(read_map(spark, path))
    earlier = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = held.join(now, "virtual_slot").select("virtual_slot", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("virtual_slot").orderBy(id_col, "text_crc32", "size")
    return (
        rows.withColumn("place", F.row_number().over(within) - 1)
        .join(F.broadcast(placed), "virtual_slot")
        .select(
            id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("offset") + F.col("place")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
        )
    )
