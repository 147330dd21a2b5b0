"""Sharding by fixed virtual slots, in DataFrame operations only.

Records are hashed into a fixed number of virtual slots. Bytes are summed per slot, and a versioned map from slot to shard says
where a slot's records live. Rebalancing edits the map - whole slots move, records are never hashed anew - and writes it as the
next version. The map has one entry per slot, a number fixed by a parameter, so it may pass through the driver.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barloom.session import fresh_dir, stage

SLOTS = 6144
#: A map stays as it is while no shard is over the mean by more than this share.
TOLERANCE = 0.001


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record's key; null has one too."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text plus 8 for the id; null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def first_map(slots: int, shards: int) -> list[int]:
    """Version 0: equal runs of slots."""
    return [s * shards // slots for s in range(slots)]


def rebalanced(current: list[int], slot_bytes: dict[int, int], shards: int) -> list[int]:
    """The next version: as few slots move as keep each shard near the mean.

    Shards above the mean give up their largest slots that are not larger than their excess; these, largest first, go to the
    shard with the fewest bytes. A last pass swaps what the greedy step left uneven: the smallest move that narrows the gap
    between the fullest and the emptiest shard, until none does.
    """
    mine: list[dict[int, int]] = [{} for _ in range(shards)]
    for slot, shard in enumerate(current):
        mine[shard][slot] = slot_bytes.get(slot, 0)
    load = [sum(m.values()) for m in mine]
    mean = sum(load) / shards
    if max(load) <= mean * (1 + TOLERANCE):
        return current
    moved: list[tuple[int, int]] = []
    for shard in range(shards):
        for slot, size in sorted(mine[shard].items(), key=lambda x: (-x[1], x[0])):
            if size and load[shard] - size >= mean:
                load[shard] -= size
                moved.append((size, slot))
                del mine[shard][slot]
        rest = sorted(((size, slot) for slot, size in mine[shard].items() if size))
        if load[shard] > mean and len(rest) > 1:                # one more small slot, to end below the mean
            size, slot = rest[0]
            load[shard] -= size
            moved.append((size, slot))
            del mine[shard][slot]
    heap = [(b, s) for s, b in enumerate(load)]
    heapq.heapify(heap)
    for size, slot in sorted(moved, key=lambda x: (-x[0], x[1])):
        low, shard = heapq.heappop(heap)
        mine[shard][slot] = size
        heapq.heappush(heap, (low + size, shard))
    load = [sum(m.values()) for m in mine]
    for _ in range(len(current)):
        high, low = max(range(shards), key=lambda s: (load[s], s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        best = min(((abs(gap - 2 * (a - b)), x, y) for x, a in [*mine[high].items()] for y, b in [(-1, 0), *_near(mine[low], a - gap / 2)]
                    if 0 < a - b < gap), default=None)
        if best is None or gap - best[0] < 1:
            break
        _, x, y = best
        a, b = mine[high].pop(x), mine[low].pop(y, 0)
        mine[low][x] = a
        if y >= 0:
            mine[high][y] = b
        load[high] += b - a
        load[low] += a - b
    return [shard for _, shard in sorted((slot, s) for s, m in enumerate(mine) for slot in m)]


def _near(sizes: dict[int, int], wanted: float) -> list[tuple[int, int]]:
    return sorted(sizes.items(), key=lambda x: (abs(x[1] - wanted), x[0]))[:1]


def slot_table(spark, current: list[int], version: int) -> DataFrame:
    """One version of the map as rows (version, virtual_slot, shard)."""
    listed = F.lit(",".join(map(str, current)))
    return spark.range(1).select(F.lit(version).alias("version"), F.posexplode(F.split(listed, ",")).alias(
        "virtual_slot", "shard")).withColumn("shard", F.col("shard").cast("int"))


def write_map(spark: SparkSession, path: str, current: list[int], version: int) -> None:
    """Stores a version of the map; others stay, and writing it again replaces it."""
    slot_table(spark, current, version).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int]] | None:
    """(version, shard of each virtual slot) of a stored version, or of the newest; None if it is not there."""
    try:
        saved = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    except AnalysisException:
        return None
    newest = saved.agg(F.max("version")).first()[0] if version is None else version
    found = saved.filter(F.col("version") == newest).collect() if newest is not None else []         # one row a virtual slot
    return (newest, [r.shard for r in sorted(found, key=lambda r: r.virtual_slot)]) if found else None


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law (``bytes``), shard, slot (place in its shard), virtual_slot, map_version.

    The map lies at ``map_path`` (by default in a new folder, which begins with version 0). The newest stored version is rebalanced for
    the table's bytes and stored as the next version if a slot moves. A map for another number of slots or shards is an error.
    Null text has no bytes; repeated rows are records of their own, in the same virtual slot; an empty table moves nothing. Places are
    numbered inside the virtual slots (thousands of small windows) and shifted by the rows of the shard's earlier slots, so no task
    holds a shard.
    """
    spark = docs.sparkSession
    records = stage(docs.select(
        "doc_id", record_size(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        virtual_slot(F.col("doc_id"), slots).alias("virtual_slot")), "records")
    loads = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()   # <= slots rows
    path = map_path or fresh_dir(spark, "slot-map")
    if read_map(spark, path) is None:
        write_map(spark, path, first_map(slots, shards), 0)
    version, stored = read_map(spark, path)
    if len(stored) != slots or max(stored) >= shards:
        raise ValueError(f"the map at {path} is not for {slots} slots and {shards} shards")
    final = rebalanced(stored, {r.virtual_slot: r.bytes for r in loads}, shards)
    if final != stored:
        version += 1
        write_map(spark, path, final, version)
    rows = {r.virtual_slot: r.rows for r in loads}
    offsets, seen = [], [0] * shards
    for s in range(slots):
        offsets.append(seen[final[s]])
        seen[final[s]] += rows.get(s, 0)
    latest = slot_table(spark, final, version).select("virtual_slot", "shard", F.element_at(
        F.split(F.lit(",".join(map(str, offsets))), ","), F.col("virtual_slot") + 1).cast("long").alias("before"))
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")) - 1
    return records.withColumn("place", place).join(F.broadcast(latest), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version"))
