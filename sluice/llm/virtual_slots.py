"""Sharding by fixed virtual slots.

Every record hashes into one of a few thousand slots. Bytes and rows are summed
per slot, and a versioned map gives each slot a shard. The hash never changes;
rebalancing edits the map alone, so the records that move are those of the moved
slots.

The map has as many rows as there are slots, whatever the corpus, so it may be
planned on the driver and broadcast.

Defined cases: a null text has 0 bytes (size 1) and the CRC of the empty string;
a null id hashes as its text; equal rows share a slot and get different
positions; an empty table gives a map of empty slots; extra columns pass through
where asked for, and those with names of the operator's own come out with "_in"
appended. Equal texts are spread like any rows: a slot is a hash of the id, so that
a group of copies with a third of all bytes fills no single shard.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, set_aside

N_SLOTS = 4096
MAP_SCHEMA = "vslot int, shard int, bytes long, rows long, first_position long"
OUT = ("size", "text_crc32", "vslot", "shard", "slot", "map_version")


def record_slot(key: str, text: str, n_slots: int = N_SLOTS) -> Column:
    """The slot of a record: a hash of its key, or of its text where the key is null."""
    return F.pmod(F.coalesce(F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key))), F.xxhash64(F.col(text))), F.lit(n_slots)).cast("int")


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), n_slots: int = N_SLOTS) -> DataFrame:
    """Key, size in bytes plus one, CRC and slot of every record; the text itself goes no further unless kept."""
    docs, names = set_aside(docs, (*OUT, "_in_slot", "first_position"))
    key, text, keep = names[key], names[text], tuple(names[c] for c in keep)
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key), *keep,
        (F.octet_length(whole) + F.lit(1)).cast("long").alias("size"),
        F.crc32(whole).alias("text_crc32"),
        record_slot(key, text, n_slots).alias("vslot"),
    )


def slot_loads(records: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows): at most one row per slot reaches the driver."""
    rows = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    return sorted((r["vslot"], r["bytes"], r["rows"]) for r in rows)


def plan_map(loads: list[tuple[int, int, int]], n_shards: int, n_slots: int = N_SLOTS) -> dict[int, int]:
    """First map: the heaviest slot goes to the lightest shard; empty slots are dealt round."""
    heap = [(0, 0, s) for s in range(n_shards)]
    heapq.heapify(heap)
    shard_of: dict[int, int] = {}
    for slot, size, rows in sorted(loads, key=lambda x: (-x[1], x[0])):
        filled, count, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (filled + size, count + rows, shard))
    for slot in range(n_slots):
        shard_of.setdefault(slot, slot % n_shards)
    return shard_of


def rebalance(shard_of: dict[int, int], loads: list[tuple[int, int, int]], n_shards: int, tolerance: float = 0.02) -> dict[int, int]:
    """An edited map: slots leave the fullest shard for the emptiest until all lie within the tolerance.

    Every move lowers the distance between two shards, so it ends; slots that
    need not move keep their shard. A larger ``n_shards`` adds empty shards.
    """
    size = {slot: b for slot, b, _ in loads}
    total = [0] * n_shards
    held: list[list[int]] = [[] for _ in range(n_shards)]
    out = dict(shard_of)
    for slot, shard in out.items():
        total[shard] += size.get(slot, 0)
        held[shard].append(slot)
    mean = sum(total) / n_shards
    stuck: set[int] = set()  # shards of slots that are each too large to move
    while len(stuck) < n_shards:
        full, empty = max((s for s in range(n_shards) if s not in stuck), key=total.__getitem__), min(range(n_shards), key=total.__getitem__)
        gap = total[full] - total[empty]
        if gap <= tolerance * mean:
            break
        fitting = [s for s in held[full] if 0 < size.get(s, 0) < gap]
        if not fitting:
            stuck.add(full)
            continue
        moved = min(fitting, key=lambda s: (abs(2 * size[s] - gap), s))
        held[full].remove(moved)
        held[empty].append(moved)
        total[full] -= size[moved]
        total[empty] += size[moved]
        out[moved] = empty
    return out


def publish(spark: SparkSession, path: str, version: int, shard_of: dict[int, int], loads: list[tuple[int, int, int]]) -> DataFrame:
    """Write one version of the map; versions are never changed once written."""
    load = {slot: (b, n) for slot, b, n in loads}
    first: dict[int, int] = {}
    rows = []
    for slot, shard in sorted(shard_of.items()):
        size, count = load.get(slot, (0, 0))
        rows.append((slot, shard, size, count, first.get(shard, 0)))
        first[shard] = first.get(shard, 0) + count
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("error").parquet(f"{path}/version={version}")
    return read_map(spark, path, version)


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version={version}")


def place(records: DataFrame, slot_map: DataFrame, version: int, key: str = "doc_id") -> DataFrame:
    """Shard of each record and its position in the shard, gapless from 0.

    A shard's positions are its slots' row counts laid end to end, so only the
    rows of one slot are ever ordered together, never those of a shard.
    """
    within = Window.partitionBy("vslot").orderBy(F.col(key), "text_crc32", "size")
    return (
        records.withColumn("_in_slot", F.row_number().over(within) - 1)
        .join(F.broadcast(slot_map.select("vslot", "shard", "first_position")), "vslot")
        .withColumn("slot", (F.col("first_position") + F.col("_in_slot")).cast("long"))
        .withColumn("map_version", F.lit(version))
        .drop("_in_slot", "first_position")
    )


def rebalance_documents(docs: DataFrame, path: str, version: int, n_shards: int, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), n_slots: int = N_SLOTS, tolerance: float = 0.0) -> DataFrame:
    """Measure the slots, edit version ``version`` of the map to even loads, publish it as the next version and place every record by that."""
    records = measured(docs, key, text, keep, n_slots)
    loads = slot_loads(records)
    before = {r["vslot"]: r["shard"] for r in read_map(docs.sparkSession, path, version).collect()}  # one row per slot
    after = rebalance(before, loads, n_shards, tolerance)
    return place(records, publish(docs.sparkSession, path, version + 1, after, loads), version + 1, records.columns[0])


def shard_documents(docs: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """A new map, slots dealt round (version 0), edited to the slots' loads (version 1), and every record placed by it."""
    path = map_path or new_path(docs.sparkSession, "slotmap")
    publish(docs.sparkSession, path, 0, plan_map([], n_shards, n_slots), [])
    return rebalance_documents(docs, path, 0, n_shards, key, text, keep, n_slots)


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard; rows of one slot stay together, so files follow slots."""
    placed.repartition("shard", "vslot").sortWithinPartitions("shard", "slot").write.mode("error").partitionBy("shard").parquet(path)
