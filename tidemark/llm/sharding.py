"""Sharding through fixed virtual slots.

Every record hashes into one of ``n_slots`` virtual slots (a few thousand, fixed for the
life of the data set).  Bytes are summed per slot, and a versioned slot-to-shard map says
which shard holds a slot.  Rebalancing, or adding shards, edits the map: it moves single
slots from the fullest shard to the emptiest one and stores the result as the next version;
records never hash again.

Only the per-slot totals (``n_slots`` rows, whatever the size of the data) reach the driver.

Edge cases: a null text counts as empty (size 1); a null ``doc_id`` hashes like any value;
rows equal in id and text share a slot; an empty table gives no rows and a balanced map;
other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, scratch_path

N_SLOTS = 8192

MAP_SCHEMA = "slot int, shard int, slot_bytes long, slot_rows long, first_position long"


def slot_records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_slots)).cast("int").alias("virtual_slot"),
    )


def slot_totals(records: DataFrame, n_slots: int = N_SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot (lists of ``n_slots`` numbers)."""
    size, rows = [0] * n_slots, [0] * n_slots
    for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r.virtual_slot], rows[r.virtual_slot] = r.b, r.n
    return size, rows


def initial_map(n_slots: int, n_shards: int) -> list[int]:
    """Version 0: slots dealt round robin."""
    return [s % n_shards for s in range(n_slots)]


def rebalance(shard_of: list[int], size: list[int], n_shards: int) -> list[int]:
    """The map edited until no move or swap of single slots between the fullest and the
    emptiest shard brings the two closer.  Shards without slots (new ones) fill first."""
    shard_of = list(shard_of)
    slots: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
    load = [0] * n_shards
    for s, k in enumerate(shard_of):
        load[k] += size[s]
        if size[s]:
            slots[k].append((size[s], s))
    for x in slots:
        x.sort()
    full = [(-load[k], k) for k in range(n_shards)]
    heapq.heapify(full)

    def near(items: list[tuple[int, int]], want: float) -> list[tuple[int, int]]:
        at = bisect_left(items, (want, -1))
        return items[max(0, at - 1):at + 1]

    def move(item: tuple[int, int], a: int, b: int) -> None:
        slots[a].pop(bisect_left(slots[a], item))
        slots[b].insert(bisect_left(slots[b], item), item)
        shard_of[item[1]] = b
        load[a] -= item[0]
        load[b] += item[0]

    while True:
        a, b = max(range(n_shards), key=load.__getitem__), min(range(n_shards), key=load.__getitem__)
        gap = load[a] - load[b]
        one = [x for x in near(slots[a], gap / 2) if 0 < x[0] < gap]
        if one:
            move(min(one, key=lambda x: abs(x[0] - gap / 2)), a, b)
            continue
        best = None
        for x in slots[a]:
            for y in near(slots[b], x[0] - gap / 2):
                d = x[0] - y[0]
                if 0 < d < gap and (best is None or abs(d - gap / 2) < best[0]):
                    best = (abs(d - gap / 2), x, y)
        if best is None:
            return shard_of
        move(best[1], a, b)
        move(best[2], b, a)


def store_map(spark: SparkSession, path: str, version: int, shard_of: list[int], size: list[int],
              rows: list[int]) -> None:
    """Write one version of the map; ``first_position`` is the slot's first row number in its shard."""
    at: dict[int, int] = {}
    out = []
    for s, k in enumerate(shard_of):
        out.append((s, k, size[s], rows[s], at.get(k, 0)))
        at[k] = at.get(k, 0) + rows[s]
    spark.createDataFrame(out, MAP_SCHEMA).coalesce(1).write.parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version={version}")


def place(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard and gapless position of each record.  The map has ``n_slots`` rows, so it is broadcast;
    positions are numbered inside a virtual slot and moved by the slot's offset in its shard."""
    in_slot = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (records.withColumn("_n", F.row_number().over(in_slot) - 1)
            .join(F.broadcast(slot_map.withColumnRenamed("slot", "virtual_slot")), "virtual_slot")
            .withColumn("position", F.col("_n") + F.col("first_position")).drop("_n"))


def shard_documents(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS,
                    map_path: str | None = None) -> DataFrame:
    """Place all rows: version 0 of the map deals slots round robin, version 1 is edited to equal
    bytes; both are stored under ``map_path`` (default: a new folder in the shared one).

    Columns: doc_id, size, text_crc32, virtual_slot, shard, slot_bytes, slot_rows, first_position, position.
    """
    spark = docs.sparkSession
    map_path = map_path or scratch_path(spark, "slot_map")
    records = save(slot_records(docs, n_slots), "slot_records")
    size, rows = slot_totals(records, n_slots)
    first = initial_map(n_slots, n_shards)
    store_map(spark, map_path, 0, first, size, rows)
    store_map(spark, map_path, 1, rebalance(first, size, n_shards), size, rows)
    return place(records, load_map(spark, map_path, 1))
