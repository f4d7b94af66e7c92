"""Sharding by fixed virtual slots. DataFrame functions only.

Records hash into ``n_slots`` virtual slots, a number that never changes. Bytes are summed per slot, and a
versioned map gives each slot its shard. Rebalancing edits the map alone: records keep their slots, and only the
slots whose entry changed move.

Null texts count as empty, null ids hash like any value, repeated rows share a slot, an empty table gives no rows;
columns beside ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideflow.llm.common import checkpointed, new_folder, text_bytes

N_SLOTS = 8192


def records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 8), text_crc32, virtual_slot. Texts stay in the scan."""
    raw = text_bytes(docs["text"])
    rows = docs.select(docs["doc_id"], (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int"))


def slot_loads(rows: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """Rows and bytes of every slot, empty ones too: n_slots rows, whatever the input."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("slot_bytes"), F.count("*").alias("slot_rows"))
    slots = rows.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return slots.join(sums, "virtual_slot", "left").fillna(0, ["slot_bytes", "slot_rows"])


def _largest_first(loads: DataFrame, start: Column) -> DataFrame:
    """Give each slot, largest first, to the shard with the least bytes: a fold over one array of n_slots entries."""

    def put(acc, slot):
        at = F.array_position(acc["load"], F.array_min(acc["load"]))
        load = F.transform(acc["load"], lambda v, i: F.when(i == at - 1, v + slot["slot_bytes"]).otherwise(v))
        shard = F.struct(slot["virtual_slot"].alias("virtual_slot"), (at - 1).cast("int").alias("shard"))
        return F.struct(load.alias("load"), F.array_append(acc["made"], shard).alias("made"))

    slots = F.sort_array(F.collect_list(F.struct("slot_bytes", "virtual_slot")), asc=False)
    rows = loads.agg(slots.alias("slots"), start.alias("start"))
    begin = F.struct(F.col("start").alias("load"), F.array().cast("array<struct<virtual_slot:int,shard:int>>").alias("made"))
    return rows.select(F.aggregate("slots", begin, put)["made"].alias("made")).select(F.inline("made"))


def slot_map(loads: DataFrame, n_shards: int, version: int = 1) -> DataFrame:
    """version, virtual_slot, shard: shards near equal in bytes."""
    start = F.array_repeat(F.lit(0).cast("long"), n_shards)
    return _largest_first(loads, start).select(F.lit(version).alias("version"), "virtual_slot", "shard")


def rebalance(old: DataFrame, loads: DataFrame, n_shards: int, slack: float = 0.02) -> DataFrame:
    """The next version of a map: slots stay where they are while their shard is under its share, the rest move.

    Shards beyond ``n_shards`` are emptied; new shards take what others give up.
    """
    both = old.select("version", "virtual_slot", "shard").join(loads, "virtual_slot")
    share = F.sum("slot_bytes").over(Window.partitionBy("version")) * (1 + slack) / n_shards
    before = F.sum("slot_bytes").over(Window.partitionBy("shard").orderBy(F.desc("slot_bytes"), "virtual_slot"))
    marked = both.withColumn("share", share).withColumn("stays", (before <= F.col("share")) & (F.col("shard") < n_shards))
    version = (F.max("version") + 1).alias("version")
    kept = marked.where("stays").groupBy("shard").agg(F.sum("slot_bytes").alias("kept_bytes"))
    shards = old.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard")).join(kept, "shard", "left")
    loads_now = shards.agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", F.coalesce("kept_bytes", F.lit(0)).alias("b")))), lambda x: x["b"]).alias("now"))
    moving = marked.where("not stays").crossJoin(F.broadcast(loads_now))  # one row
    moved = _largest_first(moving, F.first("now"))
    edited = marked.where("stays").select("virtual_slot", "shard").unionByName(moved)
    return edited.crossJoin(F.broadcast(old.agg(version))).select("version", "virtual_slot", "shard")  # one row


def first_map(spark, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 1: slots dealt in turn, before any bytes are known."""
    slot = F.col("id").cast("int")
    return spark.range(n_slots).select(F.lit(1).alias("version"), slot.alias("virtual_slot"), F.pmod(slot, F.lit(n_shards)).alias("shard"))


def save_map(new: DataFrame, folder: str) -> None:
    """Add a version to the stored maps; earlier ones stay readable."""
    new.write.mode("append").partitionBy("version").parquet(folder)


def load_map(spark, folder: str, version: int | None = None) -> DataFrame:
    maps = spark.read.parquet(folder).select("version", "virtual_slot", "shard")
    wanted = maps.agg(F.max("version").alias("version")) if version is None else spark.createDataFrame([(version,)], "version int")
    return maps.join(F.broadcast(wanted), "version")  # one row


def shard(docs: DataFrame, n_shards: int = 24, n_slots: int = N_SLOTS, maps: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    ``maps`` is the folder of the stored map: its last version (a new folder gets ``first_map``) is rebalanced by the bytes
    of the slots, stored as the next version and read back. ``slot`` is the row's place in its shard, gapless from 0: places
    are counted per virtual slot, whose first place comes from the rows of the slots before it, so no task ever sorts a
    whole shard. Texts are read once; what follows works on their sizes and checksums.
    """
    spark = docs.sparkSession
    rows = checkpointed(records(docs, n_slots))
    loads = checkpointed(slot_loads(rows, n_slots))
    if maps is None:
        maps = new_folder(spark, "shard-maps")
        save_map(first_map(spark, n_shards, n_slots), maps)
    save_map(rebalance(load_map(spark, maps), loads, n_shards, slack=0.0), maps)
    placed = load_map(spark, maps).join(loads, "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("first_place", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)))
    placed = placed.select("virtual_slot", "shard", "first_place", F.col("version").alias("map_version"))
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("place", place).join(placed, "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first_place") + F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )
