"""Sharding by fixed virtual slots.

Records hash into `SLOTS` slots once and for all; bytes are summed for each slot; a slot-to-shard map, stored by version,
says where slots lie. Rebalancing edits the map: slots stay where their shard has room up to an even share of the bytes,
largest first; the others go, largest first, to the shard with the fewest bytes. The map has `SLOTS` rows whatever the
corpus, so one row with arrays of that length decides the edits, and the map may be broadcast.

Defined results: the size of a row is its text's UTF-8 bytes (none for null) plus 8. A null doc_id is hashed with the
text like any other. Repeated rows share a slot. An empty table gives a map in which all slots have 0 bytes. Columns named
`virtual_slot` or `shard` are replaced in the rows that `sharded` returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import whole_text

SLOTS = 4096
SHARDS = 24
ROW_BYTES = 8


def text_crc(text: Column) -> Column:
    return F.crc32(text.cast("binary"))


def virtual_slot(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(doc_id, text_crc(text)), F.lit(slots)).cast("int")


def row_bytes(text: Column) -> Column:
    return (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long")


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes of every slot, empty ones included; `rows` has virtual_slot and size."""
    summed = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(summed, "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 0: slots dealt round."""
    return spark.range(slots).select(
        F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"), F.lit(0).alias("version"))


def rebalanced(old: DataFrame, loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of the map `old` for the bytes of the slots, with as many shards as asked for."""
    largest_first = Window.partitionBy("shard").orderBy(F.col("bytes").desc(), "virtual_slot")
    even = (F.sum("bytes").over(Window.partitionBy()) / F.lit(shards)).alias("even")
    known = old.join(loads, "virtual_slot").select("virtual_slot", "shard", "version", "bytes", even)
    stay = (F.sum("bytes").over(largest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)) <= F.col("even")) & (F.col("shard") < shards)
    judged = known.withColumn("stay", stay)
    kept = judged.where("stay").groupBy("shard").agg(F.sum("bytes").alias("bytes"))
    every = old.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    start = every.join(kept, "shard", "left").agg(F.array_sort(F.collect_list(
        F.struct("shard", F.coalesce("bytes", F.lit(0)).alias("bytes")))).alias("start"))
    moving = judged.agg(
        F.max("version").alias("version"),
        F.array_sort(F.collect_list(F.when(~F.col("stay"), F.struct((-F.col("bytes")).alias("less"), "virtual_slot")))).alias("moving"),
        F.collect_list(F.when(F.col("stay"), F.struct("virtual_slot", "shard"))).alias("staying"))
    placed_type = "array<struct<virtual_slot:int,shard:int>>"

    def place(state: Column, slot: Column) -> Column:
        least = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        return F.struct(
            F.transform(state["loads"], lambda load, i: F.when(i == least, load - slot["less"]).otherwise(load)).alias("loads"),
            F.concat(state["placed"], F.array(F.struct(slot["virtual_slot"].alias("virtual_slot"), least.alias("shard")))).alias("placed"))

    begin = F.struct(
        F.transform("start", lambda row: row["bytes"]).alias("loads"), F.array().cast(placed_type).alias("placed"))
    whole = moving.join(start).select(
        (F.col("version") + 1).alias("version"),
        F.concat("staying", F.aggregate("moving", begin, place, lambda state: state["placed"])).alias("cells"))
    return whole.select("version", F.explode("cells").alias("cell")).select("cell.virtual_slot", "cell.shard", "version")


def store_map(slot_map: DataFrame, folder: str) -> None:
    """Adds a version to the maps of a folder; earlier versions stay."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(folder)


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The map of a version, the latest unless named."""
    maps = spark.read.parquet(folder).select("virtual_slot", "shard", F.col("version").cast("int").alias("version"))
    chosen = maps.agg(F.max("version").alias("version")) if version is None else spark.range(1).select(F.lit(version).alias("version"))
    return maps.join(F.broadcast(chosen), "version").select("virtual_slot", "shard", "version")


def balanced_map(docs: DataFrame, folder: str, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Stores version 0 and the version edited for the bytes of `docs` in `folder`; returns the latter."""
    spark = docs.sparkSession
    store_map(first_map(spark, shards, slots), folder)
    rows = docs.select(virtual_slot(F.col("doc_id"), whole_text(), slots).alias("virtual_slot"), row_bytes(whole_text()).alias("size"))
    store_map(rebalanced(load_map(spark, folder, 0), slot_bytes(rows, slots), shards), folder)
    return load_map(spark, folder, 1)


def sharded(docs: DataFrame, slot_map: DataFrame, slots: int = SLOTS) -> DataFrame:
    """`docs` with virtual_slot and shard. No row moves: the map, of `slots` rows, is broadcast."""
    bounded = F.broadcast(slot_map.select(F.col("virtual_slot").alias("__slot"), F.col("shard").alias("__shard")))
    placed = docs.withColumn("virtual_slot", virtual_slot(F.col("doc_id"), whole_text(), slots))
    joined = placed.join(bounded, F.col("virtual_slot") == F.col("__slot"))
    return joined.drop("shard", "__slot").withColumnRenamed("__shard", "shard")


def places(rows: DataFrame) -> DataFrame:
    """`rows` (doc_id, virtual_slot, shard, size, text_crc32) with `slot`, the row's place in its shard from 0.

    Slots of a shard stand in order, rows of a slot by doc_id: only counts cross slots, so no task holds a shard.
    """
    counts = rows.groupBy("shard", "virtual_slot").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counts.select(F.col("virtual_slot").alias("__slot"), (F.sum("n").over(upto) - F.col("n")).alias("start"))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("number", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(starts), F.col("virtual_slot") == F.col("__slot")).withColumn(
        "slot", (F.col("start") + F.col("number")).cast("long")).drop("__slot", "start", "number")
