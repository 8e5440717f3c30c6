"""Sharding by fixed virtual slots, in DataFrame functions only.

Records are hashed into a fixed number of slots; bytes are summed per slot; a stored, versioned table maps
slots to shards. Rebalancing writes a new version in which only those slots move that no longer fit.

Sums are aggregated map-side. What is gathered in one place is the slot table, whose size is the fixed number of
slots. Slots take the hash of the whole record, so one hot id or text with other values beside it spreads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hazeflow.llm.frames import col
from hazeflow.scratch import materialize

SLOTS = 4096
SHARDS = 8
LAW = "bytes"


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot): UTF-8 bytes plus one; a null text has none, and checksum 0."""
    text = col(text_col).cast("string")
    return docs.select(
        col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"),
        F.pmod(F.xxhash64(col(id_col), text), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes, n): every slot, empty ones too."""
    summed = rows.groupBy(F.col("virtual_slot").alias("used")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    zero = F.lit(0).cast("long")
    joined = every.join(summed, F.col("virtual_slot") == F.col("used"), "left")
    return joined.select("virtual_slot", F.coalesce("bytes", zero).alias("bytes"), F.coalesce("n", zero).alias("n"))


def _dealt(sizes: DataFrame, shards: int, room: Column) -> DataFrame:
    """(virtual_slot, shard): largest slots first, each stays on `old` if that leaves it within `room`, else goes to the
    emptiest shard. One row of fixed size holds the slot table."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "old")))
    listed = sizes.agg(ordered.alias("slots"), F.sum("bytes").alias("total"))
    loads = F.array_repeat(F.lit(0).cast("long"), shards)
    start = F.struct(loads.alias("loads"), F.expr("cast(array() as array<int>)").alias("shards"))

    def put(state: Column, slot: Column) -> Column:
        size, old = -slot["less"], slot["old"]
        emptiest = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        stays = F.coalesce((old < shards) & (F.get(state["loads"], old) + size <= room), F.lit(False))
        target = F.when(stays, old).otherwise(emptiest)
        filled = F.transform(state["loads"], lambda x, i: F.when(i == target, x + size).otherwise(x))
        return F.struct(filled.alias("loads"), F.concat(state["shards"], F.array(target)).alias("shards"))

    dealt = listed.select("slots", F.aggregate("slots", start, put)["shards"].alias("shards"))
    pairs = dealt.select(F.explode(F.arrays_zip(F.col("slots.virtual_slot").alias("virtual_slot"), F.col("shards").alias("shard"))).alias("p"))
    return pairs.select("p.virtual_slot", "p.shard")


def first_map(sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(version 0, virtual_slot, shard, shards) with near equal bytes on all `shards`."""
    dealt = _dealt(sizes.withColumn("old", F.lit(None).cast("int")), shards, F.lit(0).cast("double"))
    return dealt.select(F.lit(0).alias("version"), "virtual_slot", "shard", F.lit(shards).alias("shards"))


def rebalanced(slot_map: DataFrame, sizes: DataFrame, shards: int, slack: float = 0.0) -> DataFrame:
    """The next version: slots move only from shards over their fair share (plus `slack`) or no longer there."""
    last = slot_map.select(F.col("virtual_slot").alias("slot"), F.col("shard").alias("old"), "version")
    joined = sizes.join(last, F.col("virtual_slot") == F.col("slot"), "left")
    room = F.col("total") * (1 + slack) / shards
    dealt = _dealt(joined, shards, room)
    version = last.agg((F.max("version") + 1).alias("version")).first()[0]
    return dealt.select(F.lit(version).alias("version"), "virtual_slot", "shard", F.lit(shards).alias("shards"))


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored map."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def stored_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the last one by default."""
    versions = spark.read.schema("virtual_slot int, shard int, shards int, version int").parquet(path)
    if version is None:
        version = versions.agg(F.max("version")).first()[0]
    return versions.filter(F.col("version") == version).select("version", "virtual_slot", "shard", "shards")


def placed(rows: DataFrame, sizes: DataFrame, slot_map: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot), a row per record.

    `slot` numbers a shard's records without gaps from 0: virtual slots in order, and in a virtual slot by id,
    checksum and size. The law is `bytes`, so `grown_shard` is null. Equal rows take neighbouring numbers; they are
    counted before any shuffle. Null ids are records like others. An empty table gives none.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    begin = sizes.join(slot_map.select("virtual_slot", "shard"), "virtual_slot").withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0)))
    begin = begin.select(F.col("virtual_slot").alias("mapped"), "shard", "begin")
    alike = rows.groupBy("virtual_slot", "doc_id", "text_crc32", "size").agg(F.count(F.lit(1)).alias("copies"))
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = alike.withColumn("at", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    # the map has a fixed number of rows
    joined = numbered.join(F.broadcast(begin), F.col("virtual_slot") == F.col("mapped"))
    first = F.col("begin") + F.col("at")
    return joined.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
        F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


def sharded(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """All records of `docs` placed by the map stored under `path`, whose first version is written if there is none yet.

    A stored map of another number of slots or shards is refused: rebalance it first. One writer of the first version at a
    time. Equal rows share a slot, so very many copies of one row make its shard larger than the others. Other columns
    of `docs` are ignored.
    """
    spark = docs.sparkSession
    rows = records(docs, id_col, text_col, slots)
    sizes = materialize(slot_sizes(rows, slots), "slot-sizes")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        store_map(first_map(sizes, shards), path)
    last = stored_map(spark, path)
    held = last.agg(F.count(F.lit(1)), F.max("shards")).first()
    if tuple(held) != (slots, shards):
        raise ValueError(f"the stored map has {held[0]} slots on {held[1]} shards, not {slots} on {shards}")
    return placed(rows, sizes, last)
