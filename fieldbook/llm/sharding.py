"""Sharding over fixed virtual slots, in DataFrame functions alone.

A record's hash puts it into one of some thousand slots, for good. Bytes and rows are summed by slot, and a map,
a small table with a version, names the shard of every slot. Rebalancing edits the map: slots stay where they are as long
as their shard is within its even part of the bytes, and the surplus slots (the smallest ones) go to the least loaded
shards, largest first. Adding shards is the same edit with more shards. Every version of the map is written to a store; a later run
reads the newest one, counts its own bytes into it, edits it and writes the next.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldbook.session import checkpoint_folder, settled

SLOTS = 4096
MAP_SCHEMA = "version int, virtual_slot int, shard int, bytes bigint"


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, virtual_slot). Size: UTF-8 bytes of the text (null: none) plus 1.

    The hash takes the id and the text's checksum, so that rows that share an id (or have none) spread too; only
    rows that are equal in both share a slot for certain.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    got = docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return got.withColumn("virtual_slot", F.pmod(F.xxhash64(F.col(id_col), F.col("text_crc32")), F.lit(slots)).cast("int"))


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes, rows) for every slot, empty ones too: a table of `slots` rows whatever the input."""
    spark = rows.sparkSession
    spine = spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    held = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    return spine.join(F.broadcast(held), "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows"))


def first_map(sizes: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: (version, virtual_slot, shard, bytes), equal ranges of slots."""
    return sizes.select(F.lit(1).alias("version"), "virtual_slot", F.floor(F.col("virtual_slot") * shards / slots).cast("int").alias("shard"), "bytes")


def write_map(chosen: DataFrame, store: str) -> None:
    """Adds one version of a map to the store, a folder that all machines reach: a folder of its own for each version.

    A version that is there already raises AnalysisException (PATH_ALREADY_EXISTS), so of two runs that edit one map the later one fails.
    """
    version = chosen.first()["version"]
    own = chosen.select(F.col("virtual_slot").cast("int"), F.col("shard").cast("int"), F.col("bytes").cast("bigint"))
    own.coalesce(1).write.mode("errorifexists").parquet(f"{store}/version={version}")


def read_map(spark: SparkSession, store: str, version: int | None = None) -> DataFrame | None:
    """A version of the stored map (none given: the newest); None if the store doesn't hold it. Nothing is written."""
    try:
        held = spark.read.schema(MAP_SCHEMA).parquet(store)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    known = held.agg(F.max("version")).first()[0] if version is None else version
    found = held.where(F.col("version") == known).select(*(x.split()[0] for x in MAP_SCHEMA.split(", ")))
    return None if known is None or found.isEmpty() else found


def rebalanced(old: DataFrame, shards: int) -> DataFrame:
    """The next version of a slot map, with bytes near equal over shards 0 to shards - 1; few slots move.

    The table has a fixed number of rows (the slots), so its windows and the one row that the fold below sees are
    of bounded size whatever the data.
    """
    even = F.sum("bytes").over(Window.partitionBy()) / shards
    order = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    judged = old.withColumn("stays", (F.sum("bytes").over(order) <= even) & (F.col("shard") < shards)).withColumn("version", F.col("version") + 1)
    loads = judged.where("stays").groupBy("shard").agg(F.sum("bytes").alias("load"))
    base = judged.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(F.broadcast(loads), "shard", "left")
    base = base.agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", F.coalesce("load", F.lit(0)).alias("load")))), lambda x: x["load"]).alias("loads"))
    moving = judged.where("not stays").agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot"))).alias("moving"))

    def put(state, item):
        to = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int")
        loads = F.transform(state["loads"], lambda x, i: F.when(i + 1 == to, x - item["less"]).otherwise(x))
        return F.struct(loads.alias("loads"), F.concat(state["moved"], F.array(F.struct(item["virtual_slot"].alias("virtual_slot"), (to - 1).alias("to")))).alias("moved"))

    start = F.struct(F.col("loads"), F.expr("cast(array() as array<struct<virtual_slot:int,to:int>>)").alias("moved"))
    moved = base.crossJoin(moving).select(F.explode(F.aggregate("moving", start, put)["moved"]).alias("m")).select("m.*")
    return judged.join(F.broadcast(moved), "virtual_slot", "left").select("version", "virtual_slot", F.coalesce("to", "shard").alias("shard"), "bytes")


def next_map(sizes: DataFrame, shards: int, store: str, slots: int = SLOTS) -> DataFrame:
    """The newest stored map with the bytes of `sizes`, edited for `shards` shards, as it was written to the store and read back.

    An empty store gets the map of even ranges first, as version 1. A stored map of another number of slots raises ValueError.
    """
    spark = sizes.sparkSession
    old = read_map(spark, store)
    if old is None:
        write_map(first_map(sizes, shards, slots), store)
        old = read_map(spark, store)
    if old.count() != slots:
        raise ValueError(f"the stored map has {old.count()} slots, not {slots}")
    now = old.drop("bytes").join(F.broadcast(sizes.select("virtual_slot", "bytes")), "virtual_slot").select("version", "virtual_slot", "shard", "bytes")
    version = old.first()["version"] + 1
    write_map(rebalanced(now, shards), store)
    return read_map(spark, store, version)


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, store: str | None = None) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version) for every row.

    The law is `bytes`: the sizes of the shards are near equal, as far as single slots allow. slot is the
    row's place in its shard, without gaps from 0. store: a folder with the versions of the slot map (none: a new one under the
    checkpoint folder); the newest is edited for these rows and becomes the next version, so slots stay where they are unless their
    shard is over its part. Null ids and texts, very long texts, repeated rows and an empty table are fine; columns
    other than the two don't matter. A place is found by counting within (virtual slot, part), where a part is one of
    16 by the row's place in the input, plus what the parts before it hold; no task sees a whole shard, even of equal rows.
    """
    parts = 16
    spark = docs.sparkSession
    store = store or f"{checkpoint_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    rows = settled(sized(docs, id_col, text_col, slots).withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")))
    cells = settled(rows.groupBy("virtual_slot", "part").agg(F.sum("size").alias("size"), F.count("*").alias("rows")))
    chosen = next_map(slot_sizes(cells.drop("rows"), slots), shards, store, slots)
    # At most slots * parts rows: small enough for a window by shard and for a broadcast.
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    places = settled(cells.join(F.broadcast(chosen.select("virtual_slot", "shard", "version")), "virtual_slot").select("virtual_slot", "part", "shard", F.col("version").alias("map_version"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base")))
    within = Window.partitionBy("virtual_slot", "part").orderBy(F.col(id_col), "text_crc32", "size")
    placed = rows.withColumn("n", F.row_number().over(within)).join(F.broadcast(places), ["virtual_slot", "part"])
    return placed.select(F.col(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("n") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
