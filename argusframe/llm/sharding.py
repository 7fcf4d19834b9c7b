"""Operator 3 (DataFrame functions only): sharding over fixed virtual slots.

A record's key is hashed into one of a fixed number of virtual slots. Bytes are summed per slot, and a versioned map,
one row a slot, says which shard holds the slot. Rebalancing edits the map: version n + 1 keeps a slot where it is
unless its shard is over its fair share. Everything the size of the map is bounded by the slot count, not by the data.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialise, shared_dir, text_or_empty

SLOTS = 4096
#: Each slot is numbered in so many parts, so that no task sorts a whole slot.
PARTS = 16


def slot_of(record: Column, slots: int = SLOTS) -> Column:
    """The virtual slot: the first 32 bits of the MD5 of the record's text."""
    return (F.conv(F.substring(F.md5(record), 1, 8), 16, 10).cast("bigint") % slots).cast("int")


def _part_of(record: Column) -> Column:
    return (F.conv(F.substring(F.md5(record), 9, 8), 16, 10).cast("bigint") % PARTS).cast("int")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, vslot, part, n): the size is the UTF-8 bytes of the text plus one; a null text has none.

    A record is its id and the CRC-32 of its text, so an id that many texts share is no hot slot. n equal records are one row.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text).alias("text_crc32")).groupBy("id", "size", "text_crc32").agg(F.count("*").alias("n"))
    record = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"))
    return rows.select("id", "size", "text_crc32", slot_of(record, slots).alias("vslot"), _part_of(record).alias("part"), "n")


def first_map(rows: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1 of a map, whatever the data: slot modulo shards. (version, vslot, shard, bytes)"""
    sums = rows.groupBy("vslot").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(sums, "vslot", "left").select(F.lit(1).alias("version"), "vslot", (F.col("vslot") % shards).cast("int").alias("shard"), F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"))


def rebalanced(old: DataFrame, shards: int) -> DataFrame:
    """The next version of a map: slots by falling bytes stay where they are while their shard has room for them
    under its fair share, else go to the shard with the least bytes. A slot whose shard no longer exists moves.

    One ordered fold over an array of all slots: its length is the fixed slot count.
    """
    zero = F.struct(F.array_repeat(F.lit(0).cast("bigint"), shards).alias("load"), F.array().cast("array<int>").alias("to"))

    def step(acc: Column, x: Column) -> Column:
        load, own = acc["load"], x["shard"]
        held = F.get(load, own)
        least = F.array_position(load, F.array_min(load)).cast("int") - 1
        to = F.when(held.isNotNull() & ((x["bytes"] == 0) | (held + x["bytes"] <= x["share"])), own).otherwise(least)
        after = F.transform(load, lambda v, i: F.when(i == to, v + x["bytes"]).otherwise(v))
        return F.struct(after.alias("load"), F.concat(acc["to"], F.array(to)).alias("to"))

    one = old.agg(F.collect_list(F.struct((-F.col("bytes")).alias("order"), "vslot", "shard", "bytes")).alias("all"), F.sum("bytes").alias("total"), F.max("version").alias("version"))
    one = one.select((F.col("version") + 1).alias("version"), F.expr(f"transform(array_sort(all), x -> struct(x.vslot AS vslot, x.shard AS shard, x.bytes AS bytes, total DIV {shards} AS share))").alias("all"))
    one = one.select("version", "all", F.aggregate("all", zero, step)["to"].alias("to"))
    return one.select("version", F.explode(F.arrays_zip("all", "to")).alias("x")).select("version", F.col("x.all.vslot").alias("vslot"), F.col("x.to").alias("shard"), F.col("x.all.bytes").alias("bytes"))


def grown(old: DataFrame, shards: int) -> DataFrame:
    """The next version with shard number `shards` added: each old shard gives it the slots past its share, and none else move.

    Within a shard slots are taken by falling hash of the slot until its share for shards + 1 is met.
    """
    w = Window.partitionBy("shard").orderBy(F.xxhash64("vslot"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("bytes").over(w)
    whole = F.sum("bytes").over(Window.partitionBy("shard"))
    return old.select((F.col("version") + 1).alias("version"), "vslot", F.when(upto > F.ceil(whole * shards / (shards + 1)), F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"), "bytes")


def store_map(slot_map: DataFrame, path: str) -> None:
    """Append a version to the stored map; a version that is there already is an error."""
    slot_map = materialise(slot_map, "shard-map")
    found = slot_map.agg(F.max("version")).first()[0]
    slot_map.drop("version").write.mode("errorifexists").parquet(f"{path}/version={found}")
    discard(slot_map)


def stored_map(spark, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the latest if none is named."""
    every = spark.read.parquet(path)
    return every.where(F.col("version") == (every.agg(F.max("version")).first()[0] if version is None else version))


def placed(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """rows of sized() with their shard and their place in it, gapless from 0 in order of slot, part and id.

    The number of rows in each slot and part gives every part's first place; a window adds up one part at a time, whose
    rows are narrow, differ and are a 65,536th of all that differ. Equal records take places in a row. The map and the counts have at most one row for
    each slot and part, and so are broadcast.
    """
    rows = rows.join(F.broadcast(slot_map.select("vslot", "shard")), "vslot")
    counts = rows.groupBy("shard", "vslot", "part").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("vslot", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("first"))
    own = Window.partitionBy("vslot", "part").orderBy("id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.withColumn("before", F.coalesce(F.sum("n").over(own), F.lit(0))).join(F.broadcast(firsts), ["vslot", "part"])
    each = F.explode(F.sequence(F.col("first") + F.col("before"), F.col("first") + F.col("before") + F.col("n") - 1))
    return before.select("id", "size", "text_crc32", "shard", each.alias("slot"), "vslot")


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> DataFrame:
    """(id, size, text_crc32, shard, slot, vslot, map_version): documents in shards of nearly equal bytes.

    The law is `bytes`: records are dealt one by one, so that groups of equal texts, however large, are spread over shards; only
    equal records (one id and one text) stay together. A null id counts as the empty text. Repeated rows each get a place, next
    to each other; empty tables give no rows. Versions 1 and 2 of the map are stored in map_path, a new folder of the shared
    one by default, and rows are placed by the stored version 2, which edits version 1.
    """
    spark = docs.sparkSession
    rows = materialise(sized(docs, id_col, text_col), "shard-rows")
    map_path = map_path or f"{shared_dir(spark)}/argusframe/shard-maps-{uuid.uuid4().hex}"
    store_map(first_map(rows, shards), map_path)
    store_map(rebalanced(stored_map(spark, map_path), shards), map_path)
    newest = stored_map(spark, map_path)
    version = newest.agg(F.max("version")).first()[0]
    return placed(rows, newest).withColumn("map_version", F.lit(version)).withColumnRenamed("id", id_col)
