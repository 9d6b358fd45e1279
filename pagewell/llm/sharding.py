"""Sharding by fixed virtual slots (DataFrame functions only).

Records are hashed into a fixed number of slots, the bytes of each slot are added up, and a
versioned table maps slots to shards. Rebalancing writes a new version of the map, edited
in few slots; records never change their slot. All tables but the records have one row
per slot, so their size is a parameter. The records themselves, with all their columns, are stored
by shard; they are shuffled once, by virtual slot, so there are at most as many files as slots.

Law of this method: ``bytes`` - the shards' sizes are near equal: the heaviest slot goes to
the lightest shard, and so on.

Defined results: a null text is empty; a null id counts as an id of its own, told apart by
the text's checksum; repeated rows share a slot and get places of their own; equal loads
go to the lower shard, equal slots to the lower slot number first; an empty table gives
an empty result; all columns of a record, whatever their names, are carried in the struct ``doc``;
texts of any length are carried whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewell.llm.common import text_or_empty, written

SLOTS = 4096
OVERHEAD = 16


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def slot_of(doc_id: Column, crc: Column, slots: int = SLOTS) -> Column:
    """Hex digits of an MD5 of the id, modulo the number of slots."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), crc.cast("string")))
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual slot and the whole record ``doc`` of every row."""
    crc = F.crc32(F.encode(text_or_empty(), "UTF-8"))
    df = docs.select(
        "doc_id",
        record_size(F.col("text").cast("string")).alias("size"),
        crc.alias("text_crc32"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
    )
    return df.withColumn("vslot", slot_of(F.col("doc_id"), F.col("text_crc32"), slots))


def slot_bytes(records: DataFrame) -> DataFrame:
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def _lightest(loads: Column) -> Column:
    return (F.array_position(loads, F.array_min(loads)) - 1).cast("int")


def initial_map(weights: DataFrame, shards: int) -> DataFrame:
    """Version 1: slots by falling bytes, each to the shard that is lightest so far.

    The fold runs over the slots alone, at most ``SLOTS`` entries in one row.
    """
    order = F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "vslot", "rows")))
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"),
        F.array().cast("array<struct<vslot:int,shard:int,bytes:bigint,rows:bigint>>").alias("out"),
    )

    def step(s: Column, x: Column) -> Column:
        to = _lightest(s["loads"])
        loads = F.transform(s["loads"], lambda v, i: F.when(i == to, v - x["minus"]).otherwise(v))
        row = F.struct(
            x["vslot"].alias("vslot"), to.alias("shard"), (-x["minus"]).alias("bytes"), x["rows"].alias("rows")
        )
        return F.struct(loads.alias("loads"), F.concat(s["out"], F.array(row)).alias("out"))

    return (
        weights.agg(order.alias("order"))
        .select(F.explode(F.aggregate("order", start, step, lambda s: s["out"])).alias("m"))
        .select(F.lit(1).alias("version"), "m.*")
    )


def rebalanced(current: DataFrame, shards: int) -> DataFrame:
    """The next version for ``shards`` shards: only slots that must move change theirs.

    Every shard gives up its lightest slots beyond an equal share, and slots of shards that
    are gone move as well; they go, heaviest first, to the shard that is lightest.
    """
    total = current.agg(F.sum("bytes").alias("total"), F.max("version").alias("last"))
    newest = current.crossJoin(F.broadcast(total)).where(F.col("version") == F.col("last"))
    running = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    newest = newest.withColumn(
        "stays",
        (F.col("shard") < shards) & (F.sum("bytes").over(running) <= F.ceil(F.col("total") / shards)),
    )
    kept_load = (
        F.sum(F.when(F.col("stays") & (F.col("shard") == i), F.col("bytes")).otherwise(0)) for i in range(shards)
    )
    state = newest.agg(
        F.max("version").alias("version"),
        F.array(*kept_load).alias("loads"),
        F.sort_array(
            F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "vslot", "rows", "shard", "stays"))
        ).alias("slots"),
    )
    start = F.struct(
        F.col("loads").alias("loads"),
        F.array().cast("array<struct<vslot:int,shard:int,bytes:bigint,rows:bigint>>").alias("out"),
    )

    def step(s: Column, x: Column) -> Column:
        to = F.when(x["stays"], x["shard"]).otherwise(_lightest(s["loads"]))
        loads = F.transform(
            s["loads"], lambda v, i: F.when(~x["stays"] & (i == to), v - x["minus"]).otherwise(v)
        )
        row = F.struct(
            x["vslot"].alias("vslot"), to.alias("shard"), (-x["minus"]).alias("bytes"), x["rows"].alias("rows")
        )
        return F.struct(loads.alias("loads"), F.concat(s["out"], F.array(row)).alias("out"))

    return state.select(
        (F.col("version") + 1).alias("version"),
        F.explode(F.aggregate("slots", start, step, lambda s: s["out"])).alias("m"),
    ).select("version", "m.*")


def place(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard of every record by one version of the map, and its place there, gapless from 0.

    Places are numbered inside each virtual slot and moved by the rows of the shard's
    earlier slots, so no task sees a whole shard.
    """
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.select(
        "vslot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first")
    )
    inside = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (
        records.withColumn("n", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), "vslot")  # at most SLOTS rows
        .withColumn("slot", (F.col("first") + F.col("n")).cast("long"))
        .drop("first", "n")
    )


def sharded(docs: DataFrame, shards: int, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """The stored records (partitioned by shard), and the stored map (version 1, partitioned by version).

    The documents are read twice, for the slots' bytes and for the records, rather than copied in between.
    """
    records = sized(docs, slots)
    slot_map = written(initial_map(slot_bytes(records), shards), "slot-map", "version")
    return written(place(records, slot_map), "shards", "shard"), slot_map


def resharded(stored: DataFrame, slot_map: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """The stored records by the map's next version, and that version; records keep their virtual slot."""
    new_map = written(rebalanced(slot_map, shards), "slot-map", "version")
    return written(place(stored.drop("shard", "slot"), new_map), "shards", "shard"), new_map
