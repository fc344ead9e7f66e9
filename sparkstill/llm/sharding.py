"""Sharding by fixed virtual slots.

A record's hash puts it into one of thousands of slots for good. The bytes of each slot
are summed, and a slot-to-shard map with a version says which shard holds a slot. The
first version deals the slots, largest first, each to the least filled shard; later
versions are edits of the one before: `grow` adds a shard that takes over slots until it
holds its share (no slot moves between old shards), `move` puts named slots elsewhere.
Maps are kept in a shared folder, one subfolder a version; a version is never overwritten.

Records that are alike in id, size and checksum would all fall into one slot, so each row
of such a group is hashed with a number drawn for the row when the records are written.

Nulls: a null text counts no bytes; a null id is hashed like any other value. Repeated
rows are separate records. An empty table gives a map over empty slots and no rows. Only
the named columns are used, so further columns may have any name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir, small, tidy

#: Bytes that a record takes besides its text.
ROW_BYTES = 16


@tidy
def records(docs: DataFrame, n_slots: int = 4096, n_cells: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, vslot and cell (a fixed part of a slot, so that no slot is counted in one task)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    keys = ["doc_id", "size", "text_crc32"]
    base = cut(base.withColumn("draw", F.xxhash64(F.rand(42))), "shard-input")
    again = small(cut(base.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*(F.col(k).alias(f"_{k}") for k in keys)), "shard-repeated"))
    same = base["doc_id"].eqNullSafe(again["_doc_id"]) & (base["size"] == again["_size"]) & (base["text_crc32"] == again["_text_crc32"])
    marked = base.join(again, same, "left")
    h = F.xxhash64("doc_id", "text_crc32", "size", F.when(F.col("_size").isNotNull(), F.col("draw")))
    return marked.select(*keys, F.pmod(h, F.lit(n_slots)).cast("int").alias("vslot"), F.pmod(F.shiftright(h, 32), F.lit(n_cells)).cast("int").alias("cell"))


def slot_bytes(rows: DataFrame, n_slots: int) -> DataFrame:
    """vslot, bytes, n of every slot, the empty ones too."""
    sums = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    every = rows.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(sums, "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("n", F.lit(0)).alias("n"))


def _deal(slots: Column, n_shards: int) -> Column:
    """Structs (vslot, shard): each slot, in the given order, to the shard with the fewest bytes."""
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), n_shards).alias("load"),
        F.array().cast("array<struct<vslot:int,shard:int>>").alias("owner"),
    )

    def step(acc: Column, slot: Column) -> Column:
        shard = (F.array_position(acc["load"], F.array_min(acc["load"])) - 1).cast("int")
        load = F.transform(acc["load"], lambda x, i: F.when(i == shard, x + slot["bytes"]).otherwise(x))
        return F.struct(load.alias("load"), F.concat(acc["owner"], F.array(F.struct(slot["vslot"].alias("vslot"), shard.alias("shard")))).alias("owner"))

    return F.aggregate(slots, start, step, lambda acc: acc["owner"])


def first_map(slots: DataFrame, n_shards: int) -> DataFrame:
    """Version 0 of the map: version, vslot, shard. `slots` has one row per slot, a fixed number."""
    ranked = F.reverse(F.array_sort(F.collect_list(F.struct("bytes", "vslot"))))
    dealt = slots.agg(_deal(ranked, n_shards).alias("owner"))
    return dealt.select(F.explode("owner").alias("o")).select(F.lit(0).alias("version"), "o.vslot", "o.shard")


def grow(old: DataFrame, slots: DataFrame, n_shards: int, version: int) -> DataFrame:
    """The map with a shard more (number `n_shards`): each old shard hands over its smallest slots up to the share of the new one.

    A shard gives slots while what it has given stays within bytes / (n_shards + 1); slots move into the new shard only.
    """
    given = Window.partitionBy("shard").orderBy("bytes", "vslot")
    total = Window.partitionBy("shard")
    moved = F.sum("bytes").over(given.rowsBetween(Window.unboundedPreceding, 0)) * (n_shards + 1) <= F.sum("bytes").over(total)
    return old.join(slots, "vslot").select(F.lit(version).alias("version"), "vslot", F.when(moved, n_shards).otherwise(F.col("shard")).cast("int").alias("shard"))


def move(old: DataFrame, slots: dict[int, int], version: int) -> DataFrame:
    """The map with some slots put into other shards."""
    edits = F.create_map(*(F.lit(v) for k, shard in slots.items() for v in (k, shard))) if slots else F.lit(None).cast("map<int,int>")
    return old.select(F.lit(version).alias("version"), "vslot", F.coalesce(F.element_at(edits, F.col("vslot")), F.col("shard")).cast("int").alias("shard"))


def save_map(slot_map: DataFrame, folder: str) -> DataFrame:
    """Write a map as a version of its own and return it as read; a version that is there already is an error."""
    version = slot_map.agg(F.max("version")).first()[0]
    slot_map.select("vslot", "shard").coalesce(1).write.mode("errorifexists").parquet(f"{folder}/version={version}")
    return load_map(slot_map.sparkSession, folder, version)


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """version, vslot and shard of a version, or of the latest one."""
    every = spark.read.parquet(folder)
    latest = every.agg(F.max("version")).first()[0] if version is None else version
    return every.where(F.col("version") == latest).select(F.col("version").cast("int").alias("version"), "vslot", "shard")


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """The records with their shard under a map and their place in it (gapless from 0).

    Places follow from counts per slot and cell: a fixed number of sums, whatever the
    input, so that they may be broadcast; only ids and sizes are shuffled.
    """
    cells = rows.groupBy("vslot", "cell").agg(F.count("*").alias("n")).join(F.broadcast(slot_map), "vslot")
    before = Window.partitionBy("shard").orderBy("vslot", "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("vslot", "cell", "shard", "version", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    at = F.row_number().over(Window.partitionBy("vslot", "cell").orderBy("doc_id", "text_crc32", "size")) - 1
    placed = rows.withColumn("place", at).join(F.broadcast(cells), ["vslot", "cell"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("place")).cast("long").alias("slot"), "vslot", "version")


@tidy
def shard(docs: DataFrame, n_shards: int = 40, n_slots: int = 4096, n_cells: int = 16, folder: str | None = None, **columns: str) -> tuple[DataFrame, DataFrame]:
    """The records with their shard and place in it, and the map that was used: the first version, kept in `folder`."""
    rows = cut(records(docs, n_slots, n_cells, **columns), "shard-records")
    folder = folder or f"{shared_dir(docs.sparkSession)}/shard-map-{uuid.uuid4().hex}"
    slot_map = save_map(first_map(slot_bytes(rows, n_slots), n_shards), folder)
    return place(rows, slot_map), slot_map
