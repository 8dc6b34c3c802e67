"""Sharding over fixed virtual slots (built-in functions only).

Records hash into a fixed number of virtual slots.  Rows and bytes are summed
per slot, and a versioned map sends slots to shards.  The map starts as a
greedy largest-first packing of the slot sums; later versions are edits that
move as few slots as needed.  Only sums per slot (a constant number of rows)
ever meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Number of virtual slots; fixed for the life of a dataset.
N_SLOTS = 4096


def with_slots(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot of every row.

    size: UTF-8 bytes of the text (null: none) plus 8.  The slot is a hash of
    id and text, so rows that share an id but not a text spread out.  Null ids
    and texts hash as nulls; a null text has the checksum of the empty text.
    Other columns of the input are ignored.
    """
    text = F.col("text")
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(n_slots)).cast("int").alias("vslot"),
    )


def slot_stats(slotted: DataFrame) -> DataFrame:
    """Rows and bytes of each slot that has rows."""
    return slotted.groupBy("vslot").agg(F.count(F.lit(1)).alias("slot_rows"), F.sum("size").alias("slot_bytes"))


def build_map(stats: DataFrame, n_shards: int) -> DataFrame:
    """Version 1 of the map: largest slots first, each to the lightest shard.

    Ties go to the lower slot and the lower shard, so reruns agree.  The fold
    runs in one task over one row per slot, a constant number.
    """
    one = stats.agg(F.array_sort(F.collect_list(F.struct((-F.col("slot_bytes")).alias("neg"), F.col("vslot"), F.col("slot_rows")))).alias("slots"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), n_shards).alias("loads"), F.array().cast("array<int>").alias("shards"))

    def step(acc, slot):
        best = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int")
        loads = F.transform(acc["loads"], lambda v, i: F.when(i == best - 1, v - slot["neg"]).otherwise(v))
        return F.struct(loads.alias("loads"), F.concat(acc["shards"], F.array(best - 1)).alias("shards"))

    packed = one.select("slots", F.aggregate("slots", start, step)["shards"].alias("shards"))
    return packed.select(F.inline(F.arrays_zip("slots", "shards"))).select(
        F.lit(1).alias("version"),
        F.col("slots.vslot").alias("vslot"),
        F.col("shards").alias("shard"),
        F.col("slots.slot_rows").alias("slot_rows"),
        (-F.col("slots.neg")).alias("slot_bytes"),
    )


def grow_map(current: DataFrame, n_shards: int) -> DataFrame:
    """The next version for one more shard: slots move only into the new one.

    Each old shard gives its smallest slots, up to its part of a fair share for
    the new shard.  ``n_shards`` is the number before growth.
    """
    by_size = W.partitionBy("shard").orderBy("slot_bytes", "vslot")
    give = F.col("all_bytes") / F.lit(n_shards * (n_shards + 1))
    return (
        current.withColumn("upto", F.sum("slot_bytes").over(by_size.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("all_bytes", F.sum("slot_bytes").over(W.partitionBy("version")))
        .select(
            (F.col("version") + 1).alias("version"),
            "vslot",
            F.when(F.col("upto") <= give, F.lit(n_shards)).otherwise(F.col("shard")).cast("int").alias("shard"),
            "slot_rows",
            "slot_bytes",
        )
    )


#: A shard may be so much heavier than the mean before slots leave it.
TOLERANCE = 0.05


def rebalance_map(current: DataFrame, stats: DataFrame, n_shards: int, tolerance: float = TOLERANCE) -> DataFrame:
    """The next version for the rows that are there now: overweight shards give slots to the lightest ones.

    Slots are looked at once, the largest first.  One leaves its shard only if
    that is more than ``tolerance`` above the mean, doesn't fall as far below
    it, and the lightest shard stays within the bound; so little more than the
    excess moves.  Slots that had no rows before go to the lightest shard.
    Ties go to the lower slot and the lower shard.
    """
    known = current.select("vslot", F.col("shard").alias("was"), "version")
    slots = stats.join(known, "vslot", "full").select("vslot", "was", "version", F.coalesce("slot_rows", F.lit(0)).alias("slot_rows"), F.coalesce("slot_bytes", F.lit(0)).alias("slot_bytes"))
    item = F.struct((-F.col("slot_bytes")).alias("neg"), "vslot", "was", "slot_rows")
    one = slots.agg(F.array_sort(F.collect_list(item)).alias("slots"), F.max("version").alias("version"), F.sum("slot_bytes").alias("total"))
    zero = F.array_repeat(F.lit(0).cast("long"), n_shards)
    one = one.withColumn("loads", F.aggregate("slots", zero, lambda acc, x: F.transform(acc, lambda v, i: F.when(i == x["was"], v - x["neg"]).otherwise(v))))
    mean = F.col("total") / F.lit(n_shards)
    high, low = mean * (1 + tolerance), mean * (1 - tolerance)

    def step(acc, x):
        lightest = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        load = F.get(acc["loads"], x["was"])
        leaves = (load > high) & (load + x["neg"] >= low) & (F.array_min(acc["loads"]) - x["neg"] <= high)
        to = F.when(x["was"].isNull() | leaves, lightest).otherwise(x["was"])
        loads = F.transform(acc["loads"], lambda v, i: v + F.when(i == to, -x["neg"]).otherwise(0) + F.when(i == x["was"], x["neg"]).otherwise(0))
        return F.struct(loads.alias("loads"), F.concat(acc["shards"], F.array(to)).alias("shards"))

    start = F.struct(F.col("loads").alias("loads"), F.array().cast("array<int>").alias("shards"))
    moved = one.select("slots", "version", F.aggregate("slots", start, step)["shards"].alias("shards"))
    return moved.select((F.col("version") + 1).alias("version"), F.inline(F.arrays_zip("slots", "shards"))).select(
        "version", F.col("slots.vslot").alias("vslot"), F.col("shards").alias("shard"), F.col("slots.slot_rows").alias("slot_rows"), (-F.col("slots.neg")).alias("slot_bytes")
    )


def save_map(slot_map: DataFrame, path: str) -> None:
    """Appends one version to the stored map."""
    slot_map.coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One stored version; the newest by default."""
    stored = spark.read.parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.filter(F.col("version") == F.lit(version))


def has_map(spark: SparkSession, path: str) -> bool:
    """Whether a map is stored there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def current_map(spark: SparkSession, stats: DataFrame, n_shards: int, path: str) -> DataFrame:
    """The map for these slot sums: the newest one stored, or the version after it where slots have to move.

    Where none is stored, version 1 is made.  A version is stored only if it
    differs from the one before; the sums are those of the rows there are now.
    """
    if not has_map(spark, path):
        save_map(build_map(stats, n_shards), path)
        return load_map(spark, path)
    old = load_map(spark, path)
    new = rebalance_map(old, stats, n_shards).persist()  # a row per slot
    before = old.select("vslot", F.col("shard").alias("was"))
    if new.join(before, "vslot", "left").filter("was is null or was <> shard").limit(1).count():
        save_map(new, path)
        new.unpersist()
        return load_map(spark, path)
    return new.withColumn("version", F.col("version") - 1)


def assign(slotted: DataFrame, slot_map: DataFrame) -> DataFrame:
    """shard of every row and its place there, numbered from 0 without gaps.

    A row's number is the rows of the shard's earlier slots plus its place in
    its own slot, so that no task sorts more than one slot.  Ties (same id) are
    ordered by checksum and size; rows equal in all three are alike.
    """
    before = W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, -1)
    offsets = slot_map.select("vslot", "shard", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)).alias("first"))
    inside = W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (
        slotted.withColumn("place", F.row_number().over(inside))
        .join(F.broadcast(offsets), "vslot")  # at most one row per slot
        .withColumn("slot", F.col("first") + F.col("place") - 1)
        .drop("first", "place")
    )


def shard(docs: DataFrame, n_shards: int = 24, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot for every row.

    The law is ``bytes``: the shards' sizes are near equal.  With ``map_path``
    the newest map stored there is used; where the rows have drifted, slots
    move and the map is stored as the next version.  A null text has no bytes
    and a null id is hashed as such; long texts count whole; rows equal in id,
    checksum and size tie and each get a place of their own, as repeated rows
    do; other columns of the input, whatever their names, are not read.  An
    empty table gives no rows.
    """
    slotted = with_slots(docs, n_slots)
    stats = slot_stats(slotted)
    slot_map = current_map(docs.sparkSession, stats, n_shards, map_path) if map_path else build_map(stats, n_shards)
    placed = assign(slotted, slot_map)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot"
    )
