"""Sharding by jump consistent hashing, in DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, text_of

# The published generator of jump consistent hashing, key * 2862933555777941757 + 1 mod 2^64,
# as a high part of 32 bits and two low parts of 16 bits.
MULTIPLIER = 2862933555777941757
A_HIGH, A_MID, A_LOW = MULTIPLIER >> 32, (MULTIPLIER >> 16) & 0xFFFF, MULTIPLIER & 0xFFFF
MASK = 0xFFFFFFFF
FIRST_JUMPS = 64


def _jump(s: Column, shards: int) -> Column:
    """One jump.  The 64-bit key is kept as two halves so that no product leaves a signed long."""
    low, high = s["low"], s["high"]
    partial = low * F.lit(A_LOW) + F.shiftleft((low * F.lit(A_MID)).bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carry = F.shiftright(partial, 32) + F.shiftright(low * F.lit(A_MID), 16)
    top = (carry + (low * F.lit(A_HIGH)).bitwiseAND(F.lit(MASK)) + high * F.lit(A_LOW)
           + F.shiftleft((high * F.lit(A_MID)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(MASK))
    step = F.lit(2147483648.0) / (F.shiftright(top, 1) + 1).cast("double")
    jumped = F.floor((s["next"] + 1).cast("double") * step).cast("long")
    return F.struct(top.alias("high"), partial.bitwiseAND(F.lit(MASK)).alias("low"),
                    F.when(s["next"] < shards, s["next"]).otherwise(s["at"]).alias("at"), s["next"].alias("grown"), jumped.alias("next"))


def jump_state(key: Column, shards: int, jumps: int) -> Column:
    """(at, grown, next) of a key: ``at`` is its shard among ``shards``, ``grown`` among one more.
    Both come from one chain, as it is the last landing place below the shard count."""
    k = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(F.shiftrightunsigned(k, 32).alias("high"), k.bitwiseAND(F.lit(MASK)).alias("low"),
                     F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("grown"), F.lit(0).cast("long").alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(jumps)), start, lambda s, _: F.when(s["next"] <= shards, _jump(s, shards)).otherwise(s))


def with_shards(df: DataFrame, key: str, shards: int, shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """Adds the shard of ``key`` among ``shards`` and among one more.  A chain makes about ln(shards)
    jumps, at most one per shard: the rare key that needs more than the first 64 walks on to its end."""
    first = df.withColumn("__jump", jump_state(F.col(key), shards, min(shards + 2, FIRST_JUMPS)))
    if shards + 2 > FIRST_JUMPS:
        first = first.withColumn("__jump", F.when(F.col("__jump.next") > shards, F.col("__jump")).otherwise(jump_state(F.col(key), shards, shards + 2)))
    return first.withColumns({shard: F.col("__jump.at").cast("int"), grown: F.col("__jump.grown").cast("int")}).drop("__jump")


def assign_shards(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, size (UTF-8 bytes of the text plus 8), text_crc32, law (``key``),
    shard, slot (0, 1, 2, ... in each shard, in order of the key), grown_shard.

    A null key counts as key 0, a null text as no bytes.  Rows that repeat a key share its shard
    and take slots of their own.  Other columns of ``docs`` are not read.  An empty table gives no rows.

    The text is read once; what follows works on narrow rows.  They are dealt into ranges of
    (key, row), so even one key with a third of all rows is spread; slots are the place within
    (shard, range) plus the rows of earlier ranges, so no task numbers a whole shard."""
    rows = stage(docs.select(F.col(key).alias("k"), (F.octet_length(text_of(text)) + 8).cast("long").alias("size"),
                             F.crc32(text_of(text)).alias("text_crc32"), F.monotonically_increasing_id().alias("row")), "shard-rows")
    placed = stage(with_shards(rows, "k", shards).repartitionByRange("k", "row").withColumn("part", F.spark_partition_id()), "shard-placed")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
               .select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("k", "row"))
    return (placed.withColumn("place", place).join(offsets, ["shard", "part"])
            .select(F.col("k").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard"))
