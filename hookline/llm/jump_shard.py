"""Jump consistent hashing: stable keys to shards without a ring table.

Method: Lamping and Veach, "A fast, minimal memory, consistent hash algorithm"
(2014).  A key seeds a 64-bit linear congruential sequence; each draw says at
which shard count the key would next move, and the last jump below the shard
count is its shard.  Appending a shard moves rows only into the new shard, and
about 1 / (n + 1) of them.

All steps are Spark SQL expressions; the modular products use decimals, since
64-bit products overflow.

Edge cases: a null key takes the sequence of key 0; a null text has no bytes and
CRC-32 0; repeated rows share a shard and take slots of their own (ties in the
slot order hold equal values, so any order gives the same rows); an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the published algorithm: multiplier, 2**64, 2**33, 2**31.
_MULTIPLIER = "2862933555777941757"
_MODULUS = "18446744073709551616"
_SHIFT = "8589934592"
_SCALE = 2147483648.0

#: Bytes counted for every row besides its text.
ROW_BYTES = 16
#: Slot ranges per shard that are numbered in separate tasks.
SLOT_RANGES = 256


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of an integer key among ``shards`` shards (0-based)."""
    if shards < 1:
        raise ValueError("shards must be positive")
    modulus = F.expr(f"CAST('{_MODULUS}' AS DECIMAL(20,0))")
    multiplier = F.expr(f"CAST('{_MULTIPLIER}' AS DECIMAL(19,0))")
    seed = F.pmod(F.coalesce(key.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")), modulus).cast("decimal(20,0)")

    def draw(acc: Column) -> Column:
        return ((acc["state"] * multiplier + F.lit(1)) % modulus).cast("decimal(20,0)")

    def step(acc: Column, _: Column) -> Column:
        state = draw(acc)
        top = F.floor(state / F.expr(f"CAST('{_SHIFT}' AS DECIMAL(10,0))")).cast("double")
        jump = F.floor((acc["next"] + 1).cast("double") * (F.lit(_SCALE) / (top + 1.0))).cast("bigint")
        moved = F.struct(acc["next"].alias("shard"), jump.alias("next"), state.alias("state"))
        return F.when(acc["next"] < shards, moved).otherwise(acc)

    start = F.struct(
        F.lit(-1).cast("bigint").alias("shard"), F.lit(0).cast("bigint").alias("next"), seed.alias("state")
    )
    # Each jump moves on by at least one shard, so `shards` steps always suffice.
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda acc: acc["shard"].cast("int"))


def key_of(df: DataFrame, column: str) -> Column:
    """Integer key: the column itself if it is an integer, else its 64-bit hash."""
    kind = df.schema[column].dataType.typeName()
    return F.col(column) if kind in ("byte", "short", "integer", "long") else F.xxhash64(F.col(column))


def moved_fraction(df: DataFrame, column: str, shards: int, grown: int) -> DataFrame:
    """One row: rows, rows that change shard when `shards` becomes `grown`, and
    rows that move between two old shards (always 0)."""
    key = key_of(df, column)
    both = df.select(jump_hash(key, shards).alias("old"), jump_hash(key, grown).alias("new"))
    moved = F.col("old") != F.col("new")
    return both.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(moved.cast("bigint")), F.lit(0)).alias("moved"),
        F.coalesce(F.sum((moved & (F.col("new") < shards)).cast("bigint")), F.lit(0)).alias("moved_among_old"),
    )


def assign_shards(docs: DataFrame, shards: int, ranges: int = SLOT_RANGES) -> DataFrame:
    """Shard, slot and next-size shard of every document.

    Slots are gapless from 0 in each shard.  A shard is numbered in `ranges`
    hash ranges of the key: a first pass over the key column alone counts rows
    per (shard, range), whose running sums (at most shards x ranges rows, hence
    broadcast) are the first slots of the ranges.
    """
    key = key_of(docs, "doc_id")
    part = F.pmod(F.xxhash64(key), F.lit(ranges)).cast("int")
    place = docs.select(jump_hash(key, shards).alias("shard"), part.alias("range"))
    first = (
        place.groupBy("shard", "range")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn(
            "first",
            F.sum("rows").over(W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1)),
        )
        .select("shard", "range", F.coalesce("first", F.lit(0)).alias("first"))
    )
    rows = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + ROW_BYTES).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0).cast("bigint")).alias("text_crc32"),
        jump_hash(key, shards).alias("shard"),
        jump_hash(key, shards + 1).alias("grown_shard"),
        part.alias("range"),
    )
    order = W.partitionBy("shard", "range").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("place", F.row_number().over(order).cast("bigint") - 1)
        .join(F.broadcast(first), ["shard", "range"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("first") + F.col("place")).alias("slot"), "grown_shard",
        )
    )
