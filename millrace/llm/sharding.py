"""Sharding by jump consistent hashing (operator 8), with DataFrame functions only.

The shard of a key follows from the key and the number of shards; there is no ring table. With
one more shard a key either stays or moves into the new one, so n shards grow to n + 1 by moving
about 1 / (n + 1) of the rows.

The jump sequence draws from a 64-bit linear congruential generator. Spark's arithmetic checks
for overflow, so its state is held as two 32-bit halves and multiplied limb by limb.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Multiplier of the generator, a fixed value of the published algorithm.
MULTIPLIER = 2862933555777941757
_M16, _M32 = 0xFFFF, 0xFFFFFFFF


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The halves of (2^32 hi + lo) * MULTIPLIER + 1 modulo 2^64."""
    mh, ml = MULTIPLIER >> 32, MULTIPLIER & _M32
    and16, and32 = (lambda x: x.bitwiseAND(F.lit(_M16))), (lambda x: x.bitwiseAND(F.lit(_M32)))
    shift = F.shiftrightunsigned
    low0, low1 = and16(lo) * F.lit(ml), shift(lo, 16) * F.lit(ml)
    sum0 = and32(low0) + F.shiftleft(and16(low1), 16) + F.lit(1)
    cross = lambda a, m: and32(and16(a) * F.lit(m)) + F.shiftleft(and16(and32(shift(a, 16) * F.lit(m))), 16)
    high = shift(low0, 32) + shift(low1, 16) + shift(sum0, 32) + cross(hi, ml) + cross(lo, mh)
    return and32(high), and32(sum0)


def jump(key: Column, shards: int) -> tuple[Column, Column]:
    """The shard of a long key among ``shards`` and among ``shards + 1``.

    A walk over growing candidate shards that ends past the last; it strictly grows, so
    ``shards + 1`` steps always suffice, and finished walks skip the rest. Null keys count as 0.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.lit(0).cast("long").alias("at"),  # the last candidate below shards + 1
        F.lit(0).cast("long").alias("was"),  # the last candidate below shards
        F.lit(0).cast("long").alias("next"),
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(F.lit(_M32)).alias("lo"),
    )

    def walk(a: Column, _: Column) -> Column:
        hi, lo = _step(a["hi"], a["lo"])
        # (state >> 33) + 1 is the upper half shifted by one more.
        leap = F.lit(float(1 << 31)) / (F.shiftrightunsigned(hi, 1) + F.lit(1)).cast("double")
        moved = F.struct(
            a["next"].alias("at"),
            F.when(a["next"] < shards, a["next"]).otherwise(a["was"]).alias("was"),
            F.floor((a["next"] + F.lit(1)).cast("double") * leap).cast("long").alias("next"),
            hi.alias("hi"),
            lo.alias("lo"),
        )
        return F.when(a["next"] > shards, a).otherwise(moved)

    walked = F.aggregate(F.sequence(F.lit(0), F.lit(shards + 1)), start, walk, lambda a: F.struct(a["was"].alias("shard"), a["at"].alias("grown")))
    return walked["shard"], walked["grown"]


def sharded(rows: DataFrame, key: str, shards: int, order: list[str], label: str = "shards") -> DataFrame:
    """``rows`` with shard, slot (0, 1, ... within the shard, along ``order``) and grown_shard (of one shard more).

    Integer keys are used as they are, other keys by a 64-bit hash. Slots are numbered by range
    partitions of (shard, order), so a shard is never one task; only one count for each
    partition and shard is summed up. Use it on narrow rows.
    """
    kind = dict(rows.dtypes)[key]
    base = F.col(f"`{key}`") if kind in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(F.col(f"`{key}`"))
    shard, grown = jump(base, shards)
    placed = rows.withColumn("__j", F.struct(shard.alias("s"), grown.alias("g"))).withColumns(
        {"shard": F.col("__j.s").cast("int"), "grown_shard": F.col("__j.g").cast("int")}
    ).drop("__j")
    by = ["shard", *order]
    keys = [F.col(c).asc_nulls_last() for c in by]
    at = common.stage(
        placed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()),
        label,
    ).withColumn("__part", F.shiftright("__at", 33))
    runs = at.groupBy("shard", "__part").agg(F.min("__at").alias("__from"), F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("shard", "__part", "__from", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # One row for each range partition and shard in it: partitions + shards at most.
    return at.join(F.broadcast(runs), ["shard", "__part"]).withColumn(
        "slot", F.col("__before") + F.col("__at") - F.col("__from")
    ).drop("__at", "__part", "__from", "__before")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    The shard depends on doc_id (null: as 0) and ``shards`` alone; a null text has size 16 and the
    checksum of the empty text. Repeated rows are numbered one after the other.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return sharded(rows, "doc_id", shards, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` in one of 40 shards, see :func:`shard_documents`."""
    return shard_documents(common.documents(spark, sf_dir))
