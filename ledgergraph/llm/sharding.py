"""Sharding by jump consistent hashing: a stable key and the number of shards decide, without a ring table.

Everything is a built-in Spark function. Slots within a shard are numbered in two levels (hash buckets of a shard are
counted, then rows are numbered within a bucket), so that no shard has to be sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgergraph.llm.common import stored, texts

LOW = 0xFFFFFFFF
STEP = 2862933555777941757  # the generator's multiplier in the published algorithm
BUCKETS = 256


def _stepped(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * STEP + 1 modulo 2^64 on 32-bit halves, in 16-bit parts of STEP so that no product overflows a long."""
    c0, c1, c2, c3 = ((STEP >> s) & 0xFFFF for s in (0, 16, 32, 48))

    def half(x: Column, a: int, b: int) -> Column:  # x * (a + b * 2^16), right in its low 32 bits
        return x * a + F.shiftleft((x * b).bitwiseAND(0xFFFF), 16)

    low = half(lo, c0, c1) + 1
    carry = F.shiftright(low, 32) + F.shiftright(lo * c1, 16)
    return (carry + half(lo, c2, c3) + half(hi, c0, c1)).bitwiseAND(LOW), low.bitwiseAND(LOW)


def jump(key: Column, shards: int) -> Column:
    """struct(shard, grown): the shard of an integer key among ``shards``, and among one more.

    A key jumps to ever higher shards; its shard is the last one below the number of shards, so one more shard only
    takes keys into itself. There are at most ``shards + 1`` jumps. A null key counts as 0.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(LOW).alias("lo"), zero.alias("next"),
                     zero.alias("shard"), zero.alias("grown"))

    def leap(s: Column, _: Column) -> Column:
        hi, lo = _stepped(s["hi"], s["lo"])
        draw = F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double")
        to = F.floor((s["next"] + 1).cast("double") * draw).cast("long")
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), to.alias("next"),
                         F.when(s["next"] < shards, s["next"]).otherwise(s["shard"]).alias("shard"), s["next"].alias("grown"))
        return F.when(s["next"] <= shards, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, leap)


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Put every document into a shard by its id.

    Returns doc_id, size (UTF-8 bytes + 8), text_crc32, law (always "key"), shard, slot (gapless from 0 in each shard)
    and grown_shard (with one shard more). Rows with the same id share a shard, and so do equal texts only if their
    ids agree: the key alone decides. A null text counts as empty (size 8, crc of no bytes); a null id as key 0;
    repeated rows get a slot each; an empty table gives an empty result; other columns are ignored.
    """
    rows = texts(docs).select(
        "doc_id", (F.octet_length("text") + 8).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"), jump(F.col("doc_id"), shards).alias("to"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    rows = stored(rows.select("doc_id", "size", "text_crc32", F.col("to.shard").cast("int").alias("shard"),
                              F.col("to.grown").cast("int").alias("grown_shard"), "bucket"), "shards")
    # At most shards x BUCKETS counts, whatever the number of rows.
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (rows.withColumn("at", F.row_number().over(within))
            .join(F.broadcast(counts), ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("base") + F.col("at") - 1).cast("long").alias("slot"), "grown_shard"))
