"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each shard draws a number from a record's key and its own id; the shard whose weighted draw
is smallest takes the record. A draw does not depend on the other shards, so that one more
shard takes records only into itself, and a share of them that fits its weight.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DRAWS = float(1 << 53)


def shard_of(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of a key (null is a key like any other) by shard id -> weight above 0.

    The least of ``-ln(u) / weight`` wins, u uniform in (0, 1] from 53 bits of XXH64 of key
    and shard id. Equal draws go to the smaller id.
    """
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be above 0 and name a shard at least")
    text = F.coalesce(key.cast("string"), F.lit("\x00null"))
    draws = []
    for shard, weight in sorted(weights.items()):
        u = (F.shiftrightunsigned(F.xxhash64(text, F.lit(int(shard))), 11) + 1) / F.lit(DRAWS)
        draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("draw"), F.lit(int(shard)).alias("shard")))
    return F.array_min(F.array(*draws))["shard"]


def slots(rows: DataFrame, by: str, order: list[str], buckets: int = 64) -> DataFrame:
    """``rows`` (no repeated rows, with a count ``n``) plus ``first``, the count before it in its group ``by``.

    A group is cut into ``buckets`` by a hash of all of ``order``, so that no task holds a
    whole group; only the buckets' totals meet.
    """
    cut = rows.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    totals = cut.groupBy(by, "__bucket").agg(F.sum("n").alias("__n"))
    before = Window.partitionBy(by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(by, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(by, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = cut.withColumn("__in", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return numbered.join(bases, [by, "__bucket"]).withColumn("first", F.col("__base") + F.col("__in")).drop(
        "__bucket", "__in", "__base"
    )


def shard_documents(
    docs: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float] | None = None,
    key: str = "doc_id", text: str = "text", buckets: int = 64,
) -> DataFrame:
    """One row per document: key, size, text_crc32, shard, slot and the shard under ``grown``.

    size is the text's UTF-8 bytes (null: none) plus 8, text_crc32 that of those bytes.
    Slots count from 0 in each shard without gaps, in the order of hash buckets of
    (key, size, text_crc32) and then of these; rows that repeat all three are counted first,
    so that a key with very many rows is one row until the end, and get neighbouring slots.
    Other columns are left out and may have any name. An empty table gives an empty result.
    """
    whole = F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")
    rows = docs.select(
        F.col(key).alias("key"), (F.octet_length(whole) + 8).cast("long").alias("size"), F.crc32(whole).alias("crc"),
    )
    rows = rows.groupBy("key", "size", "crc").agg(F.count("*").alias("n"))
    rows = rows.withColumn("shard", shard_of(F.col("key"), weights))
    rows = slots(rows, "shard", ["key", "size", "crc"], buckets)
    moved = shard_of(F.col("key"), grown) if grown else F.lit(None).cast("int")
    return rows.select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard",
        F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"), moved.alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, weights: Mapping[int, float], key: str = "doc_id", parts: int = 8) -> None:
    """All columns of ``docs`` as Parquet in one folder per shard, ``parts`` tasks sharing each shard."""
    placed = docs.withColumn("__shard", shard_of(F.col(key), weights))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in docs.columns]), F.lit(parts))
    placed.repartition(len(weights) * parts, "__shard", salt).write.partitionBy("__shard").parquet(path)
