import math
import struct
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from tickloom.llm import sharding


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, shard string")


def test_slots_and_moves(spark):
    rows = [(i, "é" * (i % 50) if i % 7 else None, "x") for i in range(3000)] + [(5, "same", "x")] * 900
    even = {i: 1.0 for i in range(24)}
    got = sharding.shard_documents(docs(spark, rows), even, even | {24: 1.0}).collect()
    assert len(got) == len(rows)
    for shard in range(24):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 24) for r in got)
    assert 60 < len({r.doc_id for r in got if r.grown_shard == 24}) < 190
    by_id = {}
    for r in got:
        assert by_id.setdefault(r.doc_id, r.shard) == r.shard
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want


def plain_shard(key, weights):
    """The least draw of all shards, one by one."""
    text = "\x00null" if key is None else str(key)
    draws = []
    for shard, weight in weights.items():
        seed = xxhash.xxh64_intdigest(text.encode(), 42)
        bits = xxhash.xxh64_intdigest(struct.pack("<i", shard), seed) >> 11
        draws.append((-math.log((bits + 1) / (1 << 53)) / weight, shard))
    return min(draws)[1]


def test_shards_equal_those_of_plain_rendezvous(spark):
    weights = {s: 1.0 + s % 3 for s in range(24)}
    rows = [(i * 7919 - 50, "x", "own") for i in range(1500)] + [(None, "x", "own")]
    got = sharding.shard_documents(docs(spark, rows), weights, weights | {24: 2.0}).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.shard == plain_shard(r.doc_id, weights)
        assert r.grown_shard == plain_shard(r.doc_id, weights | {24: 2.0})


def test_weights_and_odd_tables(spark):
    keys = spark.range(20000).select(sharding.shard_of(F.col("id"), {0: 1.0, 1: 3.0}).alias("s"))
    share = keys.agg(F.avg("s")).first()[0]
    assert 0.73 < share < 0.77
    assert sharding.shard_documents(docs(spark, []), {0: 1.0}).collect() == []
    rows = [(None, None, None), (None, None, None), (1, "", None), (1, "x" * 100000, None)]
    got = sharding.shard_documents(docs(spark, rows), {0: 1.0}).collect()
    assert sorted(r.slot for r in got) == [0, 1, 2, 3] and all(r.grown_shard is None for r in got)


def test_files_by_shard(spark, tmp_path):
    df = docs(spark, [(i, str(i), "own") for i in range(200)])
    sharding.write_shards(df, f"{tmp_path}/out", {0: 1.0, 5: 1.0}, parts=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 200 and {r[0] for r in back.select("__shard").distinct().collect()} == {0, 5}
