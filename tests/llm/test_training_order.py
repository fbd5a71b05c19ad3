import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import training_order as order
from tickloom.llm.tokens import BytePieces, vocabulary


@pytest.mark.parametrize("total", [1, 2, 3, 5, 64, 1000, 4097])
def test_slots_are_a_permutation(total):
    one, other = (order.feistel(np.arange(total), total, key) for key in (1, 2))
    assert sorted(one) == list(range(total)) == sorted(other)
    assert total < 5 or (one != other).any()
    assert (order.feistel(np.arange(total)[::-1], total, 1) == one[::-1]).all()


def plain_feistel(n, total, key):
    half = max(1, -(-(total - 1).bit_length() // 2))
    word, keys = (1 << 64) - 1, np.random.default_rng(key).integers(1, 1 << 63, order.ROUNDS, dtype=np.uint64).tolist()
    while True:
        left, right = divmod(n, 1 << half)
        for k in keys:
            x = (right + k) * 0x9E3779B97F4A7C15 & word
            x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & word
            left, right = right, left ^ (x >> 32) % (1 << half)
        n = (left << half) + right
        if n < total:
            return n


@pytest.mark.parametrize("total", [1, 2, 37, 1000, (1 << 40) + 3])
def test_slots_equal_those_of_one_number_at_a_time(total):
    some = sorted({0, total - 1, total // 2, total // 3, min(total - 1, 12345)})
    assert order.feistel(np.array(some), total, 7).tolist() == [plain_feistel(n, total, 7) for n in some]


def test_tasks_follow_the_size_and_not_the_shards(spark, tmp_path):
    assert order.shards_per_task(1, 8) == 1 and order.shards_per_task(320, 8) == 10
    assert order.shards_per_task(10**7, 1000) == order.MOST_SHARDS
    df = spark.createDataFrame([(i, f"text {i}") for i in range(1000)], "doc_id long, text string")
    cut_up = order.token_sequences(df, vocabulary("byte_bpe_50k.tiktoken"), 8)
    got = order.records(order.in_training_order(cut_up, 3, per_shard=2), 8)
    tasks = got.select("shard", F.spark_partition_id().alias("task")).distinct().collect()
    held = {t.task: sorted(x.shard for x in tasks if x.task == t.task) for t in tasks}
    assert len(tasks) == 500 and len(held) <= 500 // 8
    assert all(shards == list(range(shards[0], shards[-1] + 1)) for shards in held.values())
    order.write_shards(got, f"{tmp_path}/out")
    files = glob.glob(f"{tmp_path}/out/shard=*/part-*")
    assert len(files) == 500 and {os.path.getsize(f) for f in files} == {2 * order.stride(8)}


def test_round_trip(spark, tmp_path):
    path = vocabulary("byte_bpe_50k.tiktoken")
    encoding = BytePieces(path).encoding
    rows = [(i, " ".join(f"text {k}\n" for k in range(i * 7 % 60))) for i in range(90)] + [(3, None), (None, ""), (500, "long é " * 3000)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, slot int").repartition(3)
    got = order.materialise(df, 11, length=32, per_shard=64)
    made = got.collect()
    assert sorted(r.slot for r in made) == list(range(len(made)))
    assert all(r.slot == r.shard * 64 + r.place and len(r.record) == order.stride(32) - 1 for r in made)
    order.write_shards(got, f"{tmp_path}/out")
    files = sorted(glob.glob(f"{tmp_path}/out/shard=*/part-*"), key=lambda f: int(f.split("shard=")[1].split("/")[0]))
    assert len(files) == -(-len(made) // 64)
    records = {}
    for shard, file in enumerate(files):
        n = os.path.getsize(file) // order.stride(32)
        assert os.path.getsize(file) == n * order.stride(32)
        with open(file, "rb") as f:
            for place in reversed(range(n)):
                f.seek(place * order.stride(32))
                records[shard * 64 + place] = f.read(order.stride(32) - 1)
    texts = {}
    for r in made:
        raw = records[r.slot]
        assert raw == bytes(r.record)
        n = int.from_bytes(raw[:4], "little")
        ids = np.frombuffer(raw, "<u2", offset=4)
        assert n == r.n_tokens and (ids[n:] == order.END).all()
        texts.setdefault(r.doc_id, {})[r.piece] = ids[:n].tolist()
    for i, t in rows:
        if i is None or i == 3:
            continue
        ids = sum((texts[i][k] for k in sorted(texts[i])), [])
        assert ids[-1] == order.END and encoding.decode(ids[:-1]) == t


def test_odd_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert order.materialise(df, 1).collect() == []
    two = spark.createDataFrame([(1, None), (1, None)], "doc_id long, text string")
    assert sorted((r.slot, r.n_tokens) for r in order.materialise(two, 1).collect()) == [(0, 1), (1, 1)]
