"""Token ids written in training order.

Documents are cut into sequences of at most a fixed number of ids. A keyed Feistel network
over the smallest even number of bits that counts the sequences, walked in cycles until it
lands below their number, is a permutation: it gives every sequence a slot without any sort
or list of slots. Tasks hold ranges of slots and write records of one stride, so that a
reader finds slot s at a known byte and can go on from anywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.shared import in_batches
from tickloom.llm.tokens import byte_pieces, cut, vocabulary
from tickloom.session import cut_lineage

#: Ids in a sequence, sequences in a shard, the id that ends a document and fills up records.
LENGTH, PER_SHARD, END = 512, 8192, 50256
ROUNDS = 6
HEADER = 4
#: Shards that one task sorts and writes, at most: 32 of 8192 records of a kilobyte are a quarter of a gigabyte.
MOST_SHARDS = 32


def feistel(index: np.ndarray, total: int, key: int) -> np.ndarray:
    """The slots of ``index`` (0 to total - 1), another permutation for every key."""
    half = max(1, -(-(total - 1).bit_length() // 2))
    low = np.uint64((1 << half) - 1)
    rng = np.random.default_rng(key)
    keys = rng.integers(1, 1 << 63, ROUNDS, dtype=np.uint64)
    out = np.asarray(index, np.uint64).copy()
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> np.uint64(half), out[walking] & low
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (mixed >> np.uint64(32)) & low
        out[walking] = left << np.uint64(half) | right
        walking = walking[out[walking] >= total]
    return out.astype(np.int64)


def token_sequences(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, n_tokens, ids): each document's ids, ``end`` last, cut into sequences; ids are unsigned 16-bit."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def tokenise(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces, row, piece, ids = byte_pieces(path), [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            for k, part in enumerate(cut(pieces.of_text(text) + end.to_bytes(2, "little"), 2, length)):
                row.append(i)
                piece.append(k)
                ids.append(part)
        counts = pa.array([len(x) // 2 for x in ids], pa.int32())
        return pa.RecordBatch.from_arrays(
            [batch.column("key").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), counts, pa.array(ids, pa.binary())],
            ["key", "piece", "n_tokens", "ids"],
        )

    kind = dict(rows.dtypes)["key"]
    return in_batches(rows, tokenise, f"key {kind}, piece int, n_tokens int, ids binary")


def shards_per_task(shards: int, slots: int, most: int = MOST_SHARDS) -> int:
    """How many consecutive shards a task holds: few tasks a core (``slots`` cores) while they fit, then ``most``."""
    return max(1, min(most, shards // (4 * slots)))


def in_training_order(sequences: DataFrame, key: int, per_shard: int = PER_SHARD, most_shards: int = MOST_SHARDS) -> DataFrame:
    """``sequences`` plus slot, shard and place (in the shard), dealt to tasks by ranges of slots and sorted by slot.

    The sequences are stored once; a sequence's number is its place in the stored table, so
    that one store and key always give one order. Only the tasks' counts meet. A range is
    whole shards, at most ``most_shards``; all ranges but the last are equally long.
    """
    stored = cut_lineage(sequences.withColumn("__row", F.monotonically_increasing_id()))
    part = F.shiftright("__row", 33)
    counts = cut_lineage(stored.groupBy(part.alias("part")).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("part").alias("__part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    numbered = stored.join(bases, part == F.col("__part")).withColumn("__n", F.col("__base") + F.col("__row").bitwiseAND((1 << 33) - 1))
    numbered = numbered.drop("__row", "__part", "__base")

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        slots = feistel(batch.column("__n").to_numpy(), total, key)
        kept = [n for n in batch.schema.names if n != "__n"]
        new = [pa.array(slots), pa.array(slots // per_shard), pa.array((slots % per_shard).astype(np.int32))]
        return pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + new, kept + ["slot", "shard", "place"])

    schema = numbered.drop("__n").withColumns({c: F.lit(0).cast(t) for c, t in (("slot", "long"), ("shard", "long"), ("place", "int"))}).schema
    placed = in_batches(numbered, place, schema, rows=4096)
    shards = max(1, -(-total // per_shard))
    each = shards_per_task(shards, sequences.sparkSession.sparkContext.defaultParallelism, most_shards)
    task = F.floor(F.col("shard") / F.lit(each)).cast("int")
    return placed.repartitionById(-(-shards // each), task).sortWithinPartitions("slot")


def records(ordered: DataFrame, length: int = LENGTH, end: int = END) -> DataFrame:
    """``ordered`` with ``record`` instead of ids: n_tokens (4 bytes), then ``length`` ids of 2 bytes, little-endian, filled up with ``end``."""

    def fill(batch: pa.RecordBatch) -> pa.RecordBatch:
        unit = end.to_bytes(2, "little")
        made = [(len(x) // 2).to_bytes(HEADER, "little") + x + unit * (length - len(x) // 2) for x in batch.column("ids").to_pylist()]
        kept = [n for n in batch.schema.names if n != "ids"]
        return pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + [pa.array(made, pa.binary())], kept + ["record"])

    return in_batches(ordered, fill, ordered.drop("ids").withColumn("record", F.lit(b"")).schema, rows=4096)


def stride(length: int = LENGTH) -> int:
    """Bytes from one record of a file to the next: header, ids, a line feed."""
    return HEADER + 2 * length + 1


def write_shards(recorded: DataFrame, path: str) -> None:
    """One file of records of one stride per shard, in folders ``shard=k``, in slot order; needs ``in_training_order``'s layout.

    A task writes its shards one after the other, with one file open. Spark's writer commits whole files on any file system, so that a lost task leaves none
    behind.
    """
    lines = recorded.select("shard", "slot", F.col("record").cast("string").alias("value"))
    lines.sortWithinPartitions("shard", "slot").select("shard", "value").write.partitionBy("shard").text(path)


def materialise(docs: DataFrame, key: int, path: str | None = None, length: int = LENGTH, per_shard: int = PER_SHARD, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per sequence: slot, shard, place, the document's id, piece, n_tokens, record.

    Slots run from 0 without gaps. A null or empty text is one sequence of the end id. Rows
    that repeat an id give their sequences each. Other columns are left out. An empty table
    gives an empty result.
    """
    cut_up = token_sequences(docs, path or vocabulary("byte_bpe_50k.tiktoken"), length, key=id_column, text=text)
    return records(in_training_order(cut_up, key, per_shard), length).withColumnRenamed("key", id_column)
