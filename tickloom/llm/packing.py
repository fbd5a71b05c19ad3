"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents are dealt into cells of bounded size. Each cell is solved by several islands, each
a task's population of packings: crossover injects whole well-filled sequences of one parent
into the other, sequences that lose a document that way are dissolved, and displaced
documents are best-fitted back. Between rounds an island's elite migrates to the next. What
a cell leaves in loosely filled sequences is dealt out again among fewer cells of the same
size, until that gains little: lengths that cannot fill sequences stay as they are packed.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import in_batches
from tickloom.llm.tokens import cut, vocabulary, word_pieces
from tickloom.session import cut_lineage

CAPACITY = 4096
#: Documents a cell holds on average, islands per cell, rounds between which elites migrate.
CELL, ISLANDS, ROUNDS = 2048, 2, 2
POPULATION, GENERATIONS = 6, 8
#: Sequences filled less than this are dealt out again, at most so many times and as long as a
#: level finishes such a share of its documents.
LOOSE, LEVELS, GAIN = 0.995, 8, 0.1

Packing = list[list[int]]


def best_fit(lengths: list[int], order: list[int], bins: Packing, capacity: int) -> Packing:
    """``bins`` with the documents of ``order`` added, each where least room is left."""
    rooms = sorted((capacity - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    for i in order:
        at = bisect_left(rooms, (lengths[i],))
        if at < len(rooms):
            room, k = rooms.pop(at)
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        if room > lengths[i]:
            insort(rooms, (room - lengths[i], k))
    return bins


def crossover(lengths: list[int], one: Packing, other: Packing, capacity: int, rng: random.Random) -> Packing:
    """``one`` with well-filled sequences of ``other`` injected."""
    fill = [sum(lengths[i] for i in b) for b in other]
    ranked = sorted(range(len(other)), key=lambda k: -fill[k])
    good = [k for k in ranked[: max(1, len(ranked) // 2)] if rng.random() < 0.5] or ranked[:1]
    injected = [list(other[k]) for k in good]
    taken = {i for b in injected for i in b}
    whole, displaced = [], []
    for b in one:
        if taken.isdisjoint(b):
            whole.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    # A loosely filled sequence or two of the rest is dissolved as well, to be fitted anew.
    whole.sort(key=lambda b: -sum(lengths[i] for i in b))
    for _ in range(min(len(whole), rng.randint(0, 2))):
        displaced += whole.pop()
    displaced.sort(key=lambda i: -lengths[i])
    return best_fit(lengths, displaced, injected + whole, capacity)


def fitness(lengths: list[int], bins: Packing, capacity: int) -> tuple[int, float]:
    """Fewer sequences first, then a larger mean square of their filling; smaller is fitter."""
    return len(bins), -sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def evolve(lengths: list[int], elites: list[Packing], capacity: int, seed: int) -> Packing:
    """The fittest packing of an island after its generations; it begins with ``elites``."""
    rng, n = random.Random(seed), len(lengths)
    least = -(-sum(lengths) // capacity)
    falling = sorted(range(n), key=lambda i: -lengths[i])
    people = [[list(b) for b in e] for e in elites] or [best_fit(lengths, falling, [], capacity)]
    best = min(people, key=lambda p: fitness(lengths, p, capacity))
    if len(best) <= least:
        return best
    while len(people) < POPULATION:
        noisy = sorted(range(n), key=lambda i: -lengths[i] * rng.uniform(0.7, 1.0))
        people.append(best_fit(lengths, noisy, [], capacity))
    for _ in range(GENERATIONS):
        people.sort(key=lambda p: fitness(lengths, p, capacity))
        if len(people[0]) <= least:
            break
        half = people[: POPULATION // 2]
        children = []
        while len(half) + len(children) < POPULATION:
            one, other = rng.sample(half, 2) if len(half) > 1 else (half[0], half[0])
            children.append(crossover(lengths, one, other, capacity, rng))
        people = half + children
    return min(people, key=lambda p: fitness(lengths, p, capacity))


def _islands(cells: DataFrame, capacity: int, number: int) -> DataFrame:
    """One round on every island: (cell, island, rows, lengths, elites) -> (cell, island, rows, lengths, bin, sequences).

    ``bin`` numbers each document's sequence; elites are such arrays.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        columns = (batch.column(c).to_pylist() for c in ("cell", "island", "lengths", "elites"))
        for cell, island, lengths, elites in zip(*columns):
            packings = []
            for bins in elites:
                packing: Packing = [[] for _ in range(max(bins) + 1)]
                for i, b in enumerate(bins):
                    packing[b].append(i)
                packings.append(packing)
            best = evolve(lengths, packings, capacity, hash((cell, island, number)))
            place = np.empty(len(lengths), np.int32)
            for k, b in enumerate(best):
                place[b] = k
            found.append((place.tolist(), len(best)))
        bins = [pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.int32())]
        kept = ("cell", "island", "rows", "lengths")
        return pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + bins, [*kept, "bin", "sequences"])

    schema = "cell long, island int, rows array<long>, lengths array<int>, bin array<int>, sequences int"
    return in_batches(cells, run, schema, rows=16)


def _solve(pieces: DataFrame, cells: int, capacity: int, level: int = 0) -> DataFrame:
    """(row, length, cell, bin, filled): the fittest packing of every cell; each level deals anew."""
    dealt = pieces.withColumn("cell", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(cells)))
    held = dealt.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("row", "length"))).alias("d"))
    none = F.array().cast("array<array<int>>")
    state = held.select(
        "cell", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("d.row").alias("rows"),
        F.col("d.length").alias("lengths"), none.alias("elites"),
    )
    state = cut_lineage(_islands(state, capacity, 0))
    for number in range(1, ROUNDS):
        guests = state.select("cell", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("bin").alias("guest"))
        met = state.join(guests, ["cell", "island"]).withColumn("elites", F.array("bin", "guest"))
        state = cut_lineage(_islands(met.select("cell", "island", "rows", "lengths", "elites"), capacity, number))
    best = state.groupBy("cell").agg(
        F.max_by(F.struct("rows", "lengths", "bin"), F.struct(-F.col("sequences"), -F.col("island"))).alias("s")
    )
    items = best.select("cell", F.explode(F.arrays_zip("s.rows", "s.lengths", "s.bin")).alias("i"))
    items = items.select("cell", F.col("i.rows").alias("row"), F.col("i.lengths").alias("length"), F.col("i.bin").alias("bin"))
    filled = items.groupBy("cell", "bin").agg(F.sum("length").alias("filled"))
    return cut_lineage(items.join(filled, ["cell", "bin"]))


def pack(pieces: DataFrame, capacity: int = CAPACITY, cell: int = CELL) -> DataFrame:
    """(row, sequence_id, offset) of every (row, length): sequences hold at most ``capacity`` and are filled from 0 without gaps.

    row must tell rows apart, length be 1 to ``capacity``. Sequences of a full piece hold it
    alone. The rest is solved cell by cell, ``cell`` documents each on every level; loosely
    filled sequences are dealt out again until one cell holds them, a level finishes less
    than ``GAIN`` of its documents, or ``LEVELS`` are done. The last level's sequences are
    all final; of each of its cells one may be filled by less than half for want of others.
    """
    full = pieces.filter(F.col("length") >= capacity).select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).alias("at"), "length")
    rest, level, placed = pieces.filter(F.col("length") < capacity).select("row", F.col("length").cast("int").alias("length")), 0, []
    left = rest.count()
    while left:
        cells = -(-left // cell)
        solved = _solve(rest, cells, capacity, level)
        loose = solved.filter(F.col("filled") < LOOSE * capacity)
        after = loose.count() if cells > 1 and level + 1 < LEVELS else left
        last = after > (1 - GAIN) * left
        own = (F.lit(level) * F.lit(1 << 58) + F.col("cell") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id")
        final = solved if last else solved.filter(F.col("filled") >= LOOSE * capacity)
        placed.append(final.select("row", own, "length"))
        if last:
            break
        rest, left, level = loose.select("row", "length"), after, level + 1
    if not placed:
        return full.select("row", "sequence_id", F.col("at").cast("long").alias("offset"))
    every = placed[0]
    for more in placed[1:]:
        every = every.union(more)
    held = every.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("row", "length"))).alias("d"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<row:bigint,offset:bigint>>").alias("out"))

    def lay(acc, d):
        out = F.concat(acc["out"], F.array(F.struct(d["row"].alias("row"), acc["at"].alias("offset"))))
        return F.struct((acc["at"] + d["length"]).alias("at"), out.alias("out"))

    laid = held.select("sequence_id", F.explode(F.aggregate("d", zero, lay, lambda acc: acc["out"])).alias("o"))
    return laid.select("o.row", "sequence_id", "o.offset").union(full.select("row", "sequence_id", F.col("at").cast("long")))


def token_pieces(docs: DataFrame, path: str, end: int = 1, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every document's ids, ``end`` last, cut into pieces of ``capacity``."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def tokenise(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = word_pieces(path)
        found: list[tuple[int, int, int, int]] = []
        for row, text in enumerate(batch.column("text").to_pylist()):
            ids = pieces.of_text(text) + end.to_bytes(4, "little")
            found += [(row, k, len(p) // 4, zlib.crc32(p)) for k, p in enumerate(cut(ids, 4, capacity))]
        row, piece, length, crc = (pa.array([f[i] for f in found], pa.int64()) for i in range(4))
        start = pa.array([f[1] * capacity for f in found], pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("key").take(row), piece.cast(pa.int32()), start, length, crc], ["key", "piece", "start", "length", "ids_crc32"]
        )

    kind = dict(rows.dtypes)["key"]
    return in_batches(rows, tokenise, f"key {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of every document: key, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone. Rows that repeat a key are packed each by
    itself. Only documents longer than ``capacity`` are cut. An empty table gives an empty
    result. Other columns are left out.
    """
    pieces = token_pieces(docs, path or vocabulary("word_bpe_49k.json"), capacity=capacity, key=key, text=text)
    pieces = cut_lineage(pieces.withColumn("row", F.monotonically_increasing_id()))
    placed = pack(pieces.select("row", "length"), capacity)
    return pieces.join(placed, "row").drop("row").withColumnRenamed("key", key)

