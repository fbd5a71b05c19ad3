"""Near-duplicates by SimHash fingerprints.

Fingerprints that differ in few bits agree in whole blocks of bits (pigeonhole), so they are
joined on blocks and verified by their Hamming distance. Where the threshold is one of
shingles and not of bits, an exact join of the groups found so far gives the pairs that
differ in more bits than blocks can tell.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import components, in_batches
from tickloom.session import cut_lineage

BITS = 64
#: 64-bit words of a wide fingerprint.
WIDE = 4
#: Keys of a wide fingerprint besides its blocks, of 16 bits each that lie anywhere in it; with as
#: many, nine tenths of the pairs at 40 bits share one. An exact join that follows needs fewer.
SAMPLES, FEW_SAMPLES = 32, 8
#: Nodes that should share a key by chance, as a power of two: keys get longer beyond that, and more of them.
CROWD = 8
#: Differing bits of a wide fingerprint: a candidate, and one so close that its links are made at once.
WIDE_DISTANCE, WIDE_SURE = 56, 24
#: Jaccard similarity of shingles that makes a candidate a near-duplicate.
SIMILARITY = 0.8
#: One of so many texts tells which shingles are common: those of so many of these, and at most so many.
#: This sets an order of shingles only, and with it the work; results are the same in any order.
COUNTED, COMMON, MOST_COMMON = 16, 4, 1 << 16
#: Shingles whose bits are added up at once; nodes in a group that is not taken node by node.
SLICE, FEW = 1 << 14, 12


def _words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def _digests(words: list[bytes], width: int, digest: Callable[[bytes], bytes]) -> Iterator[np.ndarray]:
    """Digests of the shingles, a row of bytes each, ``SLICE`` at once; a shingle is ``width`` words, or all if there are fewer."""
    flat = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, stops = (ends - sizes).tolist(), ends[min(width, len(words)) - 1 :].tolist()
    for at in range(0, len(stops), SLICE):
        made = b"".join([digest(flat[x:y]) for x, y in zip(starts[at : at + SLICE], stops[at : at + SLICE])])
        yield np.frombuffer(made, np.uint8).reshape(min(SLICE, len(stops) - at), -1)


def _bits(digests: Iterator[np.ndarray]) -> bytes:
    """Bits set in over half of the digests, little-endian."""
    ones, count = 0, 0
    for part in digests:
        ones, count = ones + np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64), count + len(part)
    return np.packbits(2 * ones > count, bitorder="little").tobytes()


def fingerprint(text: str | None, width: int, seed: int = 42) -> int:
    """Signed 64 bits from XXH64. No words: 0."""
    words = _words(text)
    found = _bits(_digests(words, width, lambda x: xxhash.xxh64_intdigest(x, seed).to_bytes(8, "little"))) if words else b""
    return int.from_bytes(found, "little", signed=True)


def _long_digest(shingle: bytes) -> bytes:
    return xxhash.xxh3_128_digest(shingle, 1) + xxhash.xxh3_128_digest(shingle, 2)


def wide_fingerprint(text: str | None, width: int) -> tuple[tuple[int, ...], np.ndarray]:
    """WIDE signed 64-bit words from two XXH3 digests of 128 bits, and the set of shingles as the first 64 of them. No words: 0."""
    words, heads = _words(text), []
    if not words:
        return (0,) * WIDE, np.zeros(0, np.int64)

    def noted() -> Iterator[np.ndarray]:
        for part in _digests(words, width, _long_digest):
            heads.append(part[:, :8].copy().view("<i8").ravel())
            yield part

    found = _bits(noted())
    return tuple(np.frombuffer(found, "<i8").tolist()), np.unique(np.concatenate(heads))


def fingerprints(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, body, f0) of every row, A-Z lower-cased, ``width`` words a shingle; body is a hash of the text."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("body"), F.col(text).alias("text"))

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([fingerprint(x, width) for x in batch.column("text").to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("body"), found], ["key", "body", "f0"])

    return in_batches(rows, hashed, f"key {dict(rows.dtypes)['key']}, body long, f0 long")


def prefix(found: np.ndarray, similarity: float, common: np.ndarray | None = None) -> np.ndarray:
    """So many first shingles of a set, in one order for all sets, that any two sets that similar share one of them.

    A set that is similar has ``similarity`` of these in common at least, and so one of all
    but that many and one more. Common shingles come last in the order.
    """
    if common is not None and len(common):
        last = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
        found = np.concatenate([found[~last], found[last]])
    return found[: len(found) - needed(len(found), similarity) + 1] if len(found) else found


def needed(size: int, similarity: float) -> int:
    """The least number of a set's shingles that a similar set holds."""
    return math.ceil(similarity * size - 1e-9)


def common_shingles(docs: DataFrame, width: int, text: str = "text", counted: int = COUNTED, least: int = COMMON) -> np.ndarray:
    """Hashes of shingles that many texts hold, in order; at most ``MOST_COMMON``."""
    chosen = docs.select(F.col(text).alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(counted)) == 0)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(x, width) for x in batch.column("text").to_pylist()]))], ["token"])

    counts = in_batches(chosen, cut, "token long").groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    top = counts.orderBy(F.desc("n"), "token").limit(MOST_COMMON).select("token").toArrow()
    return np.sort(top.column("token").to_numpy())


def wide_fingerprints(docs: DataFrame, width: int, similarity: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, body, f0, ..., id, size, prefix) of every row: id stands for its set of shingles, size is their number."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("body"), F.col(text).alias("text"))
    parts, common = [f"f{i}" for i in range(WIDE)], common_shingles(docs, width, text)

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [wide_fingerprint(x, width) for x in batch.column("text").to_pylist()]
        columns = [pa.array([f[i] for f, _ in found], pa.int64()) for i in range(WIDE)]
        ids = pa.array([xxhash.xxh3_64_intdigest(x.tobytes(), 3) - (1 << 63) for _, x in found], pa.int64())
        sizes = pa.array([len(x) for _, x in found], pa.int32())
        first = pa.array([prefix(x, similarity, common) for _, x in found], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("body"), *columns, ids, sizes, first], ["key", "body", *parts, "id", "size", "prefix"]
        )

    kinds = "".join(f"{p} long, " for p in parts)
    return in_batches(rows, hashed, f"key {dict(rows.dtypes)['key']}, body long, {kinds}id long, size int, prefix array<long>")


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks of every ``blocks - distance`` blocks: two fingerprints at most ``distance`` bits apart agree under one."""
    if not distance < blocks <= BITS:
        raise ValueError("more blocks than differing bits are needed, and at most one per bit")
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    each = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(cuts)]
    return [sum(c) for c in itertools.combinations(each, blocks - distance)]


def mask_keys(distance: int, blocks: int) -> list[Column]:
    """What a 64-bit fingerprint f0 holds under each of ``block_masks``."""
    masks = [m - (1 << BITS) if m >> (BITS - 1) else m for m in block_masks(distance, blocks)]
    return [F.col("f0").bitwiseAND(F.lit(m)) for m in masks]


def block_keys(size: int = 16) -> list[Column]:
    """The blocks of ``size`` bits (a divisor of 64) of a wide fingerprint."""
    per = BITS // size
    return [
        F.shiftrightunsigned(f"f{i // per}", size * (i % per)).bitwiseAND(F.lit((1 << size) - 1)) for i in range(WIDE * per)
    ]


def sample_keys(count: int = SAMPLES, size: int = 16) -> list[Column]:
    """What a wide fingerprint holds at ``count`` fixed choices of ``size`` of its bits, hashed.

    Bits that a pair differs in spread over all choices alike, however they lie in blocks.
    """
    rng, keys = random.Random(1), []
    for _ in range(count):
        chosen = rng.sample(range(WIDE * BITS), size)
        masks = [sum(1 << b % BITS for b in chosen if b // BITS == i) for i in range(WIDE)]
        masks = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
        keys.append(F.xxhash64(*[F.col(f"f{i}").bitwiseAND(F.lit(m)) for i, m in enumerate(masks) if m]))
    return keys


def links(nodes: DataFrame, keys: list[Column], distance: int, sure: int | None = None, most: int = 4096) -> DataFrame:
    """Links (a, b) that connect all nodes (id, f0, ...) that share a key and differ in at most ``distance`` bits.

    Each node goes to one bucket per key. A bucket of more than ``most`` is cut into parts by
    a hash, and every two parts of it meet in a cell of their own, so that a task holds about
    ``2 * most`` at once however full the bucket is and no pair is left out. A large cell
    gives a spanning forest of its pairs, not the pairs: at most as many links as rows. Of
    links above ``sure`` bits the forest takes the closest, so that any pair of a cell is
    connected by links that are each at least as close as the pair, or sure.
    """
    words = [c for c in nodes.columns if c != "id"]
    held = F.array(*[F.struct(F.lit(i).alias("block"), k.alias("bits")) for i, k in enumerate(keys)])
    placed = nodes.select("*", F.explode(held).alias("k")).select("id", *words, "k.block", "k.bits")
    sizes = placed.groupBy("block", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / F.lit(most)).cast("int")
    shared = placed.join(sizes, ["block", "bits"]).withColumn("parts", parts)
    shared = shared.withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # A cell of two different parts holds both; with one part there is the one cell (0, 0).
    cells = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.least(i, "own").alias("p"), F.greatest(i, "own").alias("q"))
    )
    cell = ["block", "bits", "p", "q"]
    rows = shared.select("id", *words, "block", "bits", F.explode(cells).alias("c")).select(
        F.col("block").cast("long").alias("block"), "bits", F.col("c.p").cast("long").alias("p"), F.col("c.q").cast("long").alias("q"), "id", *words
    )
    dealt = rows.repartition(*cell).sortWithinPartitions(*cell)
    names = dealt.columns

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: np.ndarray | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                table = np.stack([batch.column(c).to_numpy() for c in names])
                table = table if left is None else np.concatenate([left, table], axis=1)
            elif left is None:
                return
            else:
                table = left
            if not table.shape[1]:
                continue
            new = np.flatnonzero((table[:4, 1:] != table[:4, :-1]).any(axis=0)) + 1
            edges = np.concatenate([[0], new, [table.shape[1]]])
            upto = len(edges) - 1 if batch is None else len(edges) - 2
            left = table[:, edges[upto] :]
            a, b = forests(table[4], table[5:].view(np.uint64), edges[: upto + 1], distance, sure)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt.mapInArrow(forest, "a long, b long").distinct()


def _apart(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.bitwise_count(one ^ other).sum(axis=0, dtype=np.int64)


def forests(
    ids: np.ndarray, words: np.ndarray, edges: np.ndarray, distance: int, sure: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the close nodes of each group ``edges[i]`` to ``edges[i + 1]``.

    Groups of a few nodes are taken together, size by size, and give all their links. Larger
    ones grow node by node: a node takes all within ``sure`` bits along, and when none is left
    the closest node within ``distance`` of any that was taken.
    """
    sure = distance if sure is None else sure
    out = [(ids[:0], ids[:0])]
    size, at = np.diff(edges), edges[:-1]
    for n in range(2, FEW + 1):
        start = at[size == n]
        for i, j in itertools.combinations(range(n), 2) if len(start) else ():
            near = start[_apart(words[:, start + i], words[:, start + j]) <= distance]
            out.append((ids[near + i], ids[near + j]))
    for start, n in zip(at[size > FEW].tolist(), size[size > FEW].tolist()):
        rest = np.arange(start + 1, start + n)
        best, via = np.full(n - 1, distance + 1), np.zeros(n - 1, np.int64)
        front = [start]
        while len(rest):
            if not front:
                at_best = int(best.argmin())
                if best[at_best] <= distance:
                    out.append((ids[via[at_best : at_best + 1]], ids[rest[at_best : at_best + 1]]))
                front = [int(rest[at_best])]
                rest, best, via = (np.delete(x, at_best) for x in (rest, best, via))
                continue
            node = front.pop()
            apart = _apart(words[:, rest], words[:, node : node + 1])
            taken = apart <= sure
            if taken.any():
                hit, left = rest[taken], ~taken
                out.append((np.full(len(hit), ids[node]), ids[hit]))
                front += hit.tolist()
                rest, best, via, apart = rest[left], best[left], via[left], apart[left]
            if sure < distance:
                closer = apart < best
                best[closer], via[closer] = apart[closer], node
    return tuple(np.concatenate([x[i] for x in out]) for i in (0, 1))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The set of the text's shingles as 64-bit hashes, those of its wide fingerprint."""
    words = _words(text)
    found = [part.copy().view("<i8").ravel() for part in _digests(words, width, lambda x: xxhash.xxh3_128_digest(x, 1)[:8])] if words else []
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def alike(linked: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, similarity: float, key: str, text: str) -> DataFrame:
    """Those of the links (a, b) whose texts have that share of shingles in common.

    ``nodes`` has id and least: (key, body) of the document that stands for the node. Only the
    texts of documents in a link are cut into shingles.
    """
    ends = linked.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = nodes.join(ends, "id").select("id", F.col("least.key").alias("key"), F.col("least.body").alias("body"))
    texts = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("body"), F.col(text).alias("text"))
    same = wanted["key"].eqNullSafe(texts["key"]) & (wanted["body"] == texts["body"])
    found = texts.join(wanted, same).select("id", "text")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = pa.array([shingles(x, width) for x in batch.column("text").to_pylist()], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column("id"), sets], ["id", "set"])

    sets = cut_lineage(in_batches(found, cut, "id long, set array<long>").dropDuplicates(["id"]))
    both = linked.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    whole = F.size("x") + F.size("y") - shared
    return both.filter(shared >= F.lit(similarity) * whole).select("a", "b")


def across(sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of sets of different groups that may be that similar; none that is, is left out.

    ``sets`` has id, root (the group), size and prefix. Similar sets share a shingle of their
    prefixes (:func:`prefix`). A pair stays a candidate if what its prefixes share and all
    that lies behind them would be enough.
    """
    placed = sets.select("id", "root", "size", F.explode("prefix").alias("token"))
    held = Window.partitionBy("token")
    ends = placed.withColumns({"__low": F.min("root").over(held), "__high": F.max("root").over(held)})
    shared = cut_lineage(ends.filter("__low <> __high").drop("__low", "__high"))
    one = shared.select("token", F.col("id").alias("a"), F.col("root").alias("__a"), F.col("size").alias("x"))
    other = shared.select("token", F.col("id").alias("b"), F.col("root").alias("__b"), F.col("size").alias("y"))
    pairs = one.join(other, "token").filter("a < b AND __a <> __b").filter(F.least("x", "y") >= F.lit(similarity - 1e-9) * F.greatest("x", "y"))
    pairs = pairs.groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))
    # One of the two prefixes ends first: all that both sets hold up to there, both prefixes hold.
    behind = F.ceil(F.lit(similarity) * F.greatest("x", "y") - F.lit(1e-9)) - 1
    enough = F.lit(similarity / (1 + similarity)) * (F.col("x") + F.col("y")) - F.lit(1e-6)
    return pairs.filter(F.col("n") + behind >= enough).select("a", "b")


def near_duplicates(
    docs: DataFrame, width: int = 5, distance: int | None = None, wide: bool = True, key: str = "doc_id", text: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """One row per document: key, its fingerprint's words f0, ... and component, the smallest key reachable by links.

    A fingerprint of 64 bits (``wide=False``) links at ``distance`` (4) or fewer differing
    bits, and every such pair is found: all but four of six blocks make a key. One of 256
    bits tells similarities of 0.8 from smaller ones, which 64 cannot: 0.8 of shingles of
    ``width`` words is 39 differing bits on average. Pairs of 56 bits or fewer are candidates
    and become links if ``similarity`` of their shingles are the same. The keys are blocks of 16
    bits, one of which any pair of fewer than 16 differing bits shares, and choices of 16 bits
    from all. In tables of over 2**24 fingerprints the choices get a bit longer with every doubling,
    and so many more that as many pairs share one; blocks are of 32 bits then. What is as similar
    but shares no key, or differs in more bits, is found by an exact join of the groups made so
    far (:func:`across`), so that the groups are those of all pairs.

    Documents with equal fingerprints, or of 256 bits with equal sets of shingles, are one node, so that
    copies, however many, are counted and not paired. Null and empty texts have fingerprint 0 and link
    like any other. Rows with a null key keep it; they count for links, and a group of only such rows has a
    null component. Rows that repeat a key get a row each. An empty table gives an empty result.
    """
    if distance is None:
        distance = WIDE_DISTANCE if wide else 4
    rows = cut_lineage(wide_fingerprints(docs, width, similarity, key, text) if wide else fingerprints(docs, width, key, text).withColumn("id", F.col("f0")))
    words = [c for c in rows.columns if c in {f"f{i}" for i in range(WIDE)}]
    if wide:
        nodes = rows.groupBy("id").agg(F.min(F.struct("key", "body", *words)).alias("at"))
        nodes = cut_lineage(nodes.select("id", *[f"at.{w}" for w in words], F.struct("at.key", "at.body").alias("least")))
        longer = max(0, math.ceil(math.log2(max(1, nodes.count()))) - 16 - CROWD)
        # A bit more is alike in 0.85 of the pairs at 0.8.
        keys = block_keys(32 if longer else 16) + sample_keys(math.ceil(FEW_SAMPLES / 0.85**longer), 16 + longer)
        linked = cut_lineage(links(nodes.select("id", *words), keys, distance, WIDE_SURE))
        close = components(alike(linked, nodes, docs, width, similarity, key, text))
        grouped = nodes.select("id").join(close.withColumnsRenamed({"node": "id", "component": "root"}), "id", "left")
        # Rows of one id have one prefix.
        sets = rows.groupBy("id").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"))
        far = cut_lineage(across(sets.join(grouped.withColumn("root", F.coalesce("root", "id")), "id"), similarity))
        linked = close.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(alike(far, nodes, docs, width, similarity, key, text))
    else:
        nodes = rows.groupBy("id", *words).agg(F.min(F.struct("key", "body")).alias("least"))
        linked = links(nodes.drop("least"), mask_keys(distance, distance + 2), distance)
    groups = components(linked).select(F.col("node").alias("id"), F.col("component").alias("root"))
    rooted = nodes.select("id", F.col("least.key").alias("least")).join(groups, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(least, "root").select("id", "component")
    return rows.join(named, "id").select(F.col("key").alias(key), *words, "component")
