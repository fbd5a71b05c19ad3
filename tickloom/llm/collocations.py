"""Phrase collocations by stripes.

A stripe is a prefix with a counter of the words that follow it. Every batch of texts makes
its own stripes, the shuffle brings those of a prefix together, and they are merged element
by element. From the merged stripes come the counts of all phrases of one more word, the
totals of prefixes, and the most frequent extensions to the right (the largest element of a
stripe) and to the left (stripes of prefixes that end alike, merged by maximum).

A phrase is no more frequent than any phrase within it. So stripes are made by length, and
only along phrases whose parts were frequent enough. Which those are, tasks look up in bit
maps of a fixed size: a wrong yes costs a row in the shuffle, a wrong no cannot happen, and
counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import cut_lineage

LONGEST = 4
LEAST = 30
TOP = 2000
SCALE = 2_000_000
#: A longer candidate takes the place of its parts if it has this share of their count, in hundredths.
SHARE = 80
#: Bytes of text whose stripes a task makes at once.
BATCH_BYTES = 8 << 20
#: Bits of a map; two of them stand for a phrase.
MAP_BITS = 1 << 26
#: Stripes of prefixes with over 1 / HOT of all words are dealt in so many parts; there are at most HOT such prefixes.
HOT, PARTS = 1000, 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_ODD = np.uint64(0x9E3779B97F4A7C15)


def tokens(texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
    """Distinct words, the word at each place, and whether it goes on the piece of the one before."""
    raw = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    kind = _KIND[raw]
    inside = kind == 0
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    coded = words.dictionary_encode()
    breaks = np.cumsum(kind == 2)[starts] if len(starts) else np.zeros(0, np.int64)
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.diff(breaks, prepend=-1) == 0


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def extend_hash(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of their prefixes and last words."""
    mixed = (prefix * _ODD) ^ (word + (prefix >> np.uint64(29)))
    return mixed * _ODD ^ (mixed >> np.uint64(32))


def phrase_hash(phrase: bytes) -> int:
    parts = word_hashes(phrase.split(b" "))
    have = parts[:1]
    for i in range(1, len(parts)):
        have = extend_hash(have, parts[i : i + 1])
    return int(have[0])


def _places(hashes: np.ndarray, lang: str) -> tuple[np.ndarray, np.ndarray]:
    own = hashes ^ np.uint64(xxhash.xxh64_intdigest(lang.encode()))
    own = (own ^ (own >> np.uint64(31))) * _ODD
    return own >> np.uint64(38), (own * _ODD) >> np.uint64(38)


class BitMap:
    """Phrases of one length that are frequent enough, as a Bloom filter of ``MAP_BITS``."""

    def __init__(self, rows: np.ndarray, bits: np.ndarray):
        self.rows, self.bits = rows, bits

    def has(self, hashes: np.ndarray, lang: str) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in _places(hashes, lang):
            row = np.searchsorted(self.rows, at >> np.uint64(6))
            row[row == len(self.rows)] = 0
            hit = (self.rows[row] == at >> np.uint64(6)) & ((self.bits[row] >> (at & np.uint64(63))) & np.uint64(1) == 1) if len(self.rows) else False
            found &= hit
        return found


def bit_map(phrases: DataFrame) -> BitMap:
    """The map of ``phrases`` (lang, phrase). At most ``MAP_BITS`` bits reach the driver, whatever their number."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, words = [], []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for at in _places(np.array([phrase_hash(phrase)], np.uint64), lang):
                    rows.append(int(at[0]) >> 6)
                    words.append(1 << (int(at[0]) & 63))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(np.array(words, np.uint64).view(np.int64))], ["row", "bits"])

    found = phrases.select("lang", F.col("phrase").cast("binary")).mapInArrow(bits, "row long, bits long")
    got = found.groupBy("row").agg(F.bit_or("bits").alias("bits")).toArrow()
    rows = got.column("row").to_numpy().astype(np.uint64)
    order = np.argsort(rows)
    return BitMap(rows[order], got.column("bits").to_numpy().view(np.uint64)[order])


def _stripes_of(lang: str, texts: list[bytes], length: int, maps: list[tuple], hot: set[int]) -> pa.RecordBatch:
    """The stripes of one batch: prefixes of ``length - 1`` words, the words after them and how often."""
    words, place, joined = tokens(texts)
    n_words = len(words)
    hashes = word_hashes(words.to_pylist())
    ids, id_hash = place, hashes
    prefixes = pa.array([b""], pa.large_binary())
    prefix_hash, prefix_of, next_of = np.zeros(1, np.uint64), np.zeros(n_words, np.int64), np.arange(n_words)
    counts = np.bincount(place, minlength=n_words)
    texts_of = words
    valid = np.ones(len(place), bool)
    for m in range(2, length + 1):
        often = BitMap(*maps[m - 2]).has(id_hash, lang)
        valid = valid & often[ids] if len(often) else np.zeros(len(place), bool)
        both = np.zeros(len(place), bool)
        both[: len(place) - m + 1] = valid[: len(place) - m + 1] & valid[1 : len(place) - m + 2] & joined[m - 1 :] if len(place) >= m else False
        at = np.flatnonzero(both)
        keys, ids_at, counts = np.unique(ids[at] * n_words + place[at + m - 1], return_inverse=True, return_counts=True)
        prefixes, prefix_hash = texts_of, id_hash
        prefix_of, next_of = keys // max(1, n_words), keys % max(1, n_words)
        id_hash = extend_hash(prefix_hash[prefix_of], hashes[next_of])
        if m < length:
            texts_of = _joined(prefixes, prefix_of, words, next_of)
        ids = np.zeros(len(place), np.int64)
        ids[at], valid = ids_at, both
    if length == 1:
        part = (hashes % np.uint64(PARTS)).astype(np.int32)
    else:
        busy = np.fromiter((int(h) in hot for h in prefix_hash), bool, len(prefix_hash)) if hot else np.zeros(len(prefix_hash), bool)
        part = np.where(busy[prefix_of], hashes[next_of] % np.uint64(PARTS), np.uint64(0)).astype(np.int32)
    order = np.lexsort((part, prefix_of))
    prefix_of, next_of, counts, part = prefix_of[order], next_of[order], counts[order], part[order]
    first = np.flatnonzero((np.diff(prefix_of, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
    offsets = pa.array(np.append(first, len(prefix_of)), pa.int32())
    following = pa.ListArray.from_arrays(offsets, words.take(pa.array(next_of)).cast(pa.binary()))
    columns = [
        pa.array([lang] * len(first), pa.string()),
        prefixes.take(pa.array(prefix_of[first])).cast(pa.binary()).cast(pa.string()),
        pa.array(part[first], pa.int32()),
        pc.binary_join(following, pa.scalar(b" ", pa.binary())).cast(pa.string()),
        pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32())),
    ]
    return pa.RecordBatch.from_arrays(columns, ["lang", "prefix", "part", "words", "counts"])


def _joined(prefixes: pa.Array, prefix_of: np.ndarray, words: pa.Array, next_of: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(prefixes.take(pa.array(prefix_of)), words.take(pa.array(next_of)), pa.scalar(b" ", pa.large_binary()))


def stripes(docs: DataFrame, length: int, maps: list[BitMap], hot: set[int]) -> DataFrame:
    """Stripes of prefixes of ``length - 1`` words, merged: lang, prefix, word, a.

    ``docs`` has lang and text (binary). The counter of one prefix is dealt by prefix and part,
    as whole stripes; a task then adds up the elements of its stripes.
    """
    tables = [(m.rows, m.bits) for m in maps]
    held = docs.sparkSession.sparkContext.broadcast((tables, hot))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                waiting.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] >= BATCH_BYTES:
                    yield _stripes_of(lang, waiting.pop(lang), length, *held.value)
                    size[lang] = 0
        for lang, texts in waiting.items():
            yield _stripes_of(lang, texts, length, *held.value)

    # A stripe's words are one string: they hold no space.
    made = docs.mapInArrow(make, "lang string, prefix string, part int, words string, counts array<int>")
    dealt = made.repartition("lang", "prefix", "part")
    zipped = F.arrays_zip(F.split("words", " ").alias("word"), F.col("counts").alias("n"))
    elements = dealt.select("lang", "prefix", "part", F.inline(zipped).alias("word", "n"))
    merged = elements.groupBy("lang", "prefix", "part", "word").agg(F.sum("n").alias("a"))
    return merged.select("lang", "prefix", "word", "a")


def _phrase(prefix, word):
    return F.when(prefix == "", word).otherwise(F.concat(prefix, F.lit(" "), word))


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): lang, length, prefix, word, phrase and a of every phrase of up to
    ``longest`` words that occurs ``least`` times or more; and lang, n, the number of all words."""
    texts = docs.filter(F.col("text").isNotNull()).select(
        F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")
    )
    found, maps, hot, totals = [], [], set(), None
    for m in range(1, longest + 1):
        level = stripes(texts, m, maps, hot)
        if m == 1:
            level = cut_lineage(level)
            totals = cut_lineage(level.groupBy("lang").agg(F.sum("a").alias("n")))
            words = totals.agg(F.sum("n")).first()[0] or 0
        level = level.filter(F.col("a") >= least).withColumn("phrase", _phrase(F.col("prefix"), F.col("word")))
        level = cut_lineage(level.select("lang", F.lit(m).alias("length"), "prefix", "word", "phrase", "a"))
        found.append(level)
        if m < longest:
            maps.append(bit_map(level))
            busy = level.filter(F.col("a") * HOT > words).select(F.col("phrase").cast("binary").alias("p")).distinct()
            hot = {phrase_hash(bytes(r.p)) for r in busy.collect()}
    whole = found[0]
    for level in found[1:]:
        whole = whole.union(level)
    return whole, totals


def subsumed(phrases: DataFrame, share: int = SHARE) -> DataFrame:
    """(lang, phrase, longest_a): the largest count of a phrase one word longer that holds the phrase.

    Any longer phrase holds one that is one word longer than the phrase and at least as
    frequent, so one word is enough.
    """
    stripe = phrases.filter("length > 1")
    right = stripe.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.max("a").alias("a"))
    tail = F.expr("if(length = 2, word, concat(substr(prefix, char_length(substring_index(prefix, ' ', 1)) + 2), ' ', word))")
    left = stripe.groupBy("lang", tail.alias("phrase")).agg(F.max("a").alias("a"))
    return right.union(left).groupBy("lang", "phrase").agg(F.max("a").alias("longest_a"))


def score(a, left, right):
    """floor(SCALE a / (left + right)), exact beyond 64 bits."""
    return F.expr(f"cast({a} as decimal(19, 0)) * {SCALE} div (cast({left} as decimal(19, 0)) + cast({right} as decimal(19, 0)))")


def collocations(docs: DataFrame, top: int = TOP, longest: int = LONGEST, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are taken whole, A to Z lower-cased, cut into pieces at ``.,;:!?`` and line ends and
    into words at spaces and tabs. Phrases of two to ``longest`` words that occur ``least``
    times are cut in two where the score ``a / (l + r)`` is lowest (of equal scores, after
    the fewest words). Those that a longer candidate holds with ``share`` hundredths of
    their count are dropped. Equal scores are ranked by count, then by the phrase's bytes.

    Null and empty texts have no words; a null lang counts as ``und``. Repeated rows count
    each time. Other columns are ignored. An empty table gives an empty result.
    """
    if longest < 2:
        raise ValueError("phrases have at least two words")
    phrases, totals = phrase_counts(docs, longest, least)
    cuts = phrases.filter("length > 1").select("lang", "phrase", "a", F.explode(F.expr("sequence(1, length - 1)")).alias("k"))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("tail", F.expr("substr(phrase, char_length(head) + 2)"))
    heads = phrases.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    tails = phrases.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r"))
    every = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    lowest = F.min(F.struct(score("a", "l", "r").alias("score"), "k", "l", "r")).alias("cut")
    best = cut_lineage(every.groupBy("lang", "phrase", "a").agg(lowest))
    left = best.join(subsumed(phrases, share), ["lang", "phrase"], "left")
    wide = "cast(coalesce(longest_a, 0) as decimal(19, 0)) * 100 >= cast(a as decimal(19, 0)) * " + str(int(share))
    kept = left.filter(f"not ({wide})").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # No task ranks more than the first rows of its parts of a language.
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    some = kept.withColumn("at", F.row_number().over(part)).filter(F.col("at") <= top).drop("at")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    ranked = some.withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
