"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over a window of words that ignores some positions. Windows of the
benchmark and of the documents are hashed under each mask and joined on the hashes; a hit is
verified word by word and may differ in a few words anywhere in the window.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import in_batches, text_key

#: Words compared at once, and the share of them that must agree.
WINDOW, SHARE = 12, 0.8
#: Words of an item that make a document go; shorter items are only reported.
PASSAGE = 5
#: Window positions fall into this many classes by their remainder.
CLASSES = 4
#: Odd multipliers, one per window position, from the golden ratio's 64 bits.
STEPS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def masks(window: int, differing: int) -> list[list[int]]:
    """Positions that each seed looks at; however ``differing`` positions lie, one seed ignores them all.

    A seed ignores ``differing`` of the classes of positions, so that its positions are
    spread over the window.
    """
    if differing == 0 < window:
        return [list(range(window))]
    if not 0 < differing < CLASSES <= window:
        raise ValueError("fewer differing words than classes, and a window of a word per class at least, are needed")
    return [
        [i for i in range(window) if i % CLASSES not in ignored]
        for ignored in itertools.combinations(range(CLASSES), differing)
    ]


class Shape(NamedTuple):
    """Windows of so many words, the seeds they are hashed under, numbered from ``first``, and how many words must agree."""

    window: int
    seeds: list[list[int]]
    first: int
    least: int


def shapes(window: int, share: float, shorter: Iterable[int] = ()) -> list[Shape]:
    """The shape of whole windows, then one for each length of shorter items."""
    out, first = [], 0
    for n in [window, *sorted(set(shorter))]:
        least = math.ceil(round(n * share, 9))
        out.append(Shape(n, masks(n, n - least), first, least))
        first += len(out[-1].seeds)
    return out


def word_hashes(text: str | None) -> np.ndarray:
    """XXH64 of the words between ASCII white space, A-Z lower-cased."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in text.encode().lower().split()] if text else [], np.uint64)


def seed_hashes(words: np.ndarray, shape: Shape) -> np.ndarray:
    """(seed, window start) -> 64 bits."""
    n = len(words) - shape.window + 1
    out = np.empty((len(shape.seeds), max(n, 0)), np.uint64)
    if n <= 0:
        return out
    scaled = {i: words[i : i + n] * STEPS[i] for i in range(shape.window)}
    for k, seed in enumerate(shape.seeds):
        total = np.full(n, (shape.first + k + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1, np.uint64)
        for i in seed:
            total += scaled[i]
        total ^= total >> np.uint64(31)
        out[k] = total * np.uint64(0xD6E8FEB86659FD93)
    return out


def _windows(rows: DataFrame, cuts: list[Shape], filter_bits: bytes | None) -> DataFrame:
    """(id, body, at, seed, hash, words) of windows.

    With a filter, those of documents that may be in it. Without, those of benchmark items: an
    item shorter than the first shape's window has one, of all its words.
    """
    kind, body = dict(rows.dtypes)["id"], "body" in rows.columns
    held = rows.sparkSession.sparkContext.broadcast(filter_bits) if filter_bits is not None else None

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.frombuffer(held.value, np.uint8) if held else None
        found = {k: [] for k in ("row", "at", "seed", "hash", "size")}
        words = []
        for row, text in enumerate(batch.column("text").to_pylist()):
            own = word_hashes(text)
            for shape in cuts:
                if bits is None and shape.window != min(len(own), cuts[0].window):
                    continue
                for k, hashes in enumerate(seed_hashes(own, shape), shape.first):
                    at = np.arange(len(hashes)) if bits is None else np.flatnonzero(_may_hold(bits, hashes))
                    found["row"].append(np.full(len(at), row))
                    found["at"].append(at)
                    found["seed"].append(np.full(len(at), k))
                    found["hash"].append(hashes[at].view(np.int64))
                    found["size"].append(np.full(len(at), shape.window))
                    words += [own[i : i + shape.window].view(np.int64) for i in at]
        row, at, seed, hashes, size = (np.concatenate([np.empty(0, np.int64), *found[k]]) for k in found)
        flat = np.concatenate([np.empty(0, np.int64), *words])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat))
        take = pa.array(row.astype(np.int64))
        columns = [batch.column("id").take(take)] + ([batch.column("body").take(take)] if body else [])
        columns += [pa.array(at.astype(np.int32)), pa.array(seed.astype(np.int32)), pa.array(hashes), lists]
        return pa.RecordBatch.from_arrays(columns, ["id"] + ["body"] * body + ["at", "seed", "hash", "words"])

    schema = f"id {kind}, " + "body string, " * body + "at int, seed int, hash long, words array<long>"
    return in_batches(rows, cut, schema, rows=64)


def _probes(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return hashes & mask, (hashes >> np.uint64(32)) * np.uint64(0x9E3779B1) & mask


def _may_hold(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    first, second = _probes(hashes, len(table) * 8)
    hit = table[first >> np.uint64(3)] >> (first & np.uint64(7)).astype(np.uint8) & 1
    at = np.flatnonzero(hit)
    hit[at] = table[second[at] >> np.uint64(3)] >> (second[at] & np.uint64(7)).astype(np.uint8) & 1
    return hit.astype(bool)


def _filter(seeded: DataFrame, bits: int) -> bytes:
    """A Bloom filter of all hashes in ``bits`` (a power of two) bits, made per task and merged one by one."""

    def make(batches):
        table = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for probe in _probes(batch.column("hash").to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(table, probe >> np.uint64(3), np.uint8(1) << (probe & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], ["bits"])

    total = np.zeros(bits // 8, np.uint8)
    for row in seeded.select("hash").coalesce(8).mapInArrow(make, "bits binary").toLocalIterator():
        total |= np.frombuffer(row.bits, np.uint8)
    return total.tobytes()


def overlaps(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, shortest: int = 1, filter_bits: int = 1 << 24,
    key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(doc, body, at, size, item): every window of a document that agrees with one of a benchmark item in ``share`` of its words.

    at counts words from 0, size is the window's. An item of fewer words than ``window``, but at
    least ``shortest``, is one window of all its words. A window that several items have is
    reported for each of them; they are joined by the window itself, after the hits are
    verified. Of the benchmark only a filter of ``filter_bits`` bits is broadcast, whatever
    its size; it thins the documents' windows. Texts without a word (and null ones) have no window.
    """
    tests = benchmark.select(F.col(item).alias("id"), F.col(item_text).alias("text"))
    n_words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    lengths = tests.filter("text IS NOT NULL").select(n_words.alias("n")).filter((F.col("n") >= shortest) & (F.col("n") > 0) & (F.col("n") < window))
    cuts = shapes(window, share, [r.n for r in lengths.distinct().collect()])
    tests = _windows(tests, cuts, None)
    seeded = tests.select("seed", "hash", F.col("words").alias("test_words")).distinct()
    table = _filter(seeded, filter_bits)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), text_key(F.col(text)).alias("body"))
    hits = _windows(rows, cuts, table)
    agree = F.size(F.filter(F.zip_with("words", "test_words", lambda a, b: a == b), lambda same: same))
    least = F.element_at(F.create_map(*[F.lit(x) for c in cuts for x in (c.window, c.least)]), F.size("words"))
    met = hits.join(seeded, ["seed", "hash"]).filter((F.size("words") == F.size("test_words")) & (agree >= least))
    met = met.select(F.col("id").alias("doc"), "body", "at", "test_words").distinct()
    members = tests.select(F.col("id").alias("item"), F.col("words").alias("test_words")).distinct()
    found = met.join(members, "test_words")
    return found.select("doc", "body", "at", F.size("test_words").alias("size"), "item").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """(doc_id, item_id, n_windows, first_word, last_word) of each document and benchmark item that overlap.

    first_word and last_word bound the overlapping windows, last_word included. Documents
    that repeat both id and text are one; rows that repeat an item's id are one item. Documents
    without an overlap are not returned. Null ids are ids like any other. An empty table on
    either side gives an empty result.
    """
    return overlaps(docs, benchmark, **how).groupBy("doc", "body", "item").agg(
        F.count_distinct("at").alias("n_windows"), F.min("at").alias("first_word"), F.max(F.col("at") + F.col("size") - 1).alias("last_word")
    ).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_windows", "first_word", "last_word")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = PASSAGE, **how
) -> DataFrame:
    """``docs``, all columns, without the rows that overlap a benchmark item of at least ``shortest`` words.

    An item of fewer words names no passage: any text may hold it. Null and empty texts stay;
    rows that repeat an id and a text go or stay together, other texts of the same id by
    themselves. An empty table on either side leaves ``docs`` as it is.
    """
    found = overlaps(docs, benchmark, key=key, text=text, shortest=shortest, **how)
    bad = found.select(F.col("doc").alias("__doc"), F.col("body").alias("__bad")).distinct()
    rows = docs.withColumn("__body", text_key(F.col(text)))
    same = F.col(key).eqNullSafe(F.col("__doc")) & (F.col("__body") == F.col("__bad"))
    return rows.join(bad, same, "left_anti").drop("__body")
