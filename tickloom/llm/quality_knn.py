"""Quality by nearest-neighbour voting in a latent semantic space.

Texts become counts of hashed terms: words, their shapes, character trigrams and how words
and lines repeat. A truncated singular value decomposition of a bounded, balanced sample of
labelled documents gives the space. The labelled vectors are broadcast; each document's
cosines with all of them are computed in blocks, and its nearest neighbours vote by
similarity.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import in_batches, worker_state

#: Shapes and traits, words, and trigrams each have buckets of their own.
SHAPE_TERMS, WORD_TERMS, TRIGRAM_TERMS = 1 << 12, 1 << 13, 1 << 12
TERMS = SHAPE_TERMS + WORD_TERMS + TRIGRAM_TERMS
#: Labelled documents in the model, half of each label as far as there are.
MOST_LABELLED = 2048
RANK = 48
NEIGHBOURS = 15
BLOCK = 256
#: Labelled rows that are dense at a time in the fit.
SPREAD = 128
#: Words told apart by their shape.
SHAPES = str.maketrans(
    {**{chr(c): "a" for c in range(97, 123)}, **{chr(c): "A" for c in range(65, 91)}, **{chr(c): "0" for c in range(48, 58)}}
)
REPEATED = re.compile(r"(.)\1+")


def _bucket(share: float) -> int:
    return min(10, math.ceil(share * 10))


def shape(word: str) -> str:
    """The word with letters as a or A, digits as 0 and runs cut to one; other letters by case."""
    if not word.isascii():
        word = "".join(c if c.isascii() else "A" if c.isupper() else "a" if c.isalpha() else "x" for c in word)
    return REPEATED.sub(r"\1", word.translate(SHAPES))


class Shapes(dict):
    """word -> term, kept while a worker lives and emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        term = self[word] = zlib.crc32(b"s" + shape(word).encode()) % SHAPE_TERMS
        return term


class Words(dict):
    """Lower-cased word -> term, kept like ``Shapes``."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        term = self[word] = SHAPE_TERMS + zlib.crc32(word.lower().encode()) % WORD_TERMS
        return term


def _trigrams(text: str) -> np.ndarray:
    """How often each bucket's trigrams of code points occur in the lower-cased text."""
    at = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    mixed = at[:-2] * np.uint32(0x9E3779B1) + at[1:-1] * np.uint32(0x85EBCA77) + at[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    return np.bincount((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(20), minlength=TRIGRAM_TERMS)


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of the whole text and their weights, of length 1; none for an empty text."""
    words = text.split() if text else []
    if not words:
        return np.array([zlib.crc32(b"empty") % SHAPE_TERMS]), np.ones(1)
    n = len(words)
    weights: dict[int, float] = {}
    for term, count in Counter(map(worker_state("shapes", Shapes).__getitem__, words)).items():
        weights[term] = weights.get(term, 0.0) + math.sqrt(count / n)
    once = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    raw = text.encode()
    letters = max(1, len(raw))
    small = sum(raw.count(c) for c in b"#*$%&|<>{}\\")
    traits = {
        "distinct words": len(once) / n,
        "commonest word": max(once.values()) / n,
        "same as last": sum(map(str.__eq__, words, words[1:])) / n,
        "repeated lines": 1 - len(set(lines)) / max(1, len(lines)),
        "symbols": min(1.0, 5 * small / letters),
        "capitals": sum(1 for c in words if c.isupper() and len(c) > 1) / n,
        "word length": min(1.0, len(text) / n / 20),
        "words": min(1.0, math.log2(n + 1) / 16),
    }
    for name, value in traits.items():
        term = zlib.crc32(f"{name} {_bucket(value)}".encode()) % SHAPE_TERMS
        weights[term] = weights.get(term, 0.0) + 0.5
    known = worker_state("words", Words)
    own = np.fromiter(map(known.__getitem__, once), np.int64, len(once))
    often = np.bincount(own, np.fromiter(once.values(), np.float64, len(once)), TERMS)
    grams = _trigrams(text) if len(text) > 2 else np.zeros(TRIGRAM_TERMS, np.int64)
    used, seen = np.flatnonzero(often), np.flatnonzero(grams)
    ids = np.concatenate([np.fromiter(weights, np.int64, len(weights)), used, SHAPE_TERMS + WORD_TERMS + seen])
    values = np.concatenate(
        [np.fromiter(weights.values(), np.float64, len(weights)), np.sqrt(often[used] / n), np.sqrt(grams[seen] / max(1, len(text) - 2))]
    )
    return ids, values / np.linalg.norm(values)


class Model(NamedTuple):
    """The space and the labelled vectors in it; a few megabytes whatever the corpus."""

    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def project(space: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """Vectors of length 1 in the space; 0 for a text none of whose terms are in it."""
    out = np.zeros((len(texts), space.shape[1]), np.float32)
    for i, text in enumerate(texts):
        ids, values = terms(text)
        out[i] = values @ space[ids]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def vote(model: tuple, texts: list[str | None], neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled vectors; 0.5 if there are none.

    Vectors that tie for the last places share them, so that the order of the labelled rows does not count.
    """
    space, vectors, labels = model
    out = np.full(len(texts), 0.5)
    k = min(neighbours, len(labels))
    for at in range(0, len(texts) if k else 0, BLOCK):
        near = np.maximum(project(space, texts[at : at + BLOCK]) @ vectors.T, 0)
        last = np.partition(near, len(labels) - k, axis=1)[:, len(labels) - k, None]
        above, equal = near > last, near == last
        weight = np.where(above, near.astype(np.float64) ** 8 + 1e-9, 0)
        rest = (last[:, 0].astype(np.float64) ** 8 + 1e-9) * (k - above.sum(axis=1))
        share = (equal @ labels) / equal.sum(axis=1)
        out[at : at + BLOCK] = (weight @ labels + rest * share) / (weight.sum(axis=1) + rest)
    return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, target: str = "quality") -> Model:
    """A model of ``docs`` (doc_id, text) by ``labels`` (doc_id, target: 0 or 1).

    Held-out rows, other labels, nulls and documents with both labels are left out. Of each
    label the ``most / 2`` ids with the smallest hash are used; these ids alone are
    broadcast, and only their texts' term weights, at most ``TERMS`` each, reach the driver.
    Of rows that repeat an id the smallest text counts.
    """
    known = labels.filter(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").alias("id")).agg(F.min(target).alias("label"), F.max(target).alias("other"))
    known = known.filter("label = other").select("id", F.col("label").cast("int").alias("label"))
    parts = [known.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(most // 2) for k in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]))
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(chosen, "id").groupBy("id", "label").agg(F.min("text").alias("text"))

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [terms(x) for x in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))],
            ["label", "ids", "weights"],
        )

    sample = in_batches(rows.orderBy("id").select("text", "label"), weigh, "label int, ids array<int>, weights array<float>")
    got = sample.toArrow().combine_chunks()
    ids, weights = (_values(got, c) for c in ("ids", "weights"))
    n, labels = got.num_rows, got.column("label").to_numpy().astype(np.float64)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(pc.list_value_length(got.column("ids")).to_numpy(), out=starts[1:])
    del got
    rarity = (np.log((1 + n) / (1 + np.bincount(ids, minlength=TERMS))) + 1).astype(np.float32)
    rows = Sparse(ids, weights * rarity[ids], starts)
    right = _right_vectors(rows, min(RANK, n)) if n else np.zeros((TERMS, 1), np.float32)
    space = right * rarity[:, None]
    vectors = np.concatenate([block @ right for block in rows.blocks()] or [np.zeros((0, right.shape[1]), np.float32)])
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Model(space, vectors / np.where(norm > 0, norm, 1), labels)


def _values(table: pa.Table, column: str) -> np.ndarray:
    """The elements of a list column, one after the other."""
    return np.concatenate([x.flatten().to_numpy() for x in table.column(column).chunks] or [np.zeros(0, np.int32)])


class Sparse(NamedTuple):
    """Rows by their terms and weights; ``starts`` has where each begins. Only blocks of rows are ever dense."""

    ids: np.ndarray
    weights: np.ndarray
    starts: np.ndarray

    def blocks(self) -> Iterator[np.ndarray]:
        for at in range(0, len(self.starts) - 1, SPREAD):
            of = self.starts[at : at + SPREAD + 1]
            dense = np.zeros((len(of) - 1, TERMS), np.float32)
            dense[np.repeat(np.arange(len(of) - 1), np.diff(of)), self.ids[of[0] : of[-1]]] = self.weights[of[0] : of[-1]]
            yield dense


def _right_vectors(rows: Sparse, rank: int) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    basis = np.random.default_rng(7).standard_normal((TERMS, rank + 8)).astype(np.float32)
    for _ in range(6):
        grown = np.zeros_like(basis)
        for block in rows.blocks():
            grown += block.T @ (block @ basis)
        basis = np.linalg.qr(grown)[0]
    _, _, right = np.linalg.svd(np.concatenate([block @ basis for block in rows.blocks()]), full_matrices=False)
    return (basis @ right.T)[:, :rank]


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row's whole text; null and empty texts are scored as an empty one."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = vote(held.value, batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(values, pa.float64())], ["key", "score"])

    found = in_batches(rows, scored, f"key {dict(rows.dtypes)['key']}, score double")
    return found.select(F.col("key").alias(key), "score")


def held_out(key: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from a score of 0.5).

    Without any label to learn from every score is 0.5. Rows that repeat a document get a
    row each. An empty table gives an empty result.
    """
    scored = score(docs, fit(docs, labels, most))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", most: int = MOST_LABELLED) -> DataFrame:
    """``docs``, all columns, without rows whose text scores below 0.5.

    Null and empty texts are scored as an empty one. Equal texts have equal scores, so all rows
    that repeat one stay or go. Without any label to learn from everything stays. Columns of
    any name pass through; an empty table gives an empty one.
    """
    model = fit(docs, labels, most)
    held = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def good(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = vote(held.value, batch.column(text).to_pylist()) >= 0.5
        return batch.filter(pa.array(keep))

    return in_batches(docs, good, docs.schema)
