"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through the threshold's bytes, most significant digits first, and
groups of one leave after each pass:

1. The first digit of a window of ``WIDTH`` bytes is its anchor, the string of ``GRAM`` bytes
   with the least hash in it, and where in the window that lies. Equal windows have equal
   anchors, and the windows around one anchor are a run, so that a run is one row.
2. The second digit is the run's whole extent. Of equal extents under one anchor all but the
   first are repeats, whole runs at a time.
3. What is left, first extents that differ under a shared anchor, is cut into cells of ``CELL``
   neighbouring windows. The third digit is the string that a cell's windows have in common,
   the fourth the cell's extent; they are judged like anchors and runs.
4. Cells left open go through the last digit, windows of full depth one by one; equal groups
   are the repeated windows.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import in_batches, worker_state

WIDTH, GRAM, CELL = 100, 24, 8
#: A run of windows in one number: first start, windows, bytes from the first start to the anchor.
BITS = 7
#: Bytes looked at together, and window starts taken from one text at a time.
CHUNK = 1 << 20
BASE, BASE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
COVERED, OPEN = 0, 1
RUN = ["head", "extent", "n", "at"]
RUN_SCHEMA = ", ".join(f"{c} long" for c in RUN)


class _Rolling:
    """Hashes of substrings from running sums of byte values times powers of an odd base, modulo 2**64."""

    def __init__(self, base: int, seed: int):
        n = 2 * CHUNK + 4 * WIDTH
        self.values = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers, self.inverse = (
            np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, b, np.uint64))) for b in (base, pow(base, -1, 1 << 64))
        )

    def sums(self, raw: np.ndarray) -> np.ndarray:
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.values[raw] * self.powers[: len(raw)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        mixed = (sums[stop] - sums[start]) * self.inverse[start]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        return mixed ^ mixed >> np.uint64(29)


def _rolling() -> tuple[_Rolling, _Rolling]:
    return worker_state(f"rolling {CHUNK}", lambda: (_Rolling(BASE, 3), _Rolling(BASE2, 5)))


def _pack(start: np.ndarray, windows: np.ndarray, lead: np.ndarray) -> np.ndarray:
    return start << 2 * BITS | windows << BITS | lead


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = (1 << BITS) - 1
    return at >> 2 * BITS, at >> BITS & low, at & low


def _least(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each start, the place of the first least hash among the ``span`` from there."""
    place, value, width = np.arange(len(hashes)), hashes, 1
    while width < span:
        step = min(width, span - width)
        ahead, own = value[step:], value[: len(value) - step]
        less = ahead < own
        place = np.where(less, place[step:], place[: len(place) - step])
        value = np.where(less, ahead, own)
        width += step
    return place


def _chunks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of several pieces of texts laid end to end; per piece its text, its start there and its number of windows."""
    held, size = [], 0
    for row, raw in enumerate(texts):
        for at in range(0, len(raw) - WIDTH + 1, CHUNK):
            piece = raw[at : at + CHUNK + WIDTH - 1]
            if size + len(piece) > 2 * CHUNK and held:
                yield _laid(held)
                held, size = [], 0
            held.append((row, at, piece))
            size += len(piece)
    if held:
        yield _laid(held)


def _laid(held: list[tuple[int, int, bytes]]):
    raw = np.frombuffer(b"".join(h[2] for h in held), np.uint8)
    rows, starts = (np.array([h[i] for h in held]) for i in (0, 1))
    return raw, rows, starts, np.array([len(h[2]) for h in held])


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Rows of all windows of ``texts`` by anchor: text, run (``_pack``), anchor's and extent's hash."""
    out = []
    rolling, _ = _rolling()
    for raw, rows, starts, sizes in _chunks(texts):
        sums = rolling.sums(raw)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        n = len(raw) - WIDTH + 1
        grams = np.arange(len(raw) - GRAM + 1)
        anchor = _least(rolling.of(sums, grams, grams + GRAM), WIDTH - GRAM + 1)
        piece = np.searchsorted(begin, np.arange(n), "right") - 1
        inside = np.arange(n) + WIDTH <= begin[piece + 1]
        new = np.ones(n, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
        first = np.flatnonzero(new & inside)
        breaks = np.concatenate([np.flatnonzero(new | ~inside), [n]])
        last = breaks[np.searchsorted(breaks, first, "right")] - 1
        own = anchor[first]
        head = rolling.of(sums, own, own + GRAM)
        shape = (own - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)
        extent = rolling.of(sums, first, last + WIDTH) ^ (shape + np.uint64(1)) * np.uint64(BASE2)
        at = piece[first]
        run = _pack(starts[at] + first - begin[at], last - first + 1, own - first)
        out.append((rows[at], run, head.view(np.int64), extent.view(np.int64)))
    return _joined(out, 4)


def _spread(head: np.ndarray, extent: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of a batch of documents; repeats within it are marked (``at`` below 0) and lose their common anchor.

    An earlier run with the same extent makes them repeats whatever else there is, so that a
    string that occurs very often is one row per batch under its anchor and the others are
    dealt out evenly.
    """
    order = np.lexsort((at, n, extent, head))
    head, extent, n, at = head[order], extent[order], n[order], at[order]
    again = np.flatnonzero((head[1:] == head[:-1]) & (extent[1:] == extent[:-1])) + 1
    own = (n[again].astype(np.uint64) * np.uint64(BASE) ^ at[again].astype(np.uint64)) * np.uint64(BASE2)
    head[again], at[again] = (own ^ own >> np.uint64(31)).view(np.int64), -1 - at[again]
    return head, extent, n, at


def _joined(parts: list[tuple], n: int) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate([np.empty(0, np.int64), *[p[i] for p in parts]]) for i in range(n))


def _pieces(raw: bytes, starts: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Pieces of a long text: bytes, where they begin, and which of the ``starts`` lie in them."""
    for at in range(0, max(1, len(raw) - WIDTH + 1), CHUNK):
        inside = np.flatnonzero((starts >= at) & (starts < at + CHUNK))
        if len(inside):
            begin = max(0, at - WIDTH)
            yield np.frombuffer(raw, np.uint8, min(CHUNK + 3 * WIDTH, len(raw) - begin), begin), begin, inside


def cells(raw: bytes, open_runs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cells of a text's runs: run (``_pack``), hash of what the cell's windows share, hash of its extent."""
    first, windows, lead = _unpack(open_runs)
    out = []
    one, two = _rolling()
    # A window's cell is how far before the anchor it starts, so that equal windows share one.
    number = np.concatenate([np.arange((a - w + 1) // CELL, a // CELL + 1) for a, w in zip(lead, windows)])
    of = np.repeat(np.arange(len(lead)), lead // CELL - (lead - windows + 1) // CELL + 1)
    anchor = (first + lead)[of]
    far = np.minimum(number * CELL + CELL - 1, lead[of])
    near = np.maximum(number * CELL, lead[of] - windows[of] + 1)
    start, size = anchor - far, far - near + 1
    for piece, begin, inside in _pieces(raw, start):
        a, c, s, n = (x[inside] for x in (anchor - begin, number, start - begin, size))
        shared = two.of(two.sums(piece), a - c * CELL, a - c * CELL - CELL + 1 + WIDTH)
        shared ^= (c.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE)
        extent = one.of(one.sums(piece), s, s + n - 1 + WIDTH)
        extent ^= ((far[inside] << BITS | n).astype(np.uint64) + np.uint64(1)) * np.uint64(BASE2)
        out.append((_pack(start[inside], n, far[inside]), shared.view(np.int64), extent.view(np.int64)))
    return _joined(out, 3)


def _sorted_groups(df: DataFrame, keys: list[str], rule: Callable, schema: str) -> DataFrame:
    """``rule(table, same)`` over sorted rows of a task; ``same[i]`` says how row i agrees with its neighbours.

    Rows come in batches; a batch's rule sees the row before and after it, so that a group
    of any size passes through without being held.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: np.ndarray | None = None
        waiting: np.ndarray | None = None
        for batch in itertools.chain(batches, [None]):
            table = None if batch is None else np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names])
            if table is not None and not table.shape[1]:
                continue
            if waiting is not None:
                after = None if table is None else table[:, :1]
                parts = [x for x in (before, waiting, after) if x is not None]
                found = rule(np.concatenate(parts, axis=1), before is not None, after is not None)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.values()], list(found))
                before = waiting[:, -1:]
            waiting = table

    return df.sortWithinPartitions(*keys).mapInArrow(run, schema)


def _judge_runs(table: np.ndarray, has_before: bool, has_after: bool) -> dict[str, np.ndarray]:
    """Runs whose first digit another row shares: covered if the row before has the same extent.

    The first row of an extent is open if its digit has another extent; where that shows
    only beyond the rows at hand it counts as open, which costs work and changes nothing.
    """
    head, extent, at = table[0], table[1], table[3]
    size, known = len(head), at < 0
    same_head = np.concatenate([[False], (head[1:] == head[:-1]) & ~known[1:] & ~known[:-1]])
    covered = known | same_head & np.concatenate([[False], extent[1:] == extent[:-1]])
    firsts = np.append(np.flatnonzero(~covered), size)
    after = firsts[np.searchsorted(firsts, np.arange(size), "right")]
    here = after < size
    more = same_head[np.minimum(after, size - 1)] & here | ~here & has_after
    keep = covered | same_head | more
    keep[0] &= not has_before
    if has_after:
        keep[-1] = False
    out = np.flatnonzero(keep)
    return {"n": table[2][out], "at": np.where(known, -1 - at, at)[out], "state": np.where(covered[out], COVERED, OPEN)}


def _judge_windows(table: np.ndarray, has_before: bool, has_after: bool) -> dict[str, np.ndarray]:
    """Windows that equal the row before them."""
    again = np.concatenate([[False], ((table[0][1:] == table[0][:-1]) & (table[1][1:] == table[1][:-1]))])
    again[0] &= not has_before
    if has_after:
        again[-1] = False
    at = np.flatnonzero(again)
    return {"n": table[2][at], "start": table[3][at]}


def _numbered(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """(n, text) with n ordered as key is, and (n, key) where keys are not such numbers themselves.

    Keys of whole numbers that tell the rows apart are used as they are. Else the distinct
    (key, text hash) are sorted and counted; rows that repeat both are one document.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), whole.alias("text"))
    if dict(rows.dtypes)["key"] in ("bigint", "int", "smallint", "tinyint"):
        odd = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1 OR key IS NULL")
        if odd.isEmpty():
            return rows.select(F.col("key").cast("long").alias("n"), "text"), None
    body = F.sha2("text", 256)
    held = rows.withColumn("body", body).dropDuplicates(["key", "body"])
    order = held.select("key", "body").orderBy(F.col("key").asc_nulls_first(), "body")
    pairs = order.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1]))
    kind = held.schema["key"].dataType.simpleString()
    names = docs.sparkSession.createDataFrame(pairs, f"k {kind}, b string, n long")
    joined = held.join(names, F.col("key").eqNullSafe(F.col("k")) & (F.col("body") == F.col("b")))
    return joined.select("n", "text"), names.select("n", F.col("k").alias("key"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_bytes, n_removed, n_spans, kept_sha256, spans.

    A byte goes if a string of ``WIDTH`` bytes that covers it also starts earlier: in a
    document with a smaller key, or earlier in the same one. Strings are judged on the input.
    spans are the maximal removed runs as (start, length) in bytes. Null and empty texts have
    nothing to remove. Rows that repeat key and text are one document and give one row; rows
    that repeat a key with other texts are documents of their own, ordered by the text's
    hash; a null key comes first. Other columns are left out. An empty table gives an empty
    result. Strings are told apart by 128 bits (anchor and extent) and 96 bits (windows).
    """
    rows, names = _numbered(docs, key, text)

    def anchors(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, at, head, extent = runs([x.encode() for x in batch.column("text").to_pylist()])
        n = batch.column("n").to_numpy()[row]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in _spread(head, extent, n, at)], RUN)

    def judged(found: DataFrame, name: str) -> DataFrame:
        """(name_n, name): per document its covered and open runs."""
        ruled = _sorted_groups(found.repartition("head"), RUN, _judge_runs, "n long, at long, state long")
        marks = ruled.groupBy("n").agg(
            *[F.collect_list(F.when(F.col("state") == k, F.col("at"))).alias(c) for k, c in ((COVERED, "covered"), (OPEN, "open"))]
        )
        return marks.select(F.col("n").alias(f"{name}_n"), F.col("covered").alias(f"{name}_covered"), F.col("open").alias(f"{name}_open"))

    runs_seen = judged(in_batches(rows, anchors, RUN_SCHEMA, rows=512), "run")

    def squeeze(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = [zlib.compress(x.encode(), 1) for x in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("n"), pa.array(packed, pa.binary())], ["n", "packed"])

    packed = in_batches(rows, squeeze, "n long, packed binary")
    marked = packed.join(runs_seen, F.col("n") == F.col("run_n"), "left").drop("run_n")

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for n, raw, held in zip(*(batch.column(c).to_pylist() for c in ("n", "packed", "run_open"))):
            if held:
                at, shared, extent = cells(zlib.decompress(raw), np.array(held))
                out.append((shared, extent, np.full(len(at), n), at))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in _joined(out, 4)], RUN)

    cells_seen = judged(in_batches(marked, split, RUN_SCHEMA), "cell")
    marked = marked.join(cells_seen, F.col("n") == F.col("cell_n"), "left").drop("cell_n")

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for n, raw, held in zip(*(batch.column(c).to_pylist() for c in ("n", "packed", "cell_open"))):
            if held:
                at, one, two = window_hashes(zlib.decompress(raw), np.array(held))
                out.append((one, two, np.full(len(at), n), at))
        one, two, n, at = _joined(out, 4)
        columns = [pa.array(one), pa.array(two.astype(np.int32)), pa.array(n), pa.array(at.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["one", "two", "n", "start"])

    deep = in_batches(marked, windows, "one long, two int, n long, start int")
    again = _sorted_groups(deep.repartition("one"), ["one", "two", "n", "start"], _judge_windows, "n long, start long")
    again = again.groupBy(F.col("n").alias("an")).agg(F.collect_list("start").alias("again"))
    whole = marked.join(again, F.col("n") == F.col("an"), "left").select("n", "packed", "run_covered", "cell_covered", "again")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for raw, *repeated in zip(*(batch.column(c).to_pylist() for c in ("packed", "run_covered", "cell_covered", "again"))):
            start, size, _ = _unpack(np.array((repeated[0] or []) + (repeated[1] or []), np.int64))
            single = np.array(repeated[2] or [], np.int64)
            found.append(_cut(zlib.decompress(raw), np.append(start, single), np.append(size, np.ones_like(single))))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32())))
        columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(
            [batch.column("n"), *columns], ["n", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        )

    done = in_batches(whole, cut, "n long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<int>>")
    if names is None:
        return done.withColumnRenamed("n", key)
    return done.join(names, "n").select(F.col("key").alias(key), *done.columns[1:])


def window_hashes(raw: bytes, open_runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, 64 and 32 bits of every window of the runs of a text."""
    one, two = _rolling()
    first, windows, _ = _unpack(open_runs)
    wanted = np.concatenate([np.arange(a, a + w) for a, w in zip(first, windows)])
    out = []
    for piece, begin, inside in _pieces(raw, wanted):
        at = wanted[inside] - begin
        hashes = [r.of(r.sums(piece), at, at + WIDTH) for r in (one, two)]
        out.append((wanted[inside], hashes[0].view(np.int64), (hashes[1] >> np.uint64(32)).astype(np.uint32).view(np.int32).astype(np.int64)))
    return _joined(out, 3)


def _cut(raw: bytes, first: np.ndarray, windows: np.ndarray) -> tuple[int, int, int, str, list[list[int]]]:
    """Sizes, hash of what stays and removed spans, by the runs of repeated windows."""
    spans: list[list[int]] = []
    order = np.argsort(first)
    for start, stop in zip(first[order].tolist(), (first + windows)[order].tolist()):
        stop += WIDTH - 1
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], stop)
        else:
            spans.append([start, stop])
    kept, at = hashlib.sha256(), 0
    for start, stop in spans:
        kept.update(raw[at:start])
        at = stop
    kept.update(raw[at:])
    return len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [[a, b - a] for a, b in spans]
