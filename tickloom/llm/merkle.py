"""A manifest of a dataset as trees of SHA-256 digests that keep their hash states.

Rows are leaves, ordered within a language; every few consecutive nodes become their hash
until one is left, and the languages' roots form one more tree. A parent is the hash of its
children's digests in hexadecimal, one block each, and retains the state that the hash had
before each child. A changed child is folded in by taking up the state before its slot,
then the new digest, then the siblings to its right: nothing to its left is read again.

Trees are built in tiers: a cell of at most ``CELL`` consecutive nodes is one row of a
tier, with all its digests and states, and its root is a node of the next tier. A cell has
the same size in every tier and language.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.sha_states import absorb, close, fresh, hex_block, pack, unpack
from tickloom.llm.shared import in_batches
from tickloom.session import cut_lineage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 2
CELL = 1 << 10

CELL_ROW = "tree string, cell long, n long, levels int, nodes binary, states binary, root binary"


# One cell, in a task


def build_cell(leaves: np.ndarray, levels: int, arity: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Digests of each level, leaves first; and the states before slots 1, 2, … of each level's parents.

    A state is as wide as its parents; where a parent has no such child the state is that after its last one.
    """
    nodes, states = [leaves], []
    for _ in range(levels):
        below = nodes[-1]
        n = -(-below.shape[1] // arity)
        state, kept = fresh(n), []
        for slot in range(arity):
            child = below[:, slot::arity]
            if slot:
                kept.append(state)
                state = state.copy()
            state[:, : child.shape[1]] = absorb(state[:, : child.shape[1]], hex_block(child))
        sizes = np.full(n, arity)
        sizes[-1:] = below.shape[1] - arity * (n - 1)
        nodes.append(close(state, sizes))
        states.append(np.stack(kept) if kept else np.zeros((0, 8, n), np.uint32))
    return nodes, states


def fold(new: np.ndarray, at: np.ndarray, below: np.ndarray, states: np.ndarray, arity: int) -> np.ndarray:
    """Digests of the parents of nodes ``at`` of a level, were each node ``new`` instead, one by one.

    Takes up the retained state before the node's slot; reads only siblings to its right.
    """
    parent, slot = at // arity, at % arity
    state = fresh(len(at))
    later = slot > 0
    state[:, later] = states[slot[later] - 1, :, parent[later]].T
    state = absorb(state, hex_block(new))
    size = np.minimum(arity, below.shape[1] - parent * arity)
    for right in range(1, arity):
        use = slot + right < size
        if use.any():
            state[:, use] = absorb(state[:, use], hex_block(below[:, (at + right)[use]]))
    return close(state, size)


def siblings(at: np.ndarray, below: np.ndarray, arity: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each place of a run but one: which nodes have another sibling there, and where it is."""
    parent, slot = at // arity, at % arity
    size = np.minimum(arity, below.shape[1] - parent * arity)
    out = []
    for j in range(arity - 1):
        other = np.where(j < slot, j, j + 1)
        out.append((other < size, parent * arity + other))
    return out


class Step(NamedTuple):
    """One level above a cell: the state before the slot, how many children, and the siblings left to right."""

    slot: int
    size: int
    state: np.ndarray
    others: np.ndarray

    def encode(self) -> bytes:
        return bytes([self.slot, self.size]) + pack(self.state) + pack(self.others)


def decode(path: bytes) -> list[Step]:
    out, at = [], 0
    while at < len(path):
        slot, size = path[at], path[at + 1]
        end = at + 34 + 32 * (size - 1)
        out.append(Step(slot, size, unpack(path[at + 2 : at + 34]), unpack(path[at + 34 : end])))
        at = end
    return out


def _steps_up(nodes: list[np.ndarray], states: list[np.ndarray], arity: int) -> list[bytes]:
    """The steps from each leaf of a cell to the cell's root."""
    paths = [b""] * nodes[0].shape[1]
    for i in range(len(paths)):
        at, parts = i, []
        for below, kept in zip(nodes, states):
            parent, slot = divmod(at, arity)
            others = [j for j in range(parent * arity, min(parent * arity + arity, below.shape[1])) if j != at]
            state = kept[slot - 1, :, parent][:, None] if slot else fresh(1)
            parts.append(Step(slot, len(others) + 1, state, below[:, others]).encode())
            at = parent
        paths[i] = b"".join(parts)
    return paths


def _read_cell(nodes: bytes, states: bytes, n: int, levels: int, arity: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    every, kept, at, size = [], [], 0, n
    flat = unpack(nodes)
    for level in range(levels + 1):
        every.append(flat[:, at : at + size])
        at, size = at + size, -(-size // arity)
    held, at = unpack(states), 0
    for below in every[:-1]:
        n_parents = -(-below.shape[1] // arity)
        own = held[:, at : at + n_parents * (arity - 1)]
        kept.append(own.reshape(8, arity - 1, n_parents).transpose(1, 0, 2))
        at += n_parents * (arity - 1)
    return every, kept


def _digest_column(words: np.ndarray) -> pa.Array:
    n = words.shape[1]
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * 32), pa.py_buffer(pack(words))])


# The dataset, on Spark


def digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields: each ``-`` if null, else its length in UTF-8 bytes, a colon and its text."""
    parts = []
    for x in fields:
        said = x.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _ranked(df: DataFrame, tree: Column, order: Sequence[str]) -> DataFrame:
    """``df`` with tree (never null), pos (from 0 in ``order`` within it) and n (rows of the tree), stored.

    Rows are dealt by ranges, so that a language of a third of all rows is many tasks'
    work; repeated rows are told apart by where they were stored.
    """
    own = df.withColumns({"tree": tree, "__row": F.xxhash64(F.monotonically_increasing_id())})
    dealt = own.repartitionByRange("tree", *order, "__row").sortWithinPartitions("tree", *order, "__row")
    at = dealt.drop("__row").withColumn("__at", F.monotonically_increasing_id())
    at = cut_lineage(at.withColumns({"__part": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))}))
    starts = at.groupBy("tree", "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    before = Window.partitionBy("tree").orderBy("__part")
    starts = starts.select(
        "tree", "__part",
        (F.coalesce(F.sum("__rows").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("__first")).alias("__shift"),
        F.sum("__rows").over(Window.partitionBy("tree")).alias("n"),
    )
    placed = at.join(starts, ["tree", "__part"])
    return placed.withColumn("pos", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")


def _levels(n: int, cell: int, arity: int) -> int:
    """Levels from ``n`` nodes to one, or to as many as fill a cell's root if there are more than a cell."""
    n, out = min(n, cell), 0
    while n > 1:
        n, out = -(-n // arity), out + 1
    return out


def _tier(nodes: DataFrame, arity: int, cell: int) -> DataFrame:
    """Cells of ``nodes`` (tree, pos, n: nodes of the tree, digest), stored."""
    own = nodes.select("tree", "n", F.expr(f"pos div {cell}").alias("cell"), F.struct("pos", "digest").alias("node"))
    grouped = own.groupBy("tree", "cell", "n").agg(F.collect_list("node").alias("nodes"))

    def build(batch: pa.RecordBatch) -> pa.RecordBatch:
        levels, every, states, roots, sizes = [], [], [], [], []
        for members, n in zip(batch.column("nodes").to_pylist(), batch.column("n").to_pylist()):
            members.sort(key=lambda x: x["pos"])
            leaves = unpack(b"".join(x["digest"] for x in members))
            levels.append(_levels(n, cell, arity))
            found, kept = build_cell(leaves, levels[-1], arity)
            every.append(b"".join(map(pack, found)))
            states.append(b"".join(pack(s.transpose(1, 0, 2).reshape(8, -1)) for s in kept))
            roots.append(pack(found[-1]))
            sizes.append(len(members))
        arrays = [
            batch.column("tree"), batch.column("cell"), batch.column("n"), pa.array(sizes, pa.int64()), pa.array(levels, pa.int32()),
            pa.array(every, pa.binary()), pa.array(states, pa.binary()), pa.array(roots, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["tree", "cell", "total", "n", "levels", "nodes", "states", "root"])

    return cut_lineage(in_batches(grouped, build, CELL_ROW + ", total long", rows=16))


def _tiers(nodes: DataFrame, arity: int, cell: int) -> list[DataFrame]:
    """Tiers of cells until every tree has one root."""
    out = []
    while True:
        cells = _tier(nodes, arity, cell)
        out.append(cells)
        above = cells.filter(F.col("total") > cell)
        if above.isEmpty():
            return out
        up = F.expr(f"(total + {cell - 1}) div {cell}")
        nodes = above.select("tree", F.col("cell").alias("pos"), up.alias("n"), F.col("root").alias("digest"))


class Manifest(NamedTuple):
    """Stored trees: members (the rows with tree and pos), tiers of cells, and the tree over the trees' roots."""

    members: DataFrame
    tiers: list[DataFrame]
    tops: DataFrame
    crown: list[DataFrame]
    arity: int
    cell: int


def build(leaves: DataFrame, order: Sequence[str], arity: int = ARITY, cell_rows: int = CELL) -> Manifest:
    """The manifest of ``leaves`` (lang, digest and others), by language, in ``order`` within one.

    Languages come null first, then by bytes. Equal rows of ``order`` come by digest;
    repeated rows are leaves of their own.
    """
    if not 2 <= arity <= 255 or cell_rows < arity:
        raise ValueError("arity goes from 2 to 255, and a cell holds that many nodes at least")
    cell = arity
    while cell * arity <= cell_rows:
        cell *= arity
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    members = _ranked(leaves, tree, [*order, "digest"])
    tiers = _tiers(members.select("tree", "pos", "n", "digest"), arity, cell)
    tops = tiers[0].filter(F.col("total") <= cell).select("tree", F.col("root").alias("digest"))
    for tier in tiers[1:]:
        tops = tops.union(tier.filter(F.col("total") <= cell).select("tree", F.col("root").alias("digest")))
    tops = _ranked(tops.withColumnRenamed("tree", "name"), F.lit("*"), ["name"])
    crown = _tiers(tops.select("tree", "pos", "n", "digest"), arity, cell)
    return Manifest(members, tiers, tops, crown, arity, cell)


def _paths(tiers: list[DataFrame], upper: DataFrame, arity: int, cell: int) -> tuple[DataFrame, DataFrame]:
    """From the top tier down: (cells of the lowest tier with their path upwards, paths of all nodes of the lowest tier).

    ``upper`` is (tree, path) above the trees' roots.
    """
    above = None
    cells = None
    for tier in reversed(tiers):
        last = tier.filter(F.col("total") <= cell).join(upper, "tree")
        cells = last
        if above is not None:
            inner = tier.filter(F.col("total") > cell).join(above.withColumnRenamed("pos", "cell"), ["tree", "cell"])
            cells = last.unionByName(inner)
        above = _children(cells, arity, cell)
    return cells, above


def _children(cells: DataFrame, arity: int, cell: int) -> DataFrame:
    """(tree, pos, path) of every node that a cell was built from."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                nodes, states = _read_cell(row["nodes"], row["states"], row["n"], row["levels"], arity)
                paths = [own + row["path"] for own in _steps_up(nodes, states, arity)]
                first = row["cell"] * cell
                names = pa.array([row["tree"]] * len(paths), pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.array(range(first, first + len(paths)), pa.int64()), pa.array(paths, pa.binary())], ["tree", "pos", "path"])

    wanted = cells.select("tree", "cell", "n", "levels", "nodes", "states", "path")
    return wanted.mapInArrow(spread, "tree string, pos long, path binary")


def verify(manifest: Manifest, key: str = "doc_id", changed: str = "changed") -> DataFrame:
    """Every member folded to the root with its ``changed`` digest, or its own where that is null.

    Returns key, leaf, subroot, root, proof_sha256 (of all siblings up to the root), all of the
    manifest as built; folded_root; and verified, whether it is the root. A member's fold is
    its own: others are not changed with it.
    """
    arity, cell = manifest.arity, manifest.cell
    no_path = manifest.crown[-1].select("tree", F.lit(b"").alias("path")).distinct()
    crown = _paths(manifest.crown, no_path, arity, cell)[1]
    root = manifest.crown[-1].select("root").first()
    subroots = manifest.tops.join(crown, ["tree", "pos"]).select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"))
    subroots = cut_lineage(subroots.withColumn("top", F.lit(bytes(root.root)) if root else F.lit(None).cast("binary")))
    cells = _paths(manifest.tiers, subroots.select("tree", "path"), arity, cell)[0]
    cells = cells.join(subroots.drop("path"), "tree")
    member = F.struct("pos", F.col(key).alias("key"), F.col(changed).alias("changed"))
    members = manifest.members.select("tree", F.expr(f"pos div {cell}").alias("cell"), member.alias("m"))
    members = members.groupBy("tree", "cell").agg(F.collect_list("m").alias("members"))
    both = cells.drop("total", "root").join(members, ["tree", "cell"])
    kind = manifest.members.schema[key].dataType.simpleString()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _check_cell(row, arity, keys)

    keys = {f.name: f.type for f in pa.schema([pa.field("key", _arrow(manifest.members, key))])}["key"]
    found = both.mapInArrow(
        check, f"key {kind}, leaf binary, subroot binary, root binary, proof_sha256 binary, folded_root binary, verified boolean"
    )
    said = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    return found.select(F.col("key").alias(key), *said, "verified")


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _check_cell(row: dict, arity: int, key_type: pa.DataType) -> pa.RecordBatch:
    nodes, states = _read_cell(row["nodes"], row["states"], row["n"], row["levels"], arity)
    members = sorted(row["members"], key=lambda m: m["pos"])
    n = len(members)
    own = pack(nodes[0])
    now = unpack(b"".join(m["changed"] or own[32 * i : 32 * i + 32] for i, m in enumerate(members)))
    at = np.arange(n)
    proof, blocks = fresh(n), np.zeros(n, np.int64)
    for below, kept in zip(nodes, states):
        for has, other in siblings(at, below, arity):
            if has.any():
                proof[:, has] = absorb(proof[:, has], hex_block(below[:, other[has]]))
                blocks += has
        now = fold(now, at, below, kept, arity)
        at = at // arity
    # Above the cell all its members take the same steps, so equal digests are folded once.
    rows, back = np.unique(now.T, axis=0, return_inverse=True)
    now = np.ascontiguousarray(rows.T)
    for step in decode(row["path"]):
        for j in range(step.size - 1):
            proof = absorb(proof, np.repeat(hex_block(step.others[:, j : j + 1]), n, axis=1))
        blocks += step.size - 1
        state = absorb(np.repeat(step.state, now.shape[1], axis=1), hex_block(now))
        for j in range(step.slot, step.size - 1):
            state = absorb(state, np.repeat(hex_block(step.others[:, j : j + 1]), now.shape[1], axis=1))
        now = close(state, step.size)
    folded = now[:, back.reshape(-1)]
    top = unpack(row["top"])
    repeat = lambda data: pa.array([data] * n, pa.binary())
    arrays = [
        pa.array([m["key"] for m in members], key_type), _digest_column(nodes[0]), repeat(row["subroot"]), repeat(row["top"]),
        _digest_column(close(proof, blocks)), _digest_column(folded), pa.array((folded == top).all(axis=0)),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def document_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, digest, and changed: the digest with one more character counted, for every seventh document.

    Those are the rows whose doc_id in decimal has a crc32 that 7 divides; a null count stays null,
    and a null doc_id is never changed.
    """
    plain = {c: F.col(c) for c in FIELDS}
    more = plain | {"n_chars": (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")}
    seventh = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return docs.select(
        "doc_id", "lang", digest(list(plain.values())).alias("digest"),
        F.when(seventh, digest(list(more.values()))).alias("changed"),
    )


def check_documents(docs: DataFrame, arity: int = ARITY, cell_rows: int = CELL) -> DataFrame:
    """One row per document: doc_id and what ``verify`` finds when single documents are tampered with.

    Leaves are doc_id, source, lang, n_chars and text of a document, other columns are not read;
    nulls differ from empty texts. Within a language leaves come by doc_id, null first, then by
    digest; repeated rows are leaves of their own. An empty table gives an empty result.
    """
    leaves = cut_lineage(document_leaves(docs))
    return verify(build(leaves, ["doc_id"], arity, cell_rows))
