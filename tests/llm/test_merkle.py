import hashlib
import random
import zlib

import numpy as np
import pytest

from tickloom.llm import merkle, sha_states

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def rise(level, arity):
    while len(level) > 1:
        level = [sha("".join(level[i : i + arity])) for i in range(0, len(level), arity)]
    return level[0]


def path(level, at, arity):
    out = []
    while len(level) > 1:
        start = at // arity * arity
        out += [x for i, x in enumerate(level[start : start + arity], start) if i != at]
        level = [sha("".join(level[i : i + arity])) for i in range(0, len(level), arity)]
        at //= arity
    return out


def brute(rows, arity=2):
    """Plain trees, built anew for every tampered document."""
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    names = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    leaves = {}
    for lang in names:
        made = [((r[0] is not None, r[0] or 0, bytes.fromhex(leaf(*r[:5]))), r) for r in by_lang[lang]]
        leaves[lang] = sorted(made, key=lambda x: x[0])
    digests = {lang: [x[0][2].hex() for x in leaves[lang]] for lang in names}
    subroots = [rise(digests[lang], arity) for lang in names]
    out = []
    for i, lang in enumerate(names):
        for at, (_, r) in enumerate(leaves[lang]):
            proof = path(digests[lang], at, arity) + path(subroots, i, arity)
            other = list(digests[lang])
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                other[at] = leaf(r[0], r[1], r[2], r[3] + 1, r[4])
            folded = rise([*subroots[:i], rise(other, arity), *subroots[i + 1 :]], arity)
            root = rise(subroots, arity)
            out.append((r[0], digests[lang][at], subroots[i], root, sha("".join(proof)), folded, folded == root))
    return out


def documents(n, seed=3):
    rng = random.Random(seed)
    langs = ["en"] * 6 + ["fr", "de", None, "", "zz", "é"]
    return [(i * 3, rng.choice(["web", None, "a:b"]), rng.choice(langs), rng.choice([None, i, 0]), rng.choice(["", None, "é\n-", f"t{i}"]), "x", 1) for i in range(n)]


@pytest.mark.parametrize("n,arity,cell", [(1, 2, 1024), (33, 2, 2), (300, 2, 8), (200, 3, 9)])
def test_against_plain_trees(spark, n, arity, cell):
    rows = documents(n)
    got = merkle.check_documents(spark.createDataFrame(rows, SCHEMA).repartition(5), arity, cell).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[5])
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, arity), key=key)


def test_repeated_rows_nulls_and_long_texts(spark):
    rows = [(7, "s", "en", 2**63 - 1, "same", None, 0)] * 40 + [(None, None, None, None, None, None, None)] * 3
    rows += [(5, "s", "en", 1, t, "p", 1) for t in ("a", "b")] + [(9, "s", "fr", 1, "é" * 400_000, "p", 1), (14, "", "", -1, "", "", 2)]
    got = merkle.check_documents(spark.createDataFrame(rows, SCHEMA), cell_rows=4).collect()
    key = lambda x: tuple(str(v) for v in x)
    want = brute(rows)
    assert sorted((key(r)[:4] for r in got)) == sorted(key(r)[:4] for r in want)
    # Which place a repeated row has is not told apart, so proofs are compared as a whole.
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_empty_table(spark):
    assert merkle.check_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_fold_reads_state_and_right_siblings_only():
    leaves = np.random.default_rng(1).integers(0, 2**32, (8, 27), dtype=np.uint32)
    nodes, states = merkle.build_cell(leaves, 3, 3)
    new, at = leaves[::-1].copy(), np.arange(27)
    hidden = nodes[0].copy()
    want = merkle.fold(new, at, nodes[0], states[0], 3)
    for i in range(27):
        blind = hidden.copy()
        blind[:, : i + 1] = 0  # the node itself and all to its left
        assert (merkle.fold(new[:, i : i + 1], at[i : i + 1], blind, states[0], 3) == want[:, i : i + 1]).all()
    for i in range(27):
        own = [sha_states.pack(leaves[:, j : j + 1]).hex() for j in range(27)]
        own[i] = sha_states.pack(new[:, i : i + 1]).hex()
        assert sha_states.pack(want[:, i : i + 1]).hex() == sha("".join(own[i // 3 * 3 : i // 3 * 3 + 3]))


def test_hash_states():
    data = np.random.default_rng(2).integers(0, 2**32, (8, 500), dtype=np.uint32)
    state = sha_states.fresh(500)
    for i in range(4):
        state = sha_states.absorb(state, sha_states.hex_block(data))
    got = sha_states.pack(sha_states.close(state, 4))
    raw = sha_states.pack(data)
    want = b"".join(hashlib.sha256(raw[32 * i : 32 * i + 32].hex().encode() * 4).digest() for i in range(500))
    assert got == want and (sha_states.unpack(raw) == data).all()
    assert sha_states.pack(sha_states.close(sha_states.fresh(1), 0)) == hashlib.sha256(b"").digest()


def test_manifest_is_stored_with_states(spark):
    leaves = merkle.document_leaves(spark.createDataFrame(documents(100), SCHEMA))
    made = merkle.build(leaves, ["doc_id"], cell_rows=16)
    assert len(made.tiers) == 2 and made.cell == 16
    for r in made.tiers[0].collect():
        nodes, states = merkle._read_cell(r.nodes, r.states, r.n, r.levels, 2)
        again, kept = merkle.build_cell(nodes[0], r.levels, 2)
        assert all((a == b).all() for a, b in zip(nodes, again)) and all((a == b).all() for a, b in zip(states, kept))
