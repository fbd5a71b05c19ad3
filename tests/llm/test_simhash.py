import random

import numpy as np
import xxhash

from tickloom.llm import simhash
from tickloom.llm.shared import components


def plain_fingerprint(text, width):
    words = [w.lower() for w in (text or "").encode().split()]
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(n)]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)
    return bits - (1 << 64) if bits >> 63 else bits


def groups(nodes, linked):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_fingerprints():
    rng = random.Random(1)
    texts = [None, "", "  \n", "One", "one TWO three", "É é A a\x0bb\tc", "  x y z w v"]
    texts += [" ".join(rng.choice(["a", "B", "cé"]) for _ in range(rng.randint(1, 200))) for _ in range(40)]
    for text in texts:
        assert simhash.fingerprint(text, 4) == plain_fingerprint(text, 4)


def test_links_connect_all_close_pairs(spark):
    rng = random.Random(2)
    fps = []
    for _ in range(60):
        base = rng.getrandbits(64)
        fps.append(base)
        for _ in range(rng.randint(0, 12)):
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                base ^= 1 << bit
            fps.append(base)
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    close = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    df = spark.createDataFrame([(f, f) for f in fps], "id long, f0 long")
    for most in (4096, 3):
        got = [(r.a, r.b) for r in simhash.links(df, simhash.mask_keys(4, 6), 4, most=most).collect()]
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in got)
        assert groups(fps, got) == groups(fps, close)


def test_masks_cover_all_differences():
    masks = simhash.block_masks(4, 6)
    assert len(masks) == 15 and all(m.bit_count() >= 20 for m in masks)
    rng = np.random.default_rng(1)
    for _ in range(300):
        flipped = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(flipped & m == 0 for m in masks)


def test_components(spark):
    rng = random.Random(4)
    linked = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    linked += [(5000, 5001 + i) for i in range(60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(linked, "a long, b long")).collect()}
    want = groups({n for e in linked for n in e}, linked)
    assert got == {n: c for n, c in want.items() if n in got}
    assert set(got) == {n for a, b in linked if a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    near = base[:200] + ["other"] + base[201:]
    rows = [(9, " ".join(base)), (4, " ".join(near)), (2, " ".join(f"v{rng.randrange(5000)}" for _ in range(300)))]
    rows += [(20 + i, " ".join(base)) for i in range(50)] + [(3, None), (1, ""), (9, " ".join(base)), (None, " ".join(base))]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, f0 int")
    got = simhash.near_duplicates(df, width=4, wide=False).collect()
    assert len(got) == len(rows)
    want = {2: 2, 1: 1, 3: 1, 9: 4, 4: 4, None: 4} | {20 + i: 4 for i in range(50)}
    close = (simhash.fingerprint(rows[0][1], 4) ^ simhash.fingerprint(rows[1][1], 4)) & (1 << 64) - 1
    assert close.bit_count() <= 4
    assert all(r.component == want[r.doc_id] for r in got)
    assert simhash.near_duplicates(df.limit(0)).collect() == []
    assert {r.doc_id: r.component for r in simhash.near_duplicates(df).collect()} == want


def test_small_and_large_groups_agree():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (4, 6), dtype=np.uint64)
    words = np.repeat(base, 5, axis=1)
    for i in range(30):
        for bit in rng.choice(256, rng.integers(0, 30), replace=False):
            words[bit // 64, i] ^= np.uint64(1) << np.uint64(bit % 64)
    ids, edges = np.arange(30), np.array([0, 2, 5, 12, 30])
    close = [
        (i, j) for a, b in zip(edges, edges[1:]) for i in range(a, b) for j in range(i + 1, b)
        if sum(int(x).bit_count() for x in words[:, i] ^ words[:, j]) <= 40
    ]
    apart = lambda i, j: sum(int(x).bit_count() for x in words[:, i] ^ words[:, j])
    for sure in (None, 0, 10):
        a, b = simhash.forests(ids, words, edges, 40, sure)
        made = {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())}
        assert made <= set(close) and groups(range(30), made) == groups(range(30), close)
    # Any close pair of a large group is connected by links that are each at least as close.
    a, b = simhash.forests(ids, words, np.array([0, 30]), 40, 0)
    made = list(zip(a.tolist(), b.tolist()))
    for i in range(30):
        for j in range(i + 1, 30):
            if (d := apart(i, j)) <= 40:
                top = groups(range(30), [p for p in made if apart(*p) <= d])
                assert top[i] == top[j]


def test_wide_fingerprints_find_similar_texts(spark):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        words = [f"w{rng.randrange(9000)}" for _ in range(rng.randint(80, 300))]
        rows.append((2 * i, " ".join(words)))
        for _ in range(max(1, len(words) // 100)):
            words[rng.randrange(len(words))] = "other"
        rows.append((2 * i + 1, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component for r in simhash.near_duplicates(df).collect()}
    assert all(got[2 * i] == 2 * i for i in range(150))
    assert sum(got[2 * i + 1] == 2 * i for i in range(150)) >= 140


def jaccard(a, b, width=5):
    one, other = ({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(one & other) / len(one | other)


def similar(rng, n, least):
    """Two texts of ``n`` words whose similarity is just above ``least``."""
    words = [f"w{rng.randrange(9000)}" for _ in range(n)]
    other, last = list(words), None
    while jaccard(" ".join(words), " ".join(other)) >= least:
        last = list(other)
        other[rng.randrange(n)] = f"x{rng.randrange(9000)}"
    return " ".join(words), " ".join(last)


def test_links_against_brute_force_similarity(spark):
    rng = random.Random(12)
    for least, found in ((0.85, 0.97), (0.8, 0.9), (0.7, 0)):
        rows = [(2 * i + k, t) for i in range(200) for k, t in enumerate(similar(rng, 400, least))]
        truth = {i for i in range(200) if jaccard(rows[2 * i][1], rows[2 * i + 1][1]) >= 0.8}
        got = {r.doc_id: r.component for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        linked = {i for i in range(200) if got[2 * i + 1] == 2 * i}
        print("similarity", least, "true", len(truth), "found", len(linked))
        assert linked <= truth and len(linked) >= found * len(truth)
        assert all(c in (d, d - 1) for d, c in got.items())


def test_a_chain_of_near_texts_stays_connected(spark):
    """One large group whose first text is not like the last; the closest links hold it together."""
    rng = random.Random(13)
    words, rows = [f"w{rng.randrange(9000)}" for _ in range(300)], []
    for i in range(80):
        rows.append((i, " ".join(words)))
        words[rng.randrange(300)] = f"y{i}"
    assert jaccard(rows[0][1], rows[-1][1]) < 0.5
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component for r in got} == {0}


def test_pairs_at_the_distance_share_a_key(spark):
    rng = random.Random(9)
    rows, far = [], 0
    signed = lambda x: [w - (1 << 64) if w >> 63 else w for w in (x >> 64 * i & (1 << 64) - 1 for i in range(4))]
    for i in range(400):
        one = rng.getrandbits(256)
        other = one ^ sum(1 << b for b in rng.sample(range(256), 40))
        far += all((one ^ other) >> 16 * k & 0xFFFF for k in range(16))
        rows += [(2 * i, *signed(one)), (2 * i + 1, *signed(other))]
    df = spark.createDataFrame(rows, "id long, f0 long, f1 long, f2 long, f3 long")
    assert far > 80
    keys = simhash.block_keys() + simhash.sample_keys()
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.links(df, keys, 40).collect()}
    assert found <= {(2 * i, 2 * i + 1) for i in range(400)} and len(found) > 0.92 * 400


def plain_groups(rows):
    """Components of all pairs that have four fifths of their shingles in common."""
    close = [(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[i + 1 :] if jaccard(x, y) >= 0.8]
    return groups([a for a, _ in rows], close)


def test_no_pair_at_the_threshold_is_left_out(spark):
    """Pairs just above it, whatever their fingerprints differ in, short and long, and all that share common passages."""
    rng = random.Random(14)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [t for n in (9, 20, 60, 150, 400) for _ in range(24) for t in similar(rng, n, 0.8)]
    texts += [" ".join([passage, *(f"q{rng.randrange(10**6)}" for _ in range(n))]) for n in range(5, 65)]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_groups(rows)


def test_equal_fingerprints_of_other_texts_hide_no_link(spark):
    """One shingle that outweighs all others makes fingerprints equal; groups are by shingles all the same."""
    rng = random.Random(15)
    flood = "a " * 400
    base = [f"w{i}" for i in range(40)]
    rows = [(0, flood + " ".join(f"v{rng.randrange(10**6)}" for _ in range(40))), (1, flood + " ".join(base)), (2, flood + " ".join([*base[:-1], "x"]))]
    assert simhash.wide_fingerprint(rows[0][1], 5)[0] == simhash.wide_fingerprint(rows[1][1], 5)[0]
    got = {r.doc_id: r.component for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 1} == plain_groups(rows)
