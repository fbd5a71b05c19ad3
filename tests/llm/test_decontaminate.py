import math
import random

from tickloom.llm.decontaminate import contaminated, decontaminate, masks


def words(rng, n):
    return [f"{rng.choice('bcdfg')}{rng.randrange(3000)}" for _ in range(n)]


def brute(docs, items, window=12, share=0.8, shortest=1):
    """{(doc, item): (windows, first, last)}: every document's windows against every item's, one by one."""
    out = {}
    for item, text in items:
        w = (text or "").lower().split()
        if len(w) < shortest or not w:
            continue
        n = min(window, len(w))
        least = math.ceil(round(share * n, 9))
        tests = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for doc, other in docs:
            v = (other or "").lower().split()
            at = [i for i in range(len(v) - n + 1) if any(sum(a == b for a, b in zip(t, v[i : i + n])) >= least for t in tests)]
            if at:
                out[doc, item] = (len(at), min(at), max(at) + n - 1)
    return out


def test_masks_ignore_any_two_positions():
    seeds = masks(12, 2)
    assert all(any(a not in s and b not in s for s in seeds) for a in range(12) for b in range(12))
    assert masks(3, 0) == [[0, 1, 2]] and [len(masks(n, d)) for n, d in ((5, 1), (11, 2))] == [4, 6]


def test_against_all_windows(spark):
    rng = random.Random(1)
    items = [(i, " ".join(words(rng, rng.randint(8, 40)))) for i in range(20)] + [(90, None), (91, "")]
    # Items that share a passage, wholly or but for a word, and short ones.
    passage = items[3][1].split()
    items += [(50, items[3][1]), (51, " ".join(passage[2:] + words(rng, 9))), (52, " ".join(["other", *passage[1:]]))]
    items += [(60 + n, " ".join(words(rng, n))) for n in (1, 3, 4, 5, 7, 9, 11)] + [(61, "unseen")]
    docs = []
    for i in range(80):
        text = words(rng, rng.randint(0, 60))
        if i % 3 == 0:
            passage = rng.choice(items[:20] + items[22:])[1].split()
            for _ in range(rng.randint(0, 4)):
                passage[rng.randrange(len(passage))] = "Changed"
            at = rng.randint(0, len(text))
            text[at:at] = [w.upper() for w in passage]
        docs.append((i, " ".join(text)))
    docs += [(200, None), (201, "")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, seed int")
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.first_word, r.last_word) for r in contaminated(df, tests).collect()}
    want = brute(docs, items)
    assert got == want and len(want) > 10 and len({d for d, _ in want}) < len(want)
    assert {i for _, i in want} & set(range(60, 72))
    tiny = {(r.doc_id, r.item_id): r.n_windows for r in contaminated(df, tests, filter_bits=64).collect()}
    assert tiny == {k: v[0] for k, v in want.items()}
    left = {r.doc_id for r in decontaminate(df, tests).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in brute(docs, items, shortest=5)}


def test_odd_tables(spark):
    text = " ".join(words(random.Random(2), 15))
    tests = spark.createDataFrame([(1, text)], "item_id long, text string")
    rows = [(None, text, "x"), (5, text, "y"), (5, text, "y"), (5, "clean " * 30000, None), (6, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, body string")
    assert sorted((r.doc_id or 0, r.n_windows) for r in contaminated(df, tests).collect()) == [(0, 4), (5, 4)]
    left = decontaminate(df, tests)
    assert left.columns == df.columns and sorted(len(r.text or "") for r in left.collect()) == [0, 180000]
    assert contaminated(df.limit(0), tests).collect() == []
    assert contaminated(df, tests.limit(0)).collect() == [] and decontaminate(df, tests.limit(0)).count() == 5
