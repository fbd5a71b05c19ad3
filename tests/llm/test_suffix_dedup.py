import hashlib
import random

import numpy as np

from tickloom.llm import suffix_dedup
from tickloom.llm.suffix_dedup import WIDTH, remove_repeats


def brute(docs):
    """{id: (n_bytes, n_removed, n_spans, kept_sha256)} by a set of all strings seen."""
    seen, out = set(), {}
    for key, text in sorted(docs):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - WIDTH + 1):
            w = raw[i : i + WIDTH]
            if w in seen:
                gone[i : i + WIDTH] = b"\x01" * WIDTH
            seen.add(w)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[key] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def made(df):
    return {r[0]: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def sample():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(10, 60))) for _ in range(12)]
    docs = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 2)
            parts += [p[cut:], " ".join(word() for _ in range(rng.randint(0, 20)))]
        text = "".join(parts)
        if rng.random() < 0.3 and docs:
            text = list(docs[rng.randrange(len(docs))][1] or "")
            for _ in range(rng.randint(0, 3)):
                if text:
                    text[rng.randrange(len(text))] = "z"
            text = "".join(text)
        docs.append((i * 3, text))
    docs += [(1, None), (2, ""), (4, "x" * 500), (5, "ab" * 300), (7, "x" * 99), (8, "x" * 100)]
    return docs


def test_against_all_windows(spark, monkeypatch):
    docs = sample()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert made(remove_repeats(df)) == brute(docs)


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 150)
    text = (random.Random(1).randbytes(400).hex()[:700] * 2).encode()
    row, at, head, _ = suffix_dedup.runs([text, b"", text[:99]])
    start, windows, lead = suffix_dedup._unpack(at)
    assert (lead < WIDTH).all() and set(row) == {0} and windows.sum() == len(text) - WIDTH + 1
    assert (np.sort(start)[1:] == np.sort(start)[:-1] + windows[np.argsort(start)][:-1]).all()
    # The two halves are equal, and so are their anchors but where a piece was cut.
    assert len(np.unique(head)) < 0.75 * len(head)
    held, _, _ = suffix_dedup.cells(text, at)
    start, windows, _ = suffix_dedup._unpack(np.sort(held))
    assert windows.max() <= suffix_dedup.CELL and windows.sum() == len(text) - WIDTH + 1
    assert (start[1:] == start[:-1] + windows[:-1]).all()
    places, one, _ = suffix_dedup.window_hashes(text, at)
    by_hash = {}
    for p, h in zip(places.tolist(), one.tolist()):
        assert by_hash.setdefault(h, text[p : p + WIDTH]) == text[p : p + WIDTH]
    assert len(by_hash) == len({text[p : p + WIDTH] for p in range(len(text) - WIDTH + 1)})


def test_repeats_of_a_batch_are_dealt_out(spark):
    # A word over and over: nearly all runs have one anchor.
    docs = [(i, "heat " * (300 + i)) for i in range(40)]
    row, at, head, extent = suffix_dedup.runs([t.encode() for _, t in docs])
    spread = suffix_dedup._spread(head, extent, row, at)
    assert np.unique(head, return_counts=True)[1].max() > 0.5 * len(head)
    assert np.unique(spread[0], return_counts=True)[1].max() < 200
    assert sorted(np.where(spread[3] < 0, -1 - spread[3], spread[3])) == sorted(at)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert made(remove_repeats(df)) == brute(docs)


def test_documents_of_the_driver(spark):
    import glob

    from conftest import SF_DIR

    rows = spark.read.parquet(glob.glob(f"{SF_DIR}/documents.parquet")[0])
    docs = [(r.doc_id, r.text) for r in rows.select("doc_id", "text").collect()]
    assert made(remove_repeats(rows)) == brute(docs)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(empty).collect() == []
    long = "0123456789" * 12
    rows = [(None, long, 1), (7, long, 2), (7, long, 2), (7, "other " + long, 3), (9, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumnRenamed("n", "start")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in remove_repeats(df).collect()), key=str)
    # A repeated row is one document; the null id comes first, so that all of 7's copies go.
    assert (None, 120, 20 - 10 + 100) in got and (9, 0, 0) in got
    assert sum(1 for r in got if r[0] == 7) == 2 and all(r[2] >= 120 for r in got if r[0] == 7)
    named = spark.createDataFrame([("b", long), ("a", long)], "doc_id string, text string")
    assert {r.doc_id: r.n_removed for r in remove_repeats(named).collect()} == {"a": 110, "b": 120}
