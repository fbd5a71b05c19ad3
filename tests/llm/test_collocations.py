import random
import re
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, a long"


def brute(rows, least=30, longest=4, top=2000, share=80):
    f, n = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        own = f.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]", piece) if w]
            n[lang] += len(words)
            own.update(tuple(words[i : i + m]) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    out = set()
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, _, l, r = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return out


def texts(seed, count=150):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "york", "city", "é", "naïve", "A", "a", "ÀB", "\x01", "x y", "hall", "\U0001f600"] + [f"w{i}" for i in range(40)]
    out = []
    for i in range(count):
        words = []
        for _ in range(rng.randint(0, 60)):
            words += rng.choice([["new", "york", "city", "hall"], ["of", "the"], ["in", "new", "york"], [rng.choice(vocabulary)], [rng.choice(vocabulary)]])
            words[-1] += rng.choice(["", "", "", "", ",", ".", "\n", "\t", "!?", "\r", " \x0b"])
        out.append((i, " ".join(words), rng.choice(["en", "fr", None, "und", ""]), None, 7))
    return out


@pytest.mark.parametrize("seed,least,top", [(1, 30, 2000), (3, 3, 40)])
def test_against_brute_force(spark, seed, least, top):
    rows = texts(seed)
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA), top=top, least=least).collect()
    want = brute(rows, least=least, top=top)
    assert want and {tuple(r) for r in got} == want and len(got) == len(want)


def test_small_batches_and_hot_prefixes(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BATCH_BYTES", 500)
    monkeypatch.setattr(collocations, "HOT", 20)
    rows = texts(4) + [(1000 + i, "hot word next hot word", "en", None, 1) for i in range(200)]
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), least=4).collect()
    assert {tuple(r) for r in got} == brute(rows, least=4)


def test_overlaps_ties_and_long_texts(spark):
    rows = [(1, "a a a a " * 5000, "en", None, 0), (2, "x" * 300_000 + " y", "en", None, 0), (3, "b c. " * 40 + "d e. " * 40, "en", "p", 1)]
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {tuple(r) for r in got} == brute(rows)
    assert [r.phrase for r in sorted(got, key=lambda r: r.rank)][:2] == ["b c", "d e"]


def test_nulls_empties_and_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, None, None, None, None), (1, "", "en", None, None), (2, " \t\n.,", None, None, None)] + [(3, "p q", None, None, 1)] * 30
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(r) for r in got] == [("und", 1, "p q", 30, 30, 30, 60, 1_000_000)]


def test_maps_have_no_wrong_no(spark):
    phrases = [("en", f"w{i} v{i % 7}") for i in range(5000)]
    made = collocations.bit_map(spark.createDataFrame(phrases, "lang string, phrase string"))
    own = np.array([collocations.phrase_hash(p.encode()) for _, p in phrases], np.uint64)
    assert made.has(own, "en").all()
    assert made.has(own, "fr").mean() < 0.01 and not collocations.BitMap(made.rows[:0], made.bits[:0]).has(own, "en").any()


def test_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(9 * 10**18, 9 * 10**18, 9 * 10**18)], "a long, l long, r long")
    assert row.select(collocations.score("a", "l", "r")).first()[0] == 1_000_000
