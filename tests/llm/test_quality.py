import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import quality_knn, quality_rules
from tickloom.llm.queries import QUERIES

WORDS = "river stone bright quiet morning paper walk garden light under window slow table green north".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(n)).capitalize() + "."


def junk(rng, n, kind):
    words = prose(rng, n).split()
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 1:
        return " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in words)
    return " ".join([words[0]] * n)


def counts(text):
    words = text.split() if text else []
    lines = [x for x in (text or "").split("\n") if x.split()]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w in windows if windows.count(w) > 1}
    marked = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    return (
        len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked),
    )


def test_counts_against_plain_ones():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", "a a a a", "é ê é ê é ê", "x\n\nx\n x", "a b c a b c\na b c", "#$ |x| <y>"]
    texts += [" ".join(rng.choice("abcé") for _ in range(rng.randint(0, 40))).replace("c a", "c\na") for _ in range(60)]
    for text in texts:
        assert quality_rules.count_text(text)[:5] == counts(text), text


def test_sketches_merge_to_the_sketch_of_all(spark):
    rng = random.Random(1)
    rows = [(i, "en", f"s{i % 3}", prose(rng, rng.randint(20, 90))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    cells = ("lang", "measure", "bucket")
    whole = quality_rules.sketch(quality_rules.measure(df)).groupBy(*cells).agg(F.sum("n").alias("n"))
    halves = [quality_rules.sketch(quality_rules.measure(df.filter(F.col("doc_id") % 2 == k))) for k in (0, 1)]
    merged = halves[0].union(halves[1]).groupBy(*cells).agg(F.sum("n").alias("n"))
    assert sorted(whole.collect()) == sorted(merged.collect())


def test_fences_are_near_exact_quartiles(spark):
    rng = random.Random(2)
    rows = [(i, "en", "s", prose(rng, 60)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    measured = quality_rules.measure(df)
    fence = quality_rules.fences(quality_rules.sketch(measured), 3.0).first()
    lengths = sorted(r.word_chars / r.n_words for r in measured.collect())
    q1, q3 = lengths[99], lengths[299]
    reach = 3 * (1 + 8 / 400) * (q3 - q1) + 0.1
    assert fence.word_length_high == pytest.approx(q3 + reach, rel=0.06)
    assert fence.word_length_low == pytest.approx(q1 - reach, abs=0.6)


def test_lower_ends_against_plain_ones(spark):
    pairs = [(float(k), float(n)) for n in (0, 1, 3, 10, 500) for k in (0, 1, 2, 3, 9, 500) if k <= n]
    got = spark.createDataFrame(pairs, "k double, n double").select(quality_rules.lower_end(F.col("k"), F.col("n"))).collect()
    for (k, n), row in zip(pairs, got):
        p, z = k / n if n else 0, 3
        want = (p + z * z / 2 / n - z * (p * (1 - p) / n + z * z / 4 / n / n) ** 0.5) / (1 + z * z / n) if k and n else 0
        assert row[0] == pytest.approx(max(0, want), abs=1e-12) and row[0] <= p


def test_groups_of_any_size_are_judged_alike(spark):
    rng = random.Random(11)

    def repeats(share):
        """About 200 words, ``share`` of them in windows that come again."""
        phrase = prose(rng, 8)[:-1].lower()
        n = round(200 * share / 8)
        return " ".join([" ".join(f"{w}{i}{rng.randrange(10**6)}" for i, w in enumerate(prose(rng, 200 - 8 * n).split()))] + [phrase] * n)

    fresh = lambda: " ".join(f"{w}{rng.randrange(10**4)}" for w in prose(rng, 200).split())
    for size in (50, 1500):
        rows = [(i, "en", "s", fresh()) for i in range(size)] + [(size, "en", "s", repeats(0.24))]
        got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")).collect()}
        assert 0.2 < got[size].n_repeat_words / got[size].n_words < 0.28
        assert got[size].rule == "repeat_share" and not got[size].base_failed and not got[size].kept
        assert all(got[i].kept for i in range(size))


def test_rare_languages_have_their_own_word_lengths(spark):
    rng = random.Random(12)
    rows = [(i, "en", "s", prose(rng, 80)) for i in range(600)]
    long = lambda: " ".join("".join(rng.choice("文字語言") for _ in range(rng.randint(20, 30))) for _ in range(60))
    rows += [(1000 + i, "zh", "s", long()) for i in range(12)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")).collect()
    assert all(r.kept for r in got)


def test_rules_catch_junk_and_keep_prose(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["en", None]), rng.choice(["a", "b"]), prose(rng, 80) if i % 6 else junk(rng, 80, i // 6 % 3)) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(df).collect()}
    assert all(kept[i] == bool(i % 6) for i in range(1200))


def test_rules_on_odd_tables(spark):
    schema = "doc_id long, lang string, source string, text string, kept int"
    assert quality_rules.quality_rules(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, None, None, None, 1), (1, "en", "s", "", 2), (1, "en", "s", "", 2), (2, None, "s", "long " * 60000, 3)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 4 and all(r.base_failed and not r.kept for r in got)


def test_classifier_on_rows_it_has_not_seen(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(30, 120)) if i % 4 else junk(rng, rng.randint(30, 120), rng.randint(0, 2))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(900)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_knn.classify(docs, labels).collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.5)
    right = [got[i].predicted == int(i % 4 > 0) for i in got if got[i].held_out]
    assert sum(right) / len(right) > 0.97


def test_classifier_tells_vocabularies_apart(spark):
    rng = random.Random(8)
    swap = str.maketrans("aeioubcdfglmnprstw", "eioauctdgflnmrpswb")
    other = [w.translate(swap) for w in WORDS]
    text = lambda pool: " ".join(rng.choice(pool) for _ in range(rng.randint(40, 90)))
    rows = [(i, text(WORDS if i % 2 else other)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, quality int")
    got = [r for r in quality_knn.classify(docs, labels).collect() if r.held_out]
    assert sum(r.predicted == r.doc_id % 2 for r in got) / len(got) > 0.97


def test_classifier_learns_nothing_from_held_out_rows(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, 60) if i % 2 else junk(rng, 60, i % 3)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 1]
    labels = lambda flip: spark.createDataFrame(
        [(i, i % 2 ^ int(flip and i in out)) for i in range(200)], "doc_id long, quality int"
    )
    one, other = (sorted(quality_knn.classify(docs, labels(f)).select("doc_id", "score").collect()) for f in (False, True))
    assert one == other


def test_classifier_on_odd_tables(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, "a b"), (2, "word " * 50000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality_knn.classify(docs, none).collect()] == [0.5] * 4
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 7)], "doc_id long, quality int")
    assert len(quality_knn.classify(docs, labels).collect()) == 4
    assert quality_knn.classify(docs.limit(0), labels).collect() == []


def test_classifier_on_the_drivers_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op9_quality_classifier"](spark, sf)
    truth = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    pairs = got.filter("held_out").join(truth, "doc_id").select("predicted", "quality").collect()
    assert sum(p == q for p, q in pairs) / len(pairs) > 0.97


def test_vote_against_a_plain_search():
    rng = np.random.default_rng(5)
    texts = [prose(random.Random(i), 20) for i in range(40)] + ["", None, "same same"] * 2
    space = rng.standard_normal((quality_knn.TERMS, 6)).astype(np.float32)
    vectors = quality_knn.project(space, [prose(random.Random(100 + i % 30), 20) for i in range(60)])  # each twice, so that there are ties
    labels = (rng.random(60) < 0.5).astype(float)
    got = quality_knn.vote((space, vectors, labels), texts, 5)
    for own, score in zip(quality_knn.project(space, texts), got):
        near = [max(0.0, float(np.float32(c))) for c in own @ vectors.T]
        last = sorted(near, reverse=True)[4]
        sure = [(c**8 + 1e-9, y) for c, y in zip(near, labels) if c > last * (1 + 1e-6)]
        tied = [y for c, y in zip(near, labels) if last * (1 - 1e-6) <= c <= last * (1 + 1e-6)]
        rest = (last**8 + 1e-9) * (5 - len(sure))
        want = (sum(w * y for w, y in sure) + rest * sum(tied) / len(tied)) / (sum(w for w, _ in sure) + rest)
        assert score == pytest.approx(want, abs=1e-4)
    order = rng.permutation(60)
    assert quality_knn.vote((space, vectors[order], labels[order]), texts, 5) == pytest.approx(got, abs=1e-4)


def test_space_against_a_plain_decomposition(spark):
    texts = [prose(random.Random(i), 30 + i % 40) for i in range(130)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    known = [i for i in range(130) if zlib.crc32(str(i).encode()) % 3 != 1]
    model = quality_knn.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(130)], "doc_id long, quality int"))
    plain = np.zeros((len(known), quality_knn.TERMS))
    for row, i in enumerate(known):
        ids, weights = quality_knn.terms(texts[i])
        plain[row, ids] = weights
    plain *= np.log((1 + len(known)) / (1 + (plain > 0).sum(axis=0))) + 1
    left, values, _ = np.linalg.svd(plain, full_matrices=False)
    want = left[:, : quality_knn.RANK] * values[: quality_knn.RANK]
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert model.vectors.shape == want.shape and list(model.labels) == [i % 2 for i in known]
    assert np.abs(model.vectors @ model.vectors.T - want @ want.T).max() < 0.02
    again = quality_knn.project(model.space, [texts[i] for i in known])
    assert np.abs((again * model.vectors).sum(axis=1) - 1).max() < 1e-3


def test_keep_good_passes_other_columns_through(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 60) if i % 2 else junk(rng, 60, i % 3), i, "x", 0.5) for i in range(120)] + [(None, None, None, None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int, ids string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    kept = quality_knn.keep_good(docs, labels)
    assert kept.schema == docs.schema
    got = [tuple(r) for r in kept.collect()]
    assert all(r in rows for r in got) and sum(r[0] is not None and r[0] % 2 for r in got) >= 58
    assert not [r for r in got if r[0] is not None and r[0] % 2 == 0][2:]
    assert quality_knn.keep_good(docs.limit(0), labels).collect() == []
