"""Every stage of the pipeline against a plain version, on a small table."""

import os
from collections import Counter

import pytest
from conftest import SF_DIR

import __spark_entry__ as entry
import corpus_pipeline
from tickloom.llm import packing
from tickloom.llm.queries import QUERIES


def within(a, b, edits):
    """Whether at most so many edits join the texts."""
    same = len(os.path.commonprefix([a, b]))
    a, b = a[same:], b[same:]
    if not a or not b or not edits:
        return len(a) + len(b) <= edits
    return within(a[1:], b[1:], edits - 1) or within(a[1:], b, edits - 1) or within(a, b[1:], edits - 1)


def roots(items, linked):
    parent = {i: i for i in items}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {i: top(i) for i in items}


def plain_lines(docs):
    every = [(d, i, x) for d, t in sorted(docs) for i, x in enumerate(t.split("\n")) if x.strip(" \t\r\x0b\x0c")]
    by_length = {}
    for x in {x for _, _, x in every if len(x) >= 20}:
        by_length.setdefault(len(x), []).append(x)
    linked = []
    for n, own in by_length.items():
        for i, a in enumerate(own):
            others = own[i + 1 :] + by_length.get(n + 1, []) + by_length.get(n + 2, [])
            linked += [(a, b) for b in others if within(a, b, 2)]
    root, seen, out = roots({x for _, _, x in every}, linked), set(), {d: t.split("\n") for d, t in docs}
    for d, i, x in every:
        if root[x] in seen:
            out[d][i] = None
        seen.add(root[x])
    return {d: "\n".join(x for x in lines if x is not None) for d, lines in out.items()}


def plain_near(docs):
    """Ids that stay, of pairs by brute force; and the pairs that have five-word shingles in common in a share of 0.8."""
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in docs if (w := t.lower().split())}
    ids, linked = sorted(sets), []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
                linked.append((a, b))
    root = roots(ids, linked)
    return {d for d, _ in docs if root.get(d, d) == d}, linked


def plain_leaks(docs, items):
    tests = {tuple(w[i : i + 12]) for _, t in items for w in [t.lower().split()] for i in range(len(w) - 11)}
    first = {}
    for t in tests:
        for k in range(12):
            first.setdefault((k, t[k]), []).append(t)
    out = set()
    for d, text in docs:
        w = text.lower().split()
        for at in range(len(w) - 11):
            near = Counter(t for k in range(12) for t in first.get((k, w[at + k]), ()))
            if near and near.most_common(1)[0][1] >= 10:
                out.add(d)
                break
    return out


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows of each stage, written and read again as the pipeline is run."""
    base = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    out.append(docs)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF_DIR).write.parquet(f"{base}/{i}")
        out.append(spark.read.parquet(f"{base}/{i}"))
    return out


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def test_columns_stay(stages):
    for stage in stages[:-1]:
        assert stage.dtypes == stages[0].dtypes


def test_quality_keeps_what_the_classifier_keeps(spark, stages):
    good = {r.doc_id for r in QUERIES["op9_quality_classifier"](spark, SF_DIR).collect() if r.predicted}
    assert dict(texts(stages[1])) == {d: t for d, t in texts(stages[0]) if d in good}


def test_lines(stages):
    left = plain_lines(texts(stages[1]))
    assert dict(texts(stages[2])) == left
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_near_duplicates(spark, stages):
    """On what the stage gets, from which line deduplication took the copies, and on the documents themselves."""
    for given, out in ((stages[2], stages[3]), (stages[0], corpus_pipeline.near_duplicates(spark, stages[0], SF_DIR))):
        docs, left = texts(given), dict(texts(out))
        stay, linked = plain_near(docs)
        assert all(left[d] == t for d, t in docs if d in left)
        # Documents without a near-duplicate all stay, and of the others one of each group, but for a tenth that may be missed.
        gone = {d for d, _ in docs} - stay
        assert stay <= set(left) and len(set(left) & gone) <= 0.1 * len(gone)
    assert len(linked) > 10


def test_decontamination(spark, stages):
    docs = texts(stages[3])
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = plain_leaks(docs, items)
    assert dict(texts(stages[4])) == {d: t for d, t in docs if d not in leaks}


def test_packing(stages):
    rows = stages[5].collect()
    assert {r.doc_id for r in rows} == {d for d, _ in texts(stages[4])}
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= packing.CAPACITY
    assert len(held) <= -(-sum(r.length for r in rows) // packing.CAPACITY) + 1


def test_run_is_the_stages(spark, stages):
    count = lambda df: Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert count(corpus_pipeline.run(spark, SF_DIR)) == count(stages[5])


def test_a_repeated_id_does_not_take_other_texts_with_it(spark):
    same, other = "one two three four five six seven " * 9, "quite another text that nothing is like " * 9
    rows = [(1, same, "en", "s", 1), (4, same, "en", "s", 1), (4, other, "en", "s", 1), (None, same + "eight", "en", "s", 1), (7, "", "en", "s", 0), (8, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_duplicates(spark, docs, SF_DIR).collect()
    ids = sorted((str(r.doc_id), r.text[:5]) for r in left)
    assert ids == [("4", "quite"), ("7", ""), ("8", ""), ("None", "one t")]


def test_every_operator_is_registered():
    names = entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))
    assert "pipeline" in names


def test_odd_documents_pass_all_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (5, "", "en", "s", 0), (5, None, "en", "s", None), (10**9, "word " * 30000, None, "s", 1)],
        docs.schema,
    )
    for table in (odd, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF_DIR)
            assert out.dtypes == docs.dtypes
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, table, SF_DIR).count() == (0 if table is not odd else 3 + 8)


def test_other_columns_pass_through_all_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(60)
    names = ["id", "key", "body", "whole", "component", "label", "score", "line", "h", "g", "at", "item", "words", "f0", "root", "drop", "least"]
    wide = docs.selectExpr("*", *[f"concat('{c}-', doc_id) AS `{c}`" for c in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        wide = stage(spark, wide, SF_DIR)
        assert wide.columns == [*docs.columns, *names]
        rows = wide.collect()
        assert rows and all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in names)
    assert corpus_pipeline.STAGES[-1][1](spark, wide, SF_DIR).select("doc_id").distinct().count() == len(rows)
