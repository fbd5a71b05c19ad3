import random

from tickloom.llm.line_dedup import drop_lines, line_report


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs, threshold=2, near=20):
    """{id: removed line numbers} by comparing every two lines."""
    every = [(d, i, line) for d, t in sorted(docs) for i, line in enumerate((t or "").split("\n")) if line.strip(" \t\r\x0b\x0c")]
    texts = sorted({line for _, _, line in every})
    parent = {t: t for t in texts}

    def top(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if min(len(a), len(b)) >= near and abs(len(a) - len(b)) <= threshold and distance(a, b) <= threshold:
                parent[top(b)] = top(a)
    seen, gone = set(), {}
    for d, i, line in every:
        if top(line) in seen:
            gone.setdefault(d, []).append(i)
        seen.add(top(line))
    return gone


def edited(rng, line, n):
    for _ in range(n):
        at, kind = rng.randint(0, len(line)), rng.randrange(3)
        line = line[:at] + ("" if kind == 0 else rng.choice("xyé")) + line[at + (kind < 2) :]
    return line


def sample(rng):
    line = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    pool = [line(rng.choice([1, 3, 10, 18, 19, 20, 21, 22, 24, 25, 40, 59, 60, 61, 62, 74, 75, 76, 90, 94, 120, 300])) for _ in range(25)]
    docs = []
    for i in range(60):
        docs.append((i, "\n".join(edited(rng, rng.choice(pool), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 5)))))
    return docs


def test_against_all_pairs(spark):
    docs = sample(random.Random(1)) + [(100, None), (101, ""), (102, "\n\n"), (103, " \n\t\n \n}\n\r\n}"), (104, "}\n\u00a0\n\u00a0")]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, at int").repartition(3)
    got = {r.doc_id: r for r in line_report(df).collect()}
    want = brute(docs)
    assert len(want) > 20
    for d, text in docs:
        assert got[d].removed == want.get(d, []) and got[d].n_removed == len(got[d].removed)
        assert got[d].n_lines == len((text or "").split("\n"))
    left = {r.doc_id: r.text for r in drop_lines(df).collect()}
    for d, text in docs:
        kept = [x for i, x in enumerate((text or "").split("\n")) if i not in want.get(d, [])]
        assert left[d] == (text if text is None else "\n".join(kept))


def test_other_thresholds(spark):
    docs = sample(random.Random(2))[:40]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for threshold in (1, 3):
        got = {r.doc_id: r.removed for r in line_report(df, threshold=threshold).collect() if r.removed}
        assert got == brute(docs, threshold)


def test_odd_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, h string")
    assert line_report(df).collect() == [] and drop_lines(df).collect() == []
    line = "a line that is long enough to be told apart from the others"
    rows = [(None, line, "p"), (1, line, "q"), (1, line, "q"), (1, "x\n" + line, "r"), (2, "word " * 40000, None), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    got = sorted((str(r.doc_id), r.n_lines, r.removed) for r in line_report(df).collect())
    assert got == [("1", 1, [0]), ("1", 1, [0]), ("1", 2, [1]), ("2", 1, []), ("3", 1, []), ("None", 1, [])]
    left = drop_lines(df)
    assert left.columns == df.columns and sorted(len(r.text or "") for r in left.collect()) == [0, 0, 0, 1, 59, 200000]
