"""SQL that DuckDB runs on the same tables, for the text operators that SQL can express.

Hash filters, indexes and sketches are left out or written out plainly; results are the same.
"""

from __future__ import annotations

from itertools import combinations

from tickloom.llm import decontaminate, quality_rules, secrets

UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
GAPS = r"'[\x20\x09-\x0D]+'"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), {GAPS}), lambda x: x <> '')"


def decontamination() -> str:
    n, least, classes = decontaminate.WINDOW, 10, decontaminate.CLASSES
    keys = []
    for k, ignored in enumerate(combinations(range(classes), n - least)):
        kept = [f"win[{i + 1}]" for i in range(n) if i % classes not in ignored]
        keys.append(f"'{k} ' || " + " || ' ' || ".join(kept))
    lists = "[" + ", ".join(keys) + "]"

    def windows(table: str, key: str) -> str:
        return f"""SELECT *, w[i : i + {n - 1}] AS win FROM (SELECT *, unnest(range(1, len(w) - {n - 2})) AS i FROM (
          SELECT DISTINCT {key} AS id, text, {_words(f"translate(text, {UPPER})")} AS w FROM {table}))"""

    own = _words(f"translate(text, {UPPER})")
    return f"""WITH test AS (SELECT DISTINCT win, id AS item FROM ({windows('benchmark', 'item_id')})),
    test_keys AS (SELECT item, win, unnest({lists}) AS k FROM test),
    doc_keys AS (SELECT id, text, i - 1 AS place, win, unnest({lists}) AS k FROM ({windows('documents', 'doc_id')})),
    long AS (SELECT DISTINCT d.id, d.text, t.item, d.place, {n} AS size FROM doc_keys d JOIN test_keys t ON d.k = t.k
      WHERE len(list_filter(range(1, {n + 1}), lambda p: d.win[p] = t.win[p])) >= {least}),
    short AS (SELECT item_id AS item, {own} AS win FROM benchmark WHERE len({own}) BETWEEN 1 AND {n - 1}),
    doc AS (SELECT DISTINCT doc_id AS id, text, {own} AS w FROM documents WHERE EXISTS (SELECT * FROM short)),
    places AS (SELECT id, text, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM doc, (SELECT DISTINCT len(win) AS size FROM short)),
    brief AS (SELECT DISTINCT id, text, item, i - 1 AS place, size FROM places JOIN short ON len(win) = size
      WHERE len(list_filter(range(1, size + 1), lambda p: w[i + p - 1] = win[p])) >= ceil(round({decontaminate.SHARE} * size, 9)))
    SELECT id AS doc_id, item AS item_id, count(DISTINCT place) AS n_windows, min(place)::INT AS first_word, max(place + size - 1)::INT AS last_word
    FROM (SELECT * FROM long UNION ALL SELECT * FROM brief) GROUP BY id, text, item"""


def secret_scan() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for k, rule in enumerate(secrets.RULES):
        pattern = quoted(rule.pattern)
        parts.append(f"""SELECT row, {k} AS k, '{rule.kind}' AS kind, regexp_extract_all(t, {pattern}) AS m,
          regexp_split_to_array(t, {pattern}) AS g, regexp_extract_all(t, {pattern}, {rule.group}) AS v, {rule.least} AS least
          FROM doc WHERE regexp_matches(t, {pattern})""")
    span = "kind || ':' || s || ':' || e"
    return f"""WITH doc AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
    found AS ({" UNION ALL ".join(parts)}),
    each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
    placed AS (SELECT *, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s FROM each),
    span AS (SELECT row, k, kind, s::BIGINT AS s, (s + length(m[i]))::BIGINT AS e FROM placed WHERE length(v[i]) >= least),
    per AS (SELECT row, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
      string_agg({span}, ',' ORDER BY s, k) FILTER (k < {len(secrets.BASE)}) AS base, string_agg({span}, ',' ORDER BY s, k) AS spans FROM span GROUP BY row)
    SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM doc LEFT JOIN per USING (row)"""


def rules(spread: float = 3.0) -> str:
    r = quality_rules
    z, gamma, low = r.CONFIDENCE, r.GAMMA, r.LEAST_VALUE
    ends = []
    for m, (a, b, unit) in r.SHARES.items():
        k, n = f"({a}::DOUBLE / {unit})", f"({b}::DOUBLE / {unit})"
        end = f"({k} / {n} + {z * z} / 2 / {n} - {z} * sqrt(greatest({k} / {n} * (1 - {k} / {n}), 0.0) / {n} + {z * z} / 4 / ({n} * {n}))) / (1 + {z * z} / {n})"
        ends.append(f"CASE WHEN {a} > 0 AND {b} > 0 THEN greatest({end}, 0.0) ELSE 0.0 END AS {m}")
    shares = ", ".join([*ends, "CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0.0 END AS word_length"])
    cells = " UNION ALL ".join(
        f"""SELECT lang, source, '{m}' AS m, CASE WHEN {m} <= {low} THEN -1000000 ELSE ceil(ln({m}) / ln({gamma}))::INT END AS b, count(*) AS n
        FROM shared GROUP BY ALL"""
        for m in r.MEASURES
    )
    ctes = []
    for i, by in enumerate((["lang", "source"], ["lang"], [])):
        keys = "".join(f"{c}, " for c in by)
        ctes.append(f"""ranked{i} AS (SELECT *, CASE WHEN b = -1000000 THEN 0.0 ELSE pow({gamma}, b - 0.5) END AS v,
          sum(n) OVER (PARTITION BY {keys}m ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {keys}m) AS total
          FROM (SELECT {keys}m, b, sum(n) AS n FROM cells GROUP BY ALL)),
        quart{i} AS (SELECT {keys}m, min(v) FILTER (upto >= 0.25 * total) AS q1, min(v) FILTER (upto >= 0.75 * total) AS q3,
          max(total)::DOUBLE AS total FROM ranked{i} GROUP BY {keys}m)""")
    blend = []
    for q in ("q1", "q3"):
        whole = f"CASE WHEN a.m = 'word_length' THEN b.{q} ELSE (b.total * b.{q} + {r.WEIGHT} * c.{q}) / (b.total + {r.WEIGHT}) END"
        blend.append(f"(a.total * a.{q} + {r.WEIGHT} * ({whole})) / (a.total + {r.WEIGHT}) AS {q}")
    reach = f"{spread} * (1 + {float(r.FEW)} / total) * (q3 - q1) + CASE WHEN m = 'word_length' THEN {r.LENGTH_ROUNDING} ELSE {r.ROUNDING} END"
    ctes.append(f"""blended AS (SELECT a.lang, a.source, a.m, b.total, {", ".join(blend)} FROM quart0 a
      JOIN quart1 b ON a.lang IS NOT DISTINCT FROM b.lang AND a.m = b.m JOIN quart2 c ON a.m = c.m)""")
    highs = ", ".join(f"max(CASE WHEN m = '{m}' THEN q3 + ({reach}) END) AS {m}_high" for m in r.MEASURES)
    ctes.append(f"""fence AS (SELECT lang, source, {highs}, max(CASE WHEN m = 'word_length' THEN q1 - ({reach}) END) AS word_length_low
      FROM blended GROUP BY lang, source)""")
    broken = [f"WHEN {m} > {m}_high THEN '{m}'" for m in r.MEASURES] + ["WHEN word_length < word_length_low THEN 'word_length'"]
    counts = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"
    count_of = lambda signs: f"length(t) - length(regexp_replace(t, '[{signs}]', '', 'g'))"
    return f"""WITH doc AS (SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS t, {_words('text')} AS w,
      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
    win AS (SELECT row, i, w[i : i + 2] AS win FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM doc)),
    often AS (SELECT row, i FROM (SELECT *, count(*) OVER (PARTITION BY row, win) AS n FROM win) WHERE n > 1),
    marked AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM often) GROUP BY row),
    counted AS (SELECT doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
      {count_of('#*$%&|<>')} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
      len(lines) AS n_lines, {count_of('A-Z')} AS n_capitals FROM doc LEFT JOIN marked USING (row)),
    shared AS (SELECT *, {shares} FROM counted),
    cells AS ({cells}),
    {", ".join(ctes)},
    judged AS (SELECT r.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE {" ".join(broken)} END AS rule
      FROM shared r LEFT JOIN fence f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source)
    SELECT {counts}, base_failed, NOT base_failed AND rule IS NULL AS kept, rule FROM judged"""


def merkle_manifest() -> str:
    field = lambda x: f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"
    leaf = lambda n: "sha256(" + " || ".join(field(x) for x in ("doc_id", "source", "lang", n, "text")) + ")"
    # A byte is taken in, then its eight bits one by one.
    steps = "flatten(list_transform(regexp_extract_all(doc_id::VARCHAR, '.'), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    bit = "CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda a, x: {bit}), 4294967295)"

    def tree(name: str, leaves: str) -> str:
        return f"""{name} AS (SELECT tree, 0 AS level, pos, n, d FROM {leaves} UNION ALL
          SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(d || coalesce(other, '')) FROM (
            SELECT *, lead(d) OVER (PARTITION BY tree ORDER BY pos) AS other FROM {name} WHERE n > 1) WHERE pos % 2 = 0)"""

    def walk(name: str, start: str, nodes: str) -> str:
        new = "sha256(CASE WHEN s.d IS NULL THEN w.cur WHEN w.pos % 2 = 0 THEN w.cur || s.d ELSE s.d || w.cur END)"
        return f"""{name} AS (SELECT row, tree, 0 AS level, pos, n, proof, cur FROM {start} UNION ALL
          SELECT w.row, w.tree, w.level + 1, w.pos // 2, (w.n + 1) // 2, w.proof || coalesce(s.d, ''), {new}
          FROM {name} w LEFT JOIN {nodes} s ON s.tree = w.tree AND s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.n > 1)"""

    place = "row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1"
    return f"""WITH RECURSIVE doc AS (SELECT row_number() OVER () AS row, doc_id, coalesce('=' || lang, '') AS tree, {leaf('n_chars')} AS d,
      CASE WHEN {crc} % 7 = 0 THEN {leaf('(n_chars + 1)')} END AS changed FROM documents),
    leaf AS (SELECT *, {place} AS pos, count(*) OVER (PARTITION BY tree) AS n, '' AS proof, coalesce(changed, d) AS cur FROM doc),
    {tree('node', 'leaf')},
    top AS (SELECT '*' AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, d FROM node WHERE n = 1),
    {tree('crown', 'top')},
    {walk('up', 'leaf', 'node')},
    upper AS (SELECT u.row, t.tree, t.pos, t.n, u.proof, u.cur FROM up u JOIN top t ON t.name = u.tree WHERE u.n = 1),
    {walk('high', 'upper', 'crown')}
    SELECT doc_id, l.d AS leaf, t.d AS subroot, r.d AS root, sha256(h.proof) AS proof_sha256, h.cur AS folded_root, h.cur = r.d AS verified
    FROM leaf l JOIN top t ON t.name = l.tree JOIN high h ON h.row = l.row AND h.n = 1, (SELECT d FROM crown WHERE n = 1) r"""


def chat_format() -> str:
    controls = r"'<\\*/?turn'"
    said = "'\\### Assistant: </turn> ok'"
    # Bad order of roles, turn by turn: what a role may follow.
    move = """CASE role WHEN 'system' THEN state = 'start' WHEN 'user' THEN state IN ('start', 'instructed', 'answered')
      WHEN 'assistant' THEN state = 'asked' ELSE false END"""
    to = "CASE role WHEN 'system' THEN 'instructed' WHEN 'user' THEN 'asked' ELSE 'answered' END"
    return f"""WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', {said} UNION ALL SELECT -7, 1, 'assistant', {said}),
    t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn FROM given),
    walk AS (SELECT conv_id, 0::BIGINT AS rn, 'start' AS state, NULL::BIGINT AS bad FROM t GROUP BY conv_id UNION ALL
      SELECT w.conv_id, t.rn, CASE WHEN {move} THEN {to} ELSE state END, coalesce(bad, CASE WHEN NOT ({move}) THEN t.rn - 1 END)
      FROM walk w JOIN t ON t.conv_id = w.conv_id AND t.rn = w.rn + 1),
    ends AS (SELECT conv_id, max_by(state, rn) AS state, max_by(bad, rn) AS bad FROM walk GROUP BY conv_id)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(length('<turn >' || chr(10) || role || text || '</turn>' || chr(10)) + len(regexp_extract_all(text, {controls})))::BIGINT AS formatted_chars,
      any_value(bad) IS NULL AS valid, any_value(bad) AS first_refused, any_value(bad) IS NULL AND any_value(state) = 'answered' AS complete
    FROM t JOIN ends USING (conv_id) GROUP BY conv_id"""


def collocation_phrases(top: int = 2000) -> str:
    words = "list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '')"
    joined = lambda x: f"array_to_string({x}, ' ')"
    return f"""WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {UPPER}), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    said AS (SELECT lang, {words} AS w FROM piece),
    n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM said GROUP BY lang),
    gram AS (SELECT lang, w[i : i + m - 1] AS p FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i
      FROM said, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)),
    f AS (SELECT lang, {joined('p')} AS phrase, p, count(*) AS a FROM gram GROUP BY lang, p),
    candidate AS (SELECT * FROM f WHERE len(p) >= 2 AND a >= 30),
    part AS (SELECT lang, {joined('p[i : i + m - 1]')} AS phrase, max(a) AS longer FROM (
      SELECT lang, p, a, m, unnest(range(1, len(p) - m + 2)) AS i FROM candidate, (SELECT unnest([2, 3]) AS m) WHERE m < len(p)) GROUP BY ALL),
    cut AS (SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a + r.a) AS score
      FROM (SELECT *, unnest(range(1, len(p))) AS k FROM candidate) c
      JOIN f l ON l.lang = c.lang AND l.phrase = {joined('c.p[1 : k]')} JOIN f r ON r.lang = c.lang AND r.phrase = {joined('c.p[k + 1 : 4]')}),
    best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS rn FROM cut),
    kept AS (SELECT b.* FROM best b LEFT JOIN part USING (lang, phrase) WHERE rn = 1 AND NOT (100::HUGEINT * coalesce(longer, 0) >= 80::HUGEINT * b.a)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= {top}"""


ORACLES = {
    "op11_merkle_manifest": merkle_manifest(), "op12_chat_format": chat_format(), "op13_collocations": collocation_phrases(),
    "op4_secret_scan": secret_scan(), "op6_decontamination": decontamination(), "op10_quality_rules": rules(),
}
