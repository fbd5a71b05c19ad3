"""Secret scans over a trigram inverted index.

A Boolean query over trigrams is derived from each rule's regular expression. Postings of the
trigrams that any rule asks for are intersected, and only documents that may match a rule are
held against it. Rules without mandatory trigrams are held against every document.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import text_key

#: Literal alternatives followed at once while a query is derived.
MOST_STRINGS = 32


@dataclass(frozen=True)
class Rule:
    """``pattern`` has one meaning in Java and Python; its group ``group`` must have ``least`` code points."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base rules in their order, then well-known public token formats.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)
RULES = BASE + ADDED

#: All clauses hold; a clause holds if one of its alternatives has all its trigrams.
Query = tuple[tuple[frozenset[str], ...], ...]


def trigram_query(pattern: str) -> Query:
    """What the lower-cased text must hold for ``pattern`` to match; empty if nothing can be said."""
    clauses: list[tuple[frozenset[str], ...]] = []

    def flush(strings: set[str]) -> None:
        if min(map(len, strings)) >= 3:
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
            # An alternative that asks for more than another one adds nothing.
            clauses.append(tuple(sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)))

    def strings_of(items: Sequence) -> set[str] | None:
        """All strings that ``items`` match, or None if there are too many."""
        out = {""}
        for kind, arg in items:
            more = literal(str(kind), arg)
            if more is None or len(out) * len(more) > MOST_STRINGS:
                return None
            out = {a + b for a in out for b in more}
        return out

    def literal(kind: str, arg) -> set[str] | None:
        if kind == "LITERAL":
            return {chr(arg).lower()}
        if kind == "IN" and all(str(k) == "LITERAL" for k, _ in arg) and len(arg) <= MOST_STRINGS:
            return {chr(c).lower() for _, c in arg}
        if kind == "SUBPATTERN":
            return strings_of(arg[-1])
        if kind == "BRANCH":
            each = [strings_of(x) for x in arg[1]]
            return None if None in each or sum(map(len, each)) > MOST_STRINGS else set().union(*each)
        if kind == "MAX_REPEAT" and arg[0] == arg[1] == 1:
            return strings_of(arg[2])
        if kind == "MAX_REPEAT" and arg[:2] == (0, 1) and (once := strings_of(arg[2])) is not None:
            return {""} | once
        return None

    def walk(items: Sequence) -> None:
        run = {""}
        for kind, arg in items:
            more = literal(str(kind), arg)
            if more is not None and len(run) * len(more) <= MOST_STRINGS:
                run = {a + b for a in run for b in more}
                continue
            flush(run)
            run = {""}
            if str(kind) == "SUBPATTERN":
                walk(arg[-1])
            elif str(kind) in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
                walk(arg[2])
        flush(run)

    walk(re._parser.parse(pattern))
    return tuple(dict.fromkeys(clauses))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def index(docs: DataFrame, trigrams: Sequence[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (trigram, doc, body): which documents hold which of ``trigrams`` in their lower-cased text.

    doc is the key, body the text's 128 bits. Rows that repeat both have one posting.
    """
    wanted = F.array(*[F.lit(t) for t in trigrams])
    held = let(F.lower(F.coalesce(F.col(text), F.lit(""))), lambda low: F.filter(wanted, lambda t: F.contains(low, t)))
    rows = docs.select(F.col(key).alias("doc"), text_key(F.col(text)).alias("body"), held.alias("held"))
    return rows.select(F.explode("held").alias("trigram"), "doc", "body").distinct()


def candidates(postings: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """(doc, body, rules): the rules whose queries a document's postings satisfy."""
    terms = [
        (rule, c, a, t, len(alternative), len(query))
        for rule, query in queries.items()
        for c, clause in enumerate(query)
        for a, alternative in enumerate(clause)
        for t in sorted(alternative)
    ]
    spark = postings.sparkSession
    table = spark.createDataFrame(terms, "rule int, clause int, alternative int, trigram string, needed int, clauses int")
    met = postings.join(table, "trigram").groupBy("doc", "body", "rule", "clause", "alternative", "needed", "clauses").count()
    met = met.filter("count = needed").groupBy("doc", "body", "rule", "clauses").agg(F.countDistinct("clause").alias("n"))
    return met.filter("n = clauses").groupBy("doc", "body").agg(F.collect_set("rule").alias("rules"))


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """Leftmost non-overlapping matches of ``rule`` as structs (start, kind, end) in code points, end exclusive."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def place(found: Column) -> Column:
        gaps = F.split(text, rule.pattern, -1)
        kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
        both = F.arrays_zip(found.alias("whole"), F.slice(gaps, 1, F.size(found)).alias("gap"), kept.alias("kept"))
        zero = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["gap"])
            end = start + F.length(x["whole"])
            span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"))
            hit = F.length(x["kept"]) >= rule.least
            return F.struct(end.alias("at"), F.when(hit, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(both, zero, step, lambda acc: acc["spans"])

    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    return let(whole, lambda found: F.when(F.size(found) == 0, empty).otherwise(place(found)))


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ``spans`` of every row: array of (start, kind, end), kind an index into ``rules``, by start and kind.

    Null and empty texts have no spans. Rows that repeat a key, a text or both get a row
    each. Other columns of ``docs`` are left out. An empty table gives an empty result.
    """
    queries = {i: trigram_query(r.pattern) for i, r in enumerate(rules)}
    mandatory = {i: q for i, q in queries.items() if q}
    whole = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("whole"))
    if mandatory:
        trigrams = sorted({t for q in mandatory.values() for clause in q for a in clause for t in a})
        found = candidates(index(docs, trigrams, key, text), mandatory)
        found = found.select(F.col("doc").alias("found_doc"), "body", "rules")
        same = F.col("doc").eqNullSafe(F.col("found_doc")) & (F.col("own") == F.col("body"))
        whole = whole.withColumn("own", text_key(F.col("whole"))).join(found, same, "left")
    each = []
    for i, rule in enumerate(rules):
        spans = spans_of(F.col("whole"), rule, i)
        none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
        each.append(F.when(F.array_contains("rules", i), spans).otherwise(none) if i in mandatory else spans)
    return whole.select(F.col("doc").alias(key), F.array_sort(F.concat(*each)).alias("spans"))


def spans_text(spans: Column, rules: Sequence[Rule]) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    each = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    return F.array_join(each, ",")
