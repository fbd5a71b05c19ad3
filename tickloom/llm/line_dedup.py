"""Line deduplication by a segment-partition edit join.

Lines within an edit distance are alike in at least one of threshold + 1 segments
(pigeonhole). Every line's segments go into an index that knows about lengths; each line
probes it with its substrings at the places a few edits can have moved them to; lines that
meet are verified by banded edit distance. Everything is built-in functions and joins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import components
from tickloom.session import cut_lineage

#: Edits that join two lines, and the code points of a line that they are a tenth of; shorter lines are joined only if equal.
THRESHOLD, LEAST_NEAR = 2, 20
#: Lines of lengths in one class are cut alike; a class ends this many times further than it begins.
CLASS_RATIO = 1.25
#: Characters that make no line.
BLANKS = " \t\r\x0b\x0c"
#: Letters counted before lines are compared.
LETTERS = "etaonirsl"


def _doc(df: DataFrame, key: str, text: str) -> DataFrame:
    """id and body (64 bits of the text) stand for a document, so that a repeated id does not mix texts up."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(key).alias("id"), F.xxhash64(whole).alias("body"), whole.alias("whole"))


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, body, at, line) of every line that is not blank; at counts from 0."""
    split = _doc(docs, key, text).select("id", "body", F.posexplode(F.split("whole", "\n", -1)).alias("at", "line"))
    # From the left alone: it stops at the first character that is no blank.
    return split.filter(F.ltrim("line", F.lit(BLANKS)) != "")


def _class(chars: Column, least: int) -> Column:
    return F.floor(F.log(chars / F.lit(float(least))) / F.lit(math.log(CLASS_RATIO)) + 1e-9).cast("int")


def segment_keys(rows: DataFrame, threshold: int, least: int) -> DataFrame:
    """``rows`` (line, chars, ...) with ``k``, structs (key, shift): a row for each key that a line is indexed under
    (shift 0) or probes the index with (any shift).

    A class's lines are cut into ``threshold`` segments from the start and one that ends the
    line, all as long as fits the class's shortest line. The i-th segment from the start can
    be moved by i edits before it; the first and the last are where they are. A line that
    an edit could put into the class below is filed there too, so that any two lines within
    ``threshold`` share a class.
    """

    def size(c: str) -> Column:
        return F.floor(F.lit(float(least)) * F.pow(F.lit(CLASS_RATIO), F.col(c)) / (threshold + 1)).cast("int")

    def of_class(c: Column, size: Column) -> Column:
        line = F.col("line")
        keys = [F.struct(F.xxhash64(c, F.lit(-1), F.right(line, size)).alias("key"), F.lit(0).alias("shift"))]
        for i in range(threshold):
            for shift in range(-i, i + 1):
                piece = line.substr(size * i + shift + 1, size)
                keys.append(F.struct(F.xxhash64(c, F.lit(i), piece).alias("key"), F.lit(shift).alias("shift")))
        return F.array(*keys)

    below = _class(F.greatest(F.col("chars") - threshold, F.lit(least)), least)
    filed = rows.withColumns({"__own": _class(F.col("chars"), least), "__below": below})
    filed = filed.withColumns({"__size": size("__own"), "__small": size("__below")})
    own, lower = of_class(F.col("__own"), F.col("__size")), of_class(F.col("__below"), F.col("__small"))
    keys = F.when(F.col("__own") == F.col("__below"), own).otherwise(F.concat(own, lower))
    return filed.withColumn("k", F.explode(keys)).drop("__own", "__below", "__size", "__small")


def near_pairs(docs: DataFrame, first: DataFrame, threshold: int, least: int, key: str, text: str) -> DataFrame:
    """Links (a, b) between hashes of different lines at most ``threshold`` edits apart.

    Keys that one line alone has leave first. Only the texts of lines that share a key are
    fetched, from where they first occur, and lines of a key are verified while they are
    joined: no candidate that fails becomes a row.
    """
    long = lines(docs, key, text).withColumn("chars", F.length("line")).filter(F.col("chars") >= least)
    every = segment_keys(long.select(F.xxhash64("line").alias("h"), "chars", "line"), threshold, least)
    # Read twice below: lines are cut and hashed once.
    rows = cut_lineage(every.select(F.col("k.key").alias("key"), "h", "chars", F.col("k.shift").alias("shift")).distinct())
    several = rows.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("key")
    shared = cut_lineage(rows.join(several, "key"))
    wanted = shared.select("h").distinct().join(first, "h")
    wanted = wanted.groupBy("first.id", "first.body").agg(F.collect_list(F.struct("h", "first.at")).alias("held"))
    wanted = wanted.select(F.col("id").alias("w_id"), F.col("body").alias("w_body"), "held")
    found = _doc(docs, key, text).join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("body") == F.col("w_body")))
    # Documents that repeat an id and a text give their lines once.
    split = found.select(F.split("whole", "\n", -1).alias("parts"), F.explode("held").alias("held"))
    texts = split.select(F.col("held.h").alias("h"), F.element_at("parts", F.col("held.at") + 1).alias("line")).dropDuplicates(["h"])
    # An edit changes how often letters occur by two at most, which tells most lines apart at once.
    tally = [(F.length("line") - F.length(F.replace("line", F.lit(x), F.lit("")))).alias(f"n{i}") for i, x in enumerate(LETTERS)]
    filed = cut_lineage(shared.join(texts.select("*", *tally), "h"))
    names = [f"n{i}" for i in range(len(LETTERS))]
    other = filed.select("key", *[F.col(c).alias(f"{c}2") for c in ("h", "chars", "shift", "line", *names)])
    apart = sum([F.abs(F.col(n) - F.col(f"{n}2")) for n in names], F.lit(0))
    met = filed.join(
        other,
        (filed["key"] == other["key"]) & (F.col("h") < F.col("h2")) & (F.abs(F.col("chars") - F.col("chars2")) <= threshold)
        & ((F.col("shift") == 0) | (F.col("shift2") == 0)) & (apart <= 2 * threshold)
        & (F.levenshtein("line", "line2", threshold) >= 0),
    )
    return met.select(F.col("h").alias("a"), F.col("h2").alias("b")).distinct()


def repeated_lines(
    docs: DataFrame, threshold: int = THRESHOLD, least_near: int = LEAST_NEAR, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, body, n_lines, drop): per document (a group of rows with one id and text) the lines that go, counted from 0.

    Blank lines stay. Equal lines of any other length, and lines of at least ``least_near`` code
    points that a chain of steps of at most ``threshold`` edits joins, are one class; of each
    class the occurrence with the smallest (id, body, place) stays. Equal lines are told by
    two hashes of 96 bits together. n_lines counts all lines of the document; drop is null
    without any.
    """
    occurring = cut_lineage(
        lines(docs, key, text).select("id", "body", "at", F.xxhash64("line").alias("h"), F.hash("line").alias("g")).distinct()
    )
    place = F.struct("id", "body", "at")
    first = occurring.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    groups = components(near_pairs(docs, first.groupBy("h").agg(F.min("first").alias("first")), threshold, least_near, key, text))
    groups = groups.withColumnRenamed("node", "h")
    # Lines that no edits join are a class by themselves.
    several = first.join(groups, "h", "left").withColumn("class", F.coalesce("component", "h"))
    several = several.withColumn("own", F.when(F.col("component").isNull(), F.col("g")))
    kept = several.filter("component IS NOT NULL OR n > 1")
    heads = kept.groupBy("class", "own").agg(F.min("first").alias("head"))
    heads = heads.select(F.col("class").alias("__class"), F.col("own").alias("__own"), "head")
    same = (F.col("class") == F.col("__class")) & F.col("own").eqNullSafe(F.col("__own"))
    named = kept.select("h", "g", "class", "own").join(heads, same).select("h", "g", "head")
    gone = occurring.join(named, ["h", "g"]).filter(~place.eqNullSafe(F.col("head")))
    return gone.groupBy("id", "body").agg(F.array_sort(F.collect_list("at")).alias("drop"))


def line_report(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per row of ``docs``: key, n_lines, n_removed, removed (line numbers from 0, ascending).

    Null and empty texts have one empty line. Rows that repeat an id and a text lose the same
    lines; the first of them keeps what comes first in all of them. An empty table gives an
    empty result. Other columns are left out.
    """
    gone = repeated_lines(docs, key=key, text=text, **how)
    gone = gone.select(F.col("id").alias("g_id"), F.col("body").alias("g_body"), "drop")
    breaks = F.octet_length("whole") - F.octet_length(F.replace("whole", F.lit("\n"), F.lit("")))
    rows = _doc(docs, key, text).select("id", "body", (breaks + 1).alias("n_lines"))
    rows = rows.join(gone, F.col("id").eqNullSafe(F.col("g_id")) & (F.col("body") == F.col("g_body")), "left")
    removed = F.coalesce("drop", F.array().cast("array<int>"))
    return rows.select(
        F.col("id").alias(key), F.col("n_lines").cast("int").alias("n_lines"), F.size(removed).alias("n_removed"), removed.alias("removed")
    )


def drop_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs``, all columns, with repeated lines taken out of the text.

    Null texts stay null; a text that loses all its lines is empty. Rows that repeat an id and a
    text lose the same lines, other texts of the same id their own. Of occurrences that tie
    (the same line twice in a text) the first place stays. An empty table gives an empty one.
    """
    gone = repeated_lines(docs, key=key, text=text, **how)
    gone = gone.select(F.col("id").alias("__id"), F.col("body").alias("__gone"), F.col("drop").alias("__drop"))
    rows = docs.withColumn("__body", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.join(gone, F.col(key).eqNullSafe(F.col("__id")) & (F.col("__body") == F.col("__gone")), "left")
    # Lines between two dropped ones are sliced out whole: work grows with the lines, not with lines times drops.
    parts, size = F.split(text, "\n", -1), F.size("__drop")
    ends = F.concat(F.col("__drop"), F.array(F.size("__parts")))
    starts = F.concat(F.array(F.lit(0)), F.transform("__drop", lambda d: d + 1))
    cut = F.zip_with(starts, ends, lambda a, b: F.slice(F.col("__parts"), a + 1, b - a))
    rows = rows.withColumn("__parts", parts)
    left = F.array_join(F.flatten(F.filter(cut, lambda x: F.size(x) > 0)), "\n")
    return rows.withColumn(text, F.when(size > 0, left).otherwise(F.col(text))).select(*docs.columns)
