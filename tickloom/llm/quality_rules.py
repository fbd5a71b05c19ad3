"""Quality rules whose limits are learnt per language and source.

Each document is measured; every measure is kept as a mergeable quantile sketch per language
and source (counts of geometric buckets, which add up exactly); limits are outlier fences on
the sketch's quartiles; documents are joined with the limits of their group and filtered.

A share counts as far as the document's length bears it out: three equal lines of ten say
little, three hundred of a thousand much. So a share is measured by the lower end of its
confidence interval. Then clean documents of a few lines have shares near 0 like others, and
where most have none, any share that is borne out is far out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.shared import SPACES, in_batches
from tickloom.session import cut_lineage

SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")

#: Share -> (numerator, denominator, how many of them make one event). A repeat of a window of three words marks six words.
SHARES = {
    "symbol_share": ("n_symbols", "word_chars", 1),
    "capital_share": ("n_capitals", "word_chars", 1),
    "dup_line_share": ("n_dup_lines", "n_lines", 1),
    "repeat_share": ("n_repeat_words", "n_words", 6),
}
MEASURES = (*SHARES, "word_length")
#: Standard errors between a share and the lower end of its interval.
CONFIDENCE = 3.0
#: What quartiles are off by through buckets and rounding: of a share, and of a word's mean length in code points.
ROUNDING, LENGTH_ROUNDING = 0.05, 0.1
#: Documents that a group's quartiles have to outweigh those of its language, and a language's those of all; quartiles of few widen the fence.
WEIGHT, FEW = 50, 8
GAMMA = 1.02
LEAST_VALUE = 1e-6


def count_text(text: str | None) -> tuple[int, ...]:
    """The counts of one whole text, in the order of COUNTS; null has none."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode()
    words = raw.split()
    n = len(words)
    spaces = len(raw) - len(raw.translate(None, SPACES))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    repeated = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        k = len(ids)
        pair = at[:-1] * k + at[1:]
        if k >= 1 << 20:
            pair = np.unique(pair, return_inverse=True)[1]
        window = pair[:-1] * k + at[2:]
        _, back, times = np.unique(window, return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[back] > 1)
        marked = np.zeros(n, bool)
        for shift in range(3):
            marked[again + shift] = True
        repeated = int(marked.sum())
    return (
        n, len(text) - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated,
        len(lines), len(raw) - len(raw.translate(None, CAPITALS)),
    )


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """key, lang, source and the counts of every document's whole text."""
    rows = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["key"]

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [count_text(x) for x in batch.column("text").to_pylist()]
        columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(len(COUNTS))]
        return pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("key", "lang", "source")] + columns, ["key", "lang", "source", *COUNTS]
        )

    return in_batches(rows, counted, f"key {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed(words: Column, repeats: Column) -> Column:
    return (words < 50) | (100 * repeats > 50 * words)


def lower_end(count: Column, total: Column) -> Column:
    """The lower end of Wilson's interval of a share, 0 without a total."""
    z2 = CONFIDENCE * CONFIDENCE
    share = count / total
    spread = F.lit(CONFIDENCE) * F.sqrt(F.greatest(share * (1 - share), F.lit(0.0)) / total + z2 / 4 / (total * total))
    low = (share + z2 / 2 / total - spread) / (1 + z2 / total)
    return F.when((count > 0) & (total > 0), F.greatest(low, F.lit(0.0))).otherwise(0.0)


def shares() -> list[Column]:
    out = [
        lower_end(F.col(above).cast("double") / unit, F.col(below).cast("double") / unit).alias(name)
        for name, (above, below, unit) in SHARES.items()
    ]
    length = F.when(F.col("n_words") > 0, F.col("word_chars") / F.col("n_words")).otherwise(0.0)
    return [*out, length.alias("word_length")]


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): bucket b counts values in (GAMMA**(b-1), GAMMA**b], the lowest all below LEAST_VALUE.

    Sketches merge by adding n. A task's rows are added up before the shuffle, so that a
    group with most documents sends as many rows as any other.
    """
    floor = math.floor(math.log(LEAST_VALUE) / math.log(GAMMA))
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES]))
    rows = measured.select("lang", "source", *shares()).select("lang", "source", pairs.alias("p"))
    bucket = F.when(F.col("p.value") <= LEAST_VALUE, floor).otherwise(F.ceil(F.log("p.value") / math.log(GAMMA)))
    return rows.groupBy("lang", "source", F.col("p.measure").alias("measure"), bucket.cast("int").alias("bucket")).agg(
        F.count("*").alias("n")
    )


def quartiles(sketched: DataFrame, by: list[str]) -> DataFrame:
    """Per group of ``by`` and measure: total, q1 and q3 of the sketch."""
    floor = math.floor(math.log(LEAST_VALUE) / math.log(GAMMA))
    cells = sketched.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    of = Window.partitionBy(*by, "measure")
    upto = of.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(of))
    value = F.when(F.col("bucket") <= floor, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket") - 0.5))
    return ranked.groupBy(*by, "measure").agg(
        F.max("total").alias("total"),
        F.min(F.when(F.col("upto") >= 0.25 * F.col("total"), value)).alias("q1"),
        F.min(F.when(F.col("upto") >= 0.75 * F.col("total"), value)).alias("q3"),
    )


def fences(sketched: DataFrame, spread: float) -> DataFrame:
    """Per language and source: the high fence of every measure and the low one of word_length, as columns.

    A group's quartiles are blended with its language's, and a language's shares with those of
    all documents, by the number of documents: there is no size at which the rule changes. Words
    of other languages say nothing about a word's length. A fence lies ``spread`` quartile
    distances beyond the quartile.
    """
    levels = [["lang", "source"], ["lang"], []]
    groups = sketched.groupBy("lang", "source", "measure").agg(F.lit(1).alias("__one")).drop("__one")
    for i, by in enumerate(levels):
        table = quartiles(sketched, by).withColumnsRenamed({c: f"{c}_{i}" for c in [*by, "measure", "total", "q1", "q3"]})
        on = F.col("measure") == F.col(f"measure_{i}")
        for c in by:
            on = on & F.col(c).eqNullSafe(F.col(f"{c}_{i}"))
        groups = groups.join(table, on)
    own_language = F.col("measure") == "word_length"

    def blended(q: str) -> Column:
        n0, n1 = F.col("total_0"), F.col("total_1")
        of_language = F.when(own_language, F.col(f"{q}_1")).otherwise((n1 * F.col(f"{q}_1") + WEIGHT * F.col(f"{q}_2")) / (n1 + WEIGHT))
        return (n0 * F.col(f"{q}_0") + WEIGHT * of_language) / (n0 + WEIGHT)

    rounding = F.when(own_language, LENGTH_ROUNDING).otherwise(ROUNDING)
    reach = F.lit(float(spread)) * (1 + F.lit(float(FEW)) / F.col("total_1")) * (F.col("q3") - F.col("q1")) + rounding
    ends = groups.select("lang", "source", "measure", "total_1", blended("q1").alias("q1"), blended("q3").alias("q3"))
    ends = ends.select("lang", "source", "measure", (F.col("q3") + reach).alias("high"), (F.col("q1") - reach).alias("low"))
    out = [F.max(F.when(F.col("measure") == m, F.col("high"))).alias(f"{m}_high") for m in MEASURES]
    low = F.max(F.when(F.col("measure") == "word_length", F.col("low"))).alias("word_length_low")
    return ends.groupBy("lang", "source").agg(*out, low)


def judge(measured: DataFrame, spread: float = 3.0) -> DataFrame:
    """``measured`` plus base_failed, rule (the first limit broken, else null) and kept.

    Null language or source is a group of its own.
    """
    groups = fences(sketch(measured), spread).withColumnsRenamed({"lang": "lang_g", "source": "source_g"})
    rows = measured.select("*", *shares())
    rows = rows.join(
        groups, F.col("lang").eqNullSafe(F.col("lang_g")) & F.col("source").eqNullSafe(F.col("source_g")), "left"
    )
    broken = [F.when(F.col(m) > F.col(f"{m}_high"), F.lit(m)) for m in MEASURES]
    broken.append(F.when(F.col("word_length") < F.col("word_length_low"), F.lit("word_length")))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    rule = F.coalesce(*broken)
    return rows.select(
        *measured.columns, failed.alias("base_failed"), rule.alias("rule"), (~failed & rule.isNull()).alias("kept")
    )


def quality_rules(docs: DataFrame, spread: float = 3.0) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, rule and the group's language and source.

    A null or empty text has no words and fails the base. Repeated rows are measured each by
    itself. Other columns of ``docs`` are left out. An empty table gives an empty result.
    """
    # Texts are read once: their counts are stored, and sketches and filter read those.
    judged = judge(cut_lineage(measure(docs)), spread)
    return judged.withColumnRenamed("key", "doc_id")
