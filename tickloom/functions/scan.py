"""Running aggregates over groups that may be too large for one task.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Trades, quotes
and alerts of one hot key can be a third of the table, so scans over them work on
*slices*: the caller names nested columns (coarse to fine) that follow the row order
within a key, every slice is scanned on its own, and only one total per slice is
scanned at the next coarser level. ``sliced`` cuts only the keys that have more rows than a
task should take; all others are one slice.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tickloom.session import cut_lineage

#: Rows of a key that one task takes whole.
ROOM = 1 << 18


def _upto(keys, order):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _before(keys, order):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def sliced(
    df: DataFrame, keys: Sequence[str], levels: Sequence[str], order: Sequence[str], room: int | None = None
) -> tuple[DataFrame, list[str], list[str]]:
    """``df`` with levels that cut keys of more than ``room`` rows only, the names of these levels, and the order in a slice.

    Rows are counted per key before the shuffle. The large keys, at most one in ``room``
    rows, are stored, so that Spark knows how many they are before it plans the join.
    """
    if not levels:
        return df, [], list(order)
    large = _large(df, keys, room)
    kinds, cuts = dict(df.dtypes), [f"__cut_{c}" for c in levels]
    whole = {c: F.lit("1970-01-01" if kinds[c].startswith(("date", "timestamp")) else "0").cast(kinds[c]) for c in levels}
    own = {cut: F.when(F.col("__large"), F.col(c)).otherwise(whole[c]) for cut, c in zip(cuts, levels)}
    # Dealt by slice and not by key, whichever join was chosen.
    out = df.join(large, list(keys), "left").withColumns(own).drop("__large").repartition(*keys, *cuts)
    return out, cuts, [*levels, *order]


def _large(df: DataFrame, keys: Sequence[str], room: int | None) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    return cut_lineage(counts.filter(F.col("__n") > (room or ROOM)).select(*keys, F.lit(True).alias("__large")))


def parted(
    df: DataFrame, keys: Sequence[str], levels: Sequence[str], order: Sequence[str], room: int | None = None
) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """``df`` in two: keys that one task takes whole, dealt by key, and those to be cut, dealt by slice.

    Also the names of the levels that cut, and the order in a key. Without levels all keys are whole.
    """
    if not levels:
        return df, df.limit(0), [], list(order)
    large = _large(df, keys, room)
    whole = df.join(large, list(keys), "left_anti")
    cut = df.join(large.drop("__large"), list(keys), "left_semi").repartition(*keys, *levels)
    return whole, cut, list(levels), [*levels, *order]


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    levels: Sequence[str],
    order: Sequence[str],
    sums: Sequence[str],
    low_of: str | None = None,
) -> DataFrame:
    """Add ``run_<c>`` for every column in ``sums``; with ``low_of`` also ``low``, the
    lowest running sum of that column so far, and ``low_before``, the same one row earlier.

    ``order`` must sort rows within the finest slice and each level must be
    monotone in the overall row order of a key.
    """
    if low_of is not None:
        df = df.withColumn("__dip", F.col(low_of))
    out = _scan(df, list(keys), list(levels), list(order), list(sums), low_of)
    return out.withColumnRenamed("__low_before", "low_before").drop(
        "__dip", "__at", *[f"before_{c}" for c in sums]
    )


def running_max(
    df: DataFrame, keys: Sequence[str], levels: Sequence[str], order: Sequence[str], col: str, out: str
) -> DataFrame:
    """Add the highest value of ``col`` so far, slice by slice."""
    return _highest(df, list(keys), list(levels), list(order), col, out).drop("__max_before")


def _highest(df, keys, levels, order, col, out):
    group = keys + levels
    own = df.withColumns(
        {out: F.max(col).over(_upto(group, order)), "__max_before": F.max(col).over(_before(group, order))}
    )
    if not levels:
        return own
    tops = df.groupBy(*group).agg(F.max(col).alias(col))
    upper = _highest(tops, keys, levels[:-1], [levels[-1]], col, "__top")
    own = own.join(upper.select(*group, F.col("__max_before").alias("__carry")), group)
    return own.withColumns(
        {out: F.greatest(out, "__carry"), "__max_before": F.greatest("__max_before", "__carry")}
    ).drop("__carry")


def _scan(df, keys, levels, order, sums, low_of):
    group = keys + levels
    upto, before = _upto(group, order), _before(group, order)
    out = df
    for c in sums:
        out = out.withColumn(f"before_{c}", F.coalesce(F.sum(c).over(before), F.lit(0).cast(df.schema[c].dataType)))
    for c in sums:
        out = out.withColumn(f"run_{c}", F.col(f"before_{c}") + F.coalesce(F.col(c), F.lit(0)))
    if low_of:
        out = out.withColumn("__at", F.col(f"before_{low_of}") + F.col("__dip"))
        out = out.withColumn("low", F.min("__at").over(upto)).withColumn(
            "__low_before", F.min("__at").over(before)
        )
    if not levels:
        return out

    totals = [F.sum(c).alias(c) for c in sums]
    if low_of:
        totals.append(F.min("__at").alias("__dip"))
    per_slice = (out if low_of else df).groupBy(*group).agg(*totals)
    upper = _scan(per_slice, keys, levels[:-1], [levels[-1]], sums, low_of)
    carried = [F.col(f"before_{c}").alias(f"__c_{c}") for c in sums]
    if low_of:
        carried.append(F.col("__low_before").alias("__c_low"))
    out = out.join(upper.select(*group, *carried), group)
    if low_of:
        carry = F.col(f"__c_{low_of}")
        out = (
            out.withColumn("low", F.least("__c_low", F.col("low") + carry))
            .withColumn("__low_before", F.least("__c_low", F.col("__low_before") + carry))
            .withColumn("__at", F.col("__at") + carry)
        )
    for c in sums:
        out = out.withColumn(f"before_{c}", F.col(f"before_{c}") + F.col(f"__c_{c}"))
        out = out.withColumn(f"run_{c}", F.col(f"run_{c}") + F.col(f"__c_{c}"))
    return out.drop(*[f"__c_{c}" for c in sums], "__c_low")


def ordered_fold(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    adds: StructType,
    start: Callable[[tuple], object],
    step: Callable[[object, tuple], tuple[object, tuple]],
    reads: Sequence[str],
) -> DataFrame:
    """Left fold over the rows of each group, in order, adding columns.

    Rows stream through the task in Arrow batches; only the fold state is kept, so a
    group is never held in memory. Groups must still be slices of bounded size, since
    one group is one task's work. ``start`` and ``step`` see the ``reads`` columns.
    """
    names = [f.name for f in adds.fields]
    schema = StructType(list(df.schema.fields) + list(adds.fields))
    group, reads = list(group), list(reads)

    def run(batches):
        key, state = None, None
        for pdf in batches:
            out: list[tuple] = []
            keys = list(zip(*(pdf[c].tolist() for c in group)))
            rows = list(zip(*(pdf[c].tolist() for c in reads)))
            for k, row in zip(keys, rows):
                if k != key:
                    key, state = k, start(row)
                state, added = step(state, row)
                out.append(added)
            for i, name in enumerate(names):
                pdf[name] = pd.Series([o[i] for o in out], index=pdf.index, dtype=object)
            yield pdf

    return (
        df.repartition(*group)
        .sortWithinPartitions(*group, *order)
        .mapInPandas(run, schema)
    )


def spaced_picks(
    df: DataFrame, key: str, ts: str, tie: str, window_us: int, slice_us: int, out: str = "sent"
) -> DataFrame:
    """Mark, per key and in time order, every row at least ``window_us`` after the last marked one.

    ``ts`` holds microseconds; of rows at the same instant the lowest ``tie`` counts.
    The rule is a chain, so a hot key cannot simply be split. Each slice of
    ``slice_us`` is reduced to a step function "earliest time a pick is allowed ->
    last pick in this slice"; chains merge after a few picks, so few steps remain.
    One fold per key over the steps gives the time from which each slice may pick,
    and rows are then marked slice by slice.
    """
    rows = df.withColumn("__slice", F.floor(F.col(ts) / F.lit(slice_us)))
    instants = rows.groupBy(key, "__slice", ts).agg(F.min(tie).alias("__first"))

    # Walking back in time, the last pick reached from an instant is the one reached
    # from the first instant a window later. Only instants up to that one are kept.
    def last_pick(ahead, row):
        t = row[0]
        free = t + window_us
        while len(ahead) > 1 and ahead[1][0] >= free:
            ahead.popleft()
        last = ahead[0][1] if ahead and ahead[0][0] >= free else t
        ahead.append((t, last))
        return ahead, (last,)

    reach = ordered_fold(
        instants.withColumn("__back", -F.col(ts)),
        [key, "__slice"], ["__back"],
        StructType([StructField("__last", LongType())]),
        lambda row: deque(), last_pick, reads=[ts],
    )
    # Earlier picks lie before the slice, so they lead either into its first window or
    # to the first instant after that. Neighbours with one outcome make one step.
    w = Window.partitionBy(key, "__slice").orderBy(ts)
    steps = (
        reach.withColumn("__in", F.col(ts) < F.col("__slice") * F.lit(slice_us) + F.lit(window_us))
        .withColumn("__prev", F.coalesce(F.lag("__in").over(w), F.lit(True)))
        .filter("__in OR __prev")
        .withColumn("__next", F.lead("__last").over(w))
        .filter("__next IS NULL OR __next <> __last")
        .select(key, "__slice", F.col(ts).alias("__until"), "__last")
    )

    never = -(2**62)

    def chain(state, row):
        current, entry, free, done = state
        part, until, last = row
        if part != current:
            current, entry, done = part, free, False
        if not done and until >= entry:
            free, done = last + window_us, True
        return (current, entry, free, done), (entry,)

    entries = ordered_fold(
        steps, [key], ["__slice", "__until"],
        StructType([StructField("__entry", LongType())]),
        lambda row: (None, never, never, False), chain, reads=["__slice", "__until", "__last"],
    ).groupBy(key, "__slice").agg(F.min("__entry").alias("__entry"))

    def mark(free, row):
        t = row[0]
        return (t + window_us, (True,)) if t >= free else (free, (False,))

    picked = ordered_fold(
        instants.join(entries, [key, "__slice"]),
        [key, "__slice"], [ts],
        StructType([StructField("__picked", BooleanType())]),
        lambda row: row[1], mark, reads=[ts, "__entry"],
    )
    return (
        rows.join(picked.select(key, "__slice", ts, "__first", "__picked"), [key, "__slice", ts])
        .withColumn(out, F.col("__picked") & (F.col(tie) == F.col("__first")))
        .drop("__slice", "__first", "__picked")
    )
