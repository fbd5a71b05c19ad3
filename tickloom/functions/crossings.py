"""Where a series first meets a condition, for many starting points at once.

A series is cut into blocks of ``FAN`` values with their low and high, blocks into blocks of
blocks, and so on. A search looks through the rest of its own block, then through the rest of
the block's block, upwards until some block may hold the answer, and then down again into
that one. Every step is an equi-join with one block, a row of at most ``FAN`` values, so that work
grows with the logarithm of a series' length, and no series is held by a row or a task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import cut_lineage

FAN = 64


def tree(series: DataFrame, key: str, fan: int | None = None) -> list[DataFrame]:
    """Levels of ``series`` (key, idx, x), lowest first: key, block, idx, lo, hi.

    idx numbers the values of a key in order, without gaps, from any number of 0 or more. In
    the highest level all are in one block.
    """
    fan = fan or FAN
    level = series.select(key, F.floor(F.col("idx") / fan).cast("long").alias("block"), F.col("idx").cast("long").alias("idx"), F.col("x").alias("lo"), F.col("x").alias("hi"))
    out = [cut_lineage(level)]
    while True:
        spread = out[-1].agg(F.min("block"), F.max("block")).first()
        if spread[0] == spread[1]:
            return out
        above = out[-1].groupBy(key, F.col("block").alias("idx")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        out.append(cut_lineage(above.select(key, F.floor(F.col("idx") / fan).cast("long").alias("block"), "idx", "lo", "hi")))


def first_where(
    searches: DataFrame, levels: Sequence[DataFrame], key: str, ids: Sequence[str], meets: Callable[[Column, Column], Column],
    fan: int | None = None,
) -> DataFrame:
    """``ids`` and ``found``, the smallest idx at or after ``start`` that meets the condition; searches without one leave."""
    return first_of_each(searches, levels, key, {"found": meets}, ["found"], fan).filter("found IS NOT NULL").select(*ids, "found")


def first_of_each(
    searches: DataFrame, levels: Sequence[DataFrame], key: str, meets: Mapping[str, Callable[[Column, Column], Column]],
    final: Sequence[str], fan: int | None = None,
) -> DataFrame:
    """``searches`` and, for each condition, the smallest idx at or after ``start`` that meets it; null for none.

    ``searches`` has key, start and what the conditions read. A condition ``(lo, hi)`` says of a
    block by its low and high whether a value in it meets the condition; for a single value
    both are the value itself. A search ends with the block in which one of the ``final``
    conditions is met first; others that are not met up to that block's end stay null.
    """
    fan = fan or FAN
    columns, names = [c for c in searches.columns if c != "start"], list(meets)
    at = F.col("start").cast("long")
    state = searches.withColumns({"start": at, **{n: F.lit(None).cast("long") for n in names}})
    met = F.coalesce(*final).isNotNull()
    done: list[DataFrame] = []
    for height, level in enumerate(levels):
        looked = _look(state, level, key, F.floor(F.col("start") / fan).cast("long"), {f"__{n}": test for n, test in meets.items()}, F.col("start"))
        if height:
            looked = cut_lineage(looked)
        for lower in reversed(levels[:height]):
            for n, test in meets.items():
                # What was found before needs no block.
                looked = _look(looked, lower, key, F.when(F.col(n).isNull(), F.col(f"__{n}")), {f"__{n}": test})
        looked = looked.withColumns({n: F.coalesce(n, f"__{n}") for n in names}).drop(*[f"__{n}" for n in names])
        looked = cut_lineage(looked)
        done.append(looked.filter(met))
        # The next level goes on with the block after this one.
        state = looked.filter(~met).withColumn("start", F.floor(F.col("start") / fan).cast("long") + 1)
    out = state
    for more in done:
        out = out.unionByName(more)
    return out.select(*columns, *names)


def _look(
    state: DataFrame, level: DataFrame, key: str, block: Column, meets: Mapping[str, Callable[[Column, Column], Column]], start: Column | None = None,
) -> DataFrame:
    """``state`` with the smallest idx of its block, from ``start`` on, that meets each condition."""
    rows = F.collect_list(F.struct("idx", "lo", "hi")).alias("__rows")
    blocks = level.groupBy(F.col(key).alias("__key"), F.col("block").alias("__block")).agg(rows)
    joined = state.withColumn("__at", block).join(blocks, (F.col(key) == F.col("__key")) & (F.col("__at") == F.col("__block")), "left")

    def least(test):
        met = F.filter("__rows", lambda x: test(x["lo"], x["hi"]) if start is None else (x["idx"] >= start) & test(x["lo"], x["hi"]))
        return F.array_min(F.transform(met, lambda x: x["idx"]))

    return joined.withColumns({n: least(test) for n, test in meets.items()}).drop("__key", "__block", "__rows", "__at")
