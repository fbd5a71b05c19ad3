"""Calendars, as-of panels and the joins that keep decisions free of look-ahead.

A bar is valid from its own date until the next bar of its code. As-of panels spell
that interval out over the calendar instead of joining on an inequality, so work and
output are linear in the result and no code's rows are paired with each other.

No join here carries a broadcast hint: the calendar, sector and market sides are
small in practice, and Spark broadcasts them when their measured size allows and
shuffles (with skew splitting) when it does not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.num import as_col
from tickloom.operators.factors import daily_return, forward_fill, history


def calendar(bars: DataFrame) -> DataFrame:
    """Distinct dates with their position and the last position.

    One row per trading day: the single-partition window sees a few thousand rows.
    """
    days = bars.select("date").distinct()
    return days.select(
        "date",
        (F.row_number().over(Window.orderBy("date")) - 1).alias("idx"),
        (F.count(F.lit(1)).over(Window.partitionBy()) - 1).cast("int").alias("last_idx"),
    )


def latest_row(df: DataFrame, cols: Sequence[str], key: str = "code", order: str = "date") -> DataFrame:
    """The given columns of each key's latest row."""
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("__r")).select(
        key, *[F.col(f"__r.{c}").alias(c) for c in cols]
    )


def latest_factor(
    df: DataFrame, factor: str, until: Column | None = None, first_n: int | None = None
) -> DataFrame:
    """Each code's latest known factor value: at or before a date, or among its first n known ones."""
    known = df.filter(F.col(factor).isNotNull())
    if first_n is not None:
        known = known.withColumn("__n", F.row_number().over(history())).filter(F.col("__n") <= first_n)
    elif until is not None:
        known = known.filter(F.col("date") <= until)
    return known.groupBy("code").agg(F.max_by(factor, "date").alias(factor))


def asof_join(probes: DataFrame, facts: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add to each probe the latest known value of each column at or before its date.

    Probes may be many per (code, date): they are first reduced to distinct
    (code, date), which the calendar bounds, filled there, and joined back.
    """
    points = probes.select("code", "date").distinct().withColumn("__probe", F.lit(1))
    points = points.select(
        "code", "date", *[F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in cols], "__probe"
    )
    known = facts.select("code", "date", *cols, F.lit(0).alias("__probe"))
    w = Window.partitionBy("code").orderBy("date", "__probe").rowsBetween(Window.unboundedPreceding, 0)
    filled = (
        known.unionByName(points)
        .withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
        .filter("__probe = 1")
        .drop("__probe")
    )
    return probes.join(filled, ["code", "date"], "left")


def align(bars: DataFrame, cal: DataFrame) -> DataFrame:
    """One row per code and calendar day: days without a bar carry NULLs and volume 0."""
    values = [c for c in bars.columns if c not in ("code", "date")]
    spaced = bars.join(cal, "date").withColumn("__next", F.lead("idx").over(Window.partitionBy("code").orderBy("idx")))
    first = F.row_number().over(Window.partitionBy("code").orderBy("idx")) == 1
    spaced = spaced.withColumn("__from", F.when(first, F.lit(0)).otherwise(F.col("idx")))
    until = F.coalesce(F.col("__next") - 1, F.col("last_idx"))
    grid = spaced.withColumn("__at", F.explode(F.sequence("__from", until)))
    real = F.col("__at") == F.col("idx")
    kept = {c: F.when(real, F.col(c)) for c in values}
    if "volume" in kept:
        kept["volume"] = F.when(real, F.coalesce(F.col("volume"), F.lit(0))).otherwise(0)
    days = cal.select("date", F.col("idx").alias("__at"))
    return (
        grid.select("code", "__at", *[kept[c].alias(c) for c in values])
        .join(days, "__at")
        .select("code", "date", F.col("__at").alias("idx"), *values)
    )


def strictly_before(bars: DataFrame, cal: DataFrame) -> DataFrame:
    """Decision panel: per code and calendar day the latest row *before* that day.

    Adds ``bar_date`` (the row's own date) and ``in_universe`` (the code trades on the
    decision day). A stopped code keeps its last row, unlike :func:`exactly_before`.
    """
    spaced = bars.join(cal, "date").withColumn(
        "__next", F.lead("idx").over(Window.partitionBy("code").orderBy("idx"))
    )
    until = F.coalesce(F.col("__next"), F.col("last_idx"))
    spread = (
        spaced.filter(F.col("idx") < until)
        .withColumn("__at", F.explode(F.sequence(F.col("idx") + 1, until)))
        .withColumn("in_universe", F.coalesce(F.col("__at") == F.col("__next"), F.lit(False)))
        .withColumnRenamed("date", "bar_date")
        .drop("__next", "idx", "last_idx")
    )
    days = cal.select("date", F.col("idx").alias("__at"))
    return spread.join(days, "__at").drop("__at")


def exactly_before(bars: DataFrame, cal: DataFrame) -> DataFrame:
    """Per decision day the rows of the calendar day before it; codes that did not trade are absent."""
    at = bars.join(cal, "date").withColumn("__at", F.col("idx") + 1).drop("idx", "last_idx")
    days = cal.select(F.col("date").alias("__d"), F.col("idx").alias("__at"))
    return at.withColumnRenamed("date", "bar_date").join(days, "__at").withColumnRenamed("__d", "date").drop("__at")


def next_bar_price(signals: DataFrame, bars: DataFrame, cal: DataFrame) -> DataFrame:
    """Execute each signal at the open (else close) of the next calendar day.

    A code without a price that day drops its signal; nothing is carried further.
    """
    nxt = cal.select(F.col("date").alias("exec_date"), (F.col("idx") - 1).alias("idx"))
    days = cal.select("date", "idx").join(nxt, "idx").drop("idx")
    fills = bars.select(
        "code", F.col("date").alias("exec_date"), F.coalesce("open", "close").alias("exec_price")
    ).filter("exec_price > 0")
    return signals.join(days, "date").join(fills, ["code", "exec_date"])


def with_market_return(bars: DataFrame, market: DataFrame) -> DataFrame:
    """Own and market returns on the dates both are known."""
    m = daily_return(market.withColumn("__all", F.lit(0)), key="__all").select("date", F.col("ret").alias("mkt_ret"))
    own = daily_return(bars).select("code", "date", "ret")
    return own.filter("ret IS NOT NULL").join(m.filter("mkt_ret IS NOT NULL"), "date")


def attach(panel: DataFrame, facts: DataFrame, cols: Sequence[str], on: str = "code") -> DataFrame:
    """Left join with unknown values as 0."""
    return panel.join(facts.select(on, *cols), on, "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0.0)) for c in cols}
    )


def price_or_close(quote: str | Column, close: str | Column) -> Column:
    q = as_col(quote)
    return F.coalesce(F.when(q > 0, q), as_col(close))


def with_positions(panel: DataFrame, positions: DataFrame) -> DataFrame:
    """Panel rows and held positions side by side; a held code without panel row is kept."""
    held = positions.withColumn("held", F.lit(True))
    return panel.join(held, ["date", "code"], "full").withColumns(
        {
            "held": F.coalesce("held", F.lit(False)),
            "in_universe": F.coalesce("in_universe", F.lit(False)),
        }
    )


def asof_factors(factors: DataFrame, cal: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Decision panel whose factor columns hold the last known value, not just the last row's."""
    return strictly_before(forward_fill(factors, cols), cal)


__all__ = [
    "align", "asof_factors", "asof_join", "attach", "calendar", "exactly_before",
    "latest_factor", "latest_row", "next_bar_price", "price_or_close", "strictly_before",
    "with_market_return", "with_positions",
]
