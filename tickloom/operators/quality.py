"""Filters, validation and freshness checks. Counts are pre-aggregated before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.num import as_col, number

REQUIRED = ("date", "open", "high", "low", "close", "vol")
PRICES = ("open", "high", "low", "close")
MIN_ROWS = 10
MIN_HISTORY = 100
HISTORY_START = "2005-01-01"
TRADING_SHARE = 0.72


def between_dates(df: DataFrame, start=None, end=None, date: str = "date") -> DataFrame:
    """Comparison on the bare column, so it reaches the Parquet scan."""
    if start is not None:
        df = df.filter(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col(date) <= F.lit(end).cast("date"))
    return df


def enough_history(bars: DataFrame, end, least: int = MIN_HISTORY) -> DataFrame:
    """Bars up to ``end`` of the codes with enough of them. Counting shuffles one row per code."""
    upto = between_dates(bars, end=end)
    long = upto.groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return upto.join(long, "code", "left_semi")


def validate(df: DataFrame, min_rows: int = MIN_ROWS, expected: DataFrame | None = None) -> DataFrame:
    """(code, rows, ok, reason) per code; the first failing rule is the reason.

    ``expected`` names codes that should have rows: those without get ``df_empty``.
    """
    missing = sorted(set(REQUIRED) - set(df.columns))
    rows = F.count(F.lit(1))
    if missing:
        per_code = df.groupBy("code").agg(rows.alias("rows"))
        bad = F.lit("missing_cols:[" + ", ".join(f"'{c}'" for c in missing) + "]")
        crossed = negative = share = None
    else:
        p = {c: number(c) for c in PRICES}
        unknown = p["open"].isNull() & p["high"].isNull() & p["low"].isNull() & p["close"].isNull()
        per_code = df.groupBy("code").agg(
            rows.alias("rows"),
            F.count_if(p["high"] < p["low"]).alias("crossed"),
            F.count_if(p["close"] < 0).alias("negative"),
            F.avg(unknown.cast("int")).alias("share"),
        )
        crossed, negative, share = F.col("crossed"), F.col("negative"), F.col("share")
    if expected is not None:
        per_code = expected.select("code").distinct().join(per_code, "code", "left")
    n = F.coalesce(F.col("rows"), F.lit(0))
    ladder = F.when(n == 0, "df_empty").when(
        n < min_rows, F.concat(F.lit("too_few_rows:"), n.cast("string"))
    )
    if missing:
        ladder = ladder.otherwise(bad)
    else:
        ladder = (
            ladder.when(crossed > 0, F.concat(F.lit("high_lt_low:"), crossed.cast("string"), F.lit("_rows")))
            .when(negative > 0, F.concat(F.lit("negative_close:"), negative.cast("string"), F.lit("_rows")))
            .when(
                share > 0.5,
                F.concat(F.lit("too_many_nan_rows:"), F.bround(share * 100).cast("int").cast("string"), F.lit("%")),
            )
            .otherwise("ok")
        )
    return per_code.select("code", n.alias("rows"), ladder.alias("reason")).withColumn(
        "ok", F.col("reason") == "ok"
    )


def validate_merged(df: DataFrame, seq: str = "seq", slice_rows: int = 1 << 20) -> DataFrame:
    """(code, ok, reason) of a merged table whose rows carry an ingest sequence.

    Order is checked inside slices of the sequence and then between them, so a code
    with very many rows is not sorted in one task.
    """
    part = df.withColumn("__part", F.floor(F.col(seq) / F.lit(slice_rows)))
    w = Window.partitionBy("code", "__part").orderBy(seq)
    slices = (
        part.withColumn("__back", F.lag("date").over(w) > F.col("date"))
        .groupBy("code", "__part")
        .agg(F.max("__back").alias("__back"), F.min("date").alias("__lo"), F.max("date").alias("__hi"))
    )
    earlier = Window.partitionBy("code").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    order = (
        slices.withColumn("__back", F.coalesce("__back", F.lit(False)) | F.coalesce(F.max("__hi").over(earlier) > F.col("__lo"), F.lit(False)))
        .groupBy("code").agg(F.max("__back").alias("__unsorted"))
    )
    dup = (
        df.groupBy("code", "date").agg((F.count(F.lit(1)) - 1).alias("n"))
        .groupBy("code").agg(F.sum("n").alias("__dup"))
    )
    reason = (
        F.when(F.col("__unsorted"), "date_not_sorted")
        .when(F.col("__dup") > 0, F.concat(F.lit("duplicate_dates:"), F.col("__dup").cast("string")))
        .otherwise("ok")
    )
    return order.join(dup, "code").select("code", reason.alias("reason")).withColumn("ok", F.col("reason") == "ok")


def needs_enrichment(bars: DataFrame, force: bool = False) -> DataFrame:
    have = {c: (F.count(c) if c in bars.columns else F.lit(0)) for c in ("turnover", "pct_change")}
    full = (have["turnover"] > 0) & (have["pct_change"] > 0)
    return bars.groupBy("code").agg((F.lit(force) | ~full).alias("needs_enrich"))


def integrity(bars: DataFrame) -> DataFrame:
    ext = [c for c in ("turnover", "pct_change", "adjust") if c in bars.columns]
    present = F.array_compact(F.array(*[F.when(F.count(c) > 0, F.lit(c)) for c in ext])) if ext else F.array()
    return bars.groupBy("code").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("min_date"), F.max("date").alias("max_date"),
        F.array_join(present, ",").alias("ext"),
    )


def max_dates(bars: DataFrame) -> DataFrame:
    """Latest stored date per code; only the two columns are read."""
    return bars.groupBy("code").agg(F.max("date").alias("max_date"))


def is_up_to_date(max_date: str | Column, as_of: Column) -> Column:
    return F.coalesce(F.datediff(as_of, as_col(max_date)) <= 1, F.lit(False))


def missing_range(stored: DataFrame, as_of: Column, history_start: str = HISTORY_START) -> DataFrame:
    """Adds (start_date, end_date) to fetch; equal dates in the future mean nothing is missing."""
    following = F.least(F.date_add("max_date", 1), as_of)
    return stored.withColumns(
        {"start_date": F.coalesce(F.when(F.col("max_date").isNotNull(), following), F.lit(history_start).cast("date")),
         "end_date": as_of}
    )


def estimated_bars(start: str | Column, end: str | Column) -> Column:
    days = F.datediff(as_col(end), as_col(start))
    return F.greatest(F.lit(1), (days * TRADING_SHARE).cast("int")) + 1


def sector_summary(listed: DataFrame, daily: DataFrame, members: DataFrame) -> DataFrame:
    """Per sector type: sectors listed, sectors with bars, constituent records."""
    counts = ("list_sectors", "daily_sectors", "constituents_records")
    parts = (listed, daily.select("sector_type", "sector_name").distinct(), members)
    stacked = None
    for name, df in zip(counts, parts):
        one = df.groupBy("sector_type").agg(F.count(F.lit(1)).alias(name))
        stacked = one if stacked is None else stacked.unionByName(one, allowMissingColumns=True)
    return stacked.groupBy("sector_type").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])


def only_watched(df: DataFrame, watch: DataFrame) -> DataFrame:
    return df.join(watch.select("code").distinct(), "code", "left_semi")


def without_suspended(df: DataFrame, suspended: DataFrame) -> DataFrame:
    return df.join(suspended.select("date", "code"), ["date", "code"], "left_anti")
