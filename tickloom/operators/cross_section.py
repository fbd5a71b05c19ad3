"""Operators across codes on one date."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.num import as_col, div

FLAT = 1e-9


def zscores(df: DataFrame, cols: Sequence[str], eps: float = 0.0, suffix: str = "_z", by: str = "date") -> DataFrame:
    """z-score per date. A flat cross-section scores 0.

    Mean and spread are pre-aggregated per date and joined back rather than computed
    in a window, so one date's rows need not fit one task.
    """
    stats = df.groupBy(by).agg(
        *[F.avg(c).alias(f"__m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"__s_{c}") for c in cols]
    )
    out = df.join(stats, by)
    for c in cols:
        s = F.col(f"__s_{c}")
        z = F.when(s > FLAT, (F.col(c) - F.col(f"__m_{c}")) / (F.nullif(s, F.lit(0.0)) + eps)).otherwise(0.0)
        out = out.withColumn(c + suffix, z)
    return out.drop(*[f"__{p}_{c}" for p in "ms" for c in cols])


def composite(weights: Mapping[str, float], suffix: str = "") -> Column:
    """Weighted mean; an unknown part makes the whole unknown."""
    total = sum(weights.values())
    parts = [F.col(c + suffix) * w for c, w in weights.items()]
    return sum(parts[1:], parts[0]) / (total if total > 0 else 1.0)


def renormalised(weights: Mapping[str, float]) -> Column:
    """Weighted mean over the known parts; 0 when none is known."""
    zero = F.lit(0.0)
    top = sum([F.coalesce(F.col(c) * w, zero) for c, w in weights.items()], zero)
    low = sum([F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()], zero)
    return F.when(low > 0, div(top, low)).otherwise(0.0)


def top_n(df: DataFrame, score: str, n: int, by: Sequence[str] = ("date",)) -> DataFrame:
    """The n best per date with equal weights, ties by code.

    Spark limits each input partition to its n best rows before the shuffle.
    """
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col("code"))
    best = df.filter(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return best.withColumn("weight", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy(*by)))


def ranked(df: DataFrame, score: str) -> DataFrame:
    return df.orderBy("date", F.col(score).desc(), "code")


def peak_and_trough(curve: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    at = F.struct(F.col(value), F.negative(F.unix_date(F.col(ts).cast("date"))))
    low = F.struct(F.col(value), F.unix_date(F.col(ts).cast("date")))
    return curve.groupBy(key).agg(
        F.max_by(ts, at).alias("peak_ts"), F.max(value).alias("peak"),
        F.min_by(ts, low).alias("trough_ts"), F.min(value).alias("trough"),
    )


def factor_map(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Export form of the score matrix: one map per (date, code), unknown factors left out."""
    pairs = [x for c in cols for x in (F.lit(c), as_col(c))]
    return df.select(
        "date", "code", F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("scores")
    )
