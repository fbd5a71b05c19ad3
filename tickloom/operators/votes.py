"""Merging the votes of several strategies on one code in one scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.num import div

MIN_SCORE = 0.3


def gate(votes: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    return votes.filter((F.col("side") != "hold") & (F.col("score") >= min_score))


def last_vote(votes: DataFrame, scan: Sequence[str], seq: str) -> DataFrame:
    """A strategy votes once per scan: its last vote counts. Leaves at most as many
    rows per scan as there are strategies."""
    keys = [*scan, "strategy"]
    values = [c for c in votes.columns if c not in keys]
    return votes.groupBy(*keys).agg(F.max_by(F.struct(*values), seq).alias("v")).select(*keys, "v.*")


def merge_votes(
    votes: DataFrame, scan: Sequence[str], rule: str = "any", min_score: float = MIN_SCORE, shown: int = 3
) -> DataFrame:
    """(scan, signal, score, strategies, reason) of gated votes; scans that end in hold leave.

    Rules: ``any`` (one side, or the side with the higher best score, buy on a tie),
    ``majority`` (over half of the votes, mean score), ``weighted`` (larger score sum above
    the minimum, mean score up to 1); any other name is buy before sell. Votes carry
    ``place``, the strategy order, which orders the joined names and reasons. ``reason`` is
    the text form with the first ``shown`` reasons; ``reasons`` has all of them.
    """
    buy, sell = F.col("side") == "buy", F.col("side") == "sell"
    row = F.struct("place", "strategy", "reason")

    def side(cond, name):
        s = F.when(cond, F.col("score"))
        return [
            F.count(s).alias(f"{name}_n"), F.sum(s).alias(f"{name}_sum"), F.max(s).alias(f"{name}_max"),
            F.sort_array(F.collect_list(F.when(cond, row))).alias(f"{name}_rows"),
        ]

    agg = votes.filter("side <> 'hold'").groupBy(*scan).agg(*side(buy, "buy"), *side(sell, "sell"))
    bn, sn = F.col("buy_n"), F.col("sell_n")
    bsum, ssum = (F.coalesce(c, F.lit(0.0)) for c in ("buy_sum", "sell_sum"))
    bmax, smax = F.col("buy_max"), F.col("sell_max")
    bavg, savg = div("buy_sum", bn), div("sell_sum", sn)
    none = F.lit(None).cast("string")
    if rule == "any":
        signal = F.when((sn == 0) | (bmax >= smax), "buy").when((bn == 0) | (smax > bmax), "sell")
        score = {"buy": bmax, "sell": smax}
    elif rule == "majority":
        signal = F.when(bn * 2 > bn + sn, "buy").when(sn * 2 > bn + sn, "sell").otherwise(none)
        score = {"buy": bavg, "sell": savg}
    elif rule == "weighted":
        signal = (
            F.when((bsum > ssum) & (bsum > min_score), "buy")
            .when((ssum > bsum) & (ssum > min_score), "sell").otherwise(none)
        )
        score = {"buy": F.least(bavg, F.lit(1.0)), "sell": F.least(savg, F.lit(1.0))}
    else:
        signal = F.when(bn > 0, "buy").when(sn > 0, "sell")
        score = {"buy": bmax, "sell": smax}
    out = agg.withColumn("signal", signal).filter("signal IS NOT NULL")
    chosen = F.when(F.col("signal") == "buy", F.col("buy_rows")).otherwise(F.col("sell_rows"))
    out = out.withColumn("rows", chosen).withColumn(
        "score", F.when(F.col("signal") == "buy", score["buy"]).otherwise(score["sell"])
    )
    return out.select(
        *scan, "signal", "score",
        F.array_join("rows.strategy", "+").alias("strategy"),
        F.col("rows.strategy").alias("strategies_triggered"),
        F.array_join(F.slice("rows.reason", 1, shown), " | ").alias("reason"),
        F.col("rows.reason").alias("reasons"),
        F.lit(rule).alias("merge_rule"),
    )
