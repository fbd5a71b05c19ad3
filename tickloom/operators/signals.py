"""Trading strategies as queries: decision panel and positions in, signals out.

The panel has one row per (decision date, code) holding only what was known before
that date (:func:`tickloom.operators.panel.strictly_before`) and the flags
``in_universe`` and ``held``. A strategy names its candidates and scores, its sales,
and how buys are cut; everything else is shared. ``score`` and ``weight`` of a sale
are 0.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.num import nonzero
from tickloom.operators.cross_section import composite, renormalised, top_n, zscores
from tickloom.operators.factors import breadth, earnings_yield, market_regime

Params = Mapping[str, object]


def _emit(df: DataFrame, side: str, reason: str | Column, score=None, weight=None) -> DataFrame:
    zero = F.lit(0.0)
    return df.select(
        "date",
        "code",
        F.lit(side).alias("side"),
        (F.col(score) if score else zero).alias("score"),
        (F.col(weight) if weight else zero).alias("weight"),
        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
    )


def _buys(
    panel: DataFrame, score: Column, n: int, reason: str | Column,
    held_first: bool = False, above: float | None = None,
) -> DataFrame:
    """Best n of the rows where ``score`` is known. Held codes count towards the n and
    the weight unless ``held_first`` removes them before ranking."""
    scored = panel.withColumn("__score", score).filter("__score IS NOT NULL")
    if held_first:
        scored = scored.filter("NOT held")
    best = top_n(scored, "__score", n)
    if not held_first:
        best = best.filter("NOT held")
    if above is not None:
        best = best.filter(F.col("__score") > above)
    return _emit(best, "BUY", reason, "__score", "weight")


def _sells(panel: DataFrame, when: Column, reason: str | Column) -> DataFrame:
    return _emit(panel.filter(F.col("held")).filter(when), "SELL", reason)


def rsrs_momentum(panel: DataFrame, p: Params) -> DataFrame:
    """``mode`` "exact" is for the exact-previous-day panel."""
    mode = p.get("mode", "asof")
    if mode == "exact":
        return rsrs_momentum_exact(panel, p)
    if mode != "asof":
        raise ValueError(f"mode is asof or exact, not {mode}")
    v, t = F.col("rsrs_adaptive"), p["rsrs_threshold"]
    buys = _buys(panel, F.when(F.col("in_universe") & (v > t), v), p["top_n"], "rsrs strong")
    return buys.unionByName(_sells(panel, v < -t, "rsrs below lower bound"))


def rsrs_momentum_exact(panel: DataFrame, p: Params) -> DataFrame:
    """The same on the exact-previous-day panel; held codes leave before ranking."""
    v, t = F.col("rsrs_adaptive"), p["rsrs_threshold"]
    buys = _buys(panel, F.when(v > t, v), p["top_n"], "rsrs strong (exact)", held_first=True)
    return buys.unionByName(_sells(panel, v < -t, "rsrs below lower bound (exact)"))


HUNTER_WEIGHTS = {"rsrs_adaptive": 0.5, "mom": 0.3, "vol_factor": 0.2}


def alpha_hunter(panel: DataFrame, p: Params) -> DataFrame:
    least = p["min_score"]
    scored = panel.withColumn(
        "hunter", F.when(F.col("bar_date").isNotNull(), renormalised(p.get("factor_weights", HUNTER_WEIGHTS)))
    )
    s = F.col("hunter")
    buys = _buys(scored, F.when(F.col("in_universe") & (s >= least), s), p["top_n"], "multi-factor")
    return buys.unionByName(_sells(scored, s < -least, "multi-factor score low"))


def rsrs_advanced(panel: DataFrame, p: Params) -> DataFrame:
    v, t = F.col("rsrs_adaptive"), p["rsrs_threshold"]
    calm = F.coalesce(F.col("vol_ratio") < 1.0, F.lit(False))
    ok = F.col("in_universe") & (F.col("rsrs_r2") >= p["r2_threshold"]) & (v > t) & ~calm
    buys = _buys(panel, F.when(ok, v), p["top_n"], "rsrs, r2 and volume agree")
    return buys.unionByName(_sells(panel, v < -t, "rsrs advanced exit"))


def holding_days() -> Column:
    return F.datediff("date", "entry_date")


def short_term(panel: DataFrame, p: Params) -> DataFrame:
    m, t = F.col("mom"), p["mom_threshold"]
    buys = _buys(panel, F.when(F.col("in_universe") & (m > t), m), p["top_n"], "short momentum")
    late = F.coalesce(holding_days() >= p["hold_calendar_days"], F.lit(False))
    why = F.when(late, "held too long").otherwise("momentum reversed")
    return buys.unionByName(_sells(panel, late | (m < -t), why))


def momentum_reversal(panel: DataFrame, p: Params) -> DataFrame:
    regime = market_regime(panel, p["market_thresh"]).drop("avg_change")
    m = F.col("mom")
    bull = F.col("regime") == "bull"
    pick = F.when(F.col("in_universe"), F.when(bull & (m > 0), m).when(~bull & (m < -0.05), -m))
    moded = panel.join(regime, "date", "left").withColumn(
        "regime", F.coalesce("regime", F.lit("neutral"))
    ).withColumn("pick", pick)
    buys = _buys(moded, F.col("pick"), p["top_n"], F.concat(F.col("regime"), F.lit(" mode")))
    return buys.unionByName(
        _sells(moded, F.col("pick").isNull(), F.concat(F.lit("mode switch "), F.col("regime")))
    )


def sentiment_reversal(panel: DataFrame, p: Params) -> DataFrame:
    z = F.col("rsrs_zscore")
    buys = _buys(panel, F.when(F.col("in_universe") & (z < p["oversold_z"]), -z), p["top_n"], "oversold")
    return buys.unionByName(_sells(panel, z > p["overbought_z"], "overbought exit"))


def microstructure_reversal(panel: DataFrame, p: Params) -> DataFrame:
    """Needs :func:`windowed` micro and ``n_rows``. On a breadth breach nothing is bought and only
    codes down 9% or more are sold."""
    if p.get("use_breadth_check", True):
        day = breadth(panel, p["breadth_limit"]).select("date", "breach")
        panel = panel.join(day, "date", "left").withColumn("breach", F.coalesce("breach", F.lit(False)))
    else:
        panel = panel.withColumn("breach", F.lit(False))
    score = F.when(F.col("in_universe") & (F.col("n_rows") >= p["illiq_window"]), F.col(windowed("kunpeng_v10", p)))
    scored = panel.withColumn("pick", score)
    calm = scored.filter("NOT breach")
    buys = _buys(calm, F.col("pick"), p["top_n"], "microstructure", above=0.1)
    worn = F.col("pick").isNull() | (F.col("pick") < -0.3)
    fell = F.coalesce(F.col("ret") <= -0.09, F.lit(False))
    sells = _sells(
        scored,
        F.when(F.col("breach"), fell).otherwise(worn),
        F.when(F.col("breach"), "breadth breaker").otherwise("microstructure worn"),
    )
    return buys.unionByName(sells)


MULTI_FACTORS = ("ep", "growth", "cmom", "quality", "rev", "liq", "resvol")


def multi_factor_scores(panel: DataFrame, p: Params) -> DataFrame:
    """Adds ``multi``, unknown outside the scored universe.

    Needs the price factors ``cmom rev liq resvol n_rows`` and, joined by code,
    ``pe_ttm net_profit_growth roe_ttm`` (all optional: unknown counts as 0).
    """
    zero = F.lit(0.0)
    scored = F.col("in_universe") & (F.col("n_rows") >= 20)
    inputs = {
        "ep": F.coalesce(earnings_yield(nonzero("pe_ttm")), zero),
        "growth": F.coalesce("net_profit_growth", zero),
        "quality": F.coalesce("roe_ttm", zero),
        **{c: F.col(c) for c in ("cmom", "rev", "liq", "resvol")},
    }
    # Rows outside the universe are unknown, so they do not enter mean and spread.
    masked = panel.withColumn("__in", F.coalesce(scored, F.lit(False))).withColumns(
        {c: F.when(F.col("__in"), x) for c, x in inputs.items()}
    )
    weights = {
        "ep": p["ep_weight"], "growth": p["growth_w"], "cmom": p["mom_w"], "quality": p["quality_w"],
        "rev": p["rev_w"], "liq": p["liq_w"], "resvol": p["res_vol_w"],
    }
    out = zscores(masked, MULTI_FACTORS, eps=1e-9)
    return out.withColumn("multi", F.when(F.col("__in"), composite(weights, "_z"))).drop("__in")


def multi_factor(panel: DataFrame, p: Params) -> DataFrame:
    scored = multi_factor_scores(panel, p)
    buys = _buys(scored, F.col("multi"), p["top_n"], "multi-factor composite", above=0.3)
    low = F.coalesce(F.col("multi") < -0.5, F.lit(True))
    return buys.unionByName(_sells(scored, low, "composite low"))


def sector_momentum_blend(panel: DataFrame, p: Params) -> DataFrame:
    """Needs ``sector_name`` and :func:`windowed` sector_mom (as of the day before) joined to the panel."""
    v, t, w = F.col("rsrs_adaptive"), p["rsrs_threshold"], p["sector_weight"]
    has = F.col("sector_name").isNotNull() & (F.col("sector_name") != "")
    mixed = F.when(has, (1 - w) * v + w * F.coalesce(windowed("sector_momentum", p), F.lit(0.0))).otherwise(v)
    seen = F.col("in_universe") & (F.col("held") | (v > t))
    scored = panel.withColumn("blend", F.when(seen, mixed))
    s = F.col("blend")
    buys = _buys(scored, F.when(s > t, s), p["top_n"], "rsrs with sector", held_first=True)
    return buys.unionByName(_sells(scored, s < -t, "rsrs with sector exit"))


# Strategy names, parameters and their defaults.
PARAMS: dict[str, dict[str, object]] = {
    "rsrs_momentum": {"top_n": 10, "rsrs_threshold": 0.5, "mode": "asof"},
    "alpha_hunter": {"top_n": 15, "min_score": 0.3},
    "rsrs_advanced": {"top_n": 10, "rsrs_threshold": 0.5, "r2_threshold": 0.7},
    "short_term": {"top_n": 5, "hold_calendar_days": 7, "mom_threshold": 0.03},
    "momentum_reversal": {"top_n": 10, "market_thresh": 0.0},
    "sentiment_reversal": {"top_n": 10, "oversold_z": -1.5, "overbought_z": 1.5},
    "kunpeng_v10": {
        "top_n": 15, "illiq_window": 20, "smart_window": 10, "breadth_limit": 0.15, "use_breadth_check": True,
    },
    "alpha_max_v5_fixed": {
        "top_n": 20, "ep_weight": 0.20, "growth_w": 0.15, "mom_w": 0.15, "quality_w": 0.20,
        "rev_w": 0.10, "liq_w": 0.10, "res_vol_w": 0.10,
    },
    "sector_momentum": {
        "top_n": 10, "rsrs_threshold": 0.5, "sector_weight": 0.3, "sector_momentum_window": 20,
    },
}

# Factors whose windows are parameters: the panel's column and the parameters that name it.
WINDOWED: dict[str, tuple[str, tuple[str, ...]]] = {
    "kunpeng_v10": ("micro", ("smart_window", "illiq_window")),
    "sector_momentum": ("sector_mom", ("sector_momentum_window",)),
}
# Parameters without a default in the table above.
OPTIONAL = {"alpha_hunter": {"factor_weights"}}


def windowed(name: str, p: Params) -> str:
    """The panel column a strategy reads for these windows: plain for the defaults, else with the windows in its name."""
    column, keys = WINDOWED[name]
    values = [p.get(k, PARAMS[name][k]) for k in keys]
    return column if values == [PARAMS[name][k] for k in keys] else "_".join([column, *map(str, values)])


STRATEGIES: dict[str, Callable[[DataFrame, Params], DataFrame]] = {
    "rsrs_momentum": rsrs_momentum,
    "alpha_hunter": alpha_hunter,
    "rsrs_advanced": rsrs_advanced,
    "short_term": short_term,
    "momentum_reversal": momentum_reversal,
    "sentiment_reversal": sentiment_reversal,
    "kunpeng_v10": microstructure_reversal,
    "alpha_max_v5_fixed": multi_factor,
    "sector_momentum": sector_momentum_blend,
}


def parameter_table(spark: SparkSession) -> DataFrame:
    """(strategy, param, type, default) of every registered strategy."""
    rows = [
        (name, key, type(value).__name__, str(value).lower() if isinstance(value, bool) else str(value))
        for name, params in PARAMS.items()
        for key, value in params.items()
    ]
    return spark.createDataFrame(rows, "strategy string, param string, type string, default string")


def register(name: str, fn: Callable[[DataFrame, Params], DataFrame], params: Params) -> None:
    """Add a strategy of one's own under a new name.

    A built-in strategy as ``fn`` brings its own defaults; ``params`` go over them.
    """
    inherited = next((PARAMS[built_in] for built_in, known in STRATEGIES.items() if known is fn), {})
    STRATEGIES[name], PARAMS[name] = fn, {**inherited, **params}


def run_strategy(name: str, panel: DataFrame, **overrides) -> DataFrame:
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name}; known: {sorted(STRATEGIES)}")
    unknown = set(overrides) - set(PARAMS[name]) - OPTIONAL.get(name, set())
    if unknown:
        raise ValueError(f"{name} has no parameters {sorted(unknown)}")
    if name in WINDOWED and (needed := windowed(name, overrides)) not in panel.columns:
        raise ValueError(f"{name} with these windows reads {needed}, which the panel was not built with")
    return STRATEGIES[name](panel, {**PARAMS[name], **overrides}).withColumn("strategy", F.lit(name))


def run_many(panel: DataFrame, runs: Mapping[str, tuple[str, Params]]) -> DataFrame:
    """Several parametrised strategies over one panel, told apart by ``run``."""
    out = None
    for label, (name, overrides) in runs.items():
        one = run_strategy(name, panel, **overrides).withColumn("run", F.lit(label))
        out = one if out is None else out.unionByName(one)
    return out


class Ranking(NamedTuple):
    """A strategy whose buys are a prefix of one ranking, cut at ``top_n`` and at a threshold on the score.

    ``score`` is unknown for rows that no threshold makes a candidate. ``above`` says whether a
    score passes, ``sold`` whether a held row is sold and why; both see a run's parameters as
    columns. Runs that differ in ``shape`` have rankings of their own.
    """

    score: Callable[[Params], Column]
    above: Callable[[Column, Column], Column]
    reason: str
    sold: Callable[[Column], tuple[Column, str | Column]]
    shape: tuple[str, ...] = ()
    held_first: Callable[[Params], bool] = lambda p: False


def _candidate(column: str | Column, extra: Column | None = None) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.when(F.col("in_universe") if extra is None else F.col("in_universe") & extra, value)


def _hunter(p: Params) -> Column:
    return F.when(F.col("bar_date").isNotNull(), renormalised(p.get("factor_weights", HUNTER_WEIGHTS)))


def _short_term_sale(p: Column) -> tuple[Column, Column]:
    late = F.coalesce(holding_days() >= p["hold_calendar_days"], F.lit(False))
    return late | (F.col("mom") < -p["mom_threshold"]), F.when(late, "held too long").otherwise("momentum reversed")


def _rsrs_sale(reason: str) -> Callable[[Column], tuple[Column, str]]:
    return lambda p: (F.col("rsrs_adaptive") < -p["rsrs_threshold"], reason)


def _agreeing(p: Params) -> Column:
    calm = F.coalesce(F.col("vol_ratio") < 1.0, F.lit(False))
    return _candidate("rsrs_adaptive", (F.col("rsrs_r2") >= p["r2_threshold"]) & ~calm)


RANKINGS: dict[Callable[[DataFrame, Params], DataFrame], Ranking] = {
    rsrs_momentum: Ranking(
        lambda p: F.col("rsrs_adaptive") if p["mode"] == "exact" else _candidate("rsrs_adaptive"),
        lambda s, p: s > p["rsrs_threshold"], "rsrs strong", _rsrs_sale("rsrs below lower bound"), ("mode",), lambda p: p["mode"] == "exact",
    ),
    alpha_hunter: Ranking(
        lambda p: F.when(F.col("in_universe"), _hunter(p)), lambda s, p: s >= p["min_score"], "multi-factor",
        lambda p: (F.col("__hunter") < -p["min_score"], "multi-factor score low"), ("factor_weights",),
    ),
    rsrs_advanced: Ranking(
        _agreeing, lambda s, p: s > p["rsrs_threshold"], "rsrs, r2 and volume agree", _rsrs_sale("rsrs advanced exit"), ("r2_threshold",),
    ),
    short_term: Ranking(lambda p: _candidate("mom"), lambda s, p: s > p["mom_threshold"], "short momentum", _short_term_sale),
    sentiment_reversal: Ranking(
        lambda p: _candidate(-F.col("rsrs_zscore")), lambda s, p: s > -p["oversold_z"], "oversold",
        lambda p: (F.col("rsrs_zscore") > p["overbought_z"], "overbought exit"),
    ),
}


def _one_ranking(panel: DataFrame, name: str, how: Ranking, shape: Params, sets: Mapping[str, Params]) -> DataFrame:
    """The signals of all runs of one shape: one scan of the panel, one sort by date and score."""
    base = {**PARAMS[name], **shape}
    numbers = [k for k in PARAMS[name] if k not in how.shape]
    run = lambda label, p: F.struct(
        F.lit(label).alias("run"), *[F.lit(float({**base, **p}[k])).alias(k) for k in numbers]
    )
    runs = F.array(*[run(label, p) for label, p in sets.items()])
    most = max(int({**base, **p}["top_n"]) for p in sets.values())

    own = panel.withColumns({"__score": how.score(base), "__hunter": _hunter(base) if how is RANKINGS[alpha_hunter] else F.lit(None)})
    if how.held_first(base):
        own = own.withColumn("__score", F.when(~F.col("held"), F.col("__score")))
    by_score = Window.partitionBy("date").orderBy(F.col("__score").desc_nulls_last(), "code")
    own = own.withColumn("__rank", F.row_number().over(by_score)).filter((F.col("__rank") <= most) & F.col("__score").isNotNull() | F.col("held"))

    def picked(p: Column) -> Column:
        return F.coalesce((F.col("__rank") <= p["top_n"]) & how.above(F.col("__score"), p), F.lit(False))

    def sold(p: Column) -> Column:
        return F.col("held") & F.coalesce(how.sold(p)[0], F.lit(False))

    each = own.withColumn("__p", F.explode(F.filter(runs, lambda p: picked(p) | sold(p))))
    p = F.col("__p")
    # A date's rows lie together already; its buys in a run are counted where they are.
    in_run = Window.partitionBy("date", F.col("__p.run"))
    each = each.withColumn("__n", F.count(F.when(picked(p), 1)).over(in_run))
    why = how.sold(p)[1]
    suffix = " (exact)" if how.held_first(base) else ""
    buy = F.struct(F.lit("BUY").alias("side"), F.col("__score").alias("score"), (F.lit(1.0) / F.col("__n")).alias("weight"), F.lit(how.reason + suffix).alias("reason"))
    sale = F.lit(why + suffix) if isinstance(why, str) else why
    sell = F.struct(F.lit("SELL").alias("side"), F.lit(0.0).alias("score"), F.lit(0.0).alias("weight"), sale.alias("reason"))
    # Bought are rows that are not held, sold are rows that are.
    signal = F.when(~F.col("held") & picked(p), buy).when(sold(p), sell)
    return each.withColumn("__s", signal).filter("__s IS NOT NULL").select("date", "code", "__s.*", F.lit(name).alias("strategy"), F.col("__p.run").alias("run"))


def run_grid(panel: DataFrame, name: str, sets: Mapping[str, Params]) -> DataFrame:
    """:func:`run_many` of one strategy under many parameter sets, by label.

    Where a strategy's buys are a prefix of a ranking, all sets share one: the panel is
    scanned and sorted once however many they are. Sets that change the score itself
    (factor weights, the mode, a filter of candidates) share it with those that change it
    alike. Other strategies run set by set.
    """
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name}; known: {sorted(STRATEGIES)}")
    how = RANKINGS.get(STRATEGIES[name])
    if how is None:
        return run_many(panel, {label: (name, p) for label, p in sets.items()})
    for p in sets.values():
        if unknown := set(p) - set(PARAMS[name]) - OPTIONAL.get(name, set()):
            raise ValueError(f"{name} has no parameters {sorted(unknown)}")
    shapes: dict[str, tuple[dict, dict]] = {}
    for label, p in sets.items():
        shape = {k: p[k] for k in how.shape if k in p}
        shapes.setdefault(repr(sorted({**PARAMS[name], **shape}.items(), key=lambda x: x[0])), (shape, {}))[1][label] = p
    out = None
    for shape, group in shapes.values():
        one = _one_ranking(panel, name, how, shape, group)
        out = one if out is None else out.unionByName(one)
    return out
