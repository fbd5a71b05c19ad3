"""Section 2.6: rolling factors over monthly bars (code = supplier)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.functions.num import div, r
from tickloom.operators import factors as fx
from tickloom.operators import upkeep
from tickloom.plans import views as v
from tickloom.plans.catalog.registry import ORACLES, query
from tickloom.session import shared_dir
from tickloom.sources.tables import load_bucketed, save_bucketed

R6 = "round({0}, 6) + 0.0 AS {0}"


def _sel(*cols: str) -> str:
    return "code, date, " + ", ".join(f'round("{c}", 6) + 0.0 AS {c}' for c in cols)


def _out(df, *cols, keys=("code", "date")):
    return df.select(*keys, *[r(c).alias(c) for c in cols])


@query("f01_window_mean_norm", "SELECT code, date, round(x, 6) + 0.0 AS low_norm, round(y, 6) + 0.0 AS high_norm FROM norm")
def f01(spark, d):
    return _out(fx.window_mean_norm(v.bars_m(spark, d)), "low_norm", "high_norm")


@query(
    "f02_rolling_ols",
    f"SELECT b.code, b.date, {R6.format('rsrs_raw')}, {R6.format('rsrs_r2')}, {R6.format('resid_std')} "
    "FROM bars_m b LEFT JOIN ols USING (code, date)",
)
def f02(spark, d):
    return _out(fx.rolling_ols(fx.window_mean_norm(v.bars_m(spark, d))), "rsrs_raw", "rsrs_r2", "resid_std")


@query(
    "f03_slope_zscore",
    f"SELECT b.code, b.date, {R6.format('rsrs_zscore')} FROM bars_m b LEFT JOIN rsrs USING (code, date)",
)
def f03(spark, d):
    return _out(fx.rsrs(v.bars_m(spark, d), mask=False), "rsrs_zscore")


@query(
    "f03_slope_zscore_short",
    "SELECT b.code, b.date, round(z, 6) + 0.0 AS z40 FROM bars_m b LEFT JOIN zs USING (code, date)",
    zs="""SELECT code, date, CASE WHEN count(rsrs_raw) OVER w >= 30
      THEN (rsrs_raw - avg(rsrs_raw) OVER w) / (stddev_samp(rsrs_raw) OVER w + 1e-9) END AS z
    FROM ols WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)""",
)
def f03_short(spark, d):
    """The same with a window shorter than the history, so that rows leave it."""
    ols = fx.rolling_ols(fx.window_mean_norm(v.bars_m(spark, d)))
    return _out(fx.slope_zscore(ols, 40, 30, out="z40"), "z40")


@query(
    "f04_adaptive",
    f"SELECT b.code, b.date, {R6.format('rsrs_adaptive')} FROM bars_m b LEFT JOIN rsrs USING (code, date)",
)
def f04(spark, d):
    return _out(fx.rsrs(v.bars_m(spark, d), mask=False), "rsrs_adaptive")


@query(
    "f05_short_history_gate",
    "SELECT b.code, b.date, b.high IS NOT NULL AND o.rsrs_raw IS NOT NULL AS known "
    "FROM src_a b LEFT JOIN g o USING (code, date)",
    g="""SELECT code, date, rsrs_raw FROM (SELECT code, date, 1.0 AS rsrs_raw,
      row_number() OVER (PARTITION BY code ORDER BY date) AS rn, count(*) OVER (PARTITION BY code) AS n
      FROM src_a) WHERE rn >= 18 AND n >= 36""",
)
def f05(spark, d):
    """Which rows of the shorter vendor-A histories get a regression at all."""
    out = fx.rolling_ols(fx.window_mean_norm(v.src_a(spark, d)))
    return out.select("code", "date", F.col("rsrs_raw").isNotNull().alias("known"))


@query(
    "f06_new_listing_mask",
    f"SELECT {_sel('rsrs_raw', 'rsrs_r2', 'resid_std', 'rsrs_zscore', 'rsrs_adaptive')} FROM factors",
)
def f06(spark, d):
    return _out(fx.rsrs(v.bars_m(spark, d)), *fx.RSRS_COLUMNS)


@query("f07_momentum", f"SELECT {_sel('mom')} FROM factors")
def f07(spark, d):
    return _out(fx.momentum(v.bars_m(spark, d)), "mom")


@query("f08_daily_return", f"SELECT {_sel('ret')} FROM ret")
def f08(spark, d):
    return _out(fx.daily_return(v.bars_m(spark, d)), "ret")


@query("f09_volatility", f"SELECT {_sel('volatility', 'vol_factor')} FROM factors")
def f09(spark, d):
    return _out(fx.volatility(fx.daily_return(v.bars_m(spark, d))), "volatility", "vol_factor")


@query("f10_volume_ratio", f"SELECT {_sel('vol_ratio')} FROM factors")
def f10(spark, d):
    return _out(fx.volume_ratio(v.bars_m(spark, d)), "vol_ratio")


@query(
    "f11_price_volume_corr",
    f"SELECT {_sel('pv_corr')} FROM c",
    c="""SELECT code, date, CASE WHEN count(*) OVER w = 20 THEN corr("close", volume) OVER w END AS pv_corr
    FROM bars_m WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
)
def f11(spark, d):
    """Where nothing moves the SQL twin's correlation is NaN, so it is shown as that."""
    out = fx.price_volume_corr(v.bars_m(spark, d))
    seen = F.count(F.lit(1)).over(fx.last_rows(fx.SHORT_WINDOW))
    flat = F.when(seen == fx.SHORT_WINDOW, F.lit(float("nan")))
    return _out(out.withColumn("pv_corr", F.coalesce("pv_corr", flat)), "pv_corr")


@query(
    "f12_forward_fill",
    "SELECT code, date, round(last_value(g IGNORE NULLS) OVER (PARTITION BY code ORDER BY date "
    "ROWS UNBOUNDED PRECEDING), 7) + 0.0 AS px FROM gaps",
    gaps="SELECT code, date, CASE WHEN high > low THEN \"close\" END AS g FROM bars_d",
)
def f12(spark, d):
    """Daily closes, those of one-price days unknown, filled forward."""
    gaps = v.bars_d(spark, d).select("code", "date", F.expr("CASE WHEN high > low THEN close END").alias("px"))
    return fx.forward_fill(gaps, ["px"]).select("code", "date", r("px", 7).alias("px"))


@query(
    "f13_factor_panel",
    f"SELECT {_sel('mom', 'volatility', 'vol_factor', 'vol_ratio', 'rsrs_raw', 'rsrs_r2', 'resid_std', 'rsrs_zscore', 'rsrs_adaptive')} FROM factors",
)
def f13(spark, d):
    return _out(
        fx.factor_panel(v.bars_m(spark, d)),
        "mom", "volatility", "vol_factor", "vol_ratio", *fx.RSRS_COLUMNS,
    )


@query("f13_panel_after_loads", ORACLES["f13_factor_panel"])
def f13_after_loads(spark, d):
    """The panel stored at the end of 1996 and brought up to date by two loads, each from its first new bar on."""
    bars, path, before = v.stored_m(spark, d), shared_dir(spark) + "/panel", None
    for until in ("1997-01-01", "1998-07-01", "2100-01-01"):
        table = bars.filter(F.col("date") < until)
        new = None if before is None else upkeep.first_changes(table.filter(F.col("date") >= before))
        upkeep.keep_up(table, path, new)
        before = until
    return _out(upkeep.read_panel(spark, path), "mom", "volatility", "vol_factor", "vol_ratio", *fx.RSRS_COLUMNS)


@query("f13_panel_over_buckets", ORACLES["f13_factor_panel"])
def f13_bucketed(spark, d):
    """The panel over a stored table in buckets by code: no exchange."""
    name = f"bars_{uuid.uuid4().hex}"
    save_bucketed(v.bars_m(spark, d), name, 8, shared_dir(spark) + "/bars")
    return _out(fx.factor_panel(load_bucketed(spark, name)), "mom", "volatility", "vol_factor", "vol_ratio", *fx.RSRS_COLUMNS)


MICRO = dict(
    micro0="""SELECT *, CASE WHEN sum(volume) OVER w10 < 1 THEN 0.0 ELSE
        (coalesce(sum(("close" - low) / nullif(high - low, 0) * volume) OVER w10, 0)
       - coalesce(sum((high - "close") / nullif(high - low, 0) * volume) OVER w10, 0))
       / sum(volume) OVER w10 END AS smart_money,
     abs(ret) / nullif(amount, 0) AS illiq,
     CASE WHEN prev_close IS NULL THEN 0.0 ELSE -least(abs("open" - prev_close)
       / CASE WHEN prev_close > 0 THEN prev_close ELSE 1 END, 0.1) * 10 END AS gap_penalty
     FROM ret WINDOW w10 AS (PARTITION BY code ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    micro1="""SELECT *, CASE WHEN count(illiq) OVER w < 5 THEN 0.0 ELSE -stddev_samp(illiq) OVER w END AS illiq_stability
     FROM micro0 WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 18 PRECEDING AND CURRENT ROW)""",
    micro="SELECT *, 0.5 * smart_money + 0.3 * illiq_stability + 0.2 * gap_penalty AS micro FROM micro1",
)


@query("f14_smart_money", f"SELECT {_sel('smart_money')} FROM micro0", **MICRO)
def f14(spark, d):
    return _out(fx.smart_money(v.bars_m(spark, d)), "smart_money")


@query("f15_amihud_stability", "SELECT code, date, round(illiq_stability * 1e6, 6) + 0.0 AS illiq_stability_e6 FROM micro1", **MICRO)
def f15(spark, d):
    out = fx.amihud_stability(v.bars_m(spark, d))
    return out.select("code", "date", r(F.col("illiq_stability") * 1e6).alias("illiq_stability_e6"))


@query("f16_gap_penalty", f"SELECT {_sel('gap_penalty')} FROM micro0", **MICRO)
def f16(spark, d):
    return _out(fx.gap_penalty(v.bars_m(spark, d)), "gap_penalty")


MULTI = dict(
    multi="""SELECT *, row_number() OVER o AS rn1,
     CASE WHEN count(*) OVER w20 >= 20 THEN coalesce(product(1 + ret) OVER w20, 1) - 1 ELSE 0 END AS cmom,
     CASE WHEN count(*) OVER w5 >= 5 THEN -coalesce(sum(ret) OVER w5, 0) ELSE 0 END AS rev,
     CASE WHEN count(nullif(amount, 0)) OVER w20 = 0 THEN 0.0
          ELSE -avg(abs(ret) / nullif(amount, 0)) OVER w20 END AS liq
     FROM ret WINDOW o AS (PARTITION BY code ORDER BY date),
     w20 AS (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
     w5 AS (PARTITION BY code ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    mret="""SELECT date, "close" / nullif(lag("close") OVER (ORDER BY date), 0) - 1 AS mkt FROM market_m""",
    joined="""SELECT r.code, r.date, r.ret, CASE WHEN m.mkt IS NOT NULL THEN r.ret END AS own,
     CASE WHEN r.ret IS NOT NULL THEN m.mkt END AS mkt FROM ret r LEFT JOIN mret m USING (date)""",
    rv0="""SELECT code, date, count(*) OVER w AS n_rows, stddev_samp(ret) OVER w AS plain,
     var_samp(own) OVER w AS vr, var_samp(mkt) OVER w AS vm, covar_samp(own, mkt) OVER w AS c, count(own) OVER w AS n
     FROM joined WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
    rv1="""SELECT *, CASE WHEN vm > 1e-9 THEN c / (vm + 1e-9) ELSE 1.0 END AS beta FROM rv0""",
    resvol="""SELECT code, date, CASE WHEN n_rows < 20 THEN 0.0 WHEN n > 10
      THEN -sqrt(greatest(vr - 2 * beta * c + beta * beta * vm, 0.0)) ELSE -plain END AS resvol FROM rv1""",
)


@query("f17_compounded_momentum", f"SELECT {_sel('cmom')} FROM multi", **MULTI)
def f17(spark, d):
    return _out(fx.compounded_momentum(fx.daily_return(v.bars_m(spark, d))), "cmom")


@query("f18_reversal", f"SELECT {_sel('rev')} FROM multi", **MULTI)
def f18(spark, d):
    return _out(fx.reversal(fx.daily_return(v.bars_m(spark, d))), "rev")


@query("f19_amihud_level", "SELECT code, date, round(liq * 1e6, 6) + 0.0 AS liq_e6 FROM multi", **MULTI)
def f19(spark, d):
    out = fx.amihud_level(fx.daily_return(v.bars_m(spark, d)))
    return out.select("code", "date", r(F.col("liq") * 1e6).alias("liq_e6"))


@query("f20_residual_volatility", f"SELECT {_sel('resvol')} FROM resvol", **MULTI)
def f20(spark, d):
    bars = v.stored_m(spark, d)
    return _out(fx.residual_volatility(fx.daily_return(bars), v.market_series(bars)), "resvol")


@query(
    "f20_residual_volatility_no_market",
    "SELECT code, date, round(CASE WHEN n_rows < 20 THEN 0.0 ELSE -plain END, 6) + 0.0 AS resvol FROM rv0",
    **MULTI,
)
def f20_plain(spark, d):
    return _out(fx.residual_volatility(fx.daily_return(v.bars_m(spark, d))), "resvol")


@query(
    "f21_earnings_yield",
    "SELECT code, round(CASE WHEN abs(pe_ttm) > 1e-6 THEN 1 / pe_ttm ELSE 0 END, 6) + 0.0 AS ep FROM fundamentals",
)
def f21(spark, d):
    return v.fundamentals(spark, d).select("code", r(fx.earnings_yield()).alias("ep"))


MAS = dict(
    mas="""SELECT code, date, "close", row_number() OVER o AS rn,
     CASE WHEN count(*) OVER w5 = 5 THEN avg("close") OVER w5 END AS ma5,
     CASE WHEN count(*) OVER w20 = 20 THEN avg("close") OVER w20 END AS ma20,
     CASE WHEN count(*) OVER w60 = 60 THEN avg("close") OVER w60 END AS ma60
     FROM bars_m WINDOW o AS (PARTITION BY code ORDER BY date),
     w5 AS (PARTITION BY code ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
     w20 AS (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
     w60 AS (PARTITION BY code ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"""
)


@query(
    "f22_moving_averages",
    """SELECT code, date, round("close" / ma5, 6) + 0.0 AS over_ma5, round("close" / ma20, 6) + 0.0 AS over_ma20,
    round("close" / ma60, 6) + 0.0 AS over_ma60,
    CASE WHEN up THEN 'buy' WHEN down THEN 'sell' ELSE 'hold' END AS side,
    round(CASE WHEN up OR down THEN least(abs("close" / ma60 - 1) * 10, 1.0) ELSE 0.0 END, 6) + 0.0 AS score
    FROM (SELECT *, "close" > ma5 AND ma5 > ma20 AND ma20 > ma60 AS up,
      "close" < ma5 AND ma5 < ma20 AND ma20 < ma60 AS down FROM mas)""",
    **MAS,
)
def f22(spark, d):
    out = fx.moving_averages(v.bars_m(spark, d))
    side, score = fx.ma_alignment(*(F.col(c) for c in ("close", "ma5", "ma20", "ma60")))
    return out.select(
        "code", "date", *[r(div("close", f"ma{n}")).alias(f"over_ma{n}") for n in (5, 20, 60)],
        side.alias("side"), r(score).alias("score"),
    )


LOOKBACK = dict(
    lookback="""SELECT *, CASE WHEN rn > 20 THEN "close" / nullif(lag("close", 19)
      OVER (PARTITION BY code ORDER BY date), 0) - 1 END AS lb FROM ret"""
)


@query(
    "f23_market_regime",
    """SELECT date, CASE WHEN avg(lb) > 0 THEN 'bull' WHEN avg(lb) IS NULL THEN 'neutral' ELSE 'bear' END AS regime,
    round(avg(lb), 6) + 0.0 AS avg_change FROM lookback GROUP BY date""",
    **LOOKBACK,
)
def f23(spark, d):
    out = fx.market_regime(fx.lookback_change(v.bars_m(spark, d)))
    return out.select("date", "regime", r("avg_change").alias("avg_change"))


@query(
    "f24_breadth_breaker",
    """SELECT date, round(s, 6) + 0.0 AS down_share, s > 0.15 AS breach FROM (
    SELECT date, coalesce(count(*) FILTER (ret <= -0.095) / nullif(count(ret), 0), 0.0) AS s FROM ret GROUP BY date)""",
)
def f24(spark, d):
    out = fx.breadth(fx.daily_return(v.bars_m(spark, d)))
    return out.select("date", r("down_share").alias("down_share"), "breach")


SECTOR = dict(
    sector_mom="""SELECT sector_name, date, CASE WHEN past > 0
      THEN greatest(least(("close" / past - 1) * 5, 1.0), -1.0) ELSE 0.0 END AS sector_mom FROM (
      SELECT *, lag("close", 20) OVER (PARTITION BY sector_name ORDER BY date) AS past FROM sector_m)"""
)


@query("f25_sector_momentum", "SELECT sector_name, date, round(sector_mom, 6) + 0.0 AS sector_mom FROM sector_mom", **SECTOR)
def f25(spark, d):
    return _out(fx.sector_momentum(v.sector_m(spark, d)), "sector_mom", keys=("sector_name", "date"))


@query(
    "f26_ttm_profit",
    """SELECT code, report_date, round(CASE WHEN count(net_profit) OVER w = 4
      THEN sum(net_profit) OVER w / 1e4 END, 6) + 0.0 AS net_profit_ttm FROM fund_q
    WINDOW w AS (PARTITION BY code ORDER BY report_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
)
def f26(spark, d):
    return _out(fx.ttm_profit(v.fund_q(spark, d)), "net_profit_ttm", keys=("code", "report_date"))


@query(
    "f27_yoy_growth",
    """SELECT code, y, round(coalesce(CASE WHEN code IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) THEN 0.1 END,
      CASE WHEN lag(p) OVER w > 0 THEN p / lag(p) OVER w - 1 END), 6) + 0.0 AS growth FROM (
      SELECT code, CAST(date_trunc('year', report_date) AS DATE) AS y, sum(net_profit) AS p FROM fund_q GROUP BY ALL)
    WINDOW w AS (PARTITION BY code ORDER BY y)""",
)
def f27(spark, d):
    """Yearly profit growth; codes with a reported figure (0.1 here) keep that."""
    yearly = v.fund_q(spark, d).groupBy("code", F.trunc("report_date", "year").alias("y")).agg(
        F.sum("net_profit").alias("p")
    )
    told = v.table(spark, d, "supplier").filter("s_acctbal < 0").select(
        F.col("s_suppkey").alias("code"), F.lit(0.1).alias("told")
    )
    out = fx.yoy_growth(yearly.join(told, "code", "left"), "p", "y", "growth", known="told")
    return out.select("code", "y", r("growth").alias("growth"))


@query(
    "f28_live_momentum",
    """SELECT q.code, q.event_id, round(q.price / l."close" - 1, 6) + 0.0 AS vs_last,
      round(q.price / c5 - 1, 6) + 0.0 AS vs_5, round(q.price / c20 - 1, 6) + 0.0 AS vs_20,
      round(q.price / m20 - 1, 6) + 0.0 AS vs_mean FROM quotes q JOIN (
      SELECT code, "close", lag("close", 4) OVER w AS c5, lag("close", 19) OVER w AS c20,
        CASE WHEN count(*) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20
        THEN avg("close") OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS m20,
        date = max(date) OVER (PARTITION BY code) AS is_last
      FROM bars_m WINDOW w AS (PARTITION BY code ORDER BY date)) l ON q.code = l.code AND is_last""",
)
def f28(spark, d):
    """Live price against the closes and the mean of the latest bars."""
    from tickloom.operators.panel import latest_row

    last = latest_row(fx.live_levels(v.bars_m(spark, d)), ["close", "close_5", "close_20", "mean_20"])
    q = v.quotes(spark, d).join(last, "code")
    gap = lambda c: r(div("price", c) - 1)
    return q.select("code", "event_id", gap("close").alias("vs_last"), gap("close_5").alias("vs_5"),
                    gap("close_20").alias("vs_20"), gap("mean_20").alias("vs_mean"))
