"""Section 2.8: strategies over the decision panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.num import r
from tickloom.operators import panel as pn
from tickloom.operators import signals as sg
from tickloom.operators import factors as fx
from tickloom.plans import views as v
from tickloom.plans.catalog.factor_queries import LOOKBACK, MICRO, MULTI, SECTOR
from tickloom.plans.catalog.panel_queries import HUNTER_SQL
from tickloom.plans.catalog.registry import query
from tickloom.plans.signal_panel import decision_panel, price_panel, with_sector

PANEL = dict(
    LOOKBACK, **MICRO, **MULTI, **SECTOR,
    wide="""SELECT f.*, l.lb, m.micro, u.cmom, u.rev, u.liq, x.resvol FROM filled f
      JOIN lookback l USING (code, date) JOIN micro m USING (code, date)
      JOIN multi u USING (code, date) JOIN resvol x USING (code, date)""",
    asofw="""SELECT c.date, c.idx = f.nxt AS in_universe, f.* EXCLUDE (date), f.date AS bar_date FROM (
      SELECT *, coalesce(lead(fi) OVER (PARTITION BY code ORDER BY fi), 1000000) AS nxt FROM (
        SELECT w.*, k.idx AS fi FROM wide w JOIN calendar k USING (date))) f
      JOIN calendar c ON c.idx > f.fi AND c.idx <= f.nxt""",
    dp="""SELECT coalesce(a.date, p.date) AS date, coalesce(a.code, p.code) AS code,
      coalesce(a.in_universe, false) AS in_universe, a.bar_date, a.rn AS n_rows, a.ret, a.lb, a.micro, a.cmom,
      a.rev, a.liq, a.resvol, a.mom, a.vol_factor, a.vol_ratio, a.rsrs_r2, a.rsrs_zscore, a.rsrs_adaptive,
      p.code IS NOT NULL AS held, p.entry_date
      FROM asofw a FULL JOIN positions_m p ON a.date = p.date AND a.code = p.code""",
)


# The panel of strategies on price and regression factors: what they do not read is not built.
PRICE_PANEL = dict(
    LOOKBACK,
    wide="SELECT f.*, l.lb FROM filled f JOIN lookback l USING (code, date)",
    asofw=PANEL["asofw"],
    dp="""SELECT coalesce(a.date, p.date) AS date, coalesce(a.code, p.code) AS code,
      coalesce(a.in_universe, false) AS in_universe, a.bar_date, a.lb, a.mom, a.vol_factor, a.vol_ratio, a.rsrs_r2, a.rsrs_zscore,
      a.rsrs_adaptive, p.code IS NOT NULL AS held, p.entry_date
      FROM asofw a FULL JOIN positions_m p ON a.date = p.date AND a.code = p.code""",
)


def _sql(score: str, n: int, buy: str, sell: str, sold: str, src: str = "dp",
         held_first: bool = False, above: str = "true") -> str:
    """Signals from a score expression, a sell condition and two reason expressions."""
    return f"""SELECT date, code, 'BUY' AS side, round(s, 6) + 0.0 AS score, round(weight, 6) + 0.0 AS weight, {buy} AS reason
      FROM (SELECT *, 1.0 / count(*) OVER (PARTITION BY date) AS weight FROM (
        SELECT *, row_number() OVER (PARTITION BY date ORDER BY s DESC, code) AS rk FROM (
          SELECT *, {score} AS s FROM {src}) WHERE s IS NOT NULL {"AND NOT held" if held_first else ""}) WHERE rk <= {n})
      WHERE NOT held AND {above}
    UNION ALL SELECT date, code, 'SELL', 0.0, 0.0, {sold} FROM {src} WHERE held AND ({sell})"""


def _show(signals):
    return signals.select("date", "code", "side", r("score").alias("score"), r("weight").alias("weight"), "reason")


@query(
    "g01_rsrs_momentum_asof",
    _sql("CASE WHEN in_universe AND rsrs_adaptive > 0.5 THEN rsrs_adaptive END", 10, "'rsrs strong'",
         "rsrs_adaptive < -0.5", "'rsrs below lower bound'"),
    **PANEL,
)
def g01(spark, d):
    return _show(sg.run_strategy("rsrs_momentum", price_panel(spark, d)))


EXACT = dict(
    exact="""SELECT coalesce(e.date, p.date) AS date, coalesce(e.code, p.code) AS code, e.rsrs_adaptive,
      p.code IS NOT NULL AS held FROM (
        SELECT c.date, f.code, f.rsrs_adaptive FROM factors f JOIN calendar k ON k.date = f.date
        JOIN calendar c ON c.idx = k.idx + 1) e
      FULL JOIN positions_m p ON e.date = p.date AND e.code = p.code""",
)


@query(
    "g01_rsrs_momentum_exact",
    _sql("CASE WHEN rsrs_adaptive > 0.5 THEN rsrs_adaptive END", 10, "'rsrs strong (exact)'",
         "rsrs_adaptive < -0.5", "'rsrs below lower bound (exact)'", src="exact", held_first=True),
    **EXACT,
)
def g01_exact(spark, d):
    bars = v.stored_m(spark, d)
    rows = fx.rsrs(bars).select("code", "date", "rsrs_adaptive")
    panel = pn.exactly_before(rows, pn.calendar(bars)).withColumn("in_universe", F.lit(True))
    panel = pn.with_positions(panel, v.positions_m(spark, d))
    return _show(sg.run_strategy("rsrs_momentum", panel, mode="exact"))


@query(
    "g02_alpha_hunter",
    _sql("CASE WHEN in_universe AND h >= 0.3 THEN h END", 15, "'multi-factor'", "h < -0.3", "'multi-factor score low'", src="hunted"),
    **PANEL, hunted=f"SELECT *, CASE WHEN bar_date IS NOT NULL THEN {HUNTER_SQL} END AS h FROM dp",
)
def g02(spark, d):
    return _show(sg.run_strategy("alpha_hunter", price_panel(spark, d)))


@query(
    "g03_rsrs_advanced",
    _sql("""CASE WHEN in_universe AND rsrs_r2 >= 0.7 AND rsrs_adaptive > 0.5
         AND NOT coalesce(vol_ratio < 1, false) THEN rsrs_adaptive END""", 10, "'rsrs, r2 and volume agree'",
         "rsrs_adaptive < -0.5", "'rsrs advanced exit'"),
    **PANEL,
)
def g03(spark, d):
    return _show(sg.run_strategy("rsrs_advanced", price_panel(spark, d)))


@query(
    "g04_short_term",
    _sql("CASE WHEN in_universe AND mom > 0.03 THEN mom END", 5, "'short momentum'",
         "date - entry_date >= 7 OR mom < -0.03",
         "CASE WHEN date - entry_date >= 7 THEN 'held too long' ELSE 'momentum reversed' END"),
    **PRICE_PANEL,
)
def g04(spark, d):
    return _show(sg.run_strategy("short_term", price_panel(spark, d)))


REGIME = dict(
    moded="""SELECT d.*, g.regime, CASE WHEN in_universe THEN CASE WHEN g.regime = 'bull' AND mom > 0 THEN mom
        WHEN g.regime <> 'bull' AND mom < -0.05 THEN -mom END END AS pick FROM dp d JOIN (
      SELECT date, CASE WHEN avg(lb) > 0 THEN 'bull' WHEN avg(lb) IS NULL THEN 'neutral' ELSE 'bear' END AS regime
      FROM dp GROUP BY date) g USING (date)""",
)


@query(
    "g05_momentum_reversal",
    _sql("pick", 10, "regime || ' mode'", "pick IS NULL", "'mode switch ' || regime", src="moded"),
    **PANEL, **REGIME,
)
def g05(spark, d):
    return _show(sg.run_strategy("momentum_reversal", price_panel(spark, d)))


@query(
    "g06_sentiment_reversal",
    _sql("CASE WHEN in_universe AND rsrs_zscore < -1.5 THEN -rsrs_zscore END", 10, "'oversold'",
         "rsrs_zscore > 1.5", "'overbought exit'"),
    **PANEL,
)
def g06(spark, d):
    return _show(sg.run_strategy("sentiment_reversal", price_panel(spark, d)))


def _micro(breach: str) -> dict[str, str]:
    return dict(
        PANEL,
        worn=f"""SELECT p.*, CASE WHEN in_universe AND n_rows >= 20 THEN micro END AS pick, {breach} AS breach FROM dp p
      JOIN (SELECT date, coalesce(count(*) FILTER (ret <= -0.095) / nullif(count(ret), 0), 0.0) AS share
        FROM dp GROUP BY date) b USING (date)""",
    )


MICRO_SQL = _sql(
    "CASE WHEN NOT breach THEN pick END", 15, "'microstructure'",
    "CASE WHEN breach THEN coalesce(ret <= -0.09, false) ELSE pick IS NULL OR pick < -0.3 END",
    "CASE WHEN breach THEN 'breadth breaker' ELSE 'microstructure worn' END", src="worn", above="s > 0.1",
)


@query("g07_microstructure", MICRO_SQL, **_micro("share > 0.15"))
def g07(spark, d):
    return _show(sg.run_strategy("kunpeng_v10", decision_panel(spark, d)))


@query("g07_microstructure_no_breaker", MICRO_SQL, **_micro("false"))
def g07_open(spark, d):
    return _show(sg.run_strategy("kunpeng_v10", decision_panel(spark, d), use_breadth_check=False))


@query(
    "g07_microstructure_windows", MICRO_SQL,
    **{
        k: x.replace("9 PRECEDING AND", "2 PRECEDING AND").replace("18 PRECEDING AND", "8 PRECEDING AND") if k in MICRO else x.replace("n_rows >= 20 THEN micro", "n_rows >= 10 THEN micro")
        for k, x in _micro("share > 0.15").items()
    },
)
def g07_windows(spark, d):
    """Windows of 3 and 10 rows instead of 10 and 20."""
    own = {"smart_window": 3, "illiq_window": 10}
    return _show(sg.run_strategy("kunpeng_v10", decision_panel(spark, d, **own), **own))


def _z(c: str) -> str:
    return (f"CASE WHEN stddev_samp({c}) OVER w > 1e-9 THEN ({c} - avg({c}) OVER w) "
            f"/ (stddev_samp({c}) OVER w + 1e-9) ELSE 0.0 END")


MULTI_SQL = dict(
    PANEL,
    inputs="""SELECT p.date, p.code, p.held, p.cmom, p.rev, p.liq, p.resvol,
      CASE WHEN abs(f.pe_ttm) > 1e-6 THEN 1 / f.pe_ttm ELSE 0 END AS ep, coalesce(f.net_profit_growth, 0) AS growth,
      coalesce(f.roe_ttm, 0) AS quality FROM dp p LEFT JOIN fundamentals f USING (code)
      WHERE in_universe AND n_rows >= 20""",
    scored=f"""SELECT date, code, held, ({_z('ep')} * 0.2 + {_z('growth')} * 0.15 + {_z('cmom')} * 0.15
      + {_z('quality')} * 0.2 + {_z('rev')} * 0.1 + {_z('liq')} * 0.1 + {_z('resvol')} * 0.1) / 1.0 AS multi
      FROM inputs WINDOW w AS (PARTITION BY date)""",
    judged="""SELECT p.date, p.code, p.held, s.multi FROM dp p LEFT JOIN scored s USING (date, code)""",
)


@query(
    "g08_multi_factor",
    _sql("multi", 20, "'multi-factor composite'", "coalesce(multi < -0.5, true)", "'composite low'", src="judged", above="s > 0.3"),
    **MULTI_SQL,
)
def g08(spark, d):
    panel = decision_panel(spark, d).join(v.fundamentals(spark, d), "code", "left")
    return _show(sg.run_strategy("alpha_max_v5_fixed", panel))


BLEND = dict(
    PANEL,
    sector_asof="""SELECT c.date, f.sector_name, f.sector_mom FROM (
      SELECT *, coalesce(lead(fi) OVER (PARTITION BY sector_name ORDER BY fi), 1000000) AS nxt FROM (
        SELECT s.*, k.idx AS fi FROM sector_mom s JOIN calendar k USING (date))) f
      JOIN calendar c ON c.idx > f.fi AND c.idx <= f.nxt""",
    blended="""SELECT p.*, CASE WHEN in_universe AND (held OR rsrs_adaptive > 0.5) THEN
      CASE WHEN i.sector_name IS NOT NULL THEN 0.7 * rsrs_adaptive + 0.3 * coalesce(s.sector_mom, 0)
      ELSE rsrs_adaptive END END AS blend FROM dp p LEFT JOIN industry i USING (code)
      LEFT JOIN sector_asof s ON s.sector_name = i.sector_name AND s.date = p.date""",
)


@query(
    "g09_sector_blend",
    _sql("CASE WHEN blend > 0.5 THEN blend END", 10, "'rsrs with sector'", "blend < -0.5", "'rsrs with sector exit'",
         src="blended", held_first=True),
    **BLEND,
)
def g09(spark, d):
    bars = v.stored_m(spark, d)
    panel = with_sector(price_panel(spark, d, bars), spark, d, bars)
    return _show(sg.run_strategy("sector_momentum", panel))


@query(
    "g09_sector_blend_window",
    _sql("CASE WHEN blend > 0.5 THEN blend END", 10, "'rsrs with sector'", "blend < -0.5", "'rsrs with sector exit'",
         src="blended", held_first=True),
    **{k: x.replace('lag("close", 20)', 'lag("close", 5)') if k == "sector_mom" else x for k, x in BLEND.items()},
)
def g09_window(spark, d):
    """Sector momentum over 5 rows instead of 20."""
    bars = v.stored_m(spark, d)
    panel = with_sector(price_panel(spark, d, bars), spark, d, bars, 5)
    return _show(sg.run_strategy("sector_momentum", panel, sector_momentum_window=5))


def _param_rows() -> str:
    rows = [
        f"('{n}', '{k}', '{type(x).__name__}', '{str(x).lower() if isinstance(x, bool) else x}')"
        for n, ps in sg.PARAMS.items() for k, x in ps.items()
    ]
    return ", ".join(rows)


#: Score, top n, source and the other arguments of each strategy's buys.
BUYS = {
    "rsrs_momentum": ("CASE WHEN in_universe AND rsrs_adaptive > 0.5 THEN rsrs_adaptive END", 10, {}),
    "alpha_hunter": ("CASE WHEN in_universe AND h >= 0.3 THEN h END", 15, {"src": "hunted"}),
    "rsrs_advanced": ("""CASE WHEN in_universe AND rsrs_r2 >= 0.7 AND rsrs_adaptive > 0.5
      AND NOT coalesce(vol_ratio < 1, false) THEN rsrs_adaptive END""", 10, {}),
    "short_term": ("CASE WHEN in_universe AND mom > 0.03 THEN mom END", 5, {}),
    "momentum_reversal": ("pick", 10, {"src": "moded"}),
    "sentiment_reversal": ("CASE WHEN in_universe AND rsrs_zscore < -1.5 THEN -rsrs_zscore END", 10, {}),
    "kunpeng_v10": ("CASE WHEN NOT breach THEN pick END", 15, {"src": "worn", "above": "s > 0.1"}),
    "alpha_max_v5_fixed": ("multi", 20, {"src": "judged", "above": "s > 0.3"}),
    "sector_momentum": ("CASE WHEN blend > 0.5 THEN blend END", 10, {"src": "blended", "held_first": True}),
}


def _count_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS strategy, count(*) AS n FROM ({_sql(score, n, repr(''), 'false', repr(''), **more)})"
        for name, (score, n, more) in BUYS.items()
    )


@query(
    "g10_parametrised_signals",
    f"""SELECT p.strategy, p.param, p.type, p."default", s.n AS buys FROM (VALUES {_param_rows()})
      p(strategy, param, type, "default") JOIN ({_count_sql()}) s ON p.strategy = s.strategy""",
    **{**MULTI_SQL, **BLEND, **_micro("share > 0.15"), **REGIME, "hunted": f"SELECT *, CASE WHEN bar_date IS NOT NULL THEN {HUNTER_SQL} END AS h FROM dp"},
)
def g10(spark, d):
    """Every strategy's parameters next to the number of buys they lead to."""
    bars = v.stored_m(spark, d)
    panel = with_sector(decision_panel(spark, d, bars), spark, d, bars).join(v.fundamentals(spark, d), "code", "left")
    signals = sg.run_many(panel, {name: (name, {}) for name in BUYS}).groupBy("strategy")
    return sg.parameter_table(spark).join(signals.agg(F.count_if(F.col("side") == "BUY").alias("buys")), "strategy")


def _grid_sql() -> str:
    parts = []
    for label, t in (("strict", 1.0), ("default", 0.5), ("loose", 0.2)):
        sql = _sql(f"CASE WHEN in_universe AND rsrs_adaptive > {t} THEN rsrs_adaptive END", 10, "''",
                   f"rsrs_adaptive < -{t}", "''")
        parts.append(f"SELECT '{label}' AS run, date, side, count(*) AS signals FROM ({sql}) GROUP BY ALL")
    return " UNION ALL ".join(parts)


@query("g11_strategy_grid", _grid_sql(), **PANEL)
def g11(spark, d):
    """One strategy under three thresholds over one panel: signals per run, date and side."""
    runs = {
        "strict": ("rsrs_momentum", {"rsrs_threshold": 1.0}),
        "default": ("rsrs_momentum", {}),
        "loose": ("rsrs_momentum", {"rsrs_threshold": 0.2}),
    }
    return sg.run_many(price_panel(spark, d), runs).groupBy("run", "date", "side").agg(
        F.count(F.lit(1)).alias("signals")
    )


#: Fifty parameter sets: ten thresholds by five sizes.
GRID = {f"{t}/{n}": {"rsrs_threshold": t / 10, "top_n": n} for t in range(10) for n in (1, 3, 10, 40, 100)}
HOLDING_GRID = {f"{t}/{h}": {"mom_threshold": t / 100, "hold_calendar_days": h, "top_n": 5 + t} for t in (0, 3, 9) for h in (3, 7, 30)}


def _run_grid_sql(sets: dict, keys: tuple[str, ...], score: str, above: str, sell: str) -> str:
    rows = ", ".join(f"('{label}', {', '.join(str(p[k]) for k in keys)})" for label, p in sets.items())
    return f"""SELECT run, date, side, count(*) AS signals, round(sum(weight), 6) + 0.0 AS weight FROM (
      SELECT run, date, code, 'BUY' AS side, weight, held FROM (SELECT *, 1.0 / count(*) OVER (PARTITION BY run, date) AS weight FROM (
        SELECT *, row_number() OVER (PARTITION BY run, date ORDER BY s DESC, code) AS rk FROM (
          SELECT g.*, d.date, d.code, d.held, {score} AS s FROM dp d JOIN grid g ON true) WHERE {above}) WHERE rk <= top_n) WHERE NOT held
      UNION ALL SELECT run, date, code, 'SELL', 0.0, held FROM dp JOIN grid ON true WHERE held AND ({sell})) GROUP BY ALL""", f"SELECT * FROM (VALUES {rows}) t(run, {', '.join(keys)})"


def _grid_query(name: str, sets: dict, *how: str):
    sql, rows = _run_grid_sql(sets, tuple(next(iter(sets.values()))), *how)
    return query(name, sql, **PRICE_PANEL, grid=rows)


def _show_grid(signals):
    return signals.groupBy("run", "date", "side").agg(F.count(F.lit(1)).alias("signals"), r(F.sum("weight")).alias("weight"))


@_grid_query(
    "g11_threshold_grid", GRID, "CASE WHEN in_universe THEN rsrs_adaptive END", "s > rsrs_threshold", "rsrs_adaptive < -rsrs_threshold"
)
def g11_thresholds(spark, d):
    """Fifty sets of one strategy over one scan and one sort of the panel."""
    return _show_grid(sg.run_grid(price_panel(spark, d), "rsrs_momentum", GRID))


@_grid_query(
    "g11_holding_grid", HOLDING_GRID, "CASE WHEN in_universe THEN mom END", "s > mom_threshold",
    "coalesce(date_diff('day', entry_date, date) >= hold_calendar_days, false) OR mom < -mom_threshold",
)
def g11_holding(spark, d):
    return _show_grid(sg.run_grid(price_panel(spark, d), "short_term", HOLDING_GRID))
