"""Sections 2.4 (calendar, as-of and lookup joins) and 2.7 (cross-section, top-k)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.num import r
from tickloom.operators import cross_section as cs
from tickloom.operators import factors as fx
from tickloom.operators import panel as pn
from tickloom.operators import signals as sg
from tickloom.plans import views as v
from tickloom.plans.catalog.registry import query
from tickloom.plans.signal_panel import FILLED
from tickloom.session import cut_lineage


def _factors(spark, d, bars=None):
    return fx.factor_panel(bars if bars is not None else v.bars_m(spark, d))


def _filled(spark, d):
    return fx.forward_fill(_factors(spark, d), FILLED)


def _narrow(spark, d):
    """The scored factors, computed once: a date's mean and the rows themselves both read them."""
    return cut_lineage(_filled(spark, d).select("code", "date", *UNIVERSE_WEIGHTS))


# ------------------------------------------------------------------ cross-section

ZS = dict(
    zs="""SELECT *, CASE WHEN stddev_samp(mom) OVER w > 1e-9 THEN (mom - avg(mom) OVER w) / stddev_samp(mom) OVER w ELSE 0.0 END AS mom_z,
     CASE WHEN stddev_samp(vol_factor) OVER w > 1e-9 THEN (vol_factor - avg(vol_factor) OVER w) / stddev_samp(vol_factor) OVER w ELSE 0.0 END AS vol_factor_z,
     CASE WHEN stddev_samp(rsrs_adaptive) OVER w > 1e-9 THEN (rsrs_adaptive - avg(rsrs_adaptive) OVER w) / stddev_samp(rsrs_adaptive) OVER w ELSE 0.0 END AS rsrs_adaptive_z
     FROM filled WINDOW w AS (PARTITION BY date)""",
    comp="SELECT *, (rsrs_adaptive_z * 0.4 + mom_z * 0.3 + vol_factor_z * 0.3) / 1.0 AS score FROM zs",
    flag="""SELECT *, CASE WHEN stddev_samp(mom) OVER w > 1e-9 THEN (mom - avg(mom) OVER w) / stddev_samp(mom) OVER w ELSE 0.0 END AS a,
     CASE WHEN stddev_samp(vol_factor) OVER w > 1e-9 THEN (vol_factor - avg(vol_factor) OVER w) / stddev_samp(vol_factor) OVER w ELSE 0.0 END AS b,
     CASE WHEN stddev_samp(vol_ratio) OVER w > 1e-9 THEN (vol_ratio - avg(vol_ratio) OVER w) / stddev_samp(vol_ratio) OVER w ELSE 0.0 END AS c
     FROM factors WINDOW w AS (PARTITION BY date)""",
)
UNIVERSE_WEIGHTS = {"rsrs_adaptive": 0.4, "mom": 0.3, "vol_factor": 0.3}
FLAGSHIP_WEIGHTS = {"mom": 0.5, "vol_factor": 0.3, "vol_ratio": 0.2}


@query(
    "flagship_top_composite",
    """SELECT date, code, rank::INT AS rank, round(score, 6) + 0.0 AS score, round(1.0 / count(*) OVER (PARTITION BY date), 6) AS weight FROM (
      SELECT date, code, s AS score, row_number() OVER (PARTITION BY date ORDER BY s DESC, code) AS rank FROM (
        SELECT date, code, a * 0.5 + b * 0.3 + c * 0.2 AS s FROM flag) WHERE s IS NOT NULL) WHERE rank <= 10""",
    **ZS,
)
def flagship(spark, d):
    """Top 10 codes per month by momentum, low volatility and volume ratio."""
    bars = fx.daily_return(fx.momentum(v.bars_m(spark, d)))
    rows = cut_lineage(fx.volume_ratio(fx.volatility(bars)).select("code", "date", *FLAGSHIP_WEIGHTS))
    scored = cs.zscores(rows, list(FLAGSHIP_WEIGHTS)).withColumn("score", cs.composite(FLAGSHIP_WEIGHTS, "_z"))
    best = cs.top_n(scored, "score", 10)
    return best.select("date", "code", "rank", r("score").alias("score"), r("weight").alias("weight"))


@query(
    "c01_cross_section_zscore",
    """SELECT code, date, round(mom_z, 6) + 0.0 AS mom_z, round(vol_factor_z, 6) + 0.0 AS vol_factor_z,
    round(rsrs_adaptive_z, 6) + 0.0 AS rsrs_adaptive_z FROM zs""",
    **ZS,
)
def c01(spark, d):
    out = cs.zscores(_narrow(spark, d), list(UNIVERSE_WEIGHTS))
    return out.select("code", "date", *[r(f"{c}_z").alias(f"{c}_z") for c in UNIVERSE_WEIGHTS])


@query(
    "c01_cross_section_zscore_eps",
    """SELECT code, date, round(CASE WHEN stddev_samp(ret) OVER w > 1e-9
      THEN (ret - avg(ret) OVER w) / (stddev_samp(ret) OVER w + 1e-9) ELSE 0.0 END, 6) + 0.0 AS ret_z
    FROM ret WINDOW w AS (PARTITION BY date)""",
)
def c01_eps(spark, d):
    rows = fx.daily_return(v.bars_m(spark, d)).select("code", "date", "ret")
    return cs.zscores(rows, ["ret"], eps=1e-9).select("code", "date", r("ret_z").alias("ret_z"))


@query("c02_weighted_composite", "SELECT code, date, round(score, 6) + 0.0 AS score FROM comp", **ZS)
def c02(spark, d):
    out = cs.zscores(_narrow(spark, d), list(UNIVERSE_WEIGHTS))
    return out.select("code", "date", r(cs.composite(UNIVERSE_WEIGHTS, "_z")).alias("score"))


HUNTER_SQL = """CASE WHEN rsrs_adaptive IS NULL AND mom IS NULL AND vol_factor IS NULL THEN 0.0 ELSE
   (coalesce(rsrs_adaptive * 0.5, 0) + coalesce(mom * 0.3, 0) + coalesce(vol_factor * 0.2, 0))
   / (CASE WHEN rsrs_adaptive IS NULL THEN 0.0 ELSE 0.5 END + CASE WHEN mom IS NULL THEN 0.0 ELSE 0.3 END
      + CASE WHEN vol_factor IS NULL THEN 0.0 ELSE 0.2 END) END"""


@query("c03_renormalised_score", f"SELECT code, date, round({HUNTER_SQL}, 6) + 0.0 AS score FROM factors")
def c03(spark, d):
    return _factors(spark, d).select("code", "date", r(cs.renormalised(sg.HUNTER_WEIGHTS)).alias("score"))


@query(
    "c04_top_n_equal_weight",
    """SELECT date, code, rank::INT AS rank, round(1.0 / count(*) OVER (PARTITION BY date), 6) AS weight FROM (
      SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY mom DESC, code) AS rank
      FROM factors WHERE mom IS NOT NULL) WHERE rank <= 10""",
)
def c04(spark, d):
    best = cs.top_n(fx.momentum(v.bars_m(spark, d)), "mom", 10)
    return best.select("date", "code", "rank", r("weight").alias("weight"))


@query(
    "c05_score_ranking",
    """SELECT date, code, round(score, 6) + 0.0 AS score FROM comp WHERE score IS NOT NULL
    AND date = (SELECT max(date) FROM bars_m) ORDER BY score DESC, code""",
    **ZS,
)
def c05(spark, d):
    """The whole universe on the latest date, best first."""
    rows = _narrow(spark, d)
    newest = rows.agg(F.max("date").alias("date"))
    out = cs.zscores(rows.join(newest, "date"), list(UNIVERSE_WEIGHTS))
    scored = out.withColumn("score", cs.composite(UNIVERSE_WEIGHTS, "_z")).filter("score IS NOT NULL")
    return cs.ranked(scored.select("date", "code", r("score").alias("score")), "score")


@query(
    "c06_daily_factor_matrix",
    """SELECT date, code, factor, round(value, 6) + 0.0 AS value FROM (
      SELECT date, code, unnest(['rsrs_adaptive','mom','vol_factor','vol_ratio']) AS factor,
        unnest([rsrs_adaptive, mom, vol_factor, vol_ratio]) AS value FROM factors) WHERE value IS NOT NULL""",
)
def c06(spark, d):
    cols = ["rsrs_adaptive", "mom", "vol_factor", "vol_ratio"]
    bars = v.stored_m(spark, d)
    grid = pn.align(_factors(spark, d, bars), pn.calendar(bars))
    cells = cs.factor_map(grid, cols).select("date", "code", F.explode("scores").alias("factor", "value"))
    return cells.withColumn("value", r("value"))


@query(
    "c07_first_codes_recent_rows",
    """SELECT portfolio, ts, round(total_value, 7) + 0.0 AS total_value FROM (
      SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY ts DESC) AS n FROM equity
      WHERE portfolio IN (SELECT DISTINCT l_suppkey FROM lineitem ORDER BY 1 LIMIT 50)) WHERE n <= 20""",
)
def c07(spark, d):
    """The last 20 rows of the curves of the first 50 codes."""
    from pyspark.sql import Window

    curve = v.equity(spark, d)
    first = curve.select("portfolio").distinct().orderBy("portfolio").limit(50)
    back = Window.partitionBy("portfolio").orderBy(F.col("ts").desc())
    out = curve.join(first, "portfolio", "left_semi").withColumn("n", F.row_number().over(back))
    return out.filter("n <= 20").select("portfolio", "ts", r("total_value", 7).alias("total_value"))


@query(
    "c08_peak_and_trough",
    """SELECT portfolio, arg_max(ts, (total_value, -epoch(ts))) AS peak_ts, round(max(total_value), 7) + 0.0 AS peak,
    arg_min(ts, (total_value, epoch(ts))) AS trough_ts, round(min(total_value), 7) + 0.0 AS trough FROM equity GROUP BY ALL""",
)
def c08(spark, d):
    out = cs.peak_and_trough(v.equity(spark, d), "portfolio", "ts", "total_value")
    return out.withColumns({"peak": r("peak", 7), "trough": r("trough", 7)})


# ------------------------------------------------------------------ joins


@query(
    "j04_latest_factor_until",
    """SELECT code, round(max_by(mom, date), 6) + 0.0 AS mom FROM factors
    WHERE mom IS NOT NULL AND date <= DATE '1999-06-15' GROUP BY code""",
)
def j04(spark, d):
    out = pn.latest_factor(_factors(spark, d), "mom", until=F.lit("1999-06-15").cast("date"))
    return out.select("code", r("mom").alias("mom"))


@query(
    "j04_latest_factor_positional",
    """SELECT code, round(max_by(mom, date), 6) + 0.0 AS mom FROM (SELECT *,
      row_number() OVER (PARTITION BY code ORDER BY date) AS n FROM factors WHERE mom IS NOT NULL)
    WHERE n <= 24 GROUP BY code""",
)
def j04_positional(spark, d):
    return pn.latest_factor(_factors(spark, d), "mom", first_n=24).select("code", r("mom").alias("mom"))


@query(
    "j04_asof_join",
    """SELECT t.code, t.l_orderkey, t.l_linenumber, t.day, round(t.qty, 2) AS qty, round(f.mom, 6) + 0.0 AS mom
    FROM trades t LEFT JOIN filled f ON f.code = t.code AND f.date = date_trunc('month', t.day)""",
)
def j04_join(spark, d):
    """Every trade with the latest momentum at or before its day."""
    probes = v.trades(spark, d).select(
        "code", F.col("day").alias("date"), "l_orderkey", "l_linenumber", "qty"
    )
    out = pn.asof_join(probes, _factors(spark, d), ["mom"])
    return out.select("code", "l_orderkey", "l_linenumber", F.col("date").alias("day"), "qty", r("mom").alias("mom"))


@query(
    "j05_asof_before",
    """SELECT date, code, bar_date, idx = nxt AS in_universe, round(mom, 6) + 0.0 AS mom,
    round(rsrs_adaptive, 6) + 0.0 AS rsrs_adaptive FROM asof_before""",
)
def j05(spark, d):
    bars = v.stored_m(spark, d)
    out = pn.asof_factors(_factors(spark, d, bars), pn.calendar(bars), FILLED)
    return out.select("date", "code", "bar_date", "in_universe", r("mom").alias("mom"), r("rsrs_adaptive").alias("rsrs_adaptive"))


DAILY = dict(
    cal_d="SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM bars_d)",
    grid_d="SELECT DISTINCT b.code, c.date, c.idx FROM (SELECT DISTINCT code FROM bars_d) b CROSS JOIN cal_d c",
)


@query("j06_trading_calendar", "SELECT date, idx::INT AS idx FROM cal_d", **DAILY)
def j06(spark, d):
    return pn.calendar(v.bars_d(spark, d)).select("date", "idx")


@query(
    "j07_calendar_alignment",
    """SELECT g.code, g.date, g.idx::INT AS idx, round(b."close", 7) + 0.0 AS "close", coalesce(b.volume, 0) AS volume
    FROM grid_d g LEFT JOIN bars_d b USING (code, date)""",
    **DAILY,
)
def j07(spark, d):
    bars = v.stored_d(spark, d)
    out = pn.align(bars.select("code", "date", "close", "volume"), pn.calendar(bars))
    return out.select("code", "date", "idx", r("close", 7).alias("close"), "volume")


@query(
    "j08_exactly_previous_day",
    """SELECT c.date, b.code, b.date AS bar_date, round(b."close", 7) + 0.0 AS "close" FROM bars_d b
    JOIN cal_d p ON p.date = b.date JOIN cal_d c ON c.idx = p.idx + 1""",
    **DAILY,
)
def j08(spark, d):
    bars = v.stored_d(spark, d)
    out = pn.exactly_before(bars.select("code", "date", "close"), pn.calendar(bars))
    return out.select("date", "code", "bar_date", r("close", 7).alias("close"))


@query(
    "j09_sector_lookup",
    """SELECT b.code, b.date, s.sector_name FROM bars_m b JOIN concept s USING (code)""",
)
def j09(spark, d):
    """Every bar with every sector of its code."""
    return v.bars_m(spark, d).join(v.concept(spark, d), "code").select("code", "date", "sector_name")


@query("j09_sector_members", "SELECT sector_name, count(*) AS members, min(code) AS first_code FROM concept GROUP BY ALL")
def j09_members(spark, d):
    return v.concept(spark, d).groupBy("sector_name").agg(
        F.count(F.lit(1)).alias("members"), F.min("code").alias("first_code")
    )


@query(
    "j10_market_alignment",
    """SELECT r.code, r.date, round(r.ret, 6) + 0.0 AS ret, round(m.mkt, 6) + 0.0 AS mkt_ret FROM ret r
    JOIN mret m USING (date) WHERE r.ret IS NOT NULL AND m.mkt IS NOT NULL""",
    mret='SELECT date, "close" / nullif(lag("close") OVER (ORDER BY date), 0) - 1 AS mkt FROM market_m',
)
def j10(spark, d):
    bars = v.stored_m(spark, d)
    out = pn.with_market_return(bars, v.market_series(bars))
    return out.select("code", "date", r("ret").alias("ret"), r("mkt_ret").alias("mkt_ret"))


@query(
    "j11_attach_fundamentals",
    """SELECT b.code, b.date, round(coalesce(f.roe_ttm, 0), 6) + 0.0 AS roe_ttm,
    round(coalesce(f.net_profit_growth, 0), 6) + 0.0 AS net_profit_growth
    FROM bars_m b LEFT JOIN (SELECT * FROM fundamentals WHERE roe_ttm > 0) f USING (code)""",
)
def j11(spark, d):
    facts = v.fundamentals(spark, d).filter("roe_ttm > 0")
    out = pn.attach(v.bars_m(spark, d), facts, ["roe_ttm", "net_profit_growth"])
    return out.select("code", "date", r("roe_ttm").alias("roe_ttm"), r("net_profit_growth").alias("net_profit_growth"))


@query(
    "j12_next_bar_execution",
    """SELECT s.date, s.code, n.date AS exec_date, round(coalesce(b."open", b."close"), 7) + 0.0 AS exec_price FROM (
      SELECT date, code FROM bars_d WHERE "close" > "open") s
    JOIN cal_d c USING (date) JOIN cal_d n ON n.idx = c.idx + 1
    JOIN bars_d b ON b.code = s.code AND b.date = n.date WHERE coalesce(b."open", b."close") > 0""",
    **DAILY,
)
def j12(spark, d):
    """Every up day as a signal, filled at the next day's open when the code trades then."""
    bars = v.stored_d(spark, d)
    signals = bars.filter("close > open").select("date", "code")
    out = pn.next_bar_price(signals, bars, pn.calendar(bars))
    return out.select("date", "code", "exec_date", r("exec_price", 7).alias("exec_price"))


@query(
    "j13_exclude_held",
    """SELECT date, code, round(mom, 6) + 0.0 AS mom FROM factors f WHERE mom > 0
    AND NOT EXISTS (SELECT 1 FROM positions_m p WHERE p.code = f.code AND p.date = f.date)""",
)
def j13(spark, d):
    rows = fx.momentum(v.bars_m(spark, d)).filter("mom > 0")
    return rows.join(v.positions_m(spark, d), ["date", "code"], "left_anti").select("date", "code", r("mom").alias("mom"))


@query(
    "j14_exit_candidates",
    """SELECT p.date, p.code, p.entry_date, round(a.mom, 6) + 0.0 AS mom FROM positions_m p
    JOIN asof_before a ON a.code = p.code AND a.date = p.date WHERE a.mom < 0""",
)
def j14(spark, d):
    """Held codes whose latest momentum before the decision is negative."""
    bars = v.stored_m(spark, d)
    panel = pn.asof_factors(fx.momentum(bars), pn.calendar(bars), ["mom"])
    out = v.positions_m(spark, d).join(panel.filter("mom < 0"), ["date", "code"])
    return out.select("date", "code", "entry_date", r("mom").alias("mom"))


@query(
    "j15_price_fallback",
    """SELECT e.event_id, e.user_id AS code, round(CASE WHEN e.value > 20 THEN e.value ELSE l.c END, 7) + 0.0 AS price
    FROM events e LEFT JOIN (SELECT code, max_by("close", date) AS c FROM bars_m GROUP BY code) l ON l.code = e.user_id""",
)
def j15(spark, d):
    """Live value where there is one above 20 (lower ones stand for a missing quote), else the last close."""
    last = pn.latest_row(v.bars_m(spark, d), ["close"])
    live = v.events(spark, d).select("event_id", F.col("user_id").alias("code"), F.when(F.col("value") > 20, F.col("value")).alias("q"))
    out = live.join(last, "code", "left")
    return out.select("event_id", "code", r(pn.price_or_close("q", "close"), 7).alias("price"))
