"""Section 2.9: portfolio analytics over trades, positions, bars and equity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.num import f32, r
from tickloom.operators import cross_section as cs
from tickloom.operators import factors as fx
from tickloom.operators import panel as pn
from tickloom.operators import portfolio as pf
from tickloom.operators import signals as sg
from tickloom.plans import views as v
from tickloom.plans.catalog import signal_queries  # noqa: F401  registers the signals compared below
from tickloom.plans.catalog.registry import ORACLES, query
from tickloom.plans.signal_panel import price_panel
from tickloom.session import cut_lineage

IDS = ["day", *v.TRADE_ORDER]
SHOW = ["code", "day", "l_orderkey", "l_linenumber", "l_partkey"]
SHOW_SQL = "code, day, l_orderkey, l_linenumber, l_partkey"

COSTS = dict(
    costs="""SELECT *, CASE WHEN side = 'BUY' THEN amount + fee + tax ELSE amount - fee - tax END AS net FROM (
      SELECT *, greatest(5.0, amount * 0.0003) AS fee, CASE WHEN side = 'BUY' THEN 0.0 ELSE amount * 0.001 END AS tax FROM (
      SELECT *, exec_price * qty AS amount FROM (
      SELECT *, CASE WHEN side = 'BUY' THEN price * (1 + 0.001) ELSE price * (1 - 0.001) END AS exec_price FROM trades)))"""
)


def _costs(spark, d):
    return pf.with_costs(v.trades(spark, d))


@query("p01_execution_price", f"SELECT {SHOW_SQL}, side, round(exec_price, 10) + 0.0 AS exec_price FROM costs", **COSTS)
def p01(spark, d):
    t = v.trades(spark, d)
    return t.select(*SHOW, "side", r(pf.execution_price("price"), 10).alias("exec_price"))


@query("p02_commission", f"SELECT {SHOW_SQL}, round(fee, 9) + 0.0 AS commission FROM costs", **COSTS)
def p02(spark, d):
    return _costs(spark, d).select(*SHOW, r("commission", 9).alias("commission"))


@query("p03_stamp_tax", f"SELECT {SHOW_SQL}, side, round(tax, 9) + 0.0 AS tax FROM costs", **COSTS)
def p03(spark, d):
    return _costs(spark, d).select(*SHOW, "side", r("tax", 9).alias("tax"))


@query("p04_net_amount", f"SELECT {SHOW_SQL}, side, CAST(CAST(net AS FLOAT) AS DOUBLE) AS net FROM costs", **COSTS)
def p04(spark, d):
    return _costs(spark, d).select(*SHOW, "side", f32("net").alias("net"))


@query(
    "p05_buy_lots",
    """SELECT o_orderkey, CASE WHEN b < p * 100 THEN 0 ELSE CAST(floor(b / p / 100) * 100 AS BIGINT) END AS shares,
    CAST(floor(o_totalprice * 0.1 / (p * 1.0005) / 100) * 100 AS BIGINT) AS live_shares FROM (
      SELECT *, least(least(w, 0.1) * o_totalprice * 20, o_totalprice) AS b, o_custkey / 7.0 + 3.1 AS p FROM (
      SELECT *, CASE o_orderstatus WHEN 'F' THEN 0.02 WHEN 'O' THEN 0.08 ELSE 0.5 END AS w FROM orders))""",
)
def p05(spark, d):
    """Orders as budgets: status gives the weight, the customer key a price."""
    w = F.when(F.col("o_orderstatus") == "F", 0.02).when(F.col("o_orderstatus") == "O", 0.08).otherwise(0.5)
    o = v.table(spark, d, "orders").withColumns({"w": w, "p": F.col("o_custkey") / 7.0 + 3.1})
    total = F.col("o_totalprice") * 20
    return o.select(
        "o_orderkey",
        pf.buy_lots("w", total, "o_totalprice", "p").alias("shares"),
        pf.live_lots("o_totalprice", "p").alias("live_shares"),
    )


BOOK = dict(
    run0="""SELECT *, CASE WHEN side = 'BUY' THEN qty ELSE 0 END AS buy, CASE WHEN side = 'BUY' THEN 0 ELSE qty END AS sell FROM trades""",
    run1="""SELECT *, sum(buy) OVER w AS run_buy, sum(sell) OVER w AS run_sell, sum(buy - sell) OVER w AS run
      FROM run0 WINDOW w AS (PARTITION BY code ORDER BY rn ROWS UNBOUNDED PRECEDING)""",
    run2="""SELECT *, least(min(run) OVER (PARTITION BY code ORDER BY rn ROWS UNBOUNDED PRECEDING), 0) AS short FROM run1""",
    booked="""SELECT *, run - short AS held, run_sell + short AS sold_upto, CASE WHEN side = 'BUY' THEN 0 ELSE qty
      - (coalesce(lag(short) OVER (PARTITION BY code ORDER BY rn), 0) - short) END AS covered FROM run2""",
    lots="""SELECT s.code, s.day, s.l_orderkey, s.l_linenumber, s.l_partkey, s.rn, s.covered,
      coalesce(sum(greatest(0, least(b.run_buy, s.sold_upto) - greatest(b.run_buy - b.qty, s.sold_upto - s.covered))
        * (s.price - b.price)), 0) AS pnl
      FROM (SELECT * FROM booked WHERE side = 'SELL') s LEFT JOIN (SELECT * FROM booked WHERE side = 'BUY') b
        ON b.code = s.code AND b.run_buy > s.sold_upto - s.covered AND b.run_buy - b.qty < s.sold_upto GROUP BY ALL""",
    cost="""SELECT code, rn, CASE WHEN side = 'BUY' THEN price ELSE 0.0 END AS avg_cost FROM booked WHERE rn = 1
      UNION ALL SELECT b.code, b.rn, CASE WHEN b.side = 'BUY'
        THEN c.avg_cost * (1 - b.qty / b.held) + b.price * (b.qty / b.held) ELSE c.avg_cost END
      FROM cost c JOIN booked b ON b.code = c.code AND b.rn = c.rn + 1""",
)


def _booked(spark, d):
    return pf.booked(v.trades(spark, d), v.TRADE_LEVELS, v.TRADE_ORDER)


def _fifo(spark, d):
    return pf.fifo_pnl(v.trades(spark, d), v.TRADE_LEVELS, v.TRADE_ORDER, IDS)


@query("p06_fifo_realised_pnl", f"SELECT {SHOW_SQL}, covered, CAST(CAST(pnl AS FLOAT) AS DOUBLE) + 0.0 AS pnl, CAST(sign(round(pnl, 4)) AS DOUBLE) + 0.0 AS win FROM lots", **BOOK)
def p06(spark, d):
    out = _fifo(spark, d)
    return out.select(*SHOW, "covered", f32("pnl").alias("pnl"), (F.signum(r("pnl", 4)) + 0.0).alias("win"))


@query("p07_average_cost", f"SELECT {SHOW_SQL}, held, CAST(CAST(avg_cost AS FLOAT) AS DOUBLE) AS avg_cost FROM booked JOIN cost USING (code, rn)", **BOOK)
def p07(spark, d):
    out = pf.average_cost(v.trades(spark, d), v.TRADE_LEVELS, v.TRADE_ORDER)
    return out.select(*SHOW, "held", f32("avg_cost").alias("avg_cost"))


MARK = dict(
    marked="""SELECT *, qty * c AS market_value, qty * c - cost * qty AS pnl,
      CASE WHEN cost * qty > 1e-9 THEN (qty * c - cost * qty) / (cost * qty) ELSE 0 END AS pnl_pct FROM (
      SELECT p.*, last_c AS c FROM positions_m p LEFT JOIN (SELECT date, code, "close" AS last_c, lead(date)
        OVER (PARTITION BY code ORDER BY date) AS until FROM bars_m) b
      ON b.code = p.code AND b.date <= p.date AND (b.until IS NULL OR b.until > p.date))"""
)


def _marked(spark, d):
    return pf.mark_to_market(v.positions_m(spark, d), v.bars_m(spark, d))


@query(
    "p08_mark_to_market",
    """SELECT date, code, CAST(CAST(market_value AS FLOAT) AS DOUBLE) AS market_value, CAST(CAST(pnl AS FLOAT) AS DOUBLE) + 0.0 AS pnl,
    round(pnl_pct, 6) + 0.0 AS pnl_pct FROM marked""",
    **MARK,
)
def p08(spark, d):
    out = _marked(spark, d)
    return out.select("date", "code", f32("market_value").alias("market_value"), f32("pnl").alias("pnl"), r("pnl_pct").alias("pnl_pct"))


@query(
    "p09_total_market_value",
    """SELECT m.date, round(sum(CASE WHEN b.volume < 150 THEN m.market_value * 0.98 ELSE m.market_value END), 3) + 0.0 AS market_value
    FROM marked m LEFT JOIN bars_m b USING (date, code) GROUP BY m.date""",
    **MARK,
)
def p09(spark, d):
    """Months with a volume under 150 count as suspended."""
    thin = v.bars_m(spark, d).filter("volume < 150")
    return pf.total_market_value(_marked(spark, d), thin).select("date", r("market_value", 3).alias("market_value"))


@query(
    "p10_trailing_watermark",
    """SELECT p.date, p.code, round(greatest(p.cost, max(b."close")), 7) + 0.0 AS watermark FROM positions_m p
    LEFT JOIN bars_m b ON b.code = p.code AND b.date > p.entry_date GROUP BY p.date, p.code, p.cost""",
)
def p10(spark, d):
    out = pf.watermarks(v.positions_m(spark, d), v.bars_m(spark, d))
    return out.select("date", "code", r("watermark", 7).alias("watermark"))


def _exit_sql(bars: int) -> str:
    """The watermark follows closes after the entry day; an exit may come from the given bar after it."""
    return f"""SELECT {SHOW_SQL}, exit_event, exit_date, round(exit_price, 7) + 0.0 AS exit_price FROM (
      SELECT e.*, arg_min(x.event, x.d) AS exit_event, min(x.d) AS exit_date, arg_min(x.p, x.d) AS exit_price FROM
      (SELECT {SHOW_SQL}, rn FROM trades WHERE side = 'BUY') e LEFT JOIN (
        SELECT code, rn, d, p, CASE WHEN k < {bars} THEN NULL WHEN (p - cost) / cost <= -0.1 THEN 'stop_loss' WHEN (p - cost) / cost >= 0.2 THEN 'take_profit'
          WHEN wm > cost AND (wm - p) / wm >= 0.05 THEN 'trailing_stop' END AS event FROM (
          SELECT t.code, t.rn, t.price AS cost, b.date AS d, b."close" AS p, greatest(t.price, max(CASE WHEN b.date > t.day THEN b."close" END)
            OVER (PARTITION BY t.code, t.rn ORDER BY b.date ROWS UNBOUNDED PRECEDING)) AS wm,
            count(CASE WHEN b.date > t.day THEN 1 END) OVER (PARTITION BY t.code, t.rn ORDER BY b.date ROWS UNBOUNDED PRECEDING) AS k
          FROM trades t JOIN bars_m b ON b.code = t.code AND b.date >= t.day WHERE t.side = 'BUY')) x
      ON x.code = e.code AND x.rn = e.rn AND x.event IS NOT NULL GROUP BY ALL)"""


def _entries(spark, d):
    return v.trades(spark, d).filter("side = 'BUY'").select(
        *SHOW, F.col("day").alias("entry_date"), F.col("price").alias("cost")
    )


def _exits(spark, d, bars):
    out = pf.exit_scan(_entries(spark, d), v.bars_m(spark, d), min_holding_bars=bars)
    return out.select(*SHOW, "exit_event", "exit_date", r("exit_price", 7).alias("exit_price"))


@query("p11_exit_scan", _exit_sql(1))
def p11(spark, d):
    """Every buy with the first monthly close that meets an exit rule."""
    return _exits(spark, d, 1)


@query("p11_exit_scan_same_day", _exit_sql(0))
def p11_same_day(spark, d):
    return _exits(spark, d, 0)


@query("p11_exit_scan_two_bars", _exit_sql(2))
def p11_two_bars(spark, d):
    return _exits(spark, d, 2)


@query(
    "p12_live_exits",
    """SELECT event_id, code, event, round(pnl_pct, 6) + 0.0 AS pnl_pct FROM (SELECT *, (price - cost) / cost AS pnl_pct,
      CASE WHEN (price - cost) / cost <= -0.08 THEN 'stop_loss' WHEN (price - cost) / cost >= 0.2 THEN 'take_profit'
       WHEN wm > 0 AND (wm - price) / wm >= 0.05 THEN 'trailing_stop' END AS event FROM (
      SELECT q.*, c.cost, greatest(c.cost, max(q.price) OVER (PARTITION BY q.code ORDER BY q.ts, q.event_id ROWS UNBOUNDED PRECEDING)) AS wm
      FROM quotes q JOIN (SELECT s_suppkey AS code, s_acctbal / 100 AS cost FROM supplier WHERE s_acctbal > 0) c USING (code)))
    WHERE event IS NOT NULL""",
)
def p12(spark, d):
    """Quotes against holdings costed at a hundredth of the supplier's balance."""
    held = v.table(spark, d, "supplier").filter("s_acctbal > 0").select(
        F.col("s_suppkey").alias("code"), (F.col("s_acctbal") / 100).alias("cost")
    ).withColumn("watermark", F.col("cost"))
    q = v.quotes(spark, d).withColumns({"day": F.to_date("ts"), "hour": F.date_trunc("hour", F.col("ts"))})
    out = pf.live_exits(held, q, ["day", "hour"], ["ts", "event_id"])
    return out.select("event_id", "code", "event", r("pnl_pct").alias("pnl_pct"))


@query(
    "p13_equity_curve",
    """SELECT date, round(cash, 2) + 0.0 AS cash, round(mv, 2) + 0.0 AS market_value, round(cash + mv, 2) + 0.0 AS total_value FROM (
    SELECT k.date, 1e9 + sum(coalesce(f.flow, 0)) OVER (ORDER BY k.date) AS cash, coalesce(mv, 0) AS mv
    FROM calendar k LEFT JOIN flows f USING (date) LEFT JOIN val v USING (date))""",
    **BOOK,
    dated="SELECT *, CAST(date_trunc('month', day) AS DATE) AS date FROM booked",
    fees="""SELECT *, price * CASE WHEN side = 'BUY' THEN (1 + 0.001) * qty ELSE (1 - 0.001) * covered END AS amount FROM dated""",
    flows="""SELECT date, sum(CASE WHEN side = 'BUY' THEN -(amount + greatest(5.0, amount * 0.0003))
      WHEN covered > 0 THEN amount - greatest(5.0, amount * 0.0003) - amount * 0.001 ELSE 0 END) AS flow FROM fees GROUP BY date""",
    grid="SELECT c.code, k.date FROM (SELECT DISTINCT code FROM bars_m) c CROSS JOIN calendar k",
    grid2="""SELECT g.code, g.date, last_value(h.held IGNORE NULLS) OVER w AS held, last_value(b."close" IGNORE NULLS) OVER w AS px
      FROM grid g LEFT JOIN bars_m b USING (code, date)
      LEFT JOIN (SELECT code, date, max_by(held, rn) AS held FROM dated GROUP BY ALL) h USING (code, date)
      WINDOW w AS (PARTITION BY g.code ORDER BY g.date ROWS UNBOUNDED PRECEDING)""",
    val="SELECT date, sum(held * px) AS mv FROM grid2 GROUP BY date",
)
def p13(spark, d):
    book = _booked(spark, d).withColumns({"date": F.trunc("day", "month"), "seq": F.struct(*IDS)})
    out = pf.equity_curve(book, v.bars_m(spark, d), 1e9)
    return out.select("date", *[r(c, 2).alias(c) for c in ("cash", "market_value", "total_value")])


DD = dict(
    dd="""SELECT *, max(drawdown) OVER (PARTITION BY portfolio ORDER BY ts ROWS UNBOUNDED PRECEDING) AS max_drawdown,
      row_number() OVER (PARTITION BY portfolio ORDER BY ts) AS rn FROM (
      SELECT *, CASE WHEN peak > 1e-9 THEN (peak - total_value) / peak ELSE 0 END AS drawdown FROM (
      SELECT *, max(total_value) OVER (PARTITION BY portfolio ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM equity))"""
)


@query("p14_drawdown", "SELECT portfolio, ts, round(drawdown, 6) + 0.0 AS drawdown, round(max_drawdown, 6) + 0.0 AS max_drawdown FROM dd", **DD)
def p14(spark, d):
    return pf.drawdowns(v.equity(spark, d)).select("portfolio", "ts", r("drawdown").alias("drawdown"), r("max_drawdown").alias("max_drawdown"))


PERF_COLS = ("total_return", "annual_return", "volatility", "sharpe_ratio", "sortino_ratio", "max_drawdown", "calmar_ratio")


def _perf(key: str, source: str) -> dict[str, str]:
    return dict(
        pr=f"""SELECT *, total_value / nullif(lag(total_value) OVER (PARTITION BY {key} ORDER BY ts), 0) - 1 AS ret,
          max(total_value) OVER (PARTITION BY {key} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM ({source})""",
        pa=f"""SELECT {key}, count(*) AS n, max_by(total_value, ts) / min_by(total_value, ts) AS g,
          stddev_pop(ret) * sqrt(252) AS volatility, stddev_pop(ret) FILTER (ret - 0.03 / 252 < 0) * sqrt(252) AS down,
          count(*) FILTER (ret - 0.03 / 252 < 0) AS bad, max((peak - total_value) / peak) AS max_drawdown FROM pr GROUP BY {key}""",
        perf="""SELECT *, g - 1 AS total_return, an AS annual_return, CASE WHEN volatility > 1e-9 THEN an / volatility ELSE 0 END AS sharpe_ratio,
          CASE WHEN bad > 0 AND down > 1e-9 THEN an / down END AS sortino_ratio,
          CASE WHEN max_drawdown <> 0 THEN an / max_drawdown END AS calmar_ratio
          FROM (SELECT *, pow(g, 252.0 / (n - 1)) - 1 AS an FROM pa WHERE n >= 2)""",
    )


def _perf_out(df, *keys):
    """Infinity would not survive the comparison, so it shows as unknown."""
    known = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c))
    return df.select(*keys, *[r(known(c)).alias(c) for c in PERF_COLS])


PERF_SQL = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in PERF_COLS)


@query("p15_performance", f"SELECT portfolio, {PERF_SQL} FROM perf", **_perf("portfolio", "SELECT portfolio, ts, ln(total_value + 1) + 100 AS total_value FROM equity"))
def p15(spark, d):
    """Performance of curves damped to a plausible size (100 + log of the close)."""
    curve = v.equity(spark, d).withColumn("total_value", F.log(F.col("total_value") + 1) + 100)
    return _perf_out(pf.performance(curve), "portfolio")


@query(
    "p16_calmar",
    "SELECT portfolio, round(calmar_ratio, 6) + 0.0 AS calmar_ratio FROM perf",
    **_perf("portfolio", "SELECT portfolio, ts, ln(total_value + 1) + 100 AS total_value FROM equity"),
)
def p16(spark, d):
    curve = v.equity(spark, d).withColumn("total_value", F.log(F.col("total_value") + 1) + 100)
    return pf.performance(curve).select("portfolio", r("calmar_ratio").alias("calmar_ratio"))


@query(
    "p17_trade_quality",
    """SELECT code, count(*) AS trades, round(avg((pnl >= 0)::INT), 6) + 0.0 AS win_rate,
    round(CASE WHEN coalesce(avg(-pnl) FILTER (pnl < 0), 0) = 0 THEN NULL
      ELSE coalesce(avg(pnl) FILTER (pnl >= 0), 0) / avg(-pnl) FILTER (pnl < 0) END, 6) + 0.0 AS profit_loss_ratio FROM lots GROUP BY code""",
    **BOOK,
)
def p17(spark, d):
    out = pf.trade_quality(_fifo(spark, d), by=["code"])
    ratio = F.when(F.col("profit_loss_ratio") < float("inf"), F.col("profit_loss_ratio"))
    return out.select("code", "trades", r("win_rate").alias("win_rate"), r(ratio).alias("profit_loss_ratio"))


@query(
    "p18_circuit_breaker",
    "SELECT portfolio, ts, since IS NOT NULL AS broken FROM br",
    **DD,
    seen="SELECT *, lag(drawdown) OVER (PARTITION BY portfolio ORDER BY ts) AS last FROM dd",
    br="""SELECT portfolio, ts, rn, CAST(NULL AS DATE) AS since FROM seen WHERE rn = 1
      UNION ALL SELECT d.portfolio, d.ts, d.rn, CASE WHEN d.rn < 3 THEN NULL WHEN b.since IS NULL THEN CASE WHEN d.last >= 0.2 THEN d.ts END
        WHEN d.ts - b.since >= 45 THEN NULL ELSE b.since END
      FROM br b JOIN seen d ON d.portfolio = b.portfolio AND d.rn = b.rn + 1""",
)
def p18(spark, d):
    """Monthly points, so the cool-down is 45 days instead of 5."""
    return pf.circuit_breaker(v.equity(spark, d), cooldown=45).select("portfolio", "ts", "broken")


def _two_books(spark, d):
    """Buys of two strategies (top 10 by momentum, top 5 by volume ratio) and some sells."""
    rows = fx.volume_ratio(fx.momentum(v.bars_m(spark, d)))
    a = cs.top_n(rows, "mom", 10).select("date", "code", F.lit("A").alias("book"), "rank", "weight")
    b = cs.top_n(rows, "vol_ratio", 5).select("date", "code", F.lit("B").alias("book"), "rank", "weight")
    sells = rows.filter("mom < -0.9").select(
        "date", "code", F.lit("S").alias("book"), F.lit(0).alias("rank"), F.lit(0.0).alias("weight")
    )
    buys = a.unionByName(b).withColumn("side", F.lit("BUY"))
    return buys.unionByName(sells.withColumn("side", F.lit("SELL")))


BOOKS = dict(
    books="""SELECT date, code, 'A' AS book, rank, 1.0 / count(*) OVER (PARTITION BY date) AS weight, 'BUY' AS side FROM (
      SELECT *, row_number() OVER (PARTITION BY date ORDER BY mom DESC, code) AS rank FROM factors WHERE mom IS NOT NULL) WHERE rank <= 10
      UNION ALL SELECT date, code, 'B', rank, 1.0 / count(*) OVER (PARTITION BY date), 'BUY' FROM (
      SELECT *, row_number() OVER (PARTITION BY date ORDER BY vol_ratio DESC, code) AS rank FROM factors WHERE vol_ratio IS NOT NULL) WHERE rank <= 5
      UNION ALL SELECT date, code, 'S', 0, 0.0, 'SELL' FROM factors WHERE mom < -0.9""",
)


@query(
    "p19_cap_positions",
    """SELECT date, code, book, side, round(weight, 6) + 0.0 AS weight FROM (SELECT b.* REPLACE (
      CASE WHEN side = 'BUY' AND s > 1 THEN weight / s ELSE weight END AS weight) FROM books b
      LEFT JOIN (SELECT date, sum(weight) AS s FROM books WHERE side = 'BUY' GROUP BY date) t USING (date))
    WHERE side <> 'BUY' OR weight <= 0.12""",
    **BOOKS,
)
def p19(spark, d):
    out = pf.cap_positions(_two_books(spark, d), cap=0.12)
    return out.select("date", "code", "book", "side", r("weight").alias("weight"))


@query(
    "p20_cap_industries",
    """SELECT date, code, book, side, sector_name FROM walk WHERE ok
    UNION ALL SELECT date, code, book, side, sector_name FROM books JOIN industry USING (code) WHERE side <> 'BUY'""",
    **BOOKS,
    queue="""SELECT *, row_number() OVER (PARTITION BY date, sector_name ORDER BY book, rank) AS k FROM books JOIN industry USING (code) WHERE side = 'BUY'""",
    walk="""SELECT date, sector_name, code, book, side, k, weight <= 0.3 AS ok, CASE WHEN weight <= 0.3 THEN weight ELSE 0.0 END AS used FROM queue WHERE k = 1
      UNION ALL SELECT q.date, q.sector_name, q.code, q.book, q.side, q.k, w.used + q.weight <= 0.3,
        CASE WHEN w.used + q.weight <= 0.3 THEN w.used + q.weight ELSE w.used END
      FROM walk w JOIN queue q ON q.date = w.date AND q.sector_name = w.sector_name AND q.k = w.k + 1""",
)
def p20(spark, d):
    out = pf.cap_industries(_two_books(spark, d), v.industry(spark, d), order=["book", "rank"])
    return out.select("date", "code", "book", "side", "sector_name")


ADMIT = dict(
    few="SELECT * FROM positions_m",
    asked="SELECT date, code, mom AS score FROM factors WHERE mom > 0",
)


@query(
    "p21_admission_cap",
    """SELECT date, code FROM (SELECT a.*, row_number() OVER (PARTITION BY a.date ORDER BY score DESC, code) AS n,
      (SELECT count(DISTINCT code) FROM few f WHERE f.date = a.date) AS h FROM asked a
      WHERE NOT EXISTS (SELECT 1 FROM few f WHERE f.date = a.date AND f.code = a.code)) WHERE n + h <= 60
    UNION ALL SELECT date, code FROM asked a WHERE EXISTS (SELECT 1 FROM few f WHERE f.date = a.date AND f.code = a.code)""",
    **ADMIT,
)
def p21(spark, d):
    """Rising codes ask to be bought next to all positions; the limit fits the number of suppliers held."""
    few = v.positions_m(spark, d)
    asked = fx.momentum(v.bars_m(spark, d)).filter("mom > 0").select("date", "code", F.col("mom").alias("score"))
    return pf.admit(asked, few, limit=60).select("date", "code")


@query("p22_holding_time_exit", "SELECT date, code, date - entry_date AS held_days FROM positions_m WHERE date - entry_date >= 7")
def p22(spark, d):
    out = v.positions_m(spark, d).withColumn("held_days", F.datediff("date", "entry_date"))
    return out.filter("held_days >= 7").select("date", "code", F.col("held_days").cast("long").alias("held_days"))


@query(
    "p23_account_summary",
    """SELECT date, round(sum(market_value), 3) + 0.0 AS market_value, count(*) AS position_count,
    round((1e6 + sum(market_value) - 2e6) / 2e6, 6) + 0.0 AS pnl_pct FROM marked GROUP BY date""",
    **MARK,
)
def p23(spark, d):
    out = pf.account_summary(_marked(spark, d), cash=1e6, initial=2e6)
    return out.select("date", r("market_value", 3).alias("market_value"), "position_count", r("pnl_pct").alias("pnl_pct"))


COMPARED = {"short_term": "g04_short_term", "rsrs_momentum": "g01_rsrs_momentum_asof", "sentiment_reversal": "g06_sentiment_reversal"}

#: Equity of strategies whose signals are filled at the next bar for a fixed amount each.
STRATEGY_CURVES = dict(
    sig=" UNION ALL ".join(f"SELECT '{n}' AS strategy, date, code, side FROM ({ORACLES[q]})" for n, q in COMPARED.items()),
    fills="""SELECT s.strategy, s.code, s.side, n.date, coalesce(b."open", b."close") AS price, floor(1e6 / coalesce(b."open", b."close")) AS qty
      FROM sig s JOIN calendar c USING (date) JOIN calendar n ON n.idx = c.idx + 1 JOIN bars_m b ON b.code = s.code AND b.date = n.date
      WHERE coalesce(b."open", b."close") > 0""",
    fill1="""SELECT *, sum(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) OVER w AS run FROM fills
      WINDOW w AS (PARTITION BY strategy, code ORDER BY date ROWS UNBOUNDED PRECEDING)""",
    fill2="""SELECT *, least(min(run) OVER (PARTITION BY strategy, code ORDER BY date ROWS UNBOUNDED PRECEDING), 0) AS short FROM fill1""",
    fill3="""SELECT *, run - short AS held, CASE WHEN side = 'BUY' THEN qty ELSE qty
      - (coalesce(lag(short) OVER (PARTITION BY strategy, code ORDER BY date), 0) - short) END AS done FROM fill2""",
    fill4="""SELECT strategy, date, sum(CASE WHEN side = 'BUY' THEN -(price * (1 + 0.001) * done + greatest(5.0, price * (1 + 0.001) * done * 0.0003))
      WHEN done > 0 THEN price * (1 - 0.001) * done * (1 - 0.001) - greatest(5.0, price * (1 - 0.001) * done * 0.0003) ELSE 0 END) AS flow
      FROM fill3 GROUP BY ALL""",
    fgrid="""SELECT f.strategy, f.code, k.date FROM (SELECT DISTINCT strategy, code FROM fills) f CROSS JOIN calendar k""",
    fval="""SELECT g.strategy, g.date, last_value(h.held IGNORE NULLS) OVER w * last_value(b."close" IGNORE NULLS) OVER w AS v, b.code IS NOT NULL AS bar
      FROM fgrid g LEFT JOIN bars_m b USING (code, date) LEFT JOIN fill3 h ON h.strategy = g.strategy AND h.code = g.code AND h.date = g.date
      WINDOW w AS (PARTITION BY g.strategy, g.code ORDER BY g.date ROWS UNBOUNDED PRECEDING)""",
    fday="SELECT strategy, date, coalesce(sum(v), 0) AS mv, max(bar) AS bar FROM fval GROUP BY ALL",
    fcurve="""SELECT * FROM (SELECT d.strategy, d.date, d.bar, 1e8 + sum(coalesce(f.flow, 0)) OVER (PARTITION BY d.strategy ORDER BY d.date) + d.mv AS total_value
      FROM fday d LEFT JOIN fill4 f ON f.strategy = d.strategy AND f.date = d.date) WHERE bar""",
)
CURVES = "SELECT strategy, date AS ts, total_value FROM fcurve"


def strategy_curves(spark, d):
    """(strategy, ts, total_value): signals filled at the next bar's open, a million each, with costs."""
    bars = v.stored_m(spark, d)
    signals = sg.run_many(price_panel(spark, d, bars), {n: (n, {}) for n in COMPARED})
    fills = pn.next_bar_price(signals.select("strategy", "date", "code", "side"), bars, pn.calendar(bars))
    fills = cut_lineage(fills.select(
        "strategy", "code", "side", F.col("exec_date").alias("date"), F.col("exec_price").alias("price"),
        F.floor(F.lit(1e6) / F.col("exec_price")).cast("double").alias("qty"),
    ))
    book = pf.booked(fills, [], ["date"], keys=("strategy", "code")).withColumn("seq", F.col("date"))
    curve = pf.equity_curve(book, bars, 1e8, by=["strategy"])
    return curve.select("strategy", F.col("date").alias("ts"), "total_value")


@query("p24_strategy_comparison", f"SELECT strategy, {PERF_SQL} FROM perf", **STRATEGY_CURVES, **_perf("strategy", CURVES))
def p24(spark, d):
    return _perf_out(pf.performance(strategy_curves(spark, d), key="strategy"), "strategy")


@query(
    "p25_daily_loss",
    """SELECT day, round(sum(least(amount - greatest(5.0, amount * 0.0003) - amount * 0.001 - avg_cost * covered, 0)), 3) + 0.0 AS daily_loss
    FROM (SELECT *, price * (1 - 0.0005) * covered AS amount FROM booked JOIN cost USING (code, rn) WHERE side = 'SELL' AND covered > 0) GROUP BY day""",
    **BOOK,
)
def p25(spark, d):
    costed = pf.average_cost(v.trades(spark, d), v.TRADE_LEVELS, v.TRADE_ORDER)
    return pf.daily_loss(pf.live_sell_pnl(costed)).select("day", r("daily_loss", 3).alias("daily_loss"))
