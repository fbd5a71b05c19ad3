"""Sections 2.8 (live strategies) and 2.10 in batch form: scores, votes, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.num import f32, r
from tickloom.operators import alerts as al
from tickloom.operators import live as lv
from tickloom.operators import panel as pn
from tickloom.operators import votes as vt
from tickloom.plans import views as v
from tickloom.plans.catalog.factor_queries import MAS
from tickloom.plans.catalog.panel_queries import HUNTER_SQL
from tickloom.plans.catalog.registry import query


def live_quotes(spark, d, bars):
    """Events as quotes around the last close of their code: 85% of it plus value / 200."""
    last = pn.latest_row(bars, ["close"])
    q = v.quotes(spark, d).join(last, "code")
    return q.select("event_id", "code", "ts", (F.col("close") * (0.85 + F.col("price") / 200)).alias("price"))


def scores(spark, d, names=tuple(lv.LIVE), params=lv.PARAMS):
    bars = v.stored_m(spark, d)
    state = lv.live_state(bars, strategies=params)
    return lv.score_quotes(live_quotes(spark, d, bars), state, names, params)


# The SQL side rebuilds each quote's window row by row instead of keeping sums.
BASE = dict(
    MAS,
    tail="""SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS back FROM norm""",
    lastc="""SELECT code, "close" AS c FROM tail WHERE back = 1""",
    lq="""SELECT q.event_id, q.code, q.ts, l.c * (0.85 + q.price / 200) AS price FROM quotes q JOIN lastc l USING (code)""",
    h17="SELECT code, x, y, low, high FROM tail WHERE back <= 17",
    newpt="""SELECT q.event_id, any_value(q.code) AS code, any_value(q.price) * 18 / (sum(h.low) + any_value(q.price)) AS x,
      any_value(q.price) * 18 / (sum(h.high) + any_value(q.price)) AS y FROM lq q JOIN h17 h USING (code) GROUP BY q.event_id""",
    pts="SELECT n.event_id, h.x, h.y FROM newpt n JOIN h17 h USING (code) UNION ALL SELECT event_id, x, y FROM newpt",
    pm="""SELECT event_id, avg(x) AS mx, avg(y) AS my, sum(x * x) AS sxx, sum(x * y) AS sxy, var_pop(x) * 18 AS cxx,
      covar_pop(y, x) * 18 AS cxy, var_pop(y) * 18 AS cyy FROM pts GROUP BY event_id""",
    pl="""SELECT *, (18 * cxy + 1e-10 * sxy) / det AS b, 18 * (my * cxx - mx * cxy + 1e-10 * my) / det AS a
      FROM (SELECT *, 18 * cxx + 1e-10 * (18 + sxx) + 1e-20 AS det FROM pm)""",
    pr="""SELECT event_id, b, CASE WHEN cyy > 1e-12 THEN greatest(0.0, 1 - (cyy - 2 * b * cxy + b * b * cxx
      + 18 * power(my - a - b * mx, 2)) / cyy) ELSE 0.0 END AS r2 FROM pl""",
    slopes="SELECT q.event_id, o.rsrs_raw AS b FROM lq q JOIN ols o USING (code) UNION ALL SELECT event_id, b FROM pr",
    pz="SELECT event_id, avg(b) AS mb, stddev_samp(b) AS sb, count(b) AS nb FROM slopes GROUP BY event_id",
    qrsrs="""SELECT p.event_id, r2, CASE WHEN nb >= 30 THEN (b - mb) / (sb + 1e-9) END * r2 AS va FROM pr p JOIN pz USING (event_id)""",
    hunt=f"SELECT code, {HUNTER_SQL} AS hunter, date FROM filled",
    hist="""SELECT r.code, r.date, row_number() OVER (PARTITION BY r.code ORDER BY r.date DESC) AS back, ret,
      abs(ret) / nullif(amount, 0) AS illiq, volume, amount,
      (("close" - low) - (high - "close")) / nullif(high - low, 0) * volume AS net FROM ret r""",
    agg="""SELECT code, coalesce(sum(net) FILTER (back <= 9), 0) AS net9, sum(volume) FILTER (back <= 9) AS vol9,
      avg(volume) FILTER (back <= 5) AS vol5, avg(amount) FILTER (back <= 5) AS amt5,
      product(1 + ret) FILTER (back <= 20 AND ret IS NOT NULL) - 1 AS cmom, sum(ret) FILTER (back <= 5) AS s5,
      -avg(illiq) FILTER (back <= 20) AS liq FROM hist GROUP BY code""",
    levels="""SELECT code, max(date) AS d, max_by("close", date) AS c, max_by(c5, date) AS c5, max_by(c20, date) AS c20,
      max_by(ma5, date) AS ma5, max_by(ma20, date) AS ma20, max_by(ma60, date) AS ma60, max(rn) AS n FROM (
      SELECT *, lag("close", 4) OVER w AS c5, lag("close", 19) OVER w AS c20 FROM mas
      WINDOW w AS (PARTITION BY code ORDER BY date)) GROUP BY code""",
    illiqs="""SELECT q.event_id, h.illiq FROM lq q JOIN hist h ON h.code = q.code AND h.back <= 18
      UNION ALL SELECT q.event_id, abs(q.price / l.c - 1) / nullif(a.amt5, 0) FROM lq q JOIN levels l USING (code) JOIN agg a USING (code)""",
    stab="""SELECT event_id, CASE WHEN count(illiq) < 5 THEN 0.0 ELSE -stddev_samp(illiq) END AS st FROM illiqs GROUP BY event_id""",
    base="""SELECT q.*, l.* EXCLUDE (code), g.va, g.r2, h.hunter, z.rsrs_zscore AS z, price / l.c - 1 AS m1, price / c5 - 1 AS m5, price / c20 - 1 AS m20,
      0.5 * CASE WHEN vol9 + vol5 < 1 THEN 0 ELSE net9 / (vol9 + vol5) END + 0.3 * st
        - 0.2 * least(abs(price - l.c) / l.c, 0.1) * 10 AS micro,
      greatest(least((0.15 * cmom - 0.1 * (s5 + price / l.c - 1) + 0.1 * liq) * 5, 1.0), -1.0) AS multi
      FROM lq q JOIN levels l USING (code) JOIN agg a USING (code) JOIN qrsrs g USING (event_id) JOIN stab USING (event_id)
      LEFT JOIN hunt h ON h.code = q.code AND h.date = l.d LEFT JOIN rsrs z ON z.code = q.code AND z.date = l.d""",
)


def _rule(buy: str, bscore: str, sell: str, sscore: str, rows: int, src: str = "base") -> str:
    return f"""SELECT event_id, code, CASE WHEN buy THEN 'buy' WHEN sell THEN 'sell' ELSE 'hold' END AS side,
      round(CASE WHEN buy THEN least(bs, 1.0) WHEN sell THEN least(ss, 1.0) ELSE 0.0 END, 6) + 0.0 AS score FROM (
      SELECT event_id, code, n >= {rows} AND coalesce({buy}, false) AS buy, n >= {rows} AND coalesce({sell}, false) AS sell,
        {bscore} AS bs, {sscore} AS ss FROM {src})"""


RULES = {
    "rsrs_momentum": _rule("va > 0.5", "va / 1.5", "va < -0.5", "abs(va) / 1.5", 40),
    "alpha_hunter": _rule("hunter >= 0.3", "hunter / (0.3 * 3)", "hunter <= -0.3", "abs(hunter) / (0.3 * 3)", 60),
    "rsrs_advanced": _rule("r2 >= 0.7 AND va > 0.5", "abs(va) * r2", "r2 >= 0.7 AND va < -0.5", "abs(va) * r2", 40),
    "short_term": _rule("m1 > 0.03 AND m5 > 0.03", "(m1 + m5) / 0.12", "m5 < -0.06", "abs(m5) / 0.12", 25),
    "momentum_reversal": _rule(
        "(price > ma20 AND m20 > 0) OR (price < ma20 AND m5 < -0.05)",
        "CASE WHEN price > ma20 AND m20 > 0 THEN m20 * 5 ELSE abs(m5) * 5 END", "m20 < -0.08", "abs(m20) * 3", 20),
    "sentiment_reversal": _rule("z < -1.5", "abs(z + 1.5) / 2", "z > 1.5", "(z - 1.5) / 2", 30),
    "kunpeng_v10": _rule("micro > 0.15", "micro * 2", "micro < -0.2", "abs(micro) * 2", 20),
    "alpha_max_v5_fixed": _rule("multi > 0.3", "multi", "multi < -0.3", "abs(multi)", 20),
    "sector_momentum": _rule("va > 0.5", "va / 1.5", "va < -0.5", "abs(va) / 1.5", 40),
    "ma_fallback": _rule(
        "price > ma5 AND ma5 > ma20 AND ma20 > ma60", "(price / ma60 - 1) * 10",
        "price < ma5 AND ma5 < ma20 AND ma20 < ma60", "(1 - price / ma60) * 10", 60),
}


def _register(name: str, strategy: str):
    @query(name, RULES[strategy], **BASE)
    def run(spark, d):
        names = () if strategy == "ma_fallback" else (strategy,)
        return scores(spark, d, names).select("event_id", "code", "side", r("score").alias("score"))

    run.__doc__ = f"Every quote scored by the live form of {strategy}."


for _n, (_q, _s) in enumerate(
    [
        ("rsrs_momentum", "rsrs_momentum"), ("alpha_hunter", "alpha_hunter"), ("rsrs_advanced", "rsrs_advanced"),
        ("short_term", "short_term"), ("momentum_reversal", "momentum_reversal"),
        ("sentiment_reversal", "sentiment_reversal"), ("microstructure", "kunpeng_v10"),
        ("multi_factor", "alpha_max_v5_fixed"), ("ma_fallback", "ma_fallback"), ("sector_momentum", "sector_momentum"),
    ],
    start=1,
):
    _register(f"r{_n:02d}_live_{_q}", _s)


@query(
    "r07_live_microstructure_windows", RULES["kunpeng_v10"].replace("n >= 20", "n >= 10"),
    **{k: x.replace("back <= 9", "back <= 3").replace("back <= 18", "back <= 8") for k, x in BASE.items()},
)
def r07_windows(spark, d):
    """Windows of 4 and 10 rows instead of 10 and 20."""
    own = {**lv.PARAMS, "kunpeng_v10": {**lv.PARAMS["kunpeng_v10"], "smart_window": 4, "illiq_window": 10}}
    return scores(spark, d, ("kunpeng_v10",), own).select("event_id", "code", "side", r("score").alias("score"))


# ------------------------------------------------------------------ scans and votes


@query(
    "t01_latest_quote",
    """SELECT code, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, max_by(price, (ts, event_id)) AS price FROM quotes GROUP BY code""",
)
def t01(spark, d):
    from tickloom.streaming.quotes import latest

    return latest(v.quotes(spark, d), tie="event_id").select("code", "event_id", "ts", "price")


def _all_rules() -> str:
    return " UNION ALL ".join(f"SELECT '{s}' AS strategy, * FROM ({RULES[s]})" for s in lv.LIVE)


SCAN = dict(BASE, rules=_all_rules())


@query("t02_score_quotes", "SELECT strategy, event_id, code, side, score FROM rules", **SCAN)
def t02(spark, d):
    return scores(spark, d).select("strategy", "event_id", "code", "side", r("score").alias("score"))


@query("t03_minimum_score_gate", "SELECT strategy, event_id, code, side, score FROM rules WHERE side <> 'hold' AND score >= 0.6", **SCAN)
def t03(spark, d):
    return vt.gate(scores(spark, d).withColumn("score", r("score")), 0.6).select("strategy", "event_id", "code", "side", "score")


PLACES = ("view", "click", "purchase", "signup", "error")


def votes(spark, d):
    """Gated last votes per code, day and strategy."""
    place = F.array_position(F.array(*[F.lit(x) for x in PLACES]), F.col("strategy"))
    last = vt.last_vote(v.votes(spark, d), ["code", "scan_date"], "event_id")
    return vt.gate(last.withColumn("place", place), 0.1)


VOTES = dict(
    lastv="""SELECT code, scan_date, strategy, max_by(side, event_id) AS side, max_by(score, event_id) AS score,
      max_by(reason, event_id) AS reason, list_position(['view','click','purchase','signup','error'], strategy) AS place
      FROM votes GROUP BY code, scan_date, strategy""",
    gated="SELECT * FROM lastv WHERE side <> 'hold' AND score >= 0.1",
    tally="""SELECT code, scan_date, count(*) FILTER (side = 'buy') AS bn, count(*) FILTER (side = 'sell') AS sn,
      sum(score) FILTER (side = 'buy') AS bsum, sum(score) FILTER (side = 'sell') AS ssum,
      max(score) FILTER (side = 'buy') AS bmax, max(score) FILTER (side = 'sell') AS smax FROM gated GROUP BY ALL""",
)


def _merge_sql(signal: str, buy: str, sell: str) -> str:
    return f"""SELECT code, scan_date, signal, round(CASE WHEN signal = 'buy' THEN {buy} ELSE {sell} END, 6) + 0.0 AS score
      FROM (SELECT *, {signal} AS signal FROM tally) WHERE signal IS NOT NULL"""


ANY_SQL = _merge_sql("CASE WHEN sn = 0 OR bmax >= smax THEN 'buy' WHEN bn = 0 OR smax > bmax THEN 'sell' END", "bmax", "smax")


def _merged(spark, d, rule):
    out = vt.merge_votes(votes(spark, d), ["code", "scan_date"], rule, 0.3)
    return out.withColumn("score", r("score"))


@query("t04_merge_any", ANY_SQL, **VOTES)
def t04(spark, d):
    return _merged(spark, d, "any").select("code", "scan_date", "signal", "score")


@query(
    "t05_merge_majority",
    _merge_sql("CASE WHEN bn > 0.5 * (bn + sn) THEN 'buy' WHEN sn > 0.5 * (bn + sn) THEN 'sell' END", "bsum / bn", "ssum / sn"),
    **VOTES,
)
def t05(spark, d):
    return _merged(spark, d, "majority").select("code", "scan_date", "signal", "score")


@query(
    "t06_merge_weighted",
    _merge_sql(
        "CASE WHEN coalesce(bsum,0) > coalesce(ssum,0) AND bsum > 0.3 THEN 'buy' WHEN coalesce(ssum,0) > coalesce(bsum,0) AND ssum > 0.3 THEN 'sell' END",
        "least(bsum / bn, 1.0)", "least(ssum / sn, 1.0)"),
    **VOTES,
)
def t06(spark, d):
    return _merged(spark, d, "weighted").select("code", "scan_date", "signal", "score")


@query(
    "t06_merge_default",
    _merge_sql("CASE WHEN bn > 0 THEN 'buy' WHEN sn > 0 THEN 'sell' END", "bmax", "smax"),
    **VOTES,
)
def t06_default(spark, d):
    return _merged(spark, d, "unknown").select("code", "scan_date", "signal", "score")


ROWS = dict(
    VOTES,
    anyrule=ANY_SQL,
    merged="""SELECT a.code, a.scan_date, a.signal, a.score, string_agg(g.strategy, '+' ORDER BY place) AS strategy,
      array_to_string(list(g.reason ORDER BY place)[1:3], ' | ') AS reason, count(*) AS n
      FROM anyrule a JOIN gated g ON g.code = a.code AND g.scan_date = a.scan_date AND g.side = a.signal GROUP BY ALL""",
)


@query("t07_merged_signal_row", "SELECT code, scan_date, signal, score, strategy, reason, n FROM merged", **ROWS)
def t07(spark, d):
    out = _merged(spark, d, "any").withColumn("n", F.size("strategies_triggered").cast("long"))
    return out.select("code", "scan_date", "signal", "score", "strategy", "reason", "n")


# ------------------------------------------------------------------ alerts


def alert_events(spark, d):
    return v.events(spark, d).select(
        "event_id", "ts", F.concat(F.col("user_id").cast("string"), F.lit("_"), "event_type").alias("key")
    )


@query(
    "t09_alert_throttle",
    """SELECT key, event_id, ts FROM sent""",
    al="""SELECT user_id || '_' || event_type AS key, event_id, ts,
      row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events""",
    walk="""SELECT key, event_id, ts, rn, ts AS last, true AS ok FROM al WHERE rn = 1
      UNION ALL SELECT a.key, a.event_id, a.ts, a.rn, CASE WHEN a.ts - w.last >= INTERVAL 3 DAY THEN a.ts ELSE w.last END,
        a.ts - w.last >= INTERVAL 3 DAY FROM walk w JOIN al a ON a.key = w.key AND a.rn = w.rn + 1""",
    sent="SELECT * FROM walk WHERE ok",
)
def t09(spark, d):
    """At most one alert per user and event type in three days."""
    return al.throttle(alert_events(spark, d), window_seconds=3 * 86400, slice_windows=2).select("key", "event_id", "ts")


@query(
    "t10_signal_alert_text",
    """SELECT event_id, CASE side WHEN 'buy' THEN 'buy' WHEN 'sell' THEN 'sell' ELSE 'info' END AS level,
      code || ' C' || code || ' -- ' || side || ' signal (score=' || format('{:.2f}', score) || ')' AS subject,
      'strategy: ' || strategy || ' | code: ' || code || ' | name: C' || code || chr(10) || 'signal: ' || side || ' | score: '
        || format('{:.4f}', score) || ' | price: ' || format('{:.2f}', score * 50) || chr(10) || 'reason: ' || reason AS body,
      code || '_' || side || '_' || strategy AS key FROM votes""",
)
def t10(spark, d):
    df = v.votes(spark, d).withColumnsRenamed({"side": "signal"}).withColumns(
        {"name": F.concat(F.lit("C"), F.col("code").cast("string")), "price": F.col("score") * 50}
    )
    return al.signal_alert(df).select("event_id", "level", "subject", "body", "key")


@query(
    "t10_merged_alert_text",
    """SELECT code, scan_date, signal AS level, code || ' C' || code || ' -- [MERGED] ' || signal || ' (score=' || format('{:.2f}', score) || ', rule=any)' AS subject,
      'merged strategies: [' || replace(strategy, '+', ', ') || ']' || chr(10) || 'code: ' || code || ' | name: C' || code || chr(10)
        || 'signal: ' || signal || ' | score: ' || format('{:.4f}', score) || ' | price: ' || format('{:.2f}', score * 10) || chr(10)
        || 'merge_rule: any | triggered: ' || n AS body, code || '_merged_' || signal AS key FROM merged""",
    **ROWS,
)
def t10_merged(spark, d):
    df = _merged(spark, d, "any").withColumns(
        {"name": F.concat(F.lit("C"), F.col("code").cast("string")), "price": F.col("score") * 10}
    )
    return al.merged_alert(df).select("code", "scan_date", "level", "subject", "body", "key")


@query(
    "t10_position_alert_text",
    """SELECT date, code, CASE WHEN pct > 0 THEN 'profit' ELSE 'loss' END AS level, '[' || CASE WHEN pct > 0 THEN 'PROFIT' ELSE 'LOSS' END || '] '
        || code || ' C' || code || ' -- marked (pnl=' || format('{:+.1f}', pct * 100) || '%)' AS subject,
      'code: ' || code || ' | name: C' || code || ' | event: marked | pnl: ' || format('{:+.1f}', pct * 100) || '% | price: '
        || format('{:.2f}', qty) AS body, code || '_marked' AS key FROM (
      SELECT date, code, qty, (qty - 25.3) / 7 AS pct FROM positions_m)""",
)
def t10_position(spark, d):
    df = v.positions_m(spark, d).select(
        "date", "code", F.concat(F.lit("C"), F.col("code").cast("string")).alias("name"), F.lit("marked").alias("event"),
        ((F.col("qty") - 25.3) / 7).alias("pnl_pct"), F.col("qty").alias("price"),
    )
    out = al.position_alert(df).withColumn("subject", al.full_subject())
    # The mark in front is left out of the comparison.
    return out.select("date", "code", "level", F.regexp_replace("subject", r"^\S+ ", "").alias("subject"), "body", "key")


@query("t11_recent_signals", "SELECT event_id, code, side, round(score, 6) + 0.0 AS score FROM votes ORDER BY ts DESC, event_id DESC LIMIT 800")
def t11(spark, d):
    out = al.recent(v.votes(spark, d), 800)
    return out.select("event_id", "code", "side", r("score").alias("score"))


@query(
    "t12_last_quote_per_minute",
    """SELECT code, time_bucket(INTERVAL 60 SECOND, ts) AS minute, max_by(event_id, (ts, event_id)) AS event_id,
    CAST(CAST(max_by(price, (ts, event_id)) AS FLOAT) AS DOUBLE) AS price FROM quotes GROUP BY ALL""",
)
def t12(spark, d):
    from tickloom.streaming.quotes import last_per_window

    out = last_per_window(v.quotes(spark, d), "60 seconds", tie="event_id")
    return out.select("code", F.col("window.start").alias("minute"), "event_id", f32("price").alias("price"))
