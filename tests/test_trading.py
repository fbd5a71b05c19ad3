"""Signals, exits, costs, votes and alerts on hand-made rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions import crossings
from tickloom.operators import alerts as al
from tickloom.operators import cross_section as cs
from tickloom.operators import live as lv
from tickloom.operators import panel as pn
from tickloom.operators import portfolio as pf
from tickloom.operators import signals as sg
from tickloom.operators import votes as vt

D0 = dt.date(2024, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def test_signal_executes_at_next_open_with_slippage(spark):
    bars = spark.createDataFrame(
        [("A", day(0), 10.0, 10.0), ("A", day(1), 11.0, 11.0), ("B", day(0), 5.0, 5.0), ("C", day(1), 1.0, 1.0), ("C", day(2), None, 2.0)],
        "code string, date date, open double, close double",
    )
    signals = spark.createDataFrame([(day(0), "A"), (day(0), "B"), (day(1), "C")], "date date, code string")
    out = pn.next_bar_price(signals, bars, pn.calendar(bars)).withColumn("side", F.lit("BUY"))
    got = {r["code"]: (r["exec_date"], r["p"]) for r in out.select("code", "exec_date", pf.execution_price("exec_price").alias("p")).collect()}
    assert got["A"] == (day(1), pytest.approx(11 * 1.001)) and got["C"] == (day(2), pytest.approx(2 * 1.001))
    assert "B" not in got  # no bar the next day: dropped, not carried


def test_asof_keeps_stale_rows_and_exact_drops_them(spark):
    bars = spark.createDataFrame(
        [("A", day(0), 1.0), ("A", day(1), 2.0), ("A", day(3), 4.0), ("B", day(0), 9.0), ("B", day(2), 8.0), ("B", day(4), 7.0)],
        "code string, date date, close double",
    )
    cal = pn.calendar(bars)
    asof = {(r["date"], r["code"]): (r["close"], r["in_universe"]) for r in pn.strictly_before(bars, cal).collect()}
    assert asof[(day(2), "A")] == (2.0, False) and asof[(day(3), "A")] == (2.0, True)
    assert asof[(day(4), "A")] == (4.0, False) and (day(0), "A") not in asof
    exact = {(r["date"], r["code"]): r["close"] for r in pn.exactly_before(bars, cal).collect()}
    assert (day(3), "A") not in exact and exact[(day(2), "A")] == 2.0 and exact[(day(3), "B")] == 8.0
    grid = {(r["date"], r["code"]): r["close"] for r in pn.align(bars, cal).collect()}
    assert len(grid) == 10 and grid[(day(2), "A")] is None


def panel_rows(spark):
    rows = [(day(5), c, True, day(4), v, h, None) for c, v, h in [("A", 3.0, True), ("B", 2.0, False), ("C", 1.0, False), ("D", -2.0, True)]]
    return spark.createDataFrame(
        rows, "date date, code string, in_universe boolean, bar_date date, rsrs_adaptive double, held boolean, entry_date date"
    )


def test_held_codes_use_a_place_only_in_the_asof_form(spark):
    p = {"top_n": 2, "rsrs_threshold": 0.5}
    asof = {(r["code"], r["side"]): r["weight"] for r in sg.rsrs_momentum(panel_rows(spark), p).collect()}
    assert asof == {("B", "BUY"): 0.5, ("D", "SELL"): 0.0}
    exact = {(r["code"], r["side"]): r["weight"] for r in sg.rsrs_momentum_exact(panel_rows(spark), p).collect()}
    assert exact == {("B", "BUY"): 0.5, ("C", "BUY"): 0.5, ("D", "SELL"): 0.0}


def test_unknown_strategy_and_parameter(spark):
    with pytest.raises(ValueError):
        sg.run_strategy("nope", panel_rows(spark))
    with pytest.raises(ValueError):
        sg.run_strategy("rsrs_momentum", panel_rows(spark), wrong=1)


def test_custom_strategy_can_be_registered(spark):
    sg.register("mine", lambda panel, p: sg.rsrs_momentum(panel, p), {"top_n": 1, "rsrs_threshold": 0.5})
    out = sg.run_strategy("mine", panel_rows(spark), rsrs_threshold=1.5)
    assert out.filter("side = 'BUY'").count() == 0 and out.first()["strategy"] == "mine"
    del sg.STRATEGIES["mine"], sg.PARAMS["mine"]


def test_a_built_in_strategy_under_another_name_has_its_defaults(spark):
    sg.register("mine", sg.rsrs_momentum, {"top_n": 1})
    try:
        assert sg.PARAMS["mine"] == {"top_n": 1, "rsrs_threshold": 0.5, "mode": "asof"}
        got = {(r.code, r.side) for r in sg.run_strategy("mine", panel_rows(spark)).collect()}
        assert got == {("D", "SELL")}  # the one place is taken by a held code
    finally:
        del sg.STRATEGIES["mine"], sg.PARAMS["mine"]


GRIDS = {
    "rsrs_momentum": [{"rsrs_threshold": t, "top_n": n, "mode": m} for t in (-0.5, 0.0, 0.7) for n in (1, 4, 50) for m in ("asof", "exact")],
    "alpha_hunter": [{"min_score": t, "top_n": n} for t in (0.0, 0.4) for n in (2, 9)] + [{"factor_weights": {"mom": 1.0}}, {}],
    "rsrs_advanced": [{"rsrs_threshold": t, "r2_threshold": x, "top_n": n} for t in (0.0, 0.5) for x in (0.2, 0.7) for n in (1, 6)],
    "short_term": [{"mom_threshold": t, "hold_calendar_days": h, "top_n": n} for t in (0.0, 0.3) for h in (2, 9) for n in (2, 30)],
    "sentiment_reversal": [{"oversold_z": a, "overbought_z": b, "top_n": n} for a in (-1.0, 0.0) for b in (0.1, 1.0) for n in (3, 30)],
    "momentum_reversal": [{"top_n": 3}, {"top_n": 8, "market_thresh": 0.1}],
}


@pytest.mark.parametrize("name", GRIDS)
def test_a_grid_gives_what_its_runs_give(spark, name):
    rng = random.Random(5)
    number = lambda: rng.choice([None, 0.5, round(rng.gauss(0, 1), 2)])
    rows = [
        (day(d), f"c{c:02d}", rng.random() < 0.8, day(d - 1) if rng.random() < 0.9 else None, rng.random() < 0.4,
         day(d - rng.randrange(12)) if rng.random() < 0.9 else None, *[number() for _ in range(7)])
        for d in range(4) for c in range(25)
    ]
    kinds = "date date, code string, in_universe boolean, bar_date date, held boolean, entry_date date, " + ", ".join(
        f"{c} double" for c in ("rsrs_adaptive", "mom", "vol_factor", "vol_ratio", "rsrs_r2", "rsrs_zscore", "lb_change")
    )
    panel = spark.createDataFrame(rows, kinds)
    sets = {f"s{i}": p for i, p in enumerate(GRIDS[name])}
    got = sg.run_grid(panel, name, sets)
    want = sg.run_many(panel, {label: (name, p) for label, p in sets.items()})
    key = lambda df: sorted(str(r) for r in df.select("run", "date", "code", "side", "score", "weight", "reason", "strategy").collect())
    assert key(got) == key(want) and len(key(got)) > 20


def test_fifty_sets_are_one_scan_and_one_sort_by_date(spark, tmp_path):
    panel_rows(spark).write.parquet(str(tmp_path / "panel"))
    sets = {f"{t}/{n}": {"rsrs_threshold": t / 10, "top_n": n} for t in range(10) for n in range(1, 6)}
    plan = sg.run_grid(spark.read.parquet(str(tmp_path / "panel")), "rsrs_momentum", sets)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    with pytest.raises(ValueError):
        sg.run_grid(panel_rows(spark), "rsrs_momentum", {"x": {"wrong": 1}})


def test_missing_factors_are_renormalised(spark):
    df = spark.createDataFrame([(1.0, None, 2.0), (None, None, None)], "rsrs_adaptive double, mom double, vol_factor double")
    got = [r[0] for r in df.select(cs.renormalised(sg.HUNTER_WEIGHTS)).collect()]
    assert got == [pytest.approx((0.5 + 0.4) / 0.7), 0.0]


@pytest.mark.parametrize(
    "path,event",
    [([9.1], "stop_loss"), ([12.2], "take_profit"), ([15.0, 14.0], "take_profit"), ([11.5, 10.8], "trailing_stop"), ([10.5], None)],
)
def test_exit_rules(spark, path, event):
    bars = spark.createDataFrame([("A", day(i + 1), p) for i, p in enumerate(path)], "code string, date date, close double")
    entries = spark.createDataFrame([("A", day(0), 10.0)], "code string, entry_date date, cost double")
    out = pf.exit_scan(entries, bars, stop=0.08, take=0.20, trail=0.05).first()
    assert out["exit_event"] == event


def test_exit_scan_waits_for_min_holding(spark):
    bars = spark.createDataFrame([("A", day(i), p) for i, p in enumerate([5.0, 5.0, 5.0])], "code string, date date, close double")
    entries = spark.createDataFrame([("A", day(0), 10.0), ("Z", day(0), 1.0)], "code string, entry_date date, cost double")
    for n in (0, 1, 2):
        got = {r["code"]: r["exit_date"] for r in pf.exit_scan(entries, bars, min_holding_bars=n).collect()}
        assert got == {"A": day(n), "Z": None}


def plain_exit(closes, entry, cost, n, stop=0.1, take=0.2, trail=0.05):
    high, seen = cost, 0
    for date, p in closes:
        if date < entry:
            continue
        if date > entry:
            high, seen = max(high, p), seen + 1
        if seen >= n:
            change = (p - cost) / cost
            if change <= -stop:
                return "stop_loss", date
            if change >= take:
                return "take_profit", date
            if high > cost and (high - p) / high >= trail:
                return "trailing_stop", date
    return None, None


@pytest.mark.parametrize("n", [0, 1, 2, 7])
def test_exit_scan_by_blocks_equals_a_walk(spark, monkeypatch, n):
    monkeypatch.setattr(crossings, "FAN", 4)
    rng = random.Random(n)
    bars, entries = [], []
    for code in "ABCDEF":
        p = 10.0
        for i in range(60):
            p = round(max(1.0, p * (1 + rng.gauss(0, 0.015))), 4)
            bars.append((code, day(i), p))
        entries += [(code, day(rng.randint(-3, 62)), round(p * rng.uniform(0.9, 1.1), 3)) for _ in range(25)]
    entries += [("A", day(5), 10.0), ("A", day(5), 10.0), ("Z", day(1), 3.0)]
    df = spark.createDataFrame(bars, "code string, date date, close double")
    out = pf.exit_scan(spark.createDataFrame(entries, "code string, entry_date date, cost double"), df, min_holding_bars=n)
    closes = {c: [(d, p) for x, d, p in bars if x == c] for c in "ABCDEFZ"}
    got = out.collect()
    assert len(got) == len(entries)
    for r in got:
        assert (r.exit_event, r.exit_date) == plain_exit(closes[r.code], r.entry_date, r.cost, n)


@pytest.mark.parametrize("fan", [3, 64])
def test_first_crossings_against_a_walk(spark, monkeypatch, fan):
    monkeypatch.setattr(crossings, "FAN", fan)
    rng = random.Random(fan)
    series = {c: [round(rng.uniform(1, 9), 1) for _ in range(n)] for c, n in (("a", 70), ("b", 1), ("c", 9))}
    df = spark.createDataFrame([(c, 100 + i, x) for c, xs in series.items() for i, x in enumerate(xs)], "code string, idx long, x double")
    asked = [(n, rng.choice("abcd"), 100 + rng.randrange(-2, 75), rng.uniform(0, 10)) for n in range(300)]
    searches = spark.createDataFrame(asked, "n int, code string, start long, price double")
    found = crossings.first_where(searches, crossings.tree(df, "code"), "code", ["n"], lambda lo, hi: lo <= F.col("price"))
    got = {r.n: r.found for r in found.collect()}
    for n, code, start, price in asked:
        hits = [100 + i for i, x in enumerate(series.get(code, [])) if 100 + i >= start and x <= price]
        assert got.get(n) == (hits[0] if hits else None)


def test_watermarks_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(pf, "BLOCK", 4)
    rng = random.Random(9)
    bars = [(c, day(i), rng.uniform(5, 15)) for c in "AB" for i in range(30)]
    entries = [(c, day(rng.randint(-2, 31)), day(rng.randint(0, 33)), rng.uniform(5, 12)) for c in "AAABBBZ" for _ in range(6)]
    held = spark.createDataFrame(entries, "code string, entry_date date, day date, cost double")
    df = spark.createDataFrame(bars, "code string, date date, close double")
    for until, last in ((None, lambda r: day(99)), (F.col("day"), lambda r: r.day)):
        for r in pf.watermarks(held, df, until).collect():
            after = [p for c, d, p in bars if c == r.code and r.entry_date < d <= last(r)]
            assert r.watermark == max([r.cost, *after])


def test_equity_charges_what_was_covered(spark):
    rows = [("A", day(0), 1, "BUY", 100.0, 50.0), ("A", day(1), 2, "SELL", 200.0, 50.0), ("A", day(2), 3, "SELL", 10.0, 50.0)]
    trades = spark.createDataFrame(rows, "code string, date date, seq int, side string, qty double, price double")
    bars = spark.createDataFrame([("A", day(i), 50.0) for i in range(4)], "code string, date date, close double")
    book = pf.booked(trades.withColumn("day", F.col("date")), ["day"], ["seq"])
    out = pf.equity_curve(book, bars, 10_000.0, slippage=0.0).orderBy("date").collect()
    assert [r.market_value for r in out] == [5000.0, 0.0, 0.0, 0.0]
    assert [round(r.cash, 2) for r in out] == [4995.0, 9985.0, 9985.0, 9985.0]


def test_live_trailing_needs_no_gain(spark):
    c = lambda x: F.lit(x)
    one = spark.range(1)
    kw = dict(stop=0.08, take=0.2, trail=0.05)
    row = one.select(
        pf.exit_event(c(10.0), c(9.5), c(10.0), **kw).alias("batch"),
        pf.exit_event(c(10.0), c(9.5), c(10.0), live=True, **kw).alias("live"),
    ).first()
    assert row["batch"] is None and row["live"] == "trailing_stop"


def test_breaker_cools_down(spark):
    values = [100.0, 100.0, 79.0, 79.0, 79.0, 100.0, 100.0, 100.0, 100.0]
    rows = [("P", day(i), x) for i, x in enumerate(values)]
    out = pf.circuit_breaker(spark.createDataFrame(rows, "portfolio string, ts date, total_value double"))
    got = [r["broken"] for r in out.orderBy("ts").collect()]
    assert got == [False, False, False, True, True, True, True, True, False]


@pytest.mark.parametrize("cooldown", [0, 1, 5, 30])
def test_breaker_equals_a_walk_over_days(spark, cooldown):
    rng, rows = random.Random(cooldown), []
    for name in "PQR":
        value, at = 100.0, 0
        for _ in range(150):
            at += rng.choice([1, 1, 1, 3, 9])
            value *= rng.choice([0.9, 0.97, 1.0, 1.02, 1.12])
            rows.append((name, day(at), value))
    rows += [("one", day(0), 5.0), ("two", day(0), 5.0), ("two", day(1), 1.0)]
    df = spark.createDataFrame(rows, "portfolio string, ts date, total_value double")
    out = pf.circuit_breaker(df, limit=0.15, cooldown=cooldown)
    got = {(r["portfolio"], r["ts"]): r["broken"] for r in out.collect()}
    want = {}
    for name in ("P", "Q", "R", "one", "two"):
        peak, last, since = 0.0, None, None
        for k, (_, ts, value) in enumerate(r for r in rows if r[0] == name):
            if k >= 2:
                if since is None and last >= 0.15:
                    since = ts
                elif since is not None and (ts - since).days >= cooldown:
                    since = None
            want[name, ts] = since is not None
            peak = max(peak, value)
            last = (peak - value) / peak
    assert got == want and any(want.values())
    assert pf.circuit_breaker(df.limit(0)).collect() == []


def test_industry_rejects_do_not_use_budget(spark):
    rows = [(day(0), "ABCD"[i], "BUY", i, w) for i, w in enumerate([0.2, 0.15, 0.1, 0.05])]
    signals = spark.createDataFrame(rows, "date date, code string, side string, rank int, weight double")
    sector = spark.createDataFrame([(c, "x") for c in "ABCD"], "code string, sector_name string")
    got = {r["code"] for r in pf.cap_industries(signals, sector, cap=0.301).collect()}
    assert got == {"A", "C"}
    seed = spark.createDataFrame([(day(0), "x", 0.14)], "date date, sector_name string, exposure double")
    assert {r["code"] for r in pf.cap_industries(signals, sector, seed, cap=0.301).collect()} == {"B"}


def test_ratios_without_losses_are_infinite(spark):
    row = pf.trade_quality(spark.createDataFrame([(5.0,), (0.0,)], "pnl double")).first()
    assert row["win_rate"] == 1.0 and row["profit_loss_ratio"] == float("inf")
    up = spark.createDataFrame([("P", day(i), 100.0 + i) for i in range(4)], "portfolio string, ts date, total_value double")
    perf = pf.performance(up).first()
    assert perf["sortino_ratio"] == float("inf") and perf["max_drawdown"] == 0 and perf["calmar_ratio"] is None


VOTES = "code string, scan int, place int, strategy string, side string, score double, reason string"


@pytest.mark.parametrize(
    "rule,votes,want",
    [
        ("any", [("buy", 0.7)], ("buy", 0.7)),
        ("any", [("buy", 0.9), ("sell", 0.6)], ("buy", 0.9)),
        ("any", [("buy", 0.6), ("sell", 0.6)], ("buy", 0.6)),
        ("any", [("buy", 0.5), ("sell", 0.6)], ("sell", 0.6)),
        ("majority", [("buy", 0.8), ("buy", 0.7)], ("buy", 0.75)),
        ("majority", [("buy", 0.9), ("hold", 0.0)], ("buy", 0.9)),
        ("majority", [("buy", 0.8), ("sell", 0.7)], None),
        ("weighted", [("buy", 0.6), ("buy", 0.8)], ("buy", 0.7)),
        ("weighted", [("buy", 0.6), ("sell", 0.6)], None),
        ("other", [("buy", 0.5), ("sell", 0.9)], ("buy", 0.5)),
        ("any", [], None),
    ],
)
def test_vote_rules(spark, rule, votes, want):
    rows = [("A", 1, i, f"s{i}", side, score, f"r{i}") for i, (side, score) in enumerate(votes)]
    out = vt.merge_votes(spark.createDataFrame(rows, VOTES), ["code", "scan"], rule, 0.0).collect()
    got = (out[0]["signal"], pytest.approx(out[0]["score"])) if out else None
    assert got == want


def test_merged_row_lists_strategies_in_order(spark):
    rows = [("A", 1, i, f"s{i}", "buy", 0.5, f"r{i}") for i in (3, 0, 2, 1)]
    out = vt.merge_votes(spark.createDataFrame(rows, VOTES), ["code", "scan"]).first()
    assert out["strategy"] == "s0+s1+s2+s3" and out["reason"] == "r0 | r1 | r2"


def test_throttle_window(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("k", t, 1), ("k", t, 2), ("k", t + dt.timedelta(seconds=0.5), 3), ("k", t + dt.timedelta(seconds=1.1), 4)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, event_id long")
    assert {r["event_id"] for r in al.throttle(df, 1).collect()} == {1, 4}


def test_alert_numbers_round_like_printf(spark):
    values = [0.125, 0.145, 2.675, 1234.5, -0.5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in values], "x double").select(al.fixed("x", 2)).collect()]
    assert got == [f"{x:.2f}" for x in values]


def live_bars(spark, n=200, code="A"):
    rows = [(code, day(i), 10.0 + i % 7, 10.5 + i % 7, 9.5 + i % 5, 10.0 + (i * 3) % 7, 1e6, (10.0 + (i * 3) % 7) * 1e6) for i in range(n)]
    return spark.createDataFrame(rows, "code string, date date, open double, high double, low double, close double, volume double, amount double")


def test_all_live_strategies_return_a_side_and_a_score(spark):
    quotes = spark.createDataFrame([("A", float(p)) for p in (8, 10, 12, 20)], "code string, price double")
    out = lv.score_quotes(quotes, lv.live_state(live_bars(spark))).collect()
    assert len(out) == 4 * len(lv.LIVE)
    assert all(r["side"] in ("buy", "sell", "hold") and 0 <= r["score"] <= 1 for r in out)


def test_short_live_history_is_not_scored(spark):
    quotes = spark.createDataFrame([("A", 10.0)], "code string, price double")
    assert lv.score_quotes(quotes, lv.live_state(live_bars(spark, 10))).count() == 0


def test_no_strategy_means_moving_average_rule(spark):
    quotes = spark.createDataFrame([("A", None)], "code string, price double")
    out = lv.score_quotes(quotes, lv.live_state(live_bars(spark)), ()).collect()
    assert [r["strategy"] for r in out] == ["ma_fallback"]


def test_one_search_for_several_crossings(spark, monkeypatch):
    """A row per search, whatever the number of conditions; it ends with the block in which a final one is met."""
    monkeypatch.setattr(crossings, "FAN", 4)
    series = [5.0, 6.0, 7.0, 3.0, 8.0, 2.0, 9.0, 9.0, 1.0, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0, 0.0]
    df = spark.createDataFrame([("A", i, x) for i, x in enumerate(series)], "code string, idx long, x double")
    searches = spark.createDataFrame([("A", 0, 4.0), ("A", 4, 1.5), ("A", 4, 0.5), ("A", 9, -1.0), ("B", 0, 4.0)], "code string, start long, low double")
    conditions = {"under": lambda lo, hi: lo <= F.col("low"), "over": lambda lo, hi: hi >= 6.5}
    found = crossings.first_of_each(searches, crossings.tree(df, "code"), "code", conditions, ["under"]).collect()
    want = {("A", 4.0, 3, 2), ("A", 1.5, 8, 4), ("A", 0.5, 17, 4), ("A", -1.0, None, 9), ("B", 4.0, None, None)}
    assert len(found) == 5 and {(r.code, r.low, r.under, r.over) for r in found} == want
