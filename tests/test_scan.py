"""Slice-wise scans against plain Python, with one key holding most rows."""

import random
from collections import deque

import pytest

from tickloom.functions import scan
from tickloom.functions.scan import running_max, running_sums, sliced, spaced_picks
from tickloom.operators import portfolio as pf


def rows_with_hot_key(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        code = "hot" if rng.random() < 0.6 else rng.choice("abc")
        out.append((code, i // 50, i // 10, i, float(rng.randint(-9, 9)), rng.random()))
    return out


SCHEMA = "code string, day int, part int, i int, q double, x double"


def by_code(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[3]):
        out.setdefault(r[0], []).append(r)
    return out


def test_running_sums_and_lows(spark):
    rows = rows_with_hot_key()
    df = running_sums(spark.createDataFrame(rows, SCHEMA), ["code"], ["day", "part"], ["i"], ["q"], low_of="q")
    got = {r["i"]: (r["run_q"], r["low"], r["low_before"]) for r in df.collect()}
    for hist in by_code(rows).values():
        total, low = 0.0, None
        for r in hist:
            before, total = low, total + r[4]
            low = total if low is None else min(low, total)
            assert got[r[3]] == (total, low, before)


def test_running_max(spark):
    rows = rows_with_hot_key()
    df = running_max(spark.createDataFrame(rows, SCHEMA), ["code"], ["day", "part"], ["i"], "x", "top")
    got = {r["i"]: r["top"] for r in df.collect()}
    for hist in by_code(rows).values():
        top = 0.0
        for r in hist:
            top = max(top, r[5])
            assert got[r[3]] == top


def test_only_keys_beyond_the_room_are_cut(spark):
    rows = rows_with_hot_key()
    sizes = {code: len(hist) for code, hist in by_code(rows).items()}
    room = max(n for code, n in sizes.items() if code != "hot")
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "date_add(DATE'2020-01-01', day) AS date")
    df, cuts, order = sliced(df, ["code"], ["date", "part"], ["i"], room)
    out = running_sums(df, ["code"], cuts, order, ["q"], low_of="q")
    got = out.collect()
    assert len(got) == len(rows)
    slices = {(r["code"], *(r[c] for c in cuts)) for r in got}
    assert len([s for s in slices if s[0] != "hot"]) == len(sizes) - 1
    assert len([s for s in slices if s[0] == "hot"]) == len({(r[2]) for r in rows if r[0] == "hot"})
    by_row = {r["i"]: (r["run_q"], r["low"]) for r in got}
    for hist in by_code(rows).values():
        total, low = 0.0, 0.0
        for k, r in enumerate(hist):
            total += r[4]
            low = total if k == 0 else min(low, total)
            assert by_row[r[3]] == (total, low)
    none, cuts, order = sliced(df.limit(0), ["code"], ["part"], ["i"])
    assert running_sums(none, ["code"], cuts, order, ["q"]).collect() == []


@pytest.fixture(params=[None, 100])
def room(request, monkeypatch):
    """All codes whole, or the hot one cut."""
    if request.param:
        monkeypatch.setattr(scan, "ROOM", request.param)


def random_trades(seed, n=500):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        code = "hot" if rng.random() < 0.7 else rng.choice("ab")
        side = "BUY" if rng.random() < 0.5 else "SELL"
        out.append((code, i // 60, i // 12, i, side, float(rng.randint(1, 50)), round(rng.uniform(1, 90), 2)))
    return out


TRADES = "code string, day int, part int, i int, side string, qty double, price double"


@pytest.mark.parametrize("levels", [[], ["day"], ["day", "part"]])
@pytest.mark.parametrize("seed,per_slice,unit", [(1, 5, 1.0), (2, 60, 2.0**40), (3, 10_000, 2.0**-20)])
def test_fifo_equals_queue(spark, room, seed, per_slice, unit, levels):
    rows = [(*r[:5], r[5] * unit, r[6]) for r in random_trades(seed)]
    out = pf.fifo_pnl(spark.createDataFrame(rows, TRADES), levels, ["i"], ["i"], per_slice=per_slice)
    got = {r["i"]: (r["covered"], r["pnl"]) for r in out.collect()}
    lots = {}
    for code, _, _, i, side, qty, price in rows:
        book = lots.setdefault(code, deque())
        if side == "BUY":
            book.append([qty, price])
            continue
        left, pnl = qty, 0.0
        while left > 0 and book:
            used = min(left, book[0][0])
            pnl += used * (price - book[0][1])
            left -= used
            book[0][0] -= used
            if book[0][0] == 0:
                book.popleft()
        covered, value = got.pop(i)
        assert covered == qty - left and value == pytest.approx(pnl, rel=1e-9, abs=1e-6 * unit)
    assert not got


@pytest.mark.parametrize("levels", [[], ["day", "part"]])
@pytest.mark.parametrize("scale", [0.5, 40.0, 300.0])
def test_average_cost_equals_ledger(spark, room, monkeypatch, levels, scale):
    # A small scale cuts often; terms older than a whole stretch of it would then still count.
    monkeypatch.setattr(pf, "SCALE", max(scale, 40.0))
    rows = random_trades(7)
    if scale < 1:
        # Halved again and again: beyond what one scale of doubles holds.
        rows = [("hot", i // 60, i // 12, i, "SELL" if i % 3 == 2 else "BUY", 9.0 if i % 3 == 2 else 5.0, 1.0 + i % 7) for i in range(1500)]
    out = pf.average_cost(spark.createDataFrame(rows, TRADES), levels, ["i"])
    got = {r["i"]: (r["held"], r["avg_cost"]) for r in out.collect()}
    state = {}
    for code, _, _, i, side, qty, price in rows:
        held, cost = state.get(code, (0.0, 0.0))
        if side == "BUY":
            cost = (cost * held + price * qty) / (held + qty)
            held += qty
        else:
            held = max(0.0, held - qty)
        state[code] = held, cost
        assert got[i][0] == held and got[i][1] == pytest.approx(cost, abs=1e-9)


def test_average_cost_of_whole_codes_moves_trades_once(spark, monkeypatch):
    stored = []

    def spy(df):
        stored.append(df.count())
        return df

    monkeypatch.setattr(pf, "cut_lineage", spy)
    out = pf.average_cost(spark.createDataFrame(random_trades(7), TRADES).repartition(3), ["day", "part"], ["i"])
    assert sum(stored) == 0
    assert out.count() == 500


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("slices", [1, 2, 5])
def test_spaced_picks_equal_fold(spark, seed, slices):
    rng = random.Random(seed)
    window = 40
    rows, t = [], 0
    for i in range(500):
        t += rng.choice([0, 1, 3, 7, 30, 90]) if seed % 2 else rng.choice([0, 1, 2])
        rows.append(("hot" if rng.random() < 0.8 else "b", t, i))
    out = spaced_picks(spark.createDataFrame(rows, "key string, us long, i long"), "key", "us", "i", window, window * slices)
    got = {r["i"] for r in out.collect() if r["sent"]}
    last, want = {}, set()
    for key, us, i in rows:
        if key not in last or us - last[key] >= window:
            last[key] = us
            want.add(i)
    assert got == want and out.count() == len(rows)
