"""The panel after loads equals the panel made whole, and rows made anew follow the change."""

import datetime as dt
import math
import random

import pytest

from tickloom.operators import factors as fx
from tickloom.operators import upkeep

KINDS = "code string, date date, open double, high double, low double, close double, volume long, source string"
COLUMNS = ["mom", "ret", "volatility", "vol_factor", "vol_ratio", *fx.RSRS_COLUMNS]


def day(i):
    return dt.date(2010, 1, 1) + dt.timedelta(days=i)


def made(rng, code, i):
    close = rng.uniform(9, 11)
    gap = rng.random() < 0.05
    return (code, day(i), close, close * rng.uniform(1, 1.05), close * rng.uniform(0.95, 1), None if gap else close, rng.randrange(1, 999), "x")


def compare(got, want):
    got, want = ({(r.code, r.date): r for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys()
    for key, row in want.items():
        for c in COLUMNS:
            a, b = got[key][c], row[c]
            assert (a is None) == (b is None), (key, c, a, b)
            assert a is None or math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-7), (key, c, a, b)


def test_three_loads_against_the_whole_panel(spark, tmp_path):
    rng, path, bars = random.Random(4), str(tmp_path / "panel"), {}

    def load(rows):
        bars.update({(r[0], r[1]): r for r in rows})
        return spark.createDataFrame(list(bars.values()), KINDS), spark.createDataFrame(rows, KINDS)

    first = [made(rng, c, i) for c, last in (("a", 200), ("b", 100), ("c", 20), ("d", 35), ("e", 150)) for i in range(last) if i % 7 != 3]
    table, _ = load(first)
    assert upkeep.keep_up(table, path, z=60) == 1
    compare(upkeep.read_panel(spark, path), fx.factor_panel(table, z=60))
    loads = [
        [made(rng, c, i) for c, i in (("a", 200), ("a", 201), ("c", 30), ("new", 5))],
        # A bar put in between, a code that becomes long enough, many new bars of one code.
        [made(rng, "b", 52), *[made(rng, "c", i) for i in range(31, 60)], *[made(rng, "a", i) for i in range(202, 300)], made(rng, "d", 36)],
        [made(rng, "a", 120), made(rng, "new", 4), *[made(rng, "new", i) for i in range(6, 90)], made(rng, "d", 60)],
    ]
    for version, rows in enumerate(loads, 2):
        table, new = load(rows)
        assert upkeep.keep_up(table, path, upkeep.first_changes(new), z=60) == version
        compare(upkeep.read_panel(spark, path), fx.factor_panel(table, z=60))


def test_rows_made_follow_the_change(spark):
    rng = random.Random(6)
    rows = [made(rng, c, i) for c in ("a", "b", "c") for i in range(400)]
    kept = upkeep.kept_panel(spark.createDataFrame(rows, KINDS), z=100).cache()
    extra = [made(rng, "a", 400), made(rng, "b", 390)]
    table = spark.createDataFrame([r for r in rows if r[:2] != ("b", day(390))] + extra, KINDS)
    changes = upkeep.first_changes(spark.createDataFrame(extra, KINDS))
    got = upkeep.changed_rows(kept, table, changes, z=100)
    assert {(r.code, r.date) for r in got.select("code", "date").collect()} == {("a", day(400))} | {("b", day(i)) for i in range(390, 400)}
    want = fx.factor_panel(table, z=100).join(got.select("code", "date"), ["code", "date"])
    compare(upkeep.panel(got), want)
    kept.unpersist()


@pytest.mark.parametrize("rows", [[], [("a", day(0), None, None, None, None, None, None)]])
def test_odd_tables(spark, rows):
    bars = spark.createDataFrame(rows, KINDS)
    compare(upkeep.panel(upkeep.kept_panel(bars)), fx.factor_panel(bars))
    assert upkeep.changed_rows(upkeep.kept_panel(bars), bars, upkeep.first_changes(bars.limit(0))).count() == 0
    assert upkeep.changed_rows(upkeep.kept_panel(bars.limit(0)), bars, upkeep.first_changes(bars)).count() == len(rows)
