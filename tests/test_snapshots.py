"""Stored bars changed in place: what is written, what is read, and what a failed load leaves."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import merge as mg
from tickloom.sources import snapshots

SCHEMA = "code string, date date, close double"


def day(i):
    return dt.date(2020, 1, 1) + dt.timedelta(days=i)


def bars(spark, codes, days, close=1.0):
    return spark.createDataFrame([(c, day(i), float(close) + i) for c in codes for i in days], SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.select("code", "date", "close").collect())


def names(codes):
    return [f"{c:06d}" for c in codes]


def files(spark, path, version=None):
    return {r.file: r for r in snapshots.manifest(spark, path, version).collect()}


def test_a_load_over_one_code_in_a_hundred_writes_one_file_in_a_hundred(spark, tmp_path):
    path, codes = str(tmp_path / "t"), names(range(400))
    assert snapshots.change(bars(spark, codes, range(40)), path, file_rows=160) == 1
    before = files(spark, path)
    assert len(before) == 100 and sum(f.rows for f in before.values()) == 16000
    assert snapshots.change(bars(spark, codes[200:204], range(35, 45), 5), path, file_rows=160) == 2
    after = files(spark, path)
    assert len(before.keys() & after.keys()) >= 98 and len(after.keys() - before.keys()) <= 2
    assert rows(snapshots.read(spark, path, 1)) == rows(bars(spark, codes, range(40)))
    want = {(c, d): x for c, d, x in rows(bars(spark, codes, range(40)))}
    want |= {(c, d): x for c, d, x in rows(bars(spark, codes[200:204], range(35, 45), 5))}
    assert rows(snapshots.read(spark, path)) == sorted((c, d, x) for (c, d), x in want.items())


def test_a_failed_load_leaves_the_old_snapshot(spark, tmp_path):
    path, codes = str(tmp_path / "t"), names(range(10))
    snapshots.change(bars(spark, codes, range(10)), path)
    old = rows(snapshots.read(spark, path))
    bad = bars(spark, codes, range(20), 9).withColumn("close", F.when(F.col("date") < day(19), F.col("close")).otherwise(F.raise_error(F.lit("broken"))))
    for failing in (bad, bars(spark, [None], [1]), bars(spark, codes, [1]).withColumn("date", F.lit(None).cast("date"))):
        with pytest.raises(Exception):
            snapshots.change(failing, path)
        assert snapshots.versions(spark, path) == [1] and rows(snapshots.read(spark, path)) == old


def test_of_two_loads_at_once_the_later_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.change(bars(spark, ["a"], range(3)), path)
    assert snapshots.change(bars(spark, ["a"], [3]), path, base=1) == 2
    with pytest.raises(snapshots.Conflict):
        snapshots.change(bars(spark, ["b"], [4]), path, base=1)
    assert rows(snapshots.read(spark, path)) == rows(bars(spark, ["a"], range(4)))
    assert snapshots.change(bars(spark, ["b"], [4]), path, base=2) == 3


@pytest.mark.parametrize("seed", [2])
def test_many_loads_against_a_plain_table(spark, tmp_path, seed):
    rng, path, want, states = random.Random(seed), str(tmp_path / "t"), {}, {}
    for load in range(6):
        new = {(f"c{rng.randrange(30):02d}", day(rng.randrange(800))): float(rng.randrange(99)) for _ in range(rng.choice([1, 40, 150]))}
        keep, whole = rng.choice(["new", "old"]), load == 4
        df = spark.createDataFrame([(c, d, x) for (c, d), x in new.items()], SCHEMA)
        version = snapshots.change(df, path, keep=keep, whole_codes=whole, file_rows=rng.choice([5, 50]))
        if whole:
            want = {k: x for k, x in want.items() if k[0] not in {c for c, _ in new}}
        want = {**want, **new} if keep == "new" else {**new, **want}
        states[version] = sorted((c, d, x) for (c, d), x in want.items())
    for version, state in states.items():
        assert rows(snapshots.read(spark, path, version)) == state
    for f in files(spark, path).values():
        assert f.min_code <= f.max_code and f.min_date.year == f.max_date.year == f.year and f.lo <= f.min_code
    picked = ["c03", "c17"]
    got = rows(snapshots.read(spark, path, None, picked, day(100), day(500)))
    assert got == [x for x in states[6] if x[0] in picked and day(100) <= x[1] <= day(500)]
    assert snapshots.expire(spark, path, keep=2) > 0 and snapshots.versions(spark, path) == [5, 6]
    assert rows(snapshots.read(spark, path, 5)) == states[5] and rows(snapshots.read(spark, path)) == states[6]
    assert snapshots.expire(spark, path, keep=2) == 0


def test_reading_opens_only_files_that_can_hold_the_rows(spark, tmp_path):
    path, codes = str(tmp_path / "t"), names(range(50))
    snapshots.change(bars(spark, codes, range(0, 1000, 10)), path, file_rows=100)
    assert len(snapshots.read(spark, path).inputFiles()) > 20
    few = snapshots.read(spark, path, None, ["000007"], day(400), day(500))
    assert len(few.inputFiles()) == 1 and few.count() == 11


def test_several_tasks_write_a_large_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "PART_ROWS", 40)
    whole = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(whole, False)
    path, codes = str(tmp_path / "t"), names(range(50))
    snapshots.change(bars(spark, codes, range(20)), path)
    snapshots.change(bars(spark, codes[10:40], range(15, 25), 5), path)
    spark.conf.unset(whole)
    want = {(c, d): x for c, d, x in rows(bars(spark, codes, range(20)))}
    want |= {(c, d): x for c, d, x in rows(bars(spark, codes[10:40], range(15, 25), 5))}
    assert rows(snapshots.read(spark, path)) == sorted((c, d, x) for (c, d), x in want.items())
    (f,) = files(spark, path).values()
    assert (f.rows, f.min_code, f.max_code, f.min_date, f.max_date) == (len(want), codes[0], codes[-1], day(0), day(24))
    assert len(snapshots.read(spark, path).inputFiles()) > 1


def test_empty_loads_and_new_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        snapshots.read(spark, path)
    assert snapshots.change(bars(spark, [], []), path) == 1 and rows(snapshots.read(spark, path)) == []
    assert snapshots.change(bars(spark, ["a"], [1]), path) == 2
    assert snapshots.change(bars(spark, [], []), path) == 2
    wide = bars(spark, ["b"], [2]).withColumns({"turnover": F.lit(0.5), "__x": F.lit("odd")})
    assert snapshots.change(wide, path) == 3
    got = {r.code: r for r in snapshots.read(spark, path).collect()}
    assert got["a"].turnover is None and got["b"].turnover == 0.5 and got["b"]["__x"] == "odd"


def test_daily_loads_in_place(spark, tmp_path):
    """Three days' loads into one table equal the loads that write it whole."""
    path, codes = str(tmp_path / "t"), names(range(20))
    kinds = "code string, date date, open double, high double, low double, close double, volume long, amount double"

    def source(these, last):
        made = [(c, day(i), 1.0 + i, 2.0 + i, 0.5 + i, 1.5 + i, 100 + i, 5.0) for c in these for i in range(last)]
        return spark.createDataFrame(made, kinds)

    universe = spark.createDataFrame([(c, 1) for c in [*codes, "none"]], "code string, market int")
    stored = source([], 0).withColumns({"turnover": F.lit(None).cast("double"), "pct_change": F.lit(None).cast("double")})
    for run, last in enumerate((30, 45, 60)):
        as_of = F.lit(day(last)).cast("date")
        extra = source(codes[5:], last).withColumns({"turnover": F.lit(0.1), "pct_change": F.lit(0.2)})
        given = source(codes[:15], last), extra, source(codes, last)
        table, log = mg.ingest(*given, stored, universe, as_of, run=run)
        version, own = mg.ingest_in_place(*given, path, universe, as_of, run=run, file_rows=50)
        assert version == run + 1
        key = lambda df: sorted(str(r) for r in df.collect())
        assert key(own) == key(log)
        got = snapshots.read(spark, path)
        assert key(got.select(*sorted(got.columns))) == key(table.select(*sorted(got.columns)))
        stored = snapshots.read(spark, path, version)
    table, log = mg.ingest(*given, stored, universe, as_of, force_full=True, run=9)
    version, own = mg.ingest_in_place(*given, path, universe, as_of, force_full=True, run=9)
    assert key(own) == key(log) and key(snapshots.read(spark, path).select(*sorted(got.columns))) == key(table.select(*sorted(got.columns)))
