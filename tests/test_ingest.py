import datetime as dt

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from tickloom.operators import clean as cl
from tickloom.operators import merge as mg
from tickloom.operators import quality as q
from tickloom.sources import tables as tb

D = dt.date
BAR = "code string, date date, open double, high double, low double, close double, vol long"


def days(n, start=D(2023, 1, 2)):
    return [start + dt.timedelta(days=i) for i in range(n)]


def bars(spark, n=20, code="600000", start=D(2023, 1, 2), **change):
    rows = []
    for i, d in enumerate(days(n, start)):
        row = dict(code=code, date=d, open=10.0, high=11.0, low=9.0, close=10.0 + i, vol=100)
        if i == 3:
            row.update(change)
        rows.append(tuple(row.values()))
    return spark.createDataFrame(rows, BAR)


def ext(spark, n=20, code="600000"):
    return bars(spark, n, code).withColumns({"turnover": F.lit(0.5), "pct_change": F.lit(1.5)})


@pytest.mark.parametrize(
    "change,reason",
    [({}, "ok"), ({"high": 8.0}, "high_lt_low:1_rows"), ({"close": -1.0}, "negative_close:1_rows")],
)
def test_validation_reasons(spark, change, reason):
    assert q.validate(bars(spark, **change)).first()["reason"] == reason


def test_validation_first_rule_wins(spark):
    assert q.validate(bars(spark, 5, high=8.0)).first()["reason"] == "too_few_rows:5"
    assert q.validate(bars(spark).drop("close")).first()["reason"] == "missing_cols:['close']"
    empty = bars(spark).filter("false")
    named = spark.createDataFrame([("600000",)], "code string")
    assert q.validate(empty, expected=named).first()["reason"] == "df_empty"
    gone = bars(spark).withColumns({c: F.when(F.col("close") < 15, F.col(c)) for c in ("open", "high", "low")})
    gone = gone.withColumn("close", F.when(F.col("close") < 15, F.col("close")))
    assert q.validate(gone).first()["reason"] == "too_many_nan_rows:75%"


def test_merged_order_and_duplicates(spark):
    def check(dates):
        rows = [("A", d, i) for i, d in enumerate(dates)]
        return q.validate_merged(spark.createDataFrame(rows, "code string, date date, seq long"), slice_rows=3).first()["reason"]

    ds = days(10)
    assert check(ds) == "ok"
    assert check(ds[:5] + ds[4:]) == "duplicate_dates:1"
    assert check(ds[5:] + ds[:5]) == "date_not_sorted"
    assert check([ds[1], ds[0]] + ds[2:]) == "date_not_sorted"


def test_missing_range(spark):
    stored = spark.createDataFrame(
        [("none", None), ("old", D(2024, 1, 10)), ("now", D(2024, 1, 20))], "code string, max_date date"
    )
    got = {r["code"]: (r["start_date"], r["end_date"]) for r in q.missing_range(stored, F.lit("2024-01-20").cast("date")).collect()}
    end = D(2024, 1, 20)
    assert got == {"none": (D(2005, 1, 1), end), "old": (D(2024, 1, 11), end), "now": (end, end)}


def test_dual_merge_cases(spark):
    a, b = bars(spark), ext(spark)
    none = bars(spark).filter("false")
    only_a = mg.merge_dual(a, b.filter("false"))
    assert only_a.count() == 20 and only_a.filter("turnover IS NOT NULL").count() == 0
    only_b = mg.merge_dual(none, b)
    assert only_b.count() == 20 and only_b.filter("turnover = 0.5").count() == 20
    both = mg.merge_dual(a, b.withColumn("close", F.lit(0.0)))
    assert both.filter("close > 0 AND pct_change = 1.5").count() == 20


def test_upsert_keeps_the_right_side(spark):
    old, new = bars(spark, 30), bars(spark, 20).withColumn("close", F.lit(99.0))
    kept_new = mg.upsert(old, new)
    assert kept_new.count() == 30 and kept_new.filter("close = 99").count() == 20
    assert mg.upsert(old, new, keep="old").filter("close = 99").count() == 0


def test_upsert_reduces_copies(spark):
    old = bars(spark, 5)
    copies = old.unionByName(old).unionByName(old)
    assert mg.upsert(copies, old).count() == 5


@pytest.mark.parametrize("keep,want", [("new", 4.0), ("old", 1.0)])
def test_upsert_with_repeats_follows_arrival(spark, keep, want):
    def rows(*values):
        return spark.createDataFrame([("A", D(2024, 1, 1), x, int(x)) for x in values], "code string, date date, close double, seq long")

    out = mg.upsert(rows(1.0, 2.0), rows(3.0, 4.0), keep=keep, seq="seq").collect()
    assert [r["close"] for r in out] == [want]


def _load(spark, a, b, c, stored, universe, force=False):
    names = spark.createDataFrame([(u,) for u in universe], "code string")
    return mg.ingest(a, b, c, stored, names, F.lit("2023-01-31").cast("date"), force)


def test_ingest_falls_back_and_logs(spark):
    none = bars(spark).filter("false")
    a = bars(spark, 20, "600000").unionByName(bars(spark, 20, "600003"))
    b = ext(spark, 20, "600000").unionByName(ext(spark, 20, "600001"))
    c = bars(spark, 20, "600002").unionByName(bars(spark, 5, "600004"))
    table, log = _load(spark, a, b, c, none, ["600000", "600001", "600002", "600003", "600004", "600005"])
    every = log.collect()
    assert [(r["code"], r["reason"]) for r in every if r["status"] == "validation"] == [("600004", "too_few_rows:5")]
    assert {r["code"] for r in mg.last_records(log).collect()} == {f"60000{i}" for i in range(6)}
    row = tb.run_stats(log).first()
    assert (row["success"], row["failed"], row["validation_failures"], row["total"]) == (4, 2, 1, 6)
    got = {r["code"]: (r["status"], r["source"], r["rows"], r["reason"]) for r in every if r["status"] != "validation"}
    assert got == {
        "600000": ("success", "merged", 20, None),
        "600001": ("success", "akshare", 20, None),
        "600002": ("success", "baostock", 20, None),
        "600003": ("success", "tdx", 20, None),
        "600004": ("failed", None, None, "validate:too_few_rows:5"),
        "600005": ("failed", None, None, "complete_fail"),
    }
    assert table.count() == 80


def test_ingest_is_incremental_and_skips_current_codes(spark):
    stored = bars(spark, 10).unionByName(bars(spark, 5, "600009", D(2023, 1, 26)))
    a = bars(spark, 25).withColumn("close", F.lit(50.0)).unionByName(bars(spark, 25, "600009"))
    none = bars(spark).filter("false")
    table, log = _load(spark, a, none, none, stored, ["600000", "600009"])
    rows = {r["code"]: r for r in log.collect()}
    assert rows["600009"]["status"] == "skipped" and rows["600000"]["rows"] == 25
    assert table.filter("code = '600000' AND close = 50").count() == 15
    full, _ = _load(spark, a, none, none, stored, ["600000"], force=True)
    assert full.filter("code = '600000' AND close = 50").count() == 25
    assert full.filter("code = '600009'").count() == 5


def test_sector_ingest_keeps_old_rows(spark):
    def sector(n, close):
        return bars(spark, n, "x").select(F.lit("banks").alias("sector_name"), "date", F.lit(close).alias("close"))

    listed = spark.createDataFrame([("banks",), ("mines",)], "name string")
    table, log = mg.ingest_sectors(sector(5, 1.0), sector(10, 2.0), listed, F.lit("2023-01-09").cast("date"))
    assert table.filter("close = 1").count() == 5 and table.filter("close = 2").count() == 3
    got = {r["sector_name"]: (r["status"], r["reason"]) for r in log.collect()}
    assert got == {"banks": ("success", None), "mines": ("failed", "empty_data")}


@pytest.mark.parametrize(
    "text,want", [("20240305", D(2024, 3, 5)), ("2024/03/05", D(2024, 3, 5)), ("2024-03-05 15:00", D(2024, 3, 5)), ("soon", None)]
)
def test_dates(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(cl.unify_date("t")).first()[0] == want


def test_code_column_by_pattern(spark):
    df = spark.createDataFrame([("银行", "600000"), ("银行", "12345x")], "`名称` string, `编号` string")
    assert cl.code_column(df) == "编号"
    assert [r["code"] for r in cl.clean_constituents(df).collect()] == ["600000"]


def test_bars_round_trip_reads_only_what_is_asked(spark, tmp_path):
    b = bars(spark, 20).withColumnRenamed("vol", "volume").withColumns({"amount": F.lit(1).cast("long")})
    tb.save_bars(b, str(tmp_path / "bars"))
    out = tb.load_bars(spark, str(tmp_path / "bars"), ["600000"], "2023-01-05", "2023-01-10")
    assert out.count() == 6 and "volume" in out.columns
    plan = out.select("close")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(date), IsNotNull(code), GreaterThanOrEqual(date" in plan.replace(
        "IsNotNull(code), IsNotNull(date)", "IsNotNull(date), IsNotNull(code)"
    )
    assert "high" not in plan.split("ReadSchema:")[1]


def test_code_from_file_name(spark, tmp_path):
    from pyspark.sql.types import StructType

    from tickloom.schemas import BARS

    schema = StructType([f for f in BARS.fields if f.name in ("date", "close")])
    (bars(spark, 3).select("date", "close").coalesce(1).write.parquet(str(tmp_path / "w")))
    part = next((tmp_path / "w").glob("part-*.parquet"))
    (tmp_path / "codes").mkdir()
    (tmp_path / "codes" / "600519.parquet").write_bytes(part.read_bytes())
    assert tb.load_bars(spark, str(tmp_path / "codes"), schema=schema).select("code").distinct().first()[0] == "600519"


def test_failed_list_skips_comments_and_bad_rows(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "list.txt").write_text("# head\n600000\t1\tfail\nbroken\n000001\tx\ty\n000002\t0\tz\n")
    got = {(r["code"], r["market"]) for r in tb.load_failed_list(spark, str(tmp_path / "f")).collect()}
    assert got == {("600000", 1), ("000002", 0)}


def test_run_log_counts(spark):
    log = spark.createDataFrame(
        [("a", "success", "tdx", 1), ("b", "success", "other", 2), ("b", "success", "akshare", 3), ("c", "failed", None, 4), ("d", "skipped", None, 5)],
        "code string, status string, source string, seq long",
    ).withColumn("reason", F.lit("r"))
    assert {r["status"]: r["codes"] for r in mg.status_counts(log).collect()} == {"success": 2, "failed": 1, "skipped": 1}
    assert {r["source"]: r["calls"] for r in mg.source_counts(log).collect()} == {"tdx": 1, "merged": 1, "akshare": 1}
    row = tb.run_stats(log).first()
    assert (row["success"], row["failed"], row["skipped"], row["total"]) == (2, 1, 1, 4)
    assert [(x["status"], x["code"]) for x in tb.run_details(log).collect()] == [("failed", "c")]


def test_panel_over_a_bucketed_table_needs_no_exchange(spark, tmp_path):
    from tickloom.operators import factors as fx
    from tickloom.plans import views as v

    bars = v.bars_m(spark, SF_DIR).cache()
    tb.save_bucketed(bars, "bars_in_buckets", 4, str(tmp_path / "bars"))
    try:
        assert len(list((tmp_path / "bars").glob("*.parquet"))) <= 4
        stored = tb.load_bucketed(spark, "bars_in_buckets", "1995-01-01")
        made = fx.factor_panel(stored)
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        key = lambda df: sorted(str(r) for r in df.select("code", "date", F.round("mom", 6), F.round("rsrs_zscore", 6)).collect())
        assert key(made) == key(fx.factor_panel(bars.filter("date >= '1995-01-01'")))
    finally:
        spark.sql("DROP TABLE bars_in_buckets")
        bars.unpersist()


def test_a_load_works_each_source_out_once(spark):
    """Sources are plans: one that several branches read would be worked out for each of them."""
    days = [dt.date(2023, 1, 2) + dt.timedelta(days=i) for i in range(20)]
    rows = [(c, d, 10.0, 10.5, 9.5, 10.0, 100, 1000.0) for c in ("000001", "000002") for d in days]
    source = spark.createDataFrame(rows, "code string, date date, open double, high double, low double, close double, volume long, amount double")
    worked = [spark.sparkContext.accumulator(0) for _ in range(3)]

    def counted(df, acc):
        def one(x):
            acc.add(1)
            return x

        return df.withColumn("code", F.udf(one, "string").asNondeterministic()("code"))

    a, b, c = (counted(source, acc) for acc in worked)
    b = b.withColumn("turnover", F.lit(1.0))
    names = source.select("code").distinct()
    table, log = mg.ingest(a, b, c, source.filter("code = 'none'").select("code", "date", "close"), names, F.lit("2023-01-31").cast("date"))
    assert table.count() == 40 and {r.status for r in log.collect()} == {"success"}
    assert [acc.value <= 40 for acc in worked] == [True] * 3
