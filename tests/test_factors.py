import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import factors as fx


def bars_frame(n, seed=0, code="A"):
    rng = np.random.default_rng(seed)
    close = 10 * np.cumprod(1 + rng.normal(0, 0.01, n))
    return pd.DataFrame(
        {
            "code": code,
            "date": [d.date() for d in pd.bdate_range("2022-01-01", periods=n)],
            "open": close, "high": close * (1 + rng.uniform(0, 0.03, n)),
            "low": close * (1 - rng.uniform(0, 0.03, n)), "close": close,
            "volume": rng.integers(1, 1000, n).astype(float), "amount": close * 1000,
        }
    )


def panel(spark, pdf, **kw):
    return fx.factor_panel(spark.createDataFrame(pdf), **kw).orderBy("code", "date").toPandas()


def model_ols(high, low, n=18, ridge=1e-10):
    """Ridge regression window by window through a linear solver."""
    y = pd.Series(high) / pd.Series(high).rolling(n, min_periods=1).mean()
    x = pd.Series(low) / pd.Series(low).rolling(n, min_periods=1).mean()
    out = np.full((len(y), 3), np.nan)
    for i in range(n - 1, len(y)):
        xs, ys = x[i - n + 1 : i + 1].to_numpy(), y[i - n + 1 : i + 1].to_numpy()
        a = np.column_stack([np.ones(n), xs])
        coef = np.linalg.solve(a.T @ a + ridge * np.eye(2), a.T @ ys)
        ss = float(((ys - a @ coef) ** 2).sum())
        tot = float(((ys - ys.mean()) ** 2).sum())
        out[i] = coef[1], max(0.0, 1 - ss / tot) if tot > 1e-12 else 0.0, np.sqrt(ss / n)
    return out


def test_regression_equals_solver(spark):
    pdf = bars_frame(120)
    got = fx.rsrs(spark.createDataFrame(pdf), mask=False).orderBy("date").toPandas()
    want = model_ols(pdf["high"], pdf["low"])
    for col, k in (("rsrs_raw", 0), ("rsrs_r2", 1), ("resid_std", 2)):
        np.testing.assert_allclose(got[col].to_numpy(float), want[:, k], rtol=1e-6, atol=1e-9)


def test_zscore_with_rows_leaving_the_window(spark):
    pdf = bars_frame(300, seed=3)
    got = fx.rsrs(spark.createDataFrame(pdf), z=100, mask=False).orderBy("date").toPandas()
    b = got["rsrs_raw"].astype(float)
    roll = b.rolling(100, min_periods=30)
    want = (b - roll.mean()) / (roll.std() + 1e-9)
    np.testing.assert_allclose(got["rsrs_zscore"].to_numpy(float), want.to_numpy(), rtol=1e-6, atol=1e-8)


def test_price_factors_equal_pandas(spark):
    pdf = bars_frame(80, seed=5)
    pdf.loc[30, "close"] = None
    got = panel(spark, pdf)
    c = pdf["close"].ffill()
    ret = c.pct_change()
    np.testing.assert_allclose(got["mom"].astype(float), c.pct_change(20), rtol=1e-9)
    np.testing.assert_allclose(got["volatility"].astype(float), ret.rolling(20).std(), rtol=1e-9)
    np.testing.assert_allclose(
        got["vol_ratio"].astype(float), pdf["volume"] / pdf["volume"].rolling(20).mean(), rtol=1e-9
    )


def test_short_history_is_unknown(spark):
    got = panel(spark, bars_frame(15))
    assert got[list(fx.RSRS_COLUMNS)].isna().all().all()


def test_constant_prices_do_not_fail(spark):
    pdf = bars_frame(60)
    pdf["high"], pdf["low"] = 11.0, 9.0
    got = panel(spark, pdf)
    assert (got["resid_std"].dropna() >= 0).all() and (got["rsrs_r2"].dropna() == 0).all()


def test_r2_stays_within_bounds(spark):
    r2 = panel(spark, bars_frame(400, seed=9))["rsrs_r2"].dropna()
    assert len(r2) and ((r2 >= 0) & (r2 <= 1 + 1e-12)).all()


def test_new_listing_mask_opens_at_row_36(spark):
    got = fx.rsrs(spark.createDataFrame(bars_frame(100))).orderBy("date").toPandas()
    assert got["rsrs_raw"].isna()[:35].all() and got["rsrs_raw"].notna()[35:].all()


FACTORS = {
    "panel": fx.factor_panel,
    "micro": fx.microstructure,
    "multi": lambda b: fx.residual_volatility(fx.amihud_level(fx.reversal(fx.compounded_momentum(fx.daily_return(b))))),
    "averages": fx.moving_averages,
    "lookback": fx.lookback_change,
    "levels": fx.live_levels,
    "corr": fx.price_volume_corr,
}


@pytest.mark.parametrize("name", FACTORS)
def test_no_look_ahead(spark, name):
    """Dropping the last row changes nothing before it."""
    pdf = bars_frame(90, seed=2)
    full = FACTORS[name](spark.createDataFrame(pdf)).orderBy("date").toPandas()[:-1]
    less = FACTORS[name](spark.createDataFrame(pdf[:-1])).orderBy("date").toPandas()
    pd.testing.assert_frame_equal(full, less, check_exact=False, atol=1e-9)


def test_flat_bar_leaves_smart_money_numerator_only(spark):
    rows = [("A", dt.date(2024, 1, 1), 11.0, 9.0, 11.0, 10.0), ("A", dt.date(2024, 1, 2), 10.0, 10.0, 10.0, 30.0)]
    df = spark.createDataFrame(rows, "code string, date date, high double, low double, close double, volume double")
    got = fx.smart_money(df).orderBy("date").select("smart_money").collect()
    assert [r[0] for r in got] == [1.0, 0.25]


def test_regime_and_breadth_edges(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(22)]
    rows = [("A", d, float(10 + i)) for i, d in enumerate(days)] + [("B", d, 10.0) for d in days]
    df = spark.createDataFrame(rows, "code string, date date, close double")
    out = {r["date"]: r for r in fx.market_regime(fx.lookback_change(df)).collect()}
    assert out[days[19]]["regime"] == "neutral" and out[days[21]]["regime"] == "bull"
    assert out[days[20]]["avg_change"] == pytest.approx((30 / 11 - 1) / 2)
    crash = spark.createDataFrame([("A", days[0], -0.2), ("B", days[0], 0.1), ("C", days[0], None)], "code string, date date, ret double")
    row = fx.breadth(crash).first()
    assert row["down_share"] == 0.5 and row["breach"]


def test_growth_needs_a_positive_base(spark):
    df = spark.createDataFrame([("A", 1, -5.0), ("A", 2, 5.0), ("A", 3, 6.0)], "code string, y int, p double")
    got = fx.yoy_growth(df, "p", "y", "g").orderBy("y").select("g").collect()
    assert got[1][0] is None and got[2][0] == pytest.approx(0.2)


def test_ttm_needs_four_reports(spark):
    df = spark.createDataFrame([("A", dt.date(2024, m, 1), 1e4) for m in (3, 6, 9, 12)], "code string, report_date date, net_profit double")
    got = [r[0] for r in fx.ttm_profit(df).orderBy("report_date").select("net_profit_ttm").collect()]
    assert got == [None, None, None, 4.0]


def test_zscore_of_nothing_known(spark):
    df = spark.createDataFrame([("A", dt.date(2024, 1, 1), None)], "code string, date date, rsrs_raw double")
    assert fx.slope_zscore(df).select(F.col("rsrs_zscore")).first()[0] is None


def test_correlation_of_flat_windows_is_unknown(spark):
    """The first two volumes are equal, and later all of a window; neither may fail."""
    pdf = bars_frame(60, seed=5)
    pdf.loc[:1, "volume"] = 7.0
    pdf.loc[30:55, "volume"] = 9.0
    got = fx.price_volume_corr(spark.createDataFrame(pdf)).orderBy("date").toPandas()["pv_corr"].astype(float)
    want = pdf["close"].rolling(20).corr(pdf["volume"])
    flat = [i for i in range(60) if i >= 49 and i <= 55]
    assert got[:19].isna().all() and got[flat].isna().all()
    rest = [i for i in range(19, 60) if i not in flat]
    np.testing.assert_allclose(got[rest].to_numpy(), want[rest].to_numpy(), rtol=1e-6, atol=1e-9)
