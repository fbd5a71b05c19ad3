"""Time-series factors per code, ordered by date.

All functions take and return a long bars table. Bars are unique on (code, date), so
one code's window holds at most one row per calendar day (about 250 a year) and every
operator here shares one exchange and one sort on (code, date).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.num import as_col, clamp, div, nonzero

OLS_WINDOW = 18
Z_WINDOW = 600
Z_MIN = 30
RIDGE = 1e-10
FLAT = 1e-12

SHORT_WINDOW = 20


def history(key: str = "code", order: str = "date"):
    return Window.partitionBy(key).orderBy(order)


def last_rows(n: int, key: str = "code", order: str = "date"):
    """Frame of the current row and the n-1 rows before it."""
    return history(key, order).rowsBetween(1 - n, 0)


def so_far(key: str = "code", order: str = "date"):
    return history(key, order).rowsBetween(Window.unboundedPreceding, 0)


def full(value: Column, over: str | Column, n: int, frame) -> Column:
    """``value``, known only where all n rows of the frame are known."""
    return F.when(F.count(as_col(over)).over(frame) == n, value)


def forward_fill(df: DataFrame, cols, key: str = "code", order: str = "date") -> DataFrame:
    w = so_far(key, order)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


# ---------------------------------------------------------------- returns and volume


def change_over(df: DataFrame, n: int, out: str, price: str = "close", key: str = "code") -> DataFrame:
    """Change against the price n rows earlier; gaps in the price are filled forward first."""
    filled = F.last(price, ignorenulls=True).over(so_far(key))
    return (
        df.withColumn("__p", filled)
        .withColumn(out, div("__p", F.lag("__p", n).over(history(key))) - 1)
        .drop("__p")
    )


def momentum(df: DataFrame, n: int = SHORT_WINDOW) -> DataFrame:
    return change_over(df, n, "mom")


def daily_return(df: DataFrame, key: str = "code") -> DataFrame:
    return change_over(df, 1, "ret", key=key)


def volatility(df: DataFrame, n: int = SHORT_WINDOW) -> DataFrame:
    """Needs ``ret``. The factor prefers calm stocks, hence the sign."""
    w = last_rows(n)
    vol = full(F.stddev_samp("ret").over(w), "ret", n, w)
    return df.withColumns({"volatility": vol, "vol_factor": -vol})


def volume_ratio(df: DataFrame, n: int = SHORT_WINDOW) -> DataFrame:
    w = last_rows(n)
    return df.withColumn("vol_ratio", full(div("volume", F.avg("volume").over(w)), "volume", n, w))


def price_volume_corr(df: DataFrame, n: int = SHORT_WINDOW) -> DataFrame:
    """Unknown where the price or the volume does not move."""
    w = last_rows(n)
    both = F.when(F.col("close").isNotNull(), F.col("volume"))
    # corr() itself fails on a flat window, that of the first two equal volumes too.
    spread = F.sqrt(F.regr_sxx("close", "volume").over(w)) * F.sqrt(F.regr_syy("close", "volume").over(w))
    return df.withColumn("pv_corr", full(div(F.regr_sxy("close", "volume").over(w), spread), both, n, w))


# ---------------------------------------------------------------- rolling regression


def window_mean_norm(df: DataFrame, n: int = OLS_WINDOW) -> DataFrame:
    """High and low relative to their own mean over the window; unknown counts as 1."""
    w = last_rows(n)
    one = F.lit(1.0)
    return df.withColumns(
        {
            "low_norm": F.coalesce(div("low", F.avg("low").over(w)), one),
            "high_norm": F.coalesce(div("high", F.avg("high").over(w)), one),
        }
    )


def rolling_ols(
    df: DataFrame, n: int = OLS_WINDOW, min_history: int = 2 * OLS_WINDOW,
    x: str = "low_norm", y: str = "high_norm",
) -> DataFrame:
    """Ridge regression of y on x over n rows: ``rsrs_raw``, ``rsrs_r2``, ``resid_std``.

    Closed form of the 2x2 normal equations in centred sums. Codes with a shorter
    history than ``min_history`` stay unknown throughout.
    """
    w = last_rows(n)
    sums = df.withColumns(
        {
            "__mx": F.avg(x).over(w),
            "__my": F.avg(y).over(w),
            "__sxx": F.sum(F.col(x) * F.col(x)).over(w),
            "__sxy": F.sum(F.col(x) * F.col(y)).over(w),
            "__cxx": F.regr_sxx(F.col(y), F.col(x)).over(w),
            "__cxy": F.regr_sxy(F.col(y), F.col(x)).over(w),
            "__cyy": F.regr_syy(F.col(y), F.col(x)).over(w),
            "__seen": F.count(F.lit(1)).over(w),
            "__rows": F.count(F.lit(1)).over(Window.partitionBy("code")),
        }
    )
    mx, my, sxx, sxy = (F.col(c) for c in ("__mx", "__my", "__sxx", "__sxy"))
    cxx, cxy, cyy = (F.col(c) for c in ("__cxx", "__cxy", "__cyy"))
    known = (F.col("__seen") == n) & (F.col("__rows") >= min_history)
    det = n * cxx + RIDGE * (n + sxx) + RIDGE * RIDGE
    slope = (n * cxy + RIDGE * sxy) / det
    level = n * (my * cxx - mx * cxy + RIDGE * my) / det
    fitted = sums.withColumns(
        {"__b": F.when(known, slope), "__a": F.when(known, level)}
    )
    b, a = F.col("__b"), F.col("__a")
    miss = my - a - b * mx
    fitted = fitted.withColumn("__ss", cyy - 2 * b * cxy + b * b * cxx + n * miss * miss)
    ss = F.col("__ss")
    fit = F.when(cyy > FLAT, F.greatest(F.lit(0.0), 1 - ss / F.nullif(cyy, F.lit(0.0)))).otherwise(0.0)
    out = fitted.withColumns(
        {
            "rsrs_raw": b,
            "rsrs_r2": F.when(b.isNotNull(), fit),
            "resid_std": F.sqrt(F.greatest(ss, F.lit(0.0)) / n),
        }
    )
    # greatest() skips NULLs, so an unknown regression must be masked again.
    out = out.withColumn("resid_std", F.when(b.isNotNull(), F.col("resid_std")))
    return out.drop(
        "__mx", "__my", "__sxx", "__sxy", "__cxx", "__cxy", "__cyy",
        "__seen", "__rows", "__b", "__a", "__ss",
    )


def slope_zscore(
    df: DataFrame, n: int = Z_WINDOW, least: int = Z_MIN, col: str = "rsrs_raw", out: str = "rsrs_zscore"
) -> DataFrame:
    """z-score of ``col`` over the last n rows.

    Running sums minus the sums n rows back: constant work per row, where a sliding
    frame of 600 rows would be re-summed for every row. Values are taken relative to 1,
    around which slopes lie, to keep the difference of squares accurate.
    """
    w, h = so_far(), history()
    v = F.col(col) - 1
    run = df.withColumns(
        {"__s": F.sum(v).over(w), "__q": F.sum(v * v).over(w), "__n": F.count(v).over(w)}
    )
    old = run.withColumns({f"__o{c}": F.coalesce(F.lag(f"__{c}", n).over(h), F.lit(0)) for c in "sqn"})
    size = F.col("__n") - F.col("__on")
    total = F.coalesce(F.col("__s"), F.lit(0.0)) - F.col("__os")
    square = F.coalesce(F.col("__q"), F.lit(0.0)) - F.col("__oq")
    mean = div(total, size)
    var = div(square - total * mean, size - 1)
    z = div(v - mean, F.sqrt(F.greatest(var, F.lit(0.0))) + 1e-9)
    return old.withColumn(out, F.when(size >= least, z)).drop(
        "__s", "__q", "__n", "__os", "__oq", "__on"
    )


def adaptive(df: DataFrame) -> DataFrame:
    return df.withColumn("rsrs_adaptive", F.col("rsrs_zscore") * F.col("rsrs_r2"))


RSRS_COLUMNS = ("rsrs_raw", "rsrs_r2", "resid_std", "rsrs_zscore", "rsrs_adaptive")


def mask_new_listing(df: DataFrame, needed: int = 2 * OLS_WINDOW, cols=RSRS_COLUMNS) -> DataFrame:
    """Hide the regression factors until ``needed`` closes have been seen."""
    seen = F.count("close").over(so_far())
    return (
        df.withColumn("__seen", seen)
        .withColumns({c: F.when(F.col("__seen") >= needed, F.col(c)) for c in cols})
        .drop("__seen")
    )


def rsrs(df: DataFrame, n: int = OLS_WINDOW, z: int = Z_WINDOW, mask: bool = True) -> DataFrame:
    out = adaptive(slope_zscore(rolling_ols(window_mean_norm(df, n), n, 2 * n), z))
    return mask_new_listing(out, 2 * n) if mask else out


def factor_panel(bars: DataFrame, n: int = OLS_WINDOW, z: int = Z_WINDOW, short: int = SHORT_WINDOW) -> DataFrame:
    """Bars with every price and volume factor; one exchange on code, one sort."""
    out = daily_return(momentum(bars, short))
    return rsrs(volume_ratio(volatility(out, short), short), n, z).drop("low_norm", "high_norm")


# ---------------------------------------------------------------- microstructure


def smart_money(df: DataFrame, n: int = 10) -> DataFrame:
    """Share of volume bought minus sold, judged by where in its range a bar closes."""
    w = last_rows(n)
    span = F.col("high") - F.col("low")
    up = div(F.col("close") - F.col("low"), span) * F.col("volume")
    down = div(F.col("high") - F.col("close"), span) * F.col("volume")
    total = F.sum("volume").over(w)
    net = F.coalesce(F.sum(up).over(w), F.lit(0.0)) - F.coalesce(F.sum(down).over(w), F.lit(0.0))
    return df.withColumn("smart_money", F.when(total < 1, 0.0).otherwise(div(net, total)))


def amihud_stability(df: DataFrame, n: int = SHORT_WINDOW) -> DataFrame:
    """Minus the spread of |return| / amount. Of n rows only n-1 have a return inside."""
    w = last_rows(n - 1)
    return (
        change_over(df, 1, "__ret")
        .withColumn("__illiq", F.abs(F.col("__ret")) / nonzero("amount"))
        .withColumn(
            "illiq_stability",
            F.when(F.count("__illiq").over(w) < 5, 0.0).otherwise(-F.stddev_samp("__illiq").over(w)),
        )
        .drop("__ret", "__illiq")
    )


def gap_penalty(df: DataFrame) -> DataFrame:
    """0 for an open at the last close down to -1 for a gap of 10% or more."""
    prev = F.lag("close").over(history())
    ref = F.when(prev > 0, prev).otherwise(1.0)
    gap = div(F.abs(F.col("open") - prev), ref)
    return df.withColumn(
        "gap_penalty", F.when(prev.isNull(), 0.0).otherwise(-F.least(gap, F.lit(0.1)) * 10)
    )


def microstructure(df: DataFrame, smart: int = 10, illiq: int = SHORT_WINDOW, out_name: str = "micro") -> DataFrame:
    out = gap_penalty(amihud_stability(smart_money(df, smart), illiq))
    return out.withColumn(
        out_name,
        0.5 * F.col("smart_money") + 0.3 * F.col("illiq_stability") + 0.2 * F.col("gap_penalty"),
    )


# ---------------------------------------------------------------- multi-factor inputs


def compounded_momentum(df: DataFrame, n: int = SHORT_WINDOW) -> DataFrame:
    """Needs ``ret``. Unknown returns are skipped; fewer than n rows give 0."""
    w = last_rows(n)
    value = F.coalesce(F.product(1 + F.col("ret")).over(w), F.lit(1.0)) - 1
    return df.withColumn("cmom", F.when(F.count(F.lit(1)).over(w) >= n, value).otherwise(0.0))


def reversal(df: DataFrame, n: int = 5) -> DataFrame:
    """Needs ``ret``."""
    w = last_rows(n)
    value = -F.coalesce(F.sum("ret").over(w), F.lit(0.0))
    return df.withColumn("rev", F.when(F.count(F.lit(1)).over(w) >= n, value).otherwise(0.0))


def amihud_level(df: DataFrame, n: int = SHORT_WINDOW) -> DataFrame:
    """Needs ``ret``. No amount in any row gives 0."""
    w = last_rows(n)
    traded = nonzero("amount")
    value = -F.avg(F.abs(F.col("ret")) / traded).over(w)
    return df.withColumn("liq", F.when(F.count(traded).over(w) == 0, 0.0).otherwise(value))


def residual_volatility(
    df: DataFrame, market: DataFrame | None = None, n: int = 60, least_rows: int = 20
) -> DataFrame:
    """Needs ``ret``. Minus the spread of what the market does not explain."""
    w = last_rows(n)
    plain = -F.stddev_samp("ret").over(w)
    if market is None:
        value = plain
    else:
        m = daily_return(market.withColumn("__all", F.lit(0)), key="__all").select(
            "date", F.col("ret").alias("__mkt")
        )
        df = df.join(m, "date", "left")
        own = F.when(F.col("__mkt").isNotNull(), F.col("ret"))
        mkt = F.when(F.col("ret").isNotNull(), F.col("__mkt"))
        df = df.withColumns(
            {
                "__vr": F.var_samp(own).over(w),
                "__vm": F.var_samp(mkt).over(w),
                "__c": F.covar_samp(own, mkt).over(w),
                "__n": F.count(own).over(w),
            }
        )
        vm, c = F.col("__vm"), F.col("__c")
        beta = F.when(vm > 1e-9, c / (vm + 1e-9)).otherwise(1.0)
        var = F.col("__vr") - 2 * beta * c + beta * beta * vm
        value = F.when(F.col("__n") > 10, -F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(plain)
    enough = F.count(F.lit(1)).over(w) >= least_rows
    return df.withColumn("resvol", F.when(enough, value).otherwise(0.0)).drop(
        "__mkt", "__vr", "__vm", "__c", "__n"
    )


def earnings_yield(pe: str | Column = "pe_ttm") -> Column:
    pe = as_col(pe)
    return F.when(F.abs(pe) > 1e-6, F.try_divide(F.lit(1.0), pe)).otherwise(0.0)


# ---------------------------------------------------------------- averages and regimes


def moving_averages(df: DataFrame, spans=(5, 20, 60)) -> DataFrame:
    return df.withColumns(
        {f"ma{n}": full(F.avg("close").over(last_rows(n)), "close", n, last_rows(n)) for n in spans}
    )


def ma_alignment(price: Column, ma5: Column, ma20: Column, ma60: Column) -> tuple[Column, Column]:
    """Side and score from price above or below three ordered averages."""
    up = (price > ma5) & (ma5 > ma20) & (ma20 > ma60)
    down = (price < ma5) & (ma5 < ma20) & (ma20 < ma60)
    off = div(price, ma60) - 1
    side = F.when(up, "buy").when(down, "sell").otherwise("hold")
    score = F.when(up | down, F.least(F.abs(off) * 10, F.lit(1.0))).otherwise(0.0)
    return side, score


def lookback_change(df: DataFrame, rows_back: int = 19, out: str = "lb_change") -> DataFrame:
    """Close against the close ``rows_back`` rows earlier, known after rows_back + 1 earlier rows."""
    h = history()
    return df.withColumn(
        out,
        F.when(
            F.row_number().over(h) > rows_back + 1,
            div("close", F.lag("close", rows_back).over(h)) - 1,
        ),
    )


def market_regime(df: DataFrame, threshold: float = 0.0, col: str = "lb_change") -> DataFrame:
    """Per date: bull when the average change beats the threshold, neutral when unknown."""
    avg = F.avg(col)
    return df.groupBy("date").agg(
        F.when(avg > threshold, "bull").when(avg.isNull(), "neutral").otherwise("bear").alias("regime"),
        avg.alias("avg_change"),
    )


def breadth(df: DataFrame, limit: float = 0.15, drop: float = -0.095, col: str = "ret") -> DataFrame:
    """Per date: share of codes falling by the drop or more, and whether it breaches the limit."""
    share = F.coalesce(div(F.count_if(F.col(col) <= drop), F.count(col)), F.lit(0.0))
    return df.groupBy("date").agg(share.alias("down_share"), (share > limit).alias("breach"))


def sector_momentum(sectors: DataFrame, n: int = SHORT_WINDOW) -> DataFrame:
    """Sector change over n rows, times 5, within [-1, 1]; too short or no base price gives 0."""
    known = sectors.filter("close IS NOT NULL")
    past = F.lag("close", n).over(history("sector_name"))
    change = clamp((div("close", past) - 1) * 5, -1.0, 1.0)
    return known.withColumn("sector_mom", F.when(past > 0, change).otherwise(0.0))


# ---------------------------------------------------------------- reports


def ttm_profit(reports: DataFrame, unit: float = 1e4) -> DataFrame:
    """Sum of the last four reports, all four known."""
    w = last_rows(4, order="report_date")
    return reports.withColumn(
        "net_profit_ttm", full(F.sum("net_profit").over(w) / unit, "net_profit", 4, w)
    )


def yoy_growth(reports: DataFrame, value: str, order: str, out: str, known: str | None = None) -> DataFrame:
    """Growth on the report before, only from a positive base; ``known`` values win."""
    prev = F.lag(value).over(history(order=order))
    growth = F.when(prev > 0, div(value, prev) - 1)
    return reports.withColumn(out, F.coalesce(F.col(known), growth) if known else growth)


def live_levels(df: DataFrame) -> DataFrame:
    """What a live price is compared with: closes 1, 5 and 20 rows back and a 20-row mean."""
    h = history()
    return df.withColumns(
        {
            "close_5": F.lag("close", 4).over(h),
            "close_20": F.lag("close", 19).over(h),
            "mean_20": full(F.avg("close").over(last_rows(20)), "close", 20, last_rows(20)),
            "n_rows": F.row_number().over(h),
        }
    )
