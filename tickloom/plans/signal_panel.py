"""The decision panel every strategy query reads.

A strategy reads its panel several times (buys, sales, statistics per date), and many
strategies share one, so the panel is written once and read by column.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import factors as fx
from tickloom.operators import panel as pn
from tickloom.operators.signals import PARAMS, windowed
from tickloom.plans import views as v
from tickloom.session import cut_lineage

FILLED = ("mom", "vol_factor", "vol_ratio", "rsrs_r2", "rsrs_zscore", "rsrs_adaptive")


def wide_factors(bars, **windows):
    """All row-level inputs of the strategies; one exchange on code for all windows."""
    p = {**PARAMS["kunpeng_v10"], **windows}
    out = fx.lookback_change(fx.factor_panel(bars))
    out = fx.microstructure(out, p["smart_window"], p["illiq_window"], windowed("kunpeng_v10", windows))
    out = fx.amihud_level(fx.reversal(fx.compounded_momentum(out)))
    out = out.withColumn("n_rows", F.row_number().over(fx.history()))
    return fx.residual_volatility(out, v.market_series(bars))


def _decide(spark, d, bars, rows, keep):
    panel = pn.asof_factors(rows, pn.calendar(bars), FILLED)
    shown = panel.select("date", "code", "in_universe", "bar_date", "lb_change", *keep, *FILLED)
    return cut_lineage(pn.with_positions(shown, v.positions_m(spark, d)))


def decision_panel(spark, d, bars=None, **windows):
    """``windows`` (smart_window, illiq_window) other than the defaults build the column that goes with them."""
    bars = bars if bars is not None else v.stored_m(spark, d)
    keep = ["n_rows", "ret", windowed("kunpeng_v10", windows), "cmom", "rev", "liq", "resvol"]
    return _decide(spark, d, bars, wide_factors(bars, **windows), keep)


def price_panel(spark, d, bars=None):
    """The narrower panel of the strategies that use price and regression factors only."""
    bars = bars if bars is not None else v.stored_m(spark, d)
    return _decide(spark, d, bars, fx.lookback_change(fx.factor_panel(bars)), [])


def with_sector(panel, spark, d, bars, n: int = PARAMS["sector_momentum"]["sector_momentum_window"]):
    """Adds the code's sector and that sector's momentum over n rows as of the day before."""
    column = windowed("sector_momentum", {"sector_momentum_window": n})
    members = v.industry(spark, d)
    mom = fx.sector_momentum(v.sector_bars(bars, members), n).select(
        F.col("sector_name").alias("code"), "date", F.col("sector_mom").alias(column)
    )
    asof = pn.strictly_before(mom, pn.calendar(bars)).select(F.col("code").alias("sector_name"), "date", column)
    return panel.join(members, "code", "left").join(asof, ["sector_name", "date"], "left")
