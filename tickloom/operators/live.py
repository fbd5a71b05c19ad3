"""Live scores: quotes joined with one row of prepared state per code.

The state row holds the sums a strategy needs from history, so scoring a quote adds
one point to those sums and never touches history again. Works the same on a batch of
quotes and on a stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.num import clamp, div, nonzero
from tickloom.operators import factors as fx
from tickloom.operators.cross_section import renormalised
from tickloom.operators.panel import price_or_close
from tickloom.operators.signals import HUNTER_WEIGHTS, PARAMS

MIN_ROWS = 30
N = fx.OLS_WINDOW

def live_state(bars: DataFrame, z: int = fx.Z_WINDOW, strategies=PARAMS) -> DataFrame:
    """One row per code with everything the live strategies need.

    Only per-row factors use windows; the sums over the last rows are plain aggregates
    over rows counted from the end, reduced before they are shuffled.
    """
    df = fx.volatility(fx.daily_return(fx.momentum(bars)))
    df = fx.rsrs(df, N, z, mask=False)
    whole, run = Window.partitionBy("code"), fx.so_far()
    rows = F.count(F.lit(1))
    df = df.withColumns(
        {
            "n_rows": rows.over(whole),
            "__back": rows.over(whole) - F.row_number().over(fx.history()) + 1,
            "__seen": F.count("close").over(run),
        }
    )
    span = F.col("high") - F.col("low")
    close, traded = F.col("close"), nonzero("amount")
    df = df.withColumns(
        {
            "u": F.col("low_norm") - 1, "w": F.col("high_norm") - 1, "b": F.col("rsrs_raw") - 1,
            "net": div((close - F.col("low")) - (F.col("high") - close), span) * F.col("volume"),
            "illiq": F.abs(F.col("ret")) / traded,
            "known_adaptive": F.when(F.col("__seen") >= 2 * N, F.col("rsrs_adaptive")),
        }
    )
    zero = F.lit(0.0)
    smart, stable = (strategies["kunpeng_v10"][k] for k in ("smart_window", "illiq_window"))
    u, w, b, illiq, ret = (F.col(c) for c in ("u", "w", "b", "illiq", "ret"))

    def recent(x, n):
        return F.when(F.col("__back") <= n, x)

    def total(x, n):
        return F.coalesce(F.sum(recent(x, n)), zero)

    def at(x, k):
        return F.max(F.when(F.col("__back") == k, x))

    def mean(n):
        known = F.count(recent(close, n))
        return F.when(known == n, F.avg(recent(close, n)))

    def last_known(c):
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date")))

    sums = {
        # The regression window still to be completed by the quote.
        "lows": total(F.col("low"), N - 1), "highs": total(F.col("high"), N - 1),
        "su": total(u, N - 1), "sw": total(w, N - 1),
        "suu": total(u * u, N - 1), "suw": total(u * w, N - 1), "sww": total(w * w, N - 1),
        "bs": total(b, z - 1), "bq": total(b * b, z - 1), "bn": F.count(recent(b, z - 1)),
        # A window's rows but the quote's; of n rows only n - 1 have a return inside.
        f"net_{smart}": total(F.col("net"), smart - 1), f"vol_{smart}": total(F.col("volume"), smart - 1),
        "vol5": F.avg(recent(F.col("volume"), 5)), "amt5": F.avg(recent(F.col("amount"), 5)),
        f"il_s_{stable}": total(illiq, stable - 2), f"il_q_{stable}": total(illiq * illiq, stable - 2),
        f"il_n_{stable}": F.count(recent(illiq, stable - 2)),
        "ret5_sum": total(ret, 5),
        "cmom": F.coalesce(F.product(recent(1 + ret, 20)), F.lit(1.0)) - 1,
        "liq": F.when(F.count(recent(traded, 20)) == 0, 0.0).otherwise(-F.avg(recent(illiq, 20))),
        "close": at(close, 1), "close_5": at(close, 5), "close_20": at(close, 20),
        "ma5": mean(5), "ma20": mean(20), "ma60": mean(60),
        "n_rows": F.max("n_rows"),
        "rsrs_zscore": last_known("rsrs_zscore"), "rsrs_adaptive": last_known("known_adaptive"),
        "mom": last_known("mom"), "vol_factor": last_known("vol_factor"),
    }
    state = df.groupBy("code").agg(*[x.alias(c) for c, x in sums.items()])
    weights = strategies["alpha_hunter"].get("factor_weights", HUNTER_WEIGHTS)
    return state.withColumn("hunter", renormalised(weights)).drop("rsrs_adaptive", "mom", "vol_factor")


def with_quote_rsrs(df: DataFrame) -> DataFrame:
    """Adds ``q_adaptive`` and ``q_r2``: the regression factors had the quote been a bar."""
    p, n, ridge = F.col("price"), N, fx.RIDGE
    x = F.coalesce(div(p * n, F.col("lows") + p), F.lit(1.0)) - 1
    y = F.coalesce(div(p * n, F.col("highs") + p), F.lit(1.0)) - 1
    df = df.withColumns({"__x": x, "__y": y})
    x, y = F.col("__x"), F.col("__y")
    su, sw = F.col("su") + x, F.col("sw") + y
    df = df.withColumns(
        {
            "__mx": su / n, "__my": sw / n,
            "__cxx": F.col("suu") + x * x - su * su / n,
            "__cxy": F.col("suw") + x * y - su * sw / n,
            "__cyy": F.col("sww") + y * y - sw * sw / n,
            "__sxx": F.col("suu") + x * x + 2 * su + n,
            "__sxy": F.col("suw") + x * y + su + sw + n,
        }
    )
    mx, my = F.col("__mx") + 1, F.col("__my") + 1
    cxx, cxy, cyy = F.col("__cxx"), F.col("__cxy"), F.col("__cyy")
    det = n * cxx + ridge * (n + F.col("__sxx")) + ridge * ridge
    df = df.withColumns(
        {
            "__slope": (n * cxy + ridge * F.col("__sxy")) / det,
            "__level": n * (my * cxx - mx * cxy + ridge * my) / det,
        }
    )
    b = F.col("__slope")
    miss = my - F.col("__level") - b * mx
    ss = cyy - 2 * b * cxy + b * b * cxx + n * miss * miss
    r2 = F.when(cyy > fx.FLAT, F.greatest(F.lit(0.0), 1 - ss / F.nullif(cyy, F.lit(0.0)))).otherwise(0.0)
    d = b - 1
    k, s, q = F.col("bn") + 1, F.col("bs") + d, F.col("bq") + d * d
    var = (q - s * s / k) / (k - 1)
    z = F.when(k >= fx.Z_MIN, (d - s / k) / (F.sqrt(F.greatest(var, F.lit(0.0))) + 1e-9))
    return df.withColumns({"q_r2": r2, "q_adaptive": z * r2}).drop(
        "__x", "__y", "__mx", "__my", "__cxx", "__cxy", "__cyy", "__sxx", "__sxy", "__slope", "__level"
    )


def _rule(buy: Column, buy_score: Column, sell: Column, sell_score: Column, ready: Column, reason: Column):
    """(side, score, reason); a strategy without enough history holds."""
    buy, sell = ready & F.coalesce(buy, F.lit(False)), ready & F.coalesce(sell, F.lit(False))
    one = F.lit(1.0)
    side = F.when(buy, "buy").when(sell, "sell").otherwise("hold")
    score = F.when(buy, F.least(buy_score, one)).when(sell, F.least(sell_score, one)).otherwise(0.0)
    why = F.when(~ready, "not enough data").otherwise(reason)
    return side, score, why


def _text(label: str, value: Column) -> Column:
    shown = F.coalesce(F.translate(F.format_number(value, 3), ",", ""), F.lit("unknown"))
    return F.concat(F.lit(label + "="), shown)


def rsrs_momentum(p):
    v, t = F.col("q_adaptive"), p["rsrs_threshold"]
    return _rule(v > t, v / (t * 3), v < -t, F.abs(v) / (t * 3), F.col("n_rows") >= 40, _text("rsrs", v))


def alpha_hunter(p):
    s, t = F.col("hunter"), p["min_score"]
    return _rule(s >= t, s / (t * 3), s <= -t, F.abs(s) / (t * 3), F.col("n_rows") >= 60, _text("score", s))


def rsrs_advanced(p):
    v, r2, t = F.col("q_adaptive"), F.col("q_r2"), p["rsrs_threshold"]
    fits = r2 >= p["r2_threshold"]
    size = F.abs(v) * r2 / (t * 2)
    return _rule(fits & (v > t), size, fits & (v < -t), size, F.col("n_rows") >= 40, _text("rsrs", v))


def _gain(base: str) -> Column:
    """Price over an earlier close; a close that is not positive counts as no change."""
    return F.when(F.col(base) > 0, div("price", base) - 1).otherwise(0.0)


def short_term(p):
    m1, m5, t = _gain("close"), _gain("close_5"), p["mom_threshold"]
    return _rule((m1 > t) & (m5 > t), (m1 + m5) / (t * 4), m5 < -2 * t, F.abs(m5) / (t * 4),
                 F.col("n_rows") >= 25, _text("mom5", m5))


def momentum_reversal(p):
    m5, m20, ma = _gain("close_5"), _gain("close_20"), F.col("ma20")
    rise, dip = (F.col("price") > ma) & (m20 > 0), (F.col("price") < ma) & (m5 < -0.05)
    ready = (F.col("n_rows") >= 20) & F.coalesce(F.col("close_20") > 0, F.lit(False))
    gain = F.when(rise, m20 * 5).otherwise(F.abs(m5) * 5)
    return _rule(rise | dip, gain, m20 < -0.08, F.abs(m20) * 3, ready, _text("mom20", m20))


def sentiment_reversal(p):
    z, low, high = F.col("rsrs_zscore"), p["oversold_z"], p["overbought_z"]
    return _rule(z < low, F.abs(z - low) / 2, z > high, (z - high) / 2, F.col("n_rows") >= 30, _text("z", z))


def microstructure(p):
    """The quote as a bar with open = high = low = close and recent mean volume.

    The state must have been built with the same windows.
    """
    w, z = p["smart_window"], p["illiq_window"]
    price, total = F.col("price"), F.col(f"vol_{w}") + F.col("vol5")
    smart = F.when(total < 1, 0.0).otherwise(div(f"net_{w}", total))
    new = F.abs(div("price", "close") - 1) / nonzero("amt5")
    known = new.isNotNull().cast("int")
    n = F.col(f"il_n_{z}") + known
    s, q = F.col(f"il_s_{z}") + F.coalesce(new, F.lit(0.0)), F.col(f"il_q_{z}") + F.coalesce(new * new, F.lit(0.0))
    var = div(q - div(s * s, n), n - 1)
    stable = F.when(n < 5, 0.0).otherwise(-F.sqrt(F.greatest(var, F.lit(0.0))))
    ref = F.when(F.col("close") > 0, F.col("close")).otherwise(1.0)
    gap = -F.least(F.abs(price - F.col("close")) / ref, F.lit(0.1)) * 10
    c = 0.5 * smart + 0.3 * stable + 0.2 * gap
    return _rule(c > 0.15, c * 2, c < -0.2, F.abs(c) * 2, F.col("n_rows") >= p["illiq_window"], _text("micro", c))


def multi_factor(p):
    now = F.when(F.col("close") > 0, div("price", "close") - 1).otherwise(0.0)
    raw = p["mom_w"] * F.col("cmom") - p["rev_w"] * (F.col("ret5_sum") + now) + p["liq_w"] * F.col("liq")
    s = clamp(raw * 5, -1.0, 1.0)
    return _rule(s > 0.3, s, s < -0.3, F.abs(s), F.col("n_rows") >= 20, _text("multi", s))


def ma_fallback(p):
    side, score = fx.ma_alignment(F.col("price"), F.col("ma5"), F.col("ma20"), F.col("ma60"))
    ready = (F.col("n_rows") >= 60) & F.coalesce(F.col("close_20") > 0, F.lit(False))
    return _rule(side == "buy", score, side == "sell", score, ready, F.lit("moving average alignment"))


LIVE = {
    "rsrs_momentum": rsrs_momentum,
    "alpha_hunter": alpha_hunter,
    "rsrs_advanced": rsrs_advanced,
    "short_term": short_term,
    "momentum_reversal": momentum_reversal,
    "sentiment_reversal": sentiment_reversal,
    "kunpeng_v10": microstructure,
    "alpha_max_v5_fixed": multi_factor,
    # Its sector part needs bars of sectors; live it goes by the regression alone.
    "sector_momentum": rsrs_momentum,
}


def scorable(quotes: DataFrame, state: DataFrame) -> DataFrame:
    """The quotes that :func:`score_quotes` gives rows for; all strategies vote on each of them."""
    known = state.filter(F.col("n_rows") >= MIN_ROWS).select("code", "close")
    return quotes.join(known, "code").filter(price_or_close("price", "close") > 0).drop("close")


def score_quotes(
    quotes: DataFrame, state: DataFrame, strategies: Sequence[str] = tuple(LIVE), params=PARAMS
) -> DataFrame:
    """One row per quote and strategy: (quote columns, strategy, place, side, score, reason).

    Codes with under 30 rows of history are not scored; a quote without a price falls
    back to the last close; without any strategy the moving-average rule scores.
    """
    joined = quotes.join(state.filter(F.col("n_rows") >= MIN_ROWS), "code")
    joined = with_quote_rsrs(joined.withColumn("price", price_or_close("price", "close")).filter("price > 0"))
    rules = {n: LIVE[n](params[n]) for n in strategies} or {"ma_fallback": ma_fallback({})}
    scored = F.array(
        *[
            F.struct(F.lit(name).alias("strategy"), F.lit(i).alias("place"), side.alias("side"),
                     score.alias("score"), why.alias("reason"))
            for i, (name, (side, score, why)) in enumerate(rules.items())
        ]
    )
    return joined.select(*[c for c in quotes.columns], F.explode(scored).alias("s")).select(*quotes.columns, "s.*")


