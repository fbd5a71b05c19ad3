"""Alert text, keys and throttling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.num import as_col, micros
from tickloom.functions.scan import spaced_picks

DEDUP_SECONDS = 300
# Marks in front of the subject by level.
LEVEL_MARK = {
    "info": "ℹ️", "buy": "🟢", "sell": "🔴", "warning": "⚠️", "error": "❌", "profit": "💰", "loss": "🔻",
}
NEWLINE = "\n"


def fixed(x, digits: int) -> Column:
    """A number with a fixed count of decimals, rounded half to even on its exact value."""
    return F.translate(F.format_number(as_col(x), digits), ",", "")


def signed_percent(x) -> Column:
    pct = as_col(x) * 100
    return F.concat(F.when(pct >= 0, "+").otherwise(""), fixed(pct, 1), F.lit("%"))


def _level(signal) -> Column:
    low = F.lower(as_col(signal))
    return F.when(low.contains("buy"), "buy").when(low.contains("sell"), "sell").otherwise("info")


def _alert(df, level, subject, body, key) -> DataFrame:
    return df.withColumns(
        {"level": level, "subject": F.concat(*subject), "body": F.concat(*body), "key": F.concat(*key)}
    )


def _t(x: str) -> Column:
    return F.lit(x)


def signal_alert(df: DataFrame) -> DataFrame:
    """Needs code, name, signal, score, strategy, price, reason."""
    c, s = F.col("code").cast("string"), F.col("signal")
    why = F.when(F.length(F.coalesce("reason", _t(""))) > 0, F.concat(_t(NEWLINE + "reason: "), "reason")).otherwise("")
    return _alert(
        df, _level(s),
        [c, _t(" "), "name", _t(" -- "), s, _t(" signal (score="), fixed("score", 2), _t(")")],
        [_t("strategy: "), "strategy", _t(" | code: "), c, _t(" | name: "), "name", _t(NEWLINE + "signal: "), s,
         _t(" | score: "), fixed("score", 4), _t(" | price: "), fixed("price", 2), why],
        [c, _t("_"), s, _t("_"), "strategy"],
    )


def merged_alert(df: DataFrame) -> DataFrame:
    """Needs code, name, signal, score, price, strategies_triggered, merge_rule."""
    c, s, rule = F.col("code").cast("string"), F.col("signal"), F.col("merge_rule")
    names, n = F.array_join("strategies_triggered", ", "), F.size("strategies_triggered").cast("string")
    return _alert(
        df, _level(s),
        [c, _t(" "), "name", _t(" -- [MERGED] "), s, _t(" (score="), fixed("score", 2), _t(", rule="), rule, _t(")")],
        [_t("merged strategies: ["), names, _t("]" + NEWLINE + "code: "), c, _t(" | name: "), "name",
         _t(NEWLINE + "signal: "), s, _t(" | score: "), fixed("score", 4), _t(" | price: "), fixed("price", 2),
         _t(NEWLINE + "merge_rule: "), rule, _t(" | triggered: "), n],
        [c, _t("_merged_"), s],
    )


def position_alert(df: DataFrame) -> DataFrame:
    """Needs code, name, event, pnl_pct, price."""
    c, e = F.col("code").cast("string"), F.col("event")
    return _alert(
        df, F.when(F.col("pnl_pct") > 0, "profit").otherwise("loss"),
        [c, _t(" "), "name", _t(" -- "), e, _t(" (pnl="), signed_percent("pnl_pct"), _t(")")],
        [_t("code: "), c, _t(" | name: "), "name", _t(" | event: "), e, _t(" | pnl: "),
         signed_percent("pnl_pct"), _t(" | price: "), fixed("price", 2)],
        [c, _t("_"), e],
    )


def full_subject(level="level", subject="subject") -> Column:
    marks = F.create_map(*[F.lit(x) for kv in LEVEL_MARK.items() for x in kv])
    mark = F.coalesce(F.try_element_at(marks, as_col(level)), F.lit(""))
    return F.concat(mark, F.lit(" ["), F.upper(as_col(level)), F.lit("] "), as_col(subject))


def throttle(
    alerts: DataFrame, window_seconds: int = DEDUP_SECONDS, key: str = "key", ts: str = "ts", tie: str = "event_id",
    slice_windows: int = 16,
) -> DataFrame:
    """Alerts that go out: per key only those at least the window after the last one sent."""
    width = window_seconds * 1_000_000
    marked = spaced_picks(
        alerts.withColumn("__us", micros(alerts, ts)), key, "__us", tie, width, width * slice_windows, "__sent"
    )
    return marked.filter("__sent").drop("__us", "__sent")


def recent(signals: DataFrame, n: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last n signals, newest first."""
    return signals.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)
