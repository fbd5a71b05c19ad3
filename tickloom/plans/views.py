"""The library's tables, derived from the generic star-schema tables on disk.

``code`` is a supplier, a bar sums up what it shipped in a month (or day), a trade is
a line item, a quote or vote is an event. Every view is one lazy plan over Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.num import div
from tickloom.session import cut_lineage

# Orders per slice: how finely one code's trades of one day are split into tasks.
SLICE_ORDERS = 1 << 20

SOURCES = {"F": "a", "O": "b"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_order():
    """A line's place in its code's history; unique per line."""
    return F.struct(
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"
    )


def price():
    return div("l_extendedprice", "l_quantity")


def _bars(lines: DataFrame, date, *extra) -> DataFrame:
    # A line's place tells its price, so the first and last place are all that is shuffled of both ends.
    px, at = price(), line_order()
    ends = lines.groupBy(F.col("l_suppkey").alias("code"), date.alias("date"), *extra).agg(
        F.min(at).alias("first"),
        F.max(px).alias("high"),
        F.min(px).alias("low"),
        F.max(at).alias("last"),
        F.sum("l_quantity").cast("long").alias("volume"),
        F.sum("l_extendedprice").alias("amount"),
    )
    opened, closed = (div(f"{end}.l_extendedprice", f"{end}.l_quantity") for end in ("first", "last"))
    kept = [c for c in ends.columns if c not in ("code", "date", "first", "high", "low", "last", "volume", "amount")]
    return ends.select(
        "code", "date", *kept, opened.alias("open"), "high", "low", closed.alias("close"), "volume", "amount"
    )


def month(col: str):
    return F.trunc(F.col(col).cast("date"), "month")


def bars_m(spark, sf_dir) -> DataFrame:
    return _bars(table(spark, sf_dir, "lineitem"), month("l_shipdate"))


def bars_d(spark, sf_dir) -> DataFrame:
    return _bars(table(spark, sf_dir, "lineitem"), F.col("l_shipdate").cast("date"))


def stored_m(spark, sf_dir) -> DataFrame:
    """Monthly bars written once, for queries that read them several times."""
    return cut_lineage(bars_m(spark, sf_dir))


def stored_d(spark, sf_dir) -> DataFrame:
    return cut_lineage(bars_d(spark, sf_dir))


def source_bars(spark, sf_dir) -> DataFrame:
    """Monthly bars per line status, the stand-in for two vendors; ext columns derived."""
    b = _bars(table(spark, sf_dir, "lineitem"), month("l_shipdate"), F.col("l_linestatus").alias("vendor"))
    return b.withColumn("turnover", div("volume", "amount")).withColumn(
        "pct_change", div("close", "open") - 1
    )


def stored_source(spark, sf_dir) -> DataFrame:
    """Both vendors' bars written once, for queries that read both."""
    return cut_lineage(source_bars(spark, sf_dir))


def src_a(spark, sf_dir, bars: DataFrame | None = None) -> DataFrame:
    """Primary vendor: no extension columns, and half of the codes are absent from it."""
    b = (source_bars(spark, sf_dir) if bars is None else bars).filter("vendor = 'F'").drop("vendor", "turnover", "pct_change")
    rich = table(spark, sf_dir, "supplier").filter("s_acctbal >= 0")
    return b.join(rich, b.code == rich.s_suppkey, "left_semi")


def src_b(spark, sf_dir, bars: DataFrame | None = None) -> DataFrame:
    return (source_bars(spark, sf_dir) if bars is None else bars).filter("vendor = 'O'").drop("vendor")


def trades(spark, sf_dir) -> DataFrame:
    """Fills with the slice columns scans use: ``day`` then ``part`` follow the trade order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("code"),
        F.col("l_shipdate").cast("date").alias("day"),
        F.floor(F.col("l_orderkey") / F.lit(SLICE_ORDERS)).alias("part"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
        F.col("l_quantity").alias("qty"),
        price().alias("price"),
    )


TRADE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
TRADE_LEVELS = ["day", "part"]


def positions_m(spark, sf_dir) -> DataFrame:
    """What is held at a date: codes whose last trade of the month before was a buy."""
    at = line_order()
    last = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("code"), month("l_shipdate").alias("m")
    ).agg(
        F.max_by(
            F.struct(
                F.col("l_returnflag").alias("flag"),
                F.col("l_shipdate").cast("date").alias("entry_date"),
                F.col("l_quantity").alias("qty"),
                price().alias("cost"),
            ),
            at,
        ).alias("t")
    )
    return last.filter("t.flag <> 'R'").select(
        F.add_months("m", 1).alias("date"), "code", "t.entry_date", "t.qty", "t.cost"
    )


def industry(spark, sf_dir) -> DataFrame:
    """One sector per code."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("code"), F.col("n_name").alias("sector_name")
    )


def concept(spark, sf_dir) -> DataFrame:
    """Many sectors per code."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    pairs = li.select("l_suppkey", "l_partkey").distinct()
    return pairs.join(p, pairs.l_partkey == p.p_partkey).select(
        F.col("l_suppkey").alias("code"), F.col("p_brand").alias("sector_name")
    ).distinct()


def sector_m(spark, sf_dir) -> DataFrame:
    return sector_bars(bars_m(spark, sf_dir), industry(spark, sf_dir))


def sector_bars(bars: DataFrame, members: DataFrame) -> DataFrame:
    """Sector bars: member averages of price, member sums of volume and amount."""
    return (
        bars.join(members, "code")
        .groupBy("sector_name", "date")
        .agg(
            F.avg("close").alias("close"),
            F.sum("volume").alias("volume"),
            F.sum("amount").alias("amount"),
        )
    )


def market_series(bars: DataFrame) -> DataFrame:
    """Equal-weight market series."""
    return bars.groupBy("date").agg(F.avg("close").alias("close"))


def fundamentals(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("code"),
        (F.col("s_acctbal") / 100).alias("pe_ttm"),
        (F.col("s_acctbal") / 20000).alias("roe_ttm"),
        (F.col("s_acctbal") / 50000 - 0.05).alias("net_profit_growth"),
    )


def fund_q(spark, sf_dir) -> DataFrame:
    """Quarterly profit per code."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(
        F.col("l_suppkey").alias("code"),
        F.trunc(F.col("l_shipdate").cast("date"), "quarter").alias("report_date"),
    ).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_profit"))


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


def quotes(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).filter("value > 0").select(
        F.col("user_id").alias("code"), "ts", F.col("value").alias("price"), "event_id"
    )


def votes(spark, sf_dir) -> DataFrame:
    """Strategy votes: one strategy per event type, scans are days."""
    kind = F.col("event_type")
    return events(spark, sf_dir).select(
        F.col("user_id").alias("code"),
        F.col("ts").cast("date").alias("scan_date"),
        kind.alias("strategy"),
        F.when(kind.isin("purchase", "signup"), "buy")
        .when(kind.isin("click", "error"), "sell")
        .otherwise("hold").alias("side"),
        F.least(F.col("value") / 50, F.lit(1.0)).alias("score"),
        F.concat(kind, F.lit("#"), F.col("event_id").cast("string")).alias("reason"),
        "event_id", "ts",
    )


def equity(spark, sf_dir) -> DataFrame:
    """Portfolio value series; a portfolio is a code and its value the close."""
    return bars_m(spark, sf_dir).select(
        F.col("code").alias("portfolio"), F.col("date").alias("ts"), F.col("close").alias("total_value")
    )


def by_code():
    return Window.partitionBy("code").orderBy("date")
