"""Sections 2.2 (cleaning), 2.3 (quality), 2.5 and the merge joins of 2.4.

Raw vendor rows are line items and events written out as text, with unreadable
values wherever a tax, discount or line number says so.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.num import div, r
from tickloom.operators import clean as cl
from tickloom.operators import merge as mg
from tickloom.operators import quality as q
from tickloom.plans import views as v
from tickloom.plans.catalog.registry import ORACLES, query
from tickloom.session import shared_dir
from tickloom.sources import snapshots

KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


def _text(c):
    return F.col(c).cast("string")


def raw_bars(spark, d):
    """One raw bar per line: text prices, some unreadable, some counts empty."""
    px = v.price()
    return v.table(spark, d, "lineitem").select(
        *KEYS,
        F.col("l_suppkey").alias("code"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("market"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"),
        F.when(F.col("l_linenumber") == 7, "n/a").otherwise(px.cast("string")).alias("open"),
        (px * 1.5).cast("string").alias("high"),
        (px * 0.5).cast("string").alias("low"),
        F.when(F.col("l_discount") == 0.05, "").otherwise(px.cast("string")).alias("close"),
        F.when(F.col("l_tax") == 0.03, "-").otherwise(_text("l_quantity")).alias("vol"),
        _text("l_extendedprice").alias("amount"),
        F.when(F.col("l_returnflag") == "R", "0").otherwise("1").alias("status"),
        _text("l_discount").alias("ext1"),
        F.when(F.col("l_tax") == 0.01, "x").otherwise(_text("l_tax")).alias("ext2"),
    )


RAW = dict(
    raw_bars="""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS code,
      CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS market, CAST(l_shipdate AS DATE) AS date,
      CASE WHEN l_linenumber <> 7 THEN px END AS o, px * 1.5 AS h, px * 0.5 AS l,
      CASE WHEN l_discount <> 0.05 THEN px END AS c,
      CASE WHEN l_tax = 0.03 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS vol,
      CAST(trunc(l_extendedprice) AS BIGINT) AS amount, l_returnflag = 'R' AS off,
      l_discount AS ext1, CASE WHEN l_tax <> 0.01 THEN l_tax END AS ext2
      FROM (SELECT *, l_extendedprice / l_quantity AS px FROM lineitem)"""
)
BAR_SQL = """l_orderkey, l_linenumber, l_partkey, code, date, round(o, 7) + 0.0 AS "open",
  round(h, 8) + 0.0 AS high, round(l, 8) + 0.0 AS low, round(c, 7) + 0.0 AS "close", vol, amount"""


def _bars_out(df, *extra):
    return df.select(*KEYS, "code", "date", r("open", 7).alias("open"), r("high", 8).alias("high"), r("low", 8).alias("low"), r("close", 7).alias("close"),
                     "vol", "amount", *extra)


@query(
    "n01_clean_exchange_bars",
    f"SELECT {BAR_SQL}, market, 'tdx' AS source, 'hfq' AS adjust FROM raw_bars",
    **RAW,
)
def n01(spark, d):
    raw = raw_bars(spark, d).withColumn("datetime", F.concat("day", F.lit(" 15:00")))
    # Line keys ride along behind the code so that every row can be compared.
    packed = raw.withColumn("code", F.struct("code", *KEYS))
    out = cl.clean_exchange_bars(packed)
    out = out.select(*[F.col(f"code.{k}").alias(k) for k in KEYS], F.col("code.code").alias("bare"), "*").drop("code")
    return _bars_out(out.withColumnRenamed("bare", "code"), "market", "source", "adjust")


B_NAMES = {n: c for c, n in cl.VENDOR_B_COLUMNS.items()}


@query(
    "n02_clean_vendor_b",
    f"""SELECT {BAR_SQL}, ext1 AS pct_change, ext2 AS turnover, ext1 AS amplitude, ext2 AS change,
    'akshare' AS source, 'hfq' AS adjust FROM raw_bars""",
    **RAW,
)
def n02(spark, d):
    raw = raw_bars(spark, d).withColumn("date", F.regexp_replace("day", "-", "/"))
    raw = raw.withColumns({"amplitude": F.col("ext1"), "pct_change": F.col("ext1"),
                           "change": F.col("ext2"), "turnover": F.col("ext2")})
    landed = raw.select(*KEYS, "code", *[F.col(n).alias(c) for n, c in B_NAMES.items()])
    return _bars_out(cl.clean_vendor_b(landed), "pct_change", "turnover", "amplitude", "change", "source", "adjust")


def _landed_c(spark, d):
    raw = raw_bars(spark, d)
    return raw.select(
        F.struct("code", *KEYS).alias("code"), F.regexp_replace("day", "-", "").alias("date"), "open", "high", "low",
        "close", F.col("vol").alias("volume"), "amount", F.col("ext2").alias("turn"),
        F.col("status").alias("tradestatus"), F.col("ext1").alias("pctChg"), F.lit("1").alias("adjustflag"),
    )


def _unpack(df):
    return df.select(*[F.col(f"code.{k}").alias(k) for k in KEYS], F.col("code.code").alias("bare"), "*").drop(
        "code"
    ).withColumnRenamed("bare", "code")


@query(
    "n03_clean_vendor_c",
    f"""SELECT {BAR_SQL}, ext1 AS pct_change, ext2 AS turnover, 'baostock' AS source, 'hfq' AS adjust
    FROM raw_bars WHERE NOT off""",
    **RAW,
)
def n03(spark, d):
    return _bars_out(_unpack(cl.clean_vendor_c(_landed_c(spark, d))), "pct_change", "turnover", "source", "adjust")


@query(
    "n04_vendor_c_extension",
    "SELECT l_orderkey, l_linenumber, l_partkey, code, date, ext2 AS turnover, ext1 AS pct_change FROM raw_bars WHERE NOT off",
    **RAW,
)
def n04(spark, d):
    return _unpack(cl.vendor_c_extension(_landed_c(spark, d))).select(*KEYS, "code", "date", "turnover", "pct_change")


@query(
    "n05_clean_sector_daily",
    """SELECT sector_name, date, round(ln("close"), 6) + 0.0 AS log_close, volume, CASE WHEN month(date) <> 5 THEN round(amount, 2) END AS amount
    FROM sector_m WHERE month(date) <> 2""",
)
def n05(spark, d):
    """Sector bars under vendor headers; February dates and May amounts are unreadable."""
    s = v.sector_m(spark, d)
    landed = s.select(
        "sector_name",
        F.when(F.month("date") == 2, "unknown").otherwise(F.date_format("date", "yyyy/MM/dd")).alias("交易日期"),
        F.col("close").cast("string").alias("收盘"),
        F.col("volume").cast("string").alias("成交量"),
        F.when(F.month("date") == 5, "--").otherwise(F.col("amount").cast("string")).alias("成交额"),
    )
    out = cl.clean_sector_daily(landed)
    return out.select("sector_name", "date", r(F.log("close")).alias("log_close"), F.col("volume").cast("long").alias("volume"),
                      r("amount", 2).alias("amount"))


@query(
    "n06_clean_sector_list",
    """SELECT n_name AS name, 'BK' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS code, 'industry' AS sector_type
    FROM nation WHERE n_regionkey <> 2""",
)
def n06(spark, d):
    n = v.table(spark, d, "nation")
    landed = n.select(
        F.when(F.col("n_regionkey") == 2, "  ").otherwise(F.concat(F.lit(" "), "n_name", F.lit(" "))).alias("板块名称"),
        F.concat(F.lit("BK"), F.lpad(_text("n_nationkey"), 4, "0"), F.lit(" ")).alias("板块代码"),
    )
    return cl.clean_sector_list(landed, "industry")


@query(
    "n06_clean_sector_list_positional",
    """SELECT p_brand AS name, p_type AS code, 'concept' AS sector_type FROM part""",
)
def n06_positional(spark, d):
    landed = v.table(spark, d, "part").select(F.col("p_brand").alias("col_a"), F.col("p_type").alias("col_b"))
    return cl.clean_sector_list(landed, "concept")


@query(
    "n07_clean_constituents",
    """SELECT l_partkey, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code FROM lineitem
    WHERE l_returnflag <> 'A' AND length(CAST(l_suppkey AS VARCHAR)) <= 6""",
)
def n07(spark, d):
    """Member codes without their leading zeros; unreadable ones leave."""
    li = v.table(spark, d, "lineitem")
    landed = li.select("l_partkey", F.when(F.col("l_returnflag") == "A", "HK.01").otherwise(
        F.concat(F.lit(" "), _text("l_suppkey"))).alias("证券代码"))
    return cl.clean_constituents(landed, keep=["l_partkey"])


@query(
    "n08_fundamental_aliases",
    """SELECT s_suppkey AS code, round(CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE s_nationkey END, 6) + 0.0 AS pe_ttm,
    CAST(s_nationkey AS DOUBLE) AS pb_lf,
    round(CASE WHEN s_acctbal / 1000 > 1 THEN s_acctbal / 1000 / 100 ELSE s_acctbal / 1000 END, 6) + 0.0 AS roe_ttm,
    CAST(NULL AS DOUBLE) AS net_profit_ttm,
    round(CASE WHEN abs(s_acctbal / 2000) > 1.5 THEN s_acctbal / 2000 / 100 ELSE s_acctbal / 2000 END, 6) + 0.0 AS revenue_growth,
    round(CASE WHEN abs(s_nationkey / 8.0) > 1.5 THEN s_nationkey / 8.0 / 100 ELSE s_nationkey / 8.0 END, 6) + 0.0 AS net_profit_growth
    FROM supplier""",
)
def n08(spark, d):
    """Alias columns as different vendor versions send them, as text."""
    bal, nat = F.col("s_acctbal"), F.col("s_nationkey")
    landed = v.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("code"),
        F.when(bal > 0, bal.cast("string")).otherwise("--").alias("PE(TTM)"),
        nat.cast("string").alias("市盈率TTM"),
        nat.cast("string").alias("PB"),
        (bal / 1000).cast("string").alias("ROE(TTM)"),
        F.lit("none").alias("净利润(TTM)"),
        (bal / 2000).cast("string").alias("营收同比"),
        (nat / 8.0).cast("string").alias("net_profit_growth"),
    )
    out = cl.fundamentals_from_aliases(landed)
    names = ("pe_ttm", "pb_lf", "roe_ttm", "net_profit_ttm", "revenue_growth", "net_profit_growth")
    return out.select("code", *[r(c).alias(c) for c in names])


@query(
    "n09_supplement_fundamentals",
    """SELECT s_suppkey AS code, round(CASE WHEN s_acctbal > 3000 THEN 1.5 WHEN s_nationkey < 12 THEN s_nationkey * 1000 + 0.5 END::DOUBLE, 4) + 0.0 AS pe_ttm,
    round(CASE WHEN s_nationkey > 3 THEN s_nationkey * 2.0 * 1e4 END, 2) + 0.0 AS circ_mv FROM supplier""",
)
def n09(spark, d):
    s = v.table(spark, d, "supplier").withColumnRenamed("s_suppkey", "code")
    nat = F.col("s_nationkey")
    known = s.select("code", F.when(F.col("s_acctbal") > 3000, 1.5).alias("pe_ttm"), F.lit(None).cast("double").alias("circ_mv"))
    thousands = F.concat(F.when(nat > 0, F.concat(nat.cast("string"), F.lit(",000"))).otherwise(F.lit("0")), F.lit(".5"))
    items = s.select(
        "code",
        F.explode(F.array(
            F.struct(F.lit("市盈率(动)").alias("item"), F.when(nat < 12, thousands).otherwise("-").alias("value")),
            F.struct(F.lit("流通市值").alias("item"),
                     F.when(nat > 3, F.concat((nat * 2).cast("string"), F.lit(".0亿"))).otherwise("?").alias("value")),
            F.struct(F.lit("行业").alias("item"), F.lit("x").alias("value")),
        )).alias("kv"),
    ).select("code", "kv.item", "kv.value")
    out = cl.supplement_fundamentals(known, items)
    return out.select("code", r("pe_ttm", 4).alias("pe_ttm"), r("circ_mv", 2).alias("circ_mv"))


def listing(spark, d):
    """Exchange codes made from order keys, spread over all six-digit numbers."""
    o = v.table(spark, d, "orders")
    return o.select("o_orderkey", (F.col("o_orderkey") * 37 % 1000000).cast("string").alias("raw"))


LISTING = dict(listing="SELECT o_orderkey, lpad(CAST(o_orderkey * 37 % 1000000 AS VARCHAR), 6, '0') AS c FROM orders")


@query(
    "n10_market_and_symbol",
    """SELECT o_orderkey, c AS code, CASE WHEN c[1] IN ('6','9') THEN 1 ELSE 0 END AS market,
    CASE WHEN c[1:2] IN ('60','68') OR c[1:3] = '900' THEN 1 ELSE 0 END AS feed_market,
    CASE WHEN c[1] IN ('6','9') THEN 'sh.' ELSE 'sz.' END || c AS symbol FROM listing""",
    **LISTING,
)
def n10(spark, d):
    out = listing(spark, d).withColumn("code", cl.zfill6("raw")).withColumn("market", cl.market_of("raw"))
    return out.select("o_orderkey", "code", "market", cl.feed_market_of("raw").alias("feed_market"),
                      cl.exchange_symbol("code", "market").alias("symbol"))


@query(
    "n11_a_share_universe",
    """SELECT DISTINCT c AS code, m AS market FROM (SELECT c, CASE WHEN c[1] IN ('6','9') THEN 1 ELSE 0 END AS m FROM listing)
    WHERE (m = 0 AND c[1:2] IN ('00','30')) OR (m = 1 AND c[1:2] IN ('60','68'))""",
    **LISTING,
)
def n11(spark, d):
    out = listing(spark, d).select(cl.zfill6("raw").alias("code"), cl.market_of("raw").alias("market"))
    return cl.a_share_universe(out)


@query("n12_unify_dates", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' OR o_custkey <> 7 THEN CAST(o_orderdate AS DATE) END AS date FROM orders")
def n12(spark, d):
    o = v.table(spark, d, "orders")
    status = F.col("o_orderstatus")
    text = (
        F.when(status == "F", F.date_format("o_orderdate", "yyyyMMdd"))
        .when(status == "O", F.date_format("o_orderdate", "yyyy/MM/dd"))
        .when(F.col("o_custkey") == 7, "soon")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    )
    return o.select("o_orderkey", cl.unify_date(text).alias("date"))


@query(
    "n13_safe_names",
    """SELECT p_partkey, trim(regexp_replace(' ' || p_name || '/' || p_brand || ':' || p_type || '?\\', '[/\\\\<>:"|?*]', '_', 'g')) AS name FROM part""",
)
def n13(spark, d):
    p = v.table(spark, d, "part")
    name = F.concat(F.lit(" "), "p_name", F.lit("/"), "p_brand", F.lit(":"), "p_type", F.lit("?\\"))
    return p.select("p_partkey", cl.safe_name(name).alias("name"))


@query(
    "n14_clean_quotes",
    """SELECT event_id, user_id AS code, round(value - 20, 6) + 0.0 AS price, CAST(trunc(value) AS BIGINT) AS vol, 0.0::DOUBLE AS bid1
    FROM events WHERE value - 20 > 0 AND event_type <> 'error'""",
)
def n14(spark, d):
    e = v.events(spark, d)
    landed = e.select(
        "event_id", F.col("user_id").alias("code"),
        F.when(F.col("event_type") == "error", "err").otherwise((F.col("value") - 20).cast("string")).alias("price"),
        F.col("value").cast("string").alias("vol"), F.lit("").alias("bid1"),
    )
    return cl.clean_quotes(landed).select("event_id", "code", r("price").alias("price"), "vol", "bid1")


# ------------------------------------------------------------------ quality


def dirty_bars(spark, d):
    """Monthly bars spoilt by nation: too short, crossed, negative, mostly unknown."""
    s = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), "s_nationkey")
    b = v.bars_m(spark, d).join(s, "code")
    n = F.col("s_nationkey")
    b = b.filter((n != 2) | (F.col("date") < "1995-08-01"))
    gone = (n == 7) & (F.col("date") >= "1997-01-01")
    b = b.withColumns(
        {
            "high": F.when((n == 3) & (F.col("volume") < 150), F.col("low") - 1).otherwise(F.col("high")),
            "close": F.when((n == 5) & (F.col("volume") < 150), -F.col("close")).otherwise(F.col("close")),
        }
    )
    return b.withColumns({c: F.when(~gone, F.col(c)) for c in q.PRICES})


DIRTY = dict(
    dirty="""SELECT b.code, b.date, n, volume,
      CASE WHEN n = 3 AND volume < 150 THEN low - 1 ELSE high END AS high, low,
      CASE WHEN n = 5 AND volume < 150 THEN -"close" ELSE "close" END AS c,
      n = 7 AND date >= DATE '1997-01-01' AS gone
      FROM bars_m b JOIN (SELECT s_suppkey AS code, s_nationkey AS n FROM supplier) USING (code)
      WHERE n <> 2 OR date < DATE '1995-08-01'"""
)


@query("q01_date_range", f"""SELECT code, date, volume FROM bars_d WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-06-30'""")
def q01(spark, d):
    return q.between_dates(v.bars_d(spark, d), "1997-01-01", "1998-06-30").select("code", "date", "volume")


@query(
    "q02_min_history",
    """SELECT code, date FROM bars_d WHERE date <= DATE '1995-08-31' AND code IN (
      SELECT code FROM bars_d WHERE date <= DATE '1995-08-31' GROUP BY code HAVING count(*) >= 50)""",
)
def q02(spark, d):
    return q.enough_history(v.bars_d(spark, d), "1995-08-31", least=50).select("code", "date")


@query(
    "q03_validate",
    """SELECT code, rows, reason, reason = 'ok' AS ok FROM (SELECT code, count(*) AS rows,
      CASE WHEN count(*) < 10 THEN 'too_few_rows:' || count(*)
       WHEN count(*) FILTER (NOT gone AND high < low) > 0 THEN 'high_lt_low:' || count(*) FILTER (NOT gone AND high < low) || '_rows'
       WHEN count(*) FILTER (NOT gone AND c < 0) > 0 THEN 'negative_close:' || count(*) FILTER (NOT gone AND c < 0) || '_rows'
       WHEN avg(gone::INT) > 0.5 THEN 'too_many_nan_rows:' || CAST(round_even(avg(gone::INT) * 100, 0) AS INT) || '%'
       ELSE 'ok' END AS reason FROM dirty GROUP BY code)""",
    **DIRTY,
)
def q03(spark, d):
    return q.validate(dirty_bars(spark, d).withColumnRenamed("volume", "vol"))


@query(
    "q03_validate_missing_columns",
    """SELECT code, count(*) AS rows, CASE WHEN count(*) < 10 THEN 'too_few_rows:' || count(*)
    ELSE 'missing_cols:[''close'', ''vol'']' END AS reason, false AS ok FROM dirty GROUP BY code""",
    **DIRTY,
)
def q03_missing(spark, d):
    return q.validate(dirty_bars(spark, d).drop("close"))


def ingest_log(spark, d):
    """Monthly bars with an ingest sequence: some codes repeat 1996, some arrive backwards."""
    s = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), "s_nationkey")
    b = v.bars_m(spark, d).select("code", "date").join(s, "code")
    day = F.unix_date("date").cast("long") * 10
    n = F.col("s_nationkey")
    once = b.withColumn("seq", F.when(n == 6, 200000 - day).otherwise(day))
    again = b.filter((n == 4) & (F.year("date") == 1996)).withColumn("seq", day + 1)
    return once.unionByName(again)


@query(
    "q04_validate_merged",
    """SELECT code, CASE WHEN n = 6 THEN 'date_not_sorted' WHEN dups > 0 THEN 'duplicate_dates:' || dups ELSE 'ok' END AS reason,
      n <> 6 AND dups = 0 AS ok FROM (
      SELECT code, any_value(s_nationkey) AS n, CASE WHEN any_value(s_nationkey) = 4
        THEN count(*) FILTER (year(date) = 1996) ELSE 0 END AS dups
      FROM bars_m JOIN supplier ON s_suppkey = code GROUP BY code)""",
)
def q04(spark, d):
    return q.validate_merged(ingest_log(spark, d), slice_rows=20000)


EXT_SQL = """SELECT code, date, CASE WHEN s_nationkey < 20 THEN turnover END AS turnover,
   CASE WHEN s_nationkey > 3 THEN pct_change END AS pct_change FROM src_b JOIN supplier ON s_suppkey = code"""


def partly_enriched(spark, d):
    s = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), "s_nationkey")
    n = F.col("s_nationkey")
    return v.src_b(spark, d).join(s, "code").withColumns(
        {"turnover": F.when(n < 20, F.col("turnover")), "pct_change": F.when(n > 3, F.col("pct_change"))}
    )


@query("q05_needs_enrichment", "SELECT code, NOT (count(turnover) > 0 AND count(pct_change) > 0) AS needs_enrich FROM ext GROUP BY code", ext=EXT_SQL)
def q05(spark, d):
    return q.needs_enrichment(partly_enriched(spark, d))


@query(
    "q06_integrity_summary",
    """SELECT code, count(*) AS rows, min(date) AS min_date, max(date) AS max_date, concat_ws(',',
      CASE WHEN count(turnover) > 0 THEN 'turnover' END, CASE WHEN count(pct_change) > 0 THEN 'pct_change' END) AS ext
    FROM ext GROUP BY code""",
    ext=EXT_SQL,
)
def q06(spark, d):
    return q.integrity(partly_enriched(spark, d))


AS_OF = "2001-11-01"


def stored_max(spark, d):
    """Latest daily bar per code; codes of negative balance have nothing stored."""
    s = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), "s_acctbal")
    held = v.bars_d(spark, d).join(s.filter("s_acctbal >= 0"), "code", "left_semi")
    return s.select("code").join(q.max_dates(held), "code", "left")


STORED = dict(
    stored_max="""SELECT s_suppkey AS code, m.max_date FROM supplier LEFT JOIN (
      SELECT code, max(date) AS max_date FROM bars_d WHERE code IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)
      GROUP BY code) m ON m.code = s_suppkey""",
    spans="""SELECT code, max_date, CASE WHEN max_date IS NULL THEN DATE '2005-01-01'
      ELSE least(max_date + 1, DATE '2001-11-01') END AS start_date, DATE '2001-11-01' AS end_date FROM stored_max""",
)


@query("q07_up_to_date", "SELECT code, coalesce(DATE '2001-11-01' - max_date <= 1, false) AS fresh FROM stored_max", **STORED)
def q07(spark, d):
    fresh = q.is_up_to_date("max_date", F.lit(AS_OF).cast("date"))
    return stored_max(spark, d).select("code", fresh.alias("fresh"))


@query("q08_missing_range", "SELECT code, start_date, end_date FROM spans", **STORED)
def q08(spark, d):
    return q.missing_range(stored_max(spark, d), F.lit(AS_OF).cast("date")).select("code", "start_date", "end_date")


@query(
    "q09_estimated_bars",
    "SELECT code, greatest(1, CAST(trunc((end_date - start_date) * 0.72) AS INT)) + 1 AS bars FROM spans",
    **STORED,
)
def q09(spark, d):
    span = q.missing_range(stored_max(spark, d), F.lit(AS_OF).cast("date"))
    return span.select("code", q.estimated_bars("start_date", "end_date").alias("bars"))


def sector_records(spark, d):
    ind = v.industry(spark, d).select("sector_name", F.lit("industry").alias("sector_type"), "code")
    con = v.concept(spark, d).select("sector_name", F.lit("concept").alias("sector_type"), "code")
    return ind.unionByName(con)


@query(
    "q10_sector_summary",
    """SELECT 'industry' AS sector_type, (SELECT count(*) FROM nation) AS list_sectors,
      (SELECT count(DISTINCT sector_name) FROM sector_m) AS daily_sectors, (SELECT count(*) FROM industry) AS constituents_records
    UNION ALL SELECT 'concept', (SELECT count(DISTINCT p_brand) FROM part), 0, (SELECT count(*) FROM concept)""",
)
def q10(spark, d):
    listed = v.table(spark, d, "nation").select(F.lit("industry").alias("sector_type")).unionByName(
        v.table(spark, d, "part").select("p_brand").distinct().select(F.lit("concept").alias("sector_type"))
    )
    daily = v.sector_m(spark, d).withColumn("sector_type", F.lit("industry"))
    return q.sector_summary(listed, daily, sector_records(spark, d))


@query("q11_watch_list", "SELECT code, date, volume FROM bars_m WHERE code IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def q11(spark, d):
    watch = v.table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("code"))
    return q.only_watched(v.bars_m(spark, d), watch).select("code", "date", "volume")


@query("q12_without_suspended", "SELECT code, date, volume FROM bars_d WHERE high > low")
def q12(spark, d):
    """One-price days count as suspended."""
    bars = v.bars_d(spark, d)
    return q.without_suspended(bars, bars.filter("NOT high > low")).select("code", "date", "volume")


# ------------------------------------------------------------------ merges

PX = 'round("close", 7) + 0.0 AS "close"'


@query(
    "j01_dual_source_merge",
    f"""SELECT a.code, a.date, {PX.replace('"close", 7', 'a."close", 7')}, round(b.turnover, 9) + 0.0 AS turnover,
      round(b.pct_change, 6) + 0.0 AS pct_change, 'primary' AS origin FROM src_a a LEFT JOIN src_b b USING (code, date)
    UNION ALL SELECT code, date, {PX}, round(turnover, 9) + 0.0, round(pct_change, 6) + 0.0, 'secondary' FROM src_b
    WHERE code NOT IN (SELECT code FROM src_a)""",
)
def j01(spark, d):
    out = mg.merge_dual(v.src_a(spark, d), v.src_b(spark, d))
    return out.select("code", "date", r("close", 7).alias("close"), r("turnover", 9).alias("turnover"),
                      r("pct_change").alias("pct_change"), "origin")


@query(
    "j02_source_fallback",
    f"""SELECT code, date, {PX}, 'first' AS source FROM src_a
    UNION ALL SELECT code, date, {PX}, 'second' FROM src_b WHERE code NOT IN (SELECT code FROM src_a)
      AND code NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)
    UNION ALL SELECT code, date, {PX}, 'third' FROM bars_m WHERE code NOT IN (SELECT code FROM src_a)
      AND code IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)""",
)
def j02(spark, d):
    """The second vendor lacks the codes of the first five nations; a third has all."""
    poor = v.table(spark, d, "supplier").filter("s_nationkey < 5").select(F.col("s_suppkey").alias("code"))
    out = mg.first_source({
        "first": v.src_a(spark, d),
        "second": v.src_b(spark, d).join(poor, "code", "left_anti"),
        "third": v.bars_m(spark, d),
    })
    return out.select("code", "date", r("close", 7).alias("close"), "source")


def _stored_ext(spark, d):
    b = v.bars_m(spark, d)
    return b.select("code", "date", div("volume", "amount").alias("turnover"))


ENRICH = dict(
    old="SELECT code, date, volume / nullif(amount, 0) AS turnover FROM bars_m",
    fresh="SELECT code, date, turnover, pct_change FROM src_b WHERE date >= DATE '2000-01-01'",
)


def _enriched(spark, d, keep):
    fresh = q.between_dates(v.src_b(spark, d), start="2000-01-01").select("code", "date", "turnover", "pct_change")
    out = mg.enrich(_stored_ext(spark, d), fresh, keep_old=keep)
    return out.select("code", "date", r("turnover", 9).alias("turnover"), r("pct_change").alias("pct_change"))


@query(
    "j03_enrich_keep_old",
    """SELECT o.code, o.date, round(coalesce(f.turnover, o.turnover), 9) + 0.0 AS turnover,
    round(f.pct_change, 6) + 0.0 AS pct_change FROM old o LEFT JOIN fresh f USING (code, date)""",
    **ENRICH,
)
def j03(spark, d):
    return _enriched(spark, d, True)


@query(
    "j03_enrich_replace",
    """SELECT o.code, o.date, round(f.turnover, 9) + 0.0 AS turnover,
    round(f.pct_change, 6) + 0.0 AS pct_change FROM old o LEFT JOIN fresh f USING (code, date)""",
    **ENRICH,
)
def j03_replace(spark, d):
    return _enriched(spark, d, False)


def _local_and_new(spark, d):
    b = v.bars_m(spark, d).select("code", "date", "close")
    local = b.filter(F.col("date") < "2001-01-01")
    new = b.filter(F.col("date") >= "2000-10-01").withColumn("close", F.col("close") * 1.01)
    return local, new


@query(
    "u01_upsert_keep_new",
    """SELECT code, date, round(CASE WHEN date >= DATE '2000-10-01' THEN "close" * 1.01 ELSE "close" END, 9) + 0.0 AS "close" FROM bars_m
    """,
)
def u01(spark, d):
    local, new = _local_and_new(spark, d)
    return mg.upsert(local, new).select("code", "date", r("close", 9).alias("close"))


@query(
    "u02_upsert_keep_old",
    """SELECT code, date, round(CASE WHEN date >= DATE '2001-01-01' THEN "close" * 1.01 ELSE "close" END, 9) + 0.0 AS "close" FROM bars_m""",
)
def u02(spark, d):
    local, new = _local_and_new(spark, d)
    return mg.upsert(local, new, keep="old").select("code", "date", r("close", 9).alias("close"))


@query(
    "u03_merge_constituents",
    """SELECT DISTINCT sector_name, 'concept' AS sector_type, code FROM (
      SELECT sector_name, code FROM concept WHERE sector_name < 'Brand#2' AND code IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
      UNION ALL SELECT sector_name, code FROM concept WHERE sector_name >= 'Brand#2')""",
)
def u03(spark, d):
    """Stored sectors keep their (partial) members, the others come from the fetch."""
    rich = v.table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("code"))
    all_ = v.concept(spark, d).select("sector_name", F.lit("concept").alias("sector_type"), "code")
    stored = all_.filter("sector_name < 'Brand#2'").join(rich, "code", "left_semi").select(*all_.columns)
    return mg.merge_constituents(stored, all_)


@query("u04_retry_set", "SELECT code, CAST(NULL AS DATE) AS max_date FROM stored_max WHERE max_date IS NULL", **STORED)
def u04(spark, d):
    """Codes with nothing stored count as failed and are loaded again from the start."""
    tasks = stored_max(spark, d)
    return mg.retry_set(tasks, tasks.filter("max_date IS NULL")).select("code", "max_date")


def run_log(spark, d):
    kind = F.col("event_type")
    return v.events(spark, d).select(
        F.col("user_id").alias("code"),
        F.when(kind.isin("purchase", "signup"), "success").when(kind == "click", "failed")
        .when(kind == "view", "skipped").otherwise("validation").alias("status"),
        F.when(F.col("value") < 5, "tdx").when(F.col("value") < 10, "akshare")
        .when(F.col("value") < 15, "baostock").otherwise("tdx+akshare").alias("source"),
        F.floor("value").alias("rows"),
        F.col("event_id").alias("seq"),
    )


LOG = dict(
    run_log="""SELECT user_id AS code, CASE WHEN event_type IN ('purchase','signup') THEN 'success' WHEN event_type = 'click' THEN 'failed'
      WHEN event_type = 'view' THEN 'skipped' ELSE 'validation' END AS status,
      CASE WHEN value < 5 THEN 'tdx' WHEN value < 10 THEN 'akshare' WHEN value < 15 THEN 'baostock' ELSE 'tdx+akshare' END AS source,
      CAST(floor(value) AS BIGINT) AS rows, event_id AS seq FROM events"""
)


@query(
    "u05_run_log_last_records",
    "SELECT code, status, max_by(source, seq) AS source, max_by(rows, seq) AS rows FROM run_log GROUP BY ALL",
    **LOG,
)
def u05(spark, d):
    return mg.last_records(run_log(spark, d)).select("code", "status", "source", "rows")


@query(
    "u05_run_log_counts",
    """SELECT 'status' AS what, status AS name, count(DISTINCT code) AS n FROM run_log GROUP BY ALL
    UNION ALL SELECT 'source', CASE WHEN source = 'tdx+akshare' THEN 'merged' ELSE source END, count(*) FROM run_log
    WHERE status = 'success' GROUP BY ALL""",
    **LOG,
)
def u05_counts(spark, d):
    log = run_log(spark, d)
    a = mg.status_counts(log).select(F.lit("status").alias("what"), F.col("status").alias("name"), F.col("codes").alias("n"))
    b = mg.source_counts(log).select(F.lit("source").alias("what"), F.col("source").alias("name"), F.col("calls").alias("n"))
    return a.unionByName(b)


def load_inputs(spark, d):
    """A load as of September 2001 over history to August 2000; one nation's codes are up to date.

    Vendors deliver all months, the second and third lack some nations, and the first
    repeats a month of one nation. A code with few new months is invalid.
    """
    cols = ["code", "date", "open", "high", "low", "close", "volume", "amount"]
    bars = v.stored_m(spark, d).select(*cols)
    s = v.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("code"), "s_nationkey", F.pmod("s_suppkey", F.lit(2)).cast("int").alias("market")
    )
    ahead = s.filter("s_nationkey = 7").select("code", F.lit(True).alias("ahead"))
    old = bars.join(ahead, "code", "left")
    stored = old.filter("date < '2000-09-01' OR ahead AND date < '2001-09-01'").drop("ahead")
    today = bars.filter("date < '2001-09-01'").join(ahead, "code", "left_semi").select("code").distinct()
    current = today.select("code", F.lit("2001-08-31").cast("date").alias("date"))
    stored = stored.unionByName(current, allowMissingColumns=True)
    vendors = v.stored_source(spark, d)
    a = v.src_a(spark, d, vendors).select(*cols)
    b = v.src_b(spark, d, vendors).select(*cols, "turnover", "pct_change").join(s.filter("s_nationkey >= 5"), "code", "left_semi")
    c = bars.join(s.filter("s_nationkey >= 3"), "code", "left_semi")
    return a, b, c, stored, s, F.lit("2001-09-01").cast("date")


def load(spark, d):
    return mg.ingest(*load_inputs(spark, d))


def load_in_place(spark, d):
    """The same load into a table of snapshots: (path, version before, version after, log)."""
    a, b, c, stored, universe, as_of = load_inputs(spark, d)
    path = shared_dir(spark) + "/bars"
    before = snapshots.change(stored, path)
    after, log = mg.ingest_in_place(a, b, c, path, universe, as_of)
    return path, before, after, log


INGEST = dict(
    nat="SELECT s_suppkey AS code, s_nationkey AS n, CAST(s_suppkey % 2 AS INTEGER) AS market FROM supplier",
    ahead="SELECT DISTINCT code FROM nat JOIN bars_m USING (code) WHERE n = 7 AND date < DATE '2001-09-01'",
    before="""SELECT code, date, "close" FROM bars_m WHERE date < DATE '2000-09-01' OR date < DATE '2001-09-01' AND code IN (SELECT code FROM ahead)
      UNION ALL SELECT code, DATE '2001-08-31', NULL FROM ahead""",
    due="""SELECT n.code, coalesce(max(b.date) + 1, DATE '1990-01-01') AS start_date FROM nat n LEFT JOIN before b USING (code)
      WHERE n.code NOT IN (SELECT code FROM ahead) GROUP BY n.code""",
    ia="SELECT a.* FROM src_a a JOIN due USING (code) WHERE date BETWEEN start_date AND DATE '2001-09-01'",
    ib="SELECT b.* FROM src_b b JOIN due USING (code) JOIN nat USING (code) WHERE date BETWEEN start_date AND DATE '2001-09-01' AND n >= 5",
    ic="SELECT c.* FROM bars_m c JOIN due USING (code) JOIN nat USING (code) WHERE date BETWEEN start_date AND DATE '2001-09-01' AND n >= 3",
    picked="""SELECT code, date, "open", high, low, "close", CASE WHEN code IN (SELECT code FROM ib) THEN 'merged' ELSE 'tdx' END AS source FROM ia
      UNION ALL SELECT code, date, "open", high, low, "close", 'akshare' FROM ib WHERE code NOT IN (SELECT code FROM ia)
      UNION ALL SELECT code, date, "open", high, low, "close", 'baostock' FROM ic
        WHERE code NOT IN (SELECT code FROM ia) AND code NOT IN (SELECT code FROM ib)""",
    checked="""SELECT code, any_value(source) AS source, CASE WHEN count(*) < 10 THEN 'too_few_rows:' || count(*)
      ELSE 'ok' END AS reason FROM picked GROUP BY code""",
    stored_after="""SELECT code, date, "close" FROM picked WHERE code IN (SELECT code FROM checked WHERE reason = 'ok')
      UNION ALL SELECT code, date, "close" FROM before""",
    verdict="""SELECT n.code, n.market, a.code IS NOT NULL AS fresh, c.reason, c.source FROM nat n
      LEFT JOIN checked c USING (code) LEFT JOIN ahead a USING (code)""",
    load_log="""SELECT code, market, CASE WHEN fresh THEN 'skipped' WHEN reason = 'ok' THEN 'success' ELSE 'failed' END AS status,
      CASE WHEN reason = 'ok' THEN source END AS source,
      CASE WHEN reason = 'ok' THEN (SELECT count(*) FROM stored_after s WHERE s.code = l.code) END AS rows,
      CASE WHEN fresh THEN 'already_up_to_date' WHEN reason IS NULL THEN 'complete_fail' WHEN reason <> 'ok' THEN 'validate:' || reason END AS reason
      FROM verdict l
      UNION ALL SELECT code, market, 'validation', NULL, NULL, reason FROM verdict WHERE NOT fresh AND reason <> 'ok'""",
)


@query(
    "u06_ingest_table",
    f"SELECT code, date, {PX} FROM stored_after",
    **INGEST,
)
def u06(spark, d):
    merged, _ = load(spark, d)
    return merged.select("code", "date", r("close", 7).alias("close"))


@query("u06_ingest_log", "SELECT code, market, status, source, rows, reason FROM load_log", **INGEST)
def u06_log(spark, d):
    _, log = load(spark, d)
    return log.select("code", "market", "status", "source", "rows", "reason")


@query("u06_ingest_in_place", f"SELECT code, date, {PX} FROM stored_after", **INGEST)
def u06_in_place(spark, d):
    path, _, after, _ = load_in_place(spark, d)
    return snapshots.read(spark, path, after).select("code", "date", r("close", 7).alias("close"))


@query("u06_ingest_in_place_log", ORACLES["u06_ingest_log"])
def u06_in_place_log(spark, d):
    return load_in_place(spark, d)[3].select("code", "market", "status", "source", "rows", "reason")


@query("u01_snapshot_before_load", f"SELECT code, date, {PX} FROM before", **INGEST)
def u01_snapshot_before(spark, d):
    """What a reader of the older snapshot still sees after the load."""
    path, before, _, _ = load_in_place(spark, d)
    return snapshots.read(spark, path, before).select("code", "date", r("close", 7).alias("close"))


@query(
    "u01_snapshot_pruned_read",
    f"SELECT code, date, {PX} FROM bars_m WHERE code IN (3, 7, 11) AND date BETWEEN DATE '1996-03-01' AND DATE '1998-05-31'",
)
def u01_snapshot_pruned(spark, d):
    """Some codes and dates of a table built year by year, each year a load of its own."""
    bars = v.stored_m(spark, d)
    path = shared_dir(spark) + "/bars"
    for years in ("date < '1997-01-01'", "date >= '1997-01-01' AND date < '1999-06-01'", "date >= '1999-06-01'"):
        snapshots.change(bars.filter(years), path, file_rows=200)
    out = snapshots.read(spark, path, None, [3, 7, 11], "1996-03-01", "1998-05-31")
    return out.select("code", "date", r("close", 7).alias("close"))


@query(
    "u07_sector_ingest",
    """SELECT sector_name, CASE WHEN left(sector_name, 8) = 'NATION_1' THEN 'skipped' ELSE 'success' END AS status,
      CASE WHEN left(sector_name, 8) <> 'NATION_1' THEN count(*) FILTER (date >= DATE '2001-06-02' AND date <= DATE '2001-10-01') END AS rows
    FROM sector_m GROUP BY sector_name""",
)
def u07(spark, d):
    """Sectors stored to June 2001, some already to October, loaded as of October."""
    s = v.sector_m(spark, d)
    ahead = F.col("sector_name").startswith("NATION_1")
    stored = s.filter(F.when(ahead, F.col("date") <= "2001-10-01").otherwise(F.col("date") <= "2001-06-01"))
    listed = v.table(spark, d, "nation").join(
        s.select(F.col("sector_name").alias("n_name")).distinct(), "n_name", "left_semi"
    ).select(F.col("n_name").alias("name"))
    _, log = mg.ingest_sectors(stored, s, listed, F.lit("2001-10-01").cast("date"))
    return log.select("sector_name", "status", "rows")
