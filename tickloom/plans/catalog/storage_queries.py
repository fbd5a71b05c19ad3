"""Section 2.1 (sources, sinks) and the streaming parts of 2.10, run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.num import f32, r
from tickloom.operators import portfolio as pf
from tickloom.operators import quality as q
from tickloom.operators import votes as vt
from tickloom.operators.live import live_state
from tickloom.operators.panel import latest_row
from tickloom.plans import views as v
from tickloom.plans.catalog.ingest_queries import INGEST, LOG, load, run_log
from tickloom.plans.catalog.live_queries import SCAN
from tickloom.plans.catalog.portfolio_queries import CURVES, PERF_COLS, STRATEGY_CURVES, _perf, strategy_curves
from tickloom.plans.catalog.registry import ORACLES, query
from tickloom.session import cut_lineage, shared_dir
from tickloom.sources import tables as tb
from tickloom.streaming import quotes as qs
from tickloom.streaming import scans, sinks, stateful

PX = 'round("close", 7) + 0.0 AS "close"'


def _stored_bars(spark, d):
    """Monthly bars written in the stored layout, for the readers to read."""
    path = shared_dir(spark) + "/bars"
    bars = v.bars_m(spark, d).withColumn("code", F.col("code").cast("string")).withColumn("amount", F.col("amount").cast("long"))
    tb.save_bars(bars, path)
    return path


@query(
    "s01_load_bars",
    f"""SELECT code, date, {PX}, volume FROM bars_m WHERE code IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)
    AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""",
)
def s01(spark, d):
    """Bars of some codes and years out of the stored table."""
    codes = v.table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").cast("string").alias("code"))
    out = tb.load_bars(spark, _stored_bars(spark, d), codes, "1996-01-01", "1999-12-31")
    return out.select(F.col("code").cast("long").alias("code"), "date", r("close", 7).alias("close"), "volume")


@query("s02_save_bars", "SELECT year(date)::INT AS year, count(*) AS rows, sum(volume)::BIGINT AS volume FROM bars_m GROUP BY ALL")
def s02(spark, d):
    """The stored table read back: rows and volume per year folder."""
    return spark.read.parquet(_stored_bars(spark, d)).groupBy("year").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("vol").alias("volume")
    )


@query("s03_list_codes", "SELECT DISTINCT code FROM bars_m ORDER BY code")
def s03(spark, d):
    return tb.list_codes(v.bars_m(spark, d))


@query("s03_list_first_codes", "SELECT DISTINCT l_suppkey AS code FROM lineitem ORDER BY code LIMIT 20")
def s03_first(spark, d):
    """The reference form with a limit on the number of codes."""
    return tb.list_codes(v.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("code")), 20)


@query("s04_max_dates", "SELECT code, max(date) AS max_date FROM bars_d GROUP BY code")
def s04(spark, d):
    days = v.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("date"))
    return q.max_dates(days)


@query(
    "s05_load_sector_daily",
    """SELECT sector_name, date, round(ln("close"), 6) + 0.0 AS log_close, volume FROM sector_m
    WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-06-30'""",
)
def s05(spark, d):
    path = shared_dir(spark) + "/sectors"
    tb.save_sector_table(v.sector_m(spark, d).withColumn("sector_type", F.lit("industry"))
                         .withColumn("volume", F.col("volume").cast("double")), path)
    out = tb.load_sector_daily(spark, path, None, "industry", "1997-01-01", "1999-06-30")
    return out.select("sector_name", "date", r(F.log("close")).alias("log_close"), F.col("volume").cast("long").alias("volume"))


@query("s06_sector_map_round_trip", "SELECT 'parquet' AS fmt, sector_name, code FROM concept UNION ALL SELECT 'csv', sector_name, code FROM concept")
def s06(spark, d):
    base = shared_dir(spark)
    members = v.concept(spark, d).select("sector_name", F.lit("concept").alias("sector_type"), F.col("code").cast("string").alias("code"))
    tb.save_sector_map(members, f"{base}/map", f"{base}/map_csv")
    out = None
    for fmt, path in (("parquet", f"{base}/map"), ("csv", f"{base}/map_csv")):
        one = tb.load_sector_map(spark, path, fmt).select(F.lit(fmt).alias("fmt"), "sector_name", F.col("code").cast("long").alias("code"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "s07_fresh_fundamentals",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS as_of FROM orders WHERE o_orderstatus = 'F'
    AND o_orderdate >= TIMESTAMP '2000-12-01' - INTERVAL 365 DAY""",
)
def s07(spark, d):
    """Orders as snapshots: status F is the current version, a year the age limit."""
    o = v.table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("as_of"),
        F.when(F.col("o_orderstatus") == "F", 2).otherwise(1).alias("version"),
    )
    out = tb.fresh_fundamentals(o, 2, F.lit("2000-12-01").cast("timestamp"), 365 * 86400)
    return out.select("o_orderkey", F.to_date("as_of").alias("as_of"))


def _log(spark, d):
    return run_log(spark, d).withColumn("reason", F.concat(F.lit("rows "), F.col("rows").cast("string")))


@query(
    "s08_run_report",
    """SELECT count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed,
      count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'validation') AS validation_failures,
      count(*) FILTER (status <> 'validation') AS total
    FROM (SELECT DISTINCT code, status FROM run_log)""",
    **LOG,
)
def s08(spark, d):
    path = shared_dir(spark) + "/stats"
    tb.save_run_stats(_log(spark, d), path)
    counts = "success bigint, failed bigint, skipped bigint, validation_failures bigint, total bigint"
    return spark.read.schema(counts).json(f"{path}/summary")


@query(
    "s08_run_details",
    """SELECT status, code, 'rows ' || CAST(max_by(rows, seq) AS VARCHAR) AS reason FROM run_log
    WHERE status IN ('failed', 'validation') GROUP BY ALL""",
    **LOG,
)
def s08_details(spark, d):
    """Every failed and invalid code, read back from its own table."""
    path = shared_dir(spark) + "/stats"
    tb.save_run_stats(_log(spark, d), path)
    return spark.read.schema("status string, code bigint, reason string").json(f"{path}/details")


@query(
    "s08_report_of_load",
    """SELECT 'count' AS what, status AS name, count(*) AS n FROM load_log GROUP BY ALL
    UNION ALL SELECT 'detail', reason, count(*) FROM load_log WHERE status IN ('failed', 'validation') GROUP BY ALL
    UNION ALL SELECT 'stored', CAST(year(date) AS VARCHAR), count(*) FROM stored_after GROUP BY ALL""",
    **INGEST,
)
def s08_load(spark, d):
    """A daily load written whole, its report and table read back."""
    base = shared_dir(spark)
    tb.save_load(*load(spark, d), f"{base}/bars", f"{base}/report")
    names = {"success": "success", "failed": "failed", "skipped": "skipped", "validation_failures": "validation"}
    got = spark.read.schema(", ".join(f"{c} bigint" for c in names)).json(f"{base}/report/summary")
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("n")) for c, n in names.items()]))
    counts = got.select(pairs.alias("p")).select(F.lit("count").alias("what"), "p.name", "p.n").filter("n > 0")
    details = spark.read.schema("status string, code bigint, reason string").json(f"{base}/report/details")
    reasons = details.groupBy(F.lit("detail").alias("what"), F.col("reason").alias("name")).agg(F.count("*").alias("n"))
    years = spark.read.parquet(f"{base}/bars").groupBy(F.lit("stored").alias("what"), F.col("year").cast("string").alias("name"))
    return counts.unionByName(reasons).unionByName(years.agg(F.count("*").alias("n")))


@query(
    "s09_failed_list",
    "SELECT DISTINCT code, 1 AS market FROM run_log WHERE status = 'failed'",
    **LOG,
)
def s09(spark, d):
    """Failed list written with comments and broken rows between, read back clean."""
    path = shared_dir(spark) + "/failed"
    failed = run_log(spark, d).filter("status = 'failed'").select(F.col("code").cast("string").alias("code")).distinct()
    good = failed.withColumns({"market": F.lit("1"), "reason": F.lit("complete_fail")})
    noise = failed.select(F.concat(F.lit("# "), "code").alias("code"), F.lit("x").alias("market"), F.lit("").alias("reason"))
    broken = failed.withColumns({"market": F.lit("sh"), "reason": F.lit("")})
    tb.save_failed_list(good.unionByName(noise).unionByName(broken), path)
    out = tb.load_failed_list(spark, path)
    return out.select(F.col("code").cast("long").alias("code"), "market")


@query(
    "s10_result_documents",
    f"""SELECT p.strategy AS strategy_name, c.ts AS timestamp, round(c.total_value, 2) + 0.0 AS total_value,
    round(p.total_return, 6) + 0.0 AS total_return, round(p.max_drawdown, 6) + 0.0 AS max_drawdown
    FROM perf p JOIN ({CURVES}) c USING (strategy)""",
    **STRATEGY_CURVES, **_perf("strategy", CURVES),
)
def s10(spark, d):
    path = shared_dir(spark) + "/results"
    curves = cut_lineage(strategy_curves(spark, d).withColumnRenamed("strategy", "strategy_name"))
    perf = pf.performance(curves, key="strategy_name").select("strategy_name", *PERF_COLS)
    tb.save_results(perf, curves.withColumnRenamed("ts", "timestamp"), path)
    out = tb.load_results(spark, path, ", ".join(f"{c}:double" for c in PERF_COLS))
    return out.select("strategy_name", "timestamp", r("total_value", 2).alias("total_value"),
                      r("total_return").alias("total_return"), r("max_drawdown").alias("max_drawdown"))


# ------------------------------------------------------------------ streams


def _event_stream(spark, d, batches=1):
    """The events as a stream, cut by time into as many micro-batches."""
    events = v.events(spark, d)
    if batches == 1:
        return qs.read_files(spark, d, schema=events.schema, only="events.parquet")
    base = shared_dir(spark) + "/landed"
    cuts = events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).agg(F.min("us"), F.max("us")).first()
    width = max(1, (cuts[1] - cuts[0]) // batches + 1)
    part = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - cuts[0]) / width)
    # As many files for every stretch of time, written by as many tasks; a stream takes files by when they landed.
    each = max(1, events.select(F.spark_partition_id().alias("p")).distinct().count())
    for i in range(batches):
        events.filter(part == i).repartition(each).write.mode("append").parquet(base)
    return qs.read_files(spark, base, schema=events.schema, files_per_batch=each)


def _quote_stream(spark, d, batches=1):
    return _event_stream(spark, d, batches).filter("value > 0").select(
        F.col("user_id").alias("code"), "ts", F.col("value").alias("price"), "event_id"
    )


def _ticks(spark, d, bars, batches=1):
    """Quotes as a stream, around the last close of their code: 85% of it plus value / 200."""
    quotes, last = _quote_stream(spark, d, batches), cut_lineage(latest_row(bars, ["close"]))
    return quotes.join(qs.beside(quotes, last), "code").select(
        "event_id", "code", "ts", (F.col("close") * (0.85 + F.col("price") / 200)).alias("price")
    )


def _run(df, spark, mode="append"):
    """Run a stream over what is there into Parquet and return the result as a table."""
    base = shared_dir(spark)
    query_ = (
        df.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start()
    )
    query_.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


@query("s11_quote_stream", "SELECT code, event_id, ts, CAST(CAST(price AS FLOAT) AS DOUBLE) AS price FROM quotes")
def s11(spark, d):
    return _run(_quote_stream(spark, d), spark).select("code", "event_id", "ts", f32("price").alias("price"))


@query(
    "s12_alert_sink",
    "SELECT event_id, code || '_' || side || '_' || strategy AS key FROM votes WHERE side <> 'hold'",
)
def s12(spark, d):
    """Alerts of a stream through the sink, with a handler that fails on every batch."""
    from tickloom.operators.alerts import signal_alert

    base = shared_dir(spark)
    kind = F.col("event_type")
    signals = _event_stream(spark, d).select(
        "event_id", "ts", F.col("user_id").alias("code"), F.col("user_id").cast("string").alias("name"),
        F.when(kind.isin("purchase", "signup"), "buy").when(kind.isin("click", "error"), "sell").alias("signal"),
        F.least(F.col("value") / 50, F.lit(1.0)).alias("score"), kind.alias("strategy"),
        F.col("value").alias("price"), F.lit("").alias("reason"),
    ).filter("signal IS NOT NULL")

    def broken(batch, epoch):
        raise RuntimeError("unreachable receiver")

    sinks.send_alerts(signal_alert(signals), f"{base}/alerts", f"{base}/ckpt", [broken], available_now=True).awaitTermination()
    return spark.read.parquet(f"{base}/alerts").select("event_id", "key")


@query(
    "t01_latest_quote_stream",
    """SELECT code, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM quotes GROUP BY code""",
)
def t01_stream(spark, d):
    base = shared_dir(spark)
    ticks = _quote_stream(spark, d, 4)
    qs.keep_latest(ticks, f"{base}/table", f"{base}/ckpt", {"availableNow": True}, tie="event_id").awaitTermination()
    return qs.latest_state(spark, f"{base}/table", ticks.schema, "event_id").read().select("code", "event_id", "ts")


@query(
    "t08_exit_stream",
    """SELECT event_id, code, event, round(pnl_pct, 6) + 0.0 AS pnl_pct FROM (SELECT *, (price - cost) / cost AS pnl_pct,
      CASE WHEN (price - cost) / cost <= -0.08 THEN 'stop_loss' WHEN (price - cost) / cost >= 0.2 THEN 'take_profit'
       WHEN wm > 0 AND (wm - price) / wm >= 0.05 THEN 'trailing_stop' END AS event FROM (
      SELECT q.*, c.cost, greatest(c.cost, max(q.price) OVER (PARTITION BY q.code ORDER BY q.ts, q.event_id ROWS UNBOUNDED PRECEDING)) AS wm
      FROM quotes q JOIN (SELECT s_suppkey AS code, s_acctbal / 100 AS cost FROM supplier WHERE s_acctbal > 0) c USING (code)))
    WHERE event IS NOT NULL""",
)
def t08(spark, d):
    """Events over five micro-batches, the highest prices carried between them."""
    return _exit_events(spark, d, 5)


def _exit_events(spark, d, batches):
    base = shared_dir(spark)
    held = v.table(spark, d, "supplier").filter("s_acctbal > 0").select(
        F.col("s_suppkey").alias("code"), (F.col("s_acctbal") / 100).alias("cost")
    ).withColumn("watermark", F.col("cost"))
    ticks = _quote_stream(spark, d, batches).withColumns({"day": F.to_date("ts"), "hour": F.date_trunc("hour", "ts")})
    stateful.exit_batches(
        ticks, held, base, f"{base}/ckpt", ["day", "hour"], ["ts", "event_id"], available_now=True
    ).awaitTermination()
    out = spark.read.parquet(f"{base}/events")
    return out.select("event_id", "code", "event", r("pnl_pct").alias("pnl_pct"))


@query(
    "t09_alert_throttle_stream",
    """SELECT key, event_id FROM sent""",
    al="""SELECT user_id || '_' || event_type AS key, event_id, ts,
      row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events""",
    walk="""SELECT key, event_id, ts, rn, ts AS last, true AS ok FROM al WHERE rn = 1
      UNION ALL SELECT a.key, a.event_id, a.ts, a.rn, CASE WHEN a.ts - w.last >= INTERVAL 3 DAY THEN a.ts ELSE w.last END,
        a.ts - w.last >= INTERVAL 3 DAY FROM walk w JOIN al a ON a.key = w.key AND a.rn = w.rn + 1""",
    sent="SELECT * FROM walk WHERE ok",
)
def t09_stream(spark, d):
    """Over five micro-batches, the last sends carried between them."""
    return _sent(spark, d, 5)


def _sent(spark, d, batches):
    base = shared_dir(spark)
    alerts = _event_stream(spark, d, batches).select(
        "event_id", "ts", F.concat(F.col("user_id").cast("string"), F.lit("_"), "event_type").alias("key")
    )
    stateful.throttle_batches(alerts, base, f"{base}/ckpt", 3 * 86400, available_now=True).awaitTermination()
    return spark.read.parquet(f"{base}/sent").select("key", "event_id")


@query("t08_exit_stream_batches", ORACLES["t08_exit_stream"])
def t08_batches(spark, d):
    """The same events from one micro-batch."""
    return _exit_events(spark, d, 1)


@query("t09_alert_throttle_stream_batches", ORACLES["t09_alert_throttle_stream"])
def t09_batches(spark, d):
    return _sent(spark, d, 1)


@query(
    "t13_scan_cadence",
    """SELECT code, minute, strategy, side, score FROM (
      SELECT q.code, q.minute, u.strategy, u.side, u.score FROM (
        SELECT code, time_bucket(INTERVAL 60 SECOND, ts) AS minute, max_by(event_id, (ts, event_id)) AS event_id FROM lq GROUP BY ALL) q
      JOIN rules u USING (event_id)) WHERE side <> 'hold'""",
    **SCAN,
)
def t13(spark, d):
    """The whole scan as one stream: a quote per code and minute, scored, gated, one batch per trigger."""
    base = shared_dir(spark)
    bars = v.stored_m(spark, d)
    ticks = _ticks(spark, d, bars)
    # History does not change while the stream runs: its state is one stored row per code.
    state = cut_lineage(live_state(bars))

    # Everything is there at once, so a batch can close its own minutes.
    def scan(batch, epoch):
        scored = qs.score_batch(batch, state, tie="event_id")
        vt.gate(scored, 0.0).select("code", F.col("window.start").alias("minute"), "strategy", "side", "score").write.mode(
            "overwrite"
        ).parquet(f"{base}/out/epoch={epoch}")

    qs.run_scans(ticks, scan, f"{base}/ckpt", every=None).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("code", "minute", "strategy", "side", r("score").alias("score"))


@query(
    "t02_score_stream",
    """SELECT q.code, q.minute, u.strategy, u.side, u.score FROM (
      SELECT code, time_bucket(INTERVAL 60 SECOND, ts) AS minute, max_by(event_id, (ts, event_id)) AS event_id FROM lq GROUP BY ALL) q
    JOIN rules u USING (event_id) WHERE q.minute + INTERVAL 60 SECOND <= (SELECT max(ts) FROM lq) - INTERVAL 10 MINUTE""",
    **SCAN,
)
def t02_stream(spark, d):
    """Quotes scored as a stream: minutes appear once the watermark has passed their end."""
    bars = v.stored_m(spark, d)
    state = cut_lineage(live_state(bars))
    ticks = _ticks(spark, d, bars, 3).withColumn("ts", F.col("ts").cast("timestamp"))
    out = _run(qs.score_stream(ticks, state, tie="event_id"), spark)
    return out.select("code", F.col("window.start").cast("timestamp_ntz").alias("minute"), "strategy", "side", r("score").alias("score"))


MERGED_SQL = """SELECT code, scan, signal, round(CASE WHEN signal = 'buy' THEN b ELSE s END, 6) + 0.0 AS score, CASE WHEN signal = 'buy' THEN bn ELSE sn END AS n
  FROM (SELECT *, {rule} AS signal FROM (SELECT code, scan, count(*) FILTER (side = 'buy') AS bn, count(*) FILTER (side = 'sell') AS sn,
    {score}(score) FILTER (side = 'buy') AS b, {score}(score) FILTER (side = 'sell') AS s FROM heard WHERE side <> 'hold' AND score >= 0.3 GROUP BY ALL))
  WHERE signal IS NOT NULL AND scan + INTERVAL 300 SECOND <= (SELECT max(ts) FROM lq) - INTERVAL 10 MINUTE"""
HEARD = dict(
    SCAN,
    heard="""SELECT code, time_bucket(INTERVAL 300 SECOND, minute) AS scan, strategy, max_by(side, minute) AS side, max_by(score, minute) AS score FROM (
      SELECT q.code, q.minute, u.strategy, u.side, u.score FROM (
        SELECT code, time_bucket(INTERVAL 60 SECOND, ts) AS minute, max_by(event_id, (ts, event_id)) AS event_id FROM lq GROUP BY ALL) q
      JOIN rules u USING (event_id)) GROUP BY ALL""",
)


def _merged_stream(spark, d, rule):
    """Quotes in five micro-batches, late ones kept aside, through three stateful operators of one query."""
    base = shared_dir(spark)
    bars = v.stored_m(spark, d)
    state = cut_lineage(live_state(bars))
    ticks = _ticks(spark, d, bars, 5).withColumn("ts", F.col("ts").cast("timestamp"))
    scans.split_late(ticks, base, f"{base}/split", trigger={"availableNow": True}).awaitTermination()
    made = scans.merged_signals(scans.read_ontime(spark, base, ticks.schema), state, rule, tie="event_id")
    return _run(made, spark).select(
        "code", F.col("scan.start").cast("timestamp_ntz").alias("scan"), "signal", r("score").alias("score"),
        F.size("strategies_triggered").cast("long").alias("n"),
    )


@query("t07_merged_signal_stream", MERGED_SQL.format(score="max", rule="CASE WHEN sn = 0 OR b >= s THEN 'buy' WHEN bn = 0 OR s > b THEN 'sell' END"), **HEARD)
def t07_stream(spark, d):
    return _merged_stream(spark, d, "any")


MAJORITY_SQL = MERGED_SQL.format(score="avg", rule="CASE WHEN bn * 2 > bn + sn THEN 'buy' WHEN sn * 2 > bn + sn THEN 'sell' END")


@query("t05_merge_majority_stream", f"SELECT code, scan, signal, n FROM ({MAJORITY_SQL})", **HEARD)
def t05_stream(spark, d):
    return _merged_stream(spark, d, "majority").drop("score")
