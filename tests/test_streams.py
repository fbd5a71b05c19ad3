"""Streams over split files end where their batch twins end."""

import datetime as dt
import random
import time

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from tickloom.operators import alerts as al
from tickloom.operators import portfolio as pf
from tickloom.plans import views as v
from tickloom.streaming import quotes as qs
from tickloom.streaming import scans, sinks, stateful
from tickloom.streaming.state import KeyedState


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Events in time order, written as several files with rising modification times."""
    path = tmp_path_factory.mktemp("landed") / "events"
    events = v.events(spark, SF_DIR)
    cuts = events.approxQuantile("event_id", [0.25, 0.5, 0.75], 0.0)
    edges = [-1, *cuts, float("inf")]
    for lo, hi in zip(edges, edges[1:]):
        events.filter((F.col("event_id") > lo) & (F.col("event_id") <= hi)).coalesce(1).write.mode("append").parquet(str(path))
    return str(path)


def stream(spark, landed):
    return qs.read_files(spark, landed, schema=v.events(spark, SF_DIR).schema, files_per_batch=1)


def run(df, base):
    q = (
        df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    assert len(q.recentProgress) >= 4
    return df.sparkSession.read.schema(df.schema).parquet(f"{base}/out")


def test_slice_wise_forms_carry_state_between_batches(spark, landed, tmp_path):
    key = F.concat(F.col("user_id").cast("string"), F.lit("_"), "event_type").alias("key")
    base = str(tmp_path / "throttle")
    stateful.throttle_batches(
        stream(spark, landed).select("event_id", "ts", key), base, f"{base}/ckpt", 5 * 86400, available_now=True
    ).awaitTermination()
    want = al.throttle(v.events(spark, SF_DIR).select("event_id", "ts", key), 5 * 86400)
    got = spark.read.parquet(f"{base}/sent")
    assert sorted(r[0] for r in got.select("event_id").collect()) == sorted(r[0] for r in want.select("event_id").collect())
    assert got.select("epoch").distinct().count() == 4

    held = v.table(spark, SF_DIR, "supplier").filter("s_acctbal > 0").select(
        F.col("s_suppkey").alias("code"), (F.col("s_acctbal") / 100).alias("cost")
    ).withColumn("watermark", F.col("cost"))
    cols = {"day": F.to_date("ts"), "hour": F.date_trunc("hour", "ts")}
    quotes = stream(spark, landed).filter("value > 0").select(
        F.col("user_id").alias("code"), "ts", F.col("value").alias("price"), "event_id"
    ).withColumns(cols)
    base = str(tmp_path / "exits")
    stateful.exit_batches(
        quotes, held, base, f"{base}/ckpt", ["day", "hour"], ["ts", "event_id"], available_now=True
    ).awaitTermination()
    want = pf.live_exits(held, v.quotes(spark, SF_DIR).withColumns(cols), ["day", "hour"], ["ts", "event_id"])
    pick = lambda df: sorted((r["event_id"], r["event"]) for r in df.collect())
    assert pick(spark.read.parquet(f"{base}/events")) == pick(want)


def test_latest_quote_table(spark, landed, tmp_path):
    quotes = stream(spark, landed).select(F.col("user_id").alias("code"), "ts", F.col("value").alias("price"), "event_id")
    q = qs.keep_latest(quotes, str(tmp_path / "t"), str(tmp_path / "c"), {"availableNow": True}, tie="event_id")
    q.awaitTermination()
    got = qs.latest_state(spark, str(tmp_path / "t"), quotes.schema, "event_id").read()
    want = v.events(spark, SF_DIR).groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")))
    assert {tuple(r) for r in got.select("code", "event_id").collect()} == {tuple(r) for r in want.collect()}


def test_alert_batch_repeats_replace_and_handlers_are_isolated(spark, tmp_path):
    seen = []

    def bad(batch, epoch):
        raise RuntimeError("down")

    write = sinks.alert_batch(str(tmp_path / "alerts"), [bad, lambda batch, epoch: seen.append((epoch, batch.count()))])
    batch = spark.createDataFrame([("k", "buy", "s", "b")], "key string, level string, subject string, body string")
    write(batch, 0)
    write(batch.union(batch), 0)
    write(batch, 1)
    assert spark.read.parquet(str(tmp_path / "alerts")).count() == 2 and seen == [(0, 1), (0, 1), (1, 1)]


def test_half_a_batch_is_never_seen(spark, tmp_path):
    path = str(tmp_path / "alerts")
    write = sinks.alert_batch(path)
    rows = spark.range(0, 40, 1, 4).select(
        F.col("id").cast("string").alias("key"), F.lit("buy").alias("level"), F.lit("s").alias("subject"), F.lit("b").alias("body"), "id"
    )
    write(rows.filter("id < 10"), 0)
    broken = rows.withColumn("key", F.when(F.col("id") < 39, F.col("key")).otherwise(F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception):
        write(broken, 1)
    assert spark.read.parquet(path).count() == 10
    write(rows, 1)
    assert spark.read.parquet(path).count() == 50


def test_watermarked_scoring_stream(spark, landed, tmp_path):
    from tickloom.operators.live import live_state

    quotes = stream(spark, landed).select(
        F.col("user_id").alias("code"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") * 50 + 1).alias("price")
    )
    state = live_state(v.bars_m(spark, SF_DIR))
    out = run(qs.score_stream(quotes, state, ["short_term"]), tmp_path)
    assert out.count() > 0 and out.select("strategy").distinct().collect()[0][0] == "short_term"


def bytes_below(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_state_writes_follow_the_batch_not_the_keys(spark, tmp_path):
    fold = lambda df: df.groupBy("k").agg(F.max("x").alias("x"))
    state = KeyedState(spark, str(tmp_path / "s"), "k long, x long", "k", fold)
    pairs = lambda keys, x: spark.range(keys.start, keys.stop).selectExpr("id k", f"{x} + id x")
    state.add(pairs(range(200_000), 0), 0)
    whole, want = bytes_below(tmp_path / "s" / "data"), {k: k for k in range(200_000)}
    for epoch in range(1, 12):
        keys = range(epoch * 10, epoch * 10 + 40)
        state.add(pairs(keys, epoch * 1_000_000), epoch)
        want |= {k: epoch * 1_000_000 + k for k in keys}
        own = sum(bytes_below(p) for p in (tmp_path / "s" / "data").glob(f"epoch={epoch}"))
        assert own < whole / 10
        runs = state._runs(epoch + 1)
        assert max(sum(1 for r in runs if r.bucket == b) for b in range(64)) <= 6
    assert dict(state.read().collect()) == want
    few = state.before(12, spark.createDataFrame([(15,)], "k long"))
    assert few.count() < 200_000 / 32 and few.filter("k = 15").first().x == want[15]


@pytest.mark.parametrize("seed", [2])
def test_state_against_a_plain_dictionary(spark, tmp_path, seed):
    rng, want, past = random.Random(seed), {}, {}
    fold = lambda df: df.groupBy("k").agg(F.max_by("v", "at").alias("v"), F.max("at").alias("at"))
    state = KeyedState(spark, str(tmp_path / "s"), "k string, v double, at long", "k", fold, buckets=3)
    for epoch in range(8):
        rows = [(rng.choice("abcdefgh") + str(rng.randrange(6)) if rng.random() > 0.05 else None, rng.random(), epoch * 100 + i) for i in range(rng.choice([0, 1, 5, 60]))]
        df = spark.createDataFrame(rows, "k string, v double, at long")
        for again in range(2):  # a repeated batch changes nothing
            state.add(df, epoch)
            past[epoch] = dict(want)
            now = {**want, **{k: (v, at) for k, v, at in rows}}
            assert {r.k: (r.v, r.at) for r in state.read().collect()} == now
        want = now
        # The state before a batch can still be read when it is run again.
        assert {r.k: (r.v, r.at) for r in state.before(epoch).collect()} == past[epoch]


def test_forgotten_keys_leave_when_they_are_written_again(spark, tmp_path):
    fold = lambda df: df.groupBy("k").agg(F.max("last").alias("last"))
    state = KeyedState(spark, str(tmp_path / "s"), "k long, last long", "k", fold, buckets=1)
    state.add(spark.createDataFrame([(1, 10), (2, 20)], "k long, last long"), 0)
    state.add(spark.createDataFrame([(3, 90)], "k long, last long"), 1, F.col("last") < 15)
    assert {tuple(r) for r in state.read().collect()} == {(2, 20), (3, 90)}


def _quotes(rng, batches):
    """Batches of quotes; some of a batch are older than what came before, a few of them too old."""
    out, n = [], 0
    for b in range(batches):
        rows = []
        for _ in range(120):
            back = rng.choice([0, 0, 0, 0, 200, 2000]) if b else 0
            at = dt.datetime(2024, 5, 6, 9, 30) + dt.timedelta(seconds=max(0, b * 900 + rng.randrange(900) - back), microseconds=rng.randrange(10**6))
            rows.append((rng.choice("ABC"), at, 10 + 8 * rng.random(), n := n + 1))
        out.append(rows)
    out[1].append(("A", None, 11.0, n + 1))
    return out


def test_merged_signals_as_a_stream(spark, tmp_path):
    """Over five micro-batches with late rows the stream gives what the table gives, and no quote vanishes."""
    from test_trading import live_bars

    from tickloom.operators.live import live_state

    kinds = "code string, ts timestamp, price double, event_id long"
    batches = _quotes(random.Random(3), 5)
    for rows in batches:
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)  # files are taken by when they landed
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    base = str(tmp_path / "split")
    scans.split_late(stream, base, f"{base}/ckpt", trigger={"availableNow": True}).awaitTermination()

    late, ontime, newest = set(), set(), None
    for rows in batches:
        for _, at, _, event in rows:
            end = at and at.replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
            (late if at is None or newest and end <= newest - dt.timedelta(minutes=10) else ontime).add(event)
        newest = max([newest or dt.datetime.min, *(at for _, at, _, _ in rows if at)])
    ids = lambda name: {r.event_id for r in spark.read.parquet(f"{base}/{name}").collect()}
    assert ids("late") == late and ids("ontime") == ontime and len(late) > 20

    state = live_state(live_bars(spark).unionByName(live_bars(spark, code="B")).unionByName(live_bars(spark, 90, "C"))).cache()
    for rule in ("any", "majority", "weighted"):
        quotes = scans.read_ontime(spark, base, kinds, 1)
        made = scans.merged_signals(quotes, state, rule, 0.1, tie="event_id")
        query = (
            made.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / rule))
            .option("checkpointLocation", str(tmp_path / f"c_{rule}")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        assert len(query.recentProgress) >= 5 and len(query.lastProgress.stateOperators) == 3
        assert all(op.numRowsDroppedByWatermark == 0 for p in query.recentProgress for op in p.stateOperators)
        got = spark.read.schema(made.schema).parquet(str(tmp_path / rule))
        table = scans.merged_signals(spark.read.schema(kinds).parquet(f"{base}/ontime"), state, rule, 0.1, tie="event_id")
        closed = newest - dt.timedelta(minutes=10)
        want = {str(r) for r in table.filter(F.col("scan.end") <= F.lit(closed)).collect()}
        assert {str(r) for r in got.collect()} == want and len(want) > 10
    state.unpersist()


def test_votes_are_made_after_the_last_quote_of_a_scan_is_chosen(spark):
    """No state holds a row per strategy: both choices of a last quote lie below the step that makes votes."""
    from test_trading import live_bars

    from tickloom.operators.live import live_state

    made = live_state(live_bars(spark))
    state = spark.createDataFrame(made.collect(), made.schema)
    quotes = spark.createDataFrame([r for rows in _quotes(random.Random(3), 2) for r in rows], "code string, ts timestamp, price double, event_id long")
    plan = scans.merged_signals(quotes, state, tie="event_id")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate explode")
    assert above.count("Aggregate [") == 1 and below.count("Aggregate [") == 2


def _last_plan(stream, base, capsys):
    """The plan of the last batch of a stream that runs over what is there."""
    query = (
        stream.writeStream.format("noop").outputMode("append").option("checkpointLocation", f"{base}/ckpt")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    capsys.readouterr()
    query.explain()
    return capsys.readouterr().out


def test_what_a_watermark_closes_is_not_broadcast(spark, tmp_path, capsys):
    """Scans are closed by a batch without new quotes, which Spark takes for empty."""
    from test_trading import live_bars

    from tickloom.operators.live import live_state

    kinds = "code string, ts timestamp, price double, event_id long"
    rows = [r for rows in _quotes(random.Random(3), 2) for r in rows]
    spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(str(tmp_path / "in"))
    live_state(live_bars(spark)).write.parquet(str(tmp_path / "state"))
    quotes, state = spark.readStream.schema(kinds).parquet(str(tmp_path / "in")), spark.read.parquet(str(tmp_path / "state"))
    for name, made in {"merged": scans.merged_signals(quotes, state, tie="event_id"), "scored": qs.score_stream(quotes, state)}.items():
        plan = _last_plan(made, tmp_path / name, capsys)
        assert "StateStoreSave" in plan and "ShuffledHashJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name, step", [("t07_merged_signal_stream", (scans, "split_late")), ("t13_scan_cadence", (qs, "run_scans"))])
def test_quotes_are_not_broadcast_to_their_last_close(spark, tmp_path, capsys, monkeypatch, name, step):
    """Files of quotes are a fraction of the rows in them, so that Spark takes large batches for small."""
    from tickloom.plans.catalog import QUERIES

    seen = []

    def take(ticks, *args, **kwargs):
        seen.append(ticks)
        raise InterruptedError

    monkeypatch.setattr(*step, take)
    with pytest.raises(InterruptedError):
        QUERIES[name](spark, SF_DIR)
    plan = _last_plan(seen[0], tmp_path, capsys)
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan


def test_a_repeated_batch_is_not_split_twice(spark, tmp_path):
    from tickloom.streaming.state import publish

    df = spark.range(5).selectExpr("id")
    assert publish(df, str(tmp_path / "t"), 0) and not publish(df.union(df), str(tmp_path / "t"), 0)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5


def test_cadence_trigger_scans_again_and_again(spark, landed, tmp_path):
    """A scan on the clock, not on what is there: new files are picked up by a later trigger."""
    seen = []
    source = str(tmp_path / "in")
    events = v.events(spark, SF_DIR)
    events.limit(10).coalesce(1).write.mode("append").parquet(source)
    stream_ = qs.read_files(spark, source, schema=events.schema)
    query = qs.run_scans(stream_, lambda batch, epoch: seen.append(batch.count()), str(tmp_path / "c"), every="1 second")
    try:
        for want in (10, 17):
            end = time.monotonic() + 60
            while sum(seen) < want and time.monotonic() < end:
                time.sleep(0.2)
            assert sum(seen) == want
            events.limit(7).coalesce(1).write.mode("append").parquet(source)
    finally:
        query.stop()
    assert len(seen) >= 2
