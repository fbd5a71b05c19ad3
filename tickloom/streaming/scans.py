"""Merged signals as they happen: quotes in, one signal per code and scan out.

Two steps. The first keeps quotes that come too late aside, so that nothing vanishes in a
watermark. The second is one query of three stateful operators: last quote per code and
minute, last of these per scan, merged votes on it. Each passes the event time of its windows
on, so that one watermark closes minutes, scans and votes in turn. Quotes are scored after the
second one, so that no state holds a row per strategy.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.operators import votes as vt
from tickloom.operators.live import scorable, score_quotes
from tickloom.streaming.quotes import LATENESS, RECOMPUTE_EVERY, SCAN_EVERY, beside, last_per_window
from tickloom.streaming.state import KeyedState, publish


def _clock(spark, path: str) -> KeyedState:
    """The newest event time seen, in microseconds."""
    return KeyedState(spark, f"{path}/clock", "one int, newest bigint", "one", lambda df: df.groupBy("one").agg(F.max("newest").alias("newest")), buckets=1)


def split_late(
    quotes: DataFrame, path: str, checkpoint: str, lateness_seconds: int = 600, width_seconds: int = 60,
    ts: str = "ts", trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Quotes in time land in ``path/ontime``, those that come too late in ``path/late``.

    A quote is late if its window of ``width_seconds`` ends at or before the newest time of all
    batches before its own, less ``lateness_seconds``. Every quote with a time lands in one of
    the two, once, and a batch appears whole. Quotes without a time are late.
    """

    def work(batch: DataFrame, epoch: int) -> None:
        clock = _clock(batch.sparkSession, path)
        micros = F.unix_micros(F.col(ts).cast("timestamp"))
        before = clock.before(epoch).first()
        if before is None:
            late = F.col(ts).isNull()
        else:
            width = width_seconds * 1_000_000
            end = (F.floor(micros / F.lit(width)) + 1) * width
            late = F.coalesce(end <= before.newest - lateness_seconds * 1_000_000, F.lit(True))
        publish(batch.filter(~late), f"{path}/ontime", epoch)
        publish(batch.filter(late), f"{path}/late", epoch)
        seen = batch.agg(F.lit(1).alias("one"), F.max(micros).alias("newest")).filter("newest IS NOT NULL")
        clock.add(seen, epoch)

    trigger = trigger or {"processingTime": "10 seconds"}
    return quotes.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_ontime(spark, path: str, schema, batches_at_once: int | None = None) -> DataFrame:
    """The stream of quotes that :func:`split_late` found in time, in its order."""
    reader = spark.readStream.schema(schema).format("parquet")
    if batches_at_once is not None:
        reader = reader.option("maxFilesPerTrigger", batches_at_once)
    return reader.load(f"{path}/ontime/epoch=*")


def merged_signals(
    quotes: DataFrame, state: DataFrame, rule: str = "any", min_score: float = vt.MIN_SCORE, strategies: Sequence[str] | None = None,
    lateness: str = LATENESS, minute: str = RECOMPUTE_EVERY, scan: str = SCAN_EVERY, tie: str | None = None,
) -> DataFrame:
    """(code, scan, signal, score, ...) of every code and scan whose gated votes agree on a side.

    ``quotes`` is a stream (code, ts, price) or a table, which gives what the stream gives
    in the end. A scan appears once the watermark has passed its end. ``scan`` has to be a
    multiple of ``minute``. The static side ``state`` has one row per code.
    """
    if quotes.isStreaming:
        quotes = quotes.withWatermark("ts", lateness)
    last, state = last_per_window(quotes, minute, tie), beside(quotes, state)
    names = {} if strategies is None else {"strategies": tuple(strategies)}
    # Every strategy votes on every quote that can be scored, so its last vote of a scan is that on the scan's last such quote.
    heard = scorable(last, state).withColumn("at", F.window_time("window"))
    values = [c for c in last.columns if c not in ("code", "window")]
    final = heard.groupBy("code", F.window("at", scan).alias("scan")).agg(F.max_by(F.struct(*values), F.col("window.start")).alias("q"))
    votes = score_quotes(final.select("code", "scan", "q.*"), state, **names)
    gated = vt.gate(votes.select("code", "scan", "strategy", "place", "side", "score", "reason"), min_score)
    return vt.merge_votes(gated, ["code", "scan"], rule, min_score)
