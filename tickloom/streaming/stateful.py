"""Per-key state on streams: exit rules of positions and alert throttling.

Every micro-batch goes through the slice-wise batch operator, so that a key holding a third
of the rows is spread over many tasks. What it leaves per key is added to a
:class:`~tickloom.streaming.state.KeyedState`: a batch writes its own keys and reads the
buckets they are in. A repeated micro-batch reads what the one before it left and changes
nothing that is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.functions.num import micros
from tickloom.operators import portfolio as pf
from tickloom.operators.alerts import DEDUP_SECONDS, throttle
from tickloom.streaming.state import KeyedState, publish


def _batches(stream: DataFrame, work, checkpoint: str, available_now: bool) -> StreamingQuery:
    trigger = {"availableNow": True} if available_now else {"processingTime": "10 seconds"}
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def last_sends(spark: SparkSession, path: str, kind: str = "string", key: str = "key") -> KeyedState:
    """When each key was sent last, in microseconds: the state of :func:`throttle_batches`."""
    return KeyedState(spark, f"{path}/state", f"{key} {kind}, last bigint", key, lambda df: df.groupBy(key).agg(F.max("last").alias("last")))


def highest_prices(spark: SparkSession, path: str, kind: str = "string") -> KeyedState:
    """The highest price per code: the state of :func:`exit_batches`."""
    return KeyedState(spark, f"{path}/state", f"code {kind}, high double", "code", lambda df: df.groupBy("code").agg(F.max("high").alias("high")))


def throttle_batches(
    alerts: DataFrame, path: str, checkpoint: str, window_seconds: int = DEDUP_SECONDS, key: str = "key",
    ts: str = "ts", tie: str = "event_id", available_now: bool = False, lateness_seconds: int = 86400,
) -> StreamingQuery:
    """Sent alerts land in ``path/sent``, the last send per key in ``path/state``.

    A key is forgotten when it is written next once its last send is a window and ``lateness_seconds`` older than
    the newest alert.

    An alert less than a window after its key's last send cannot go out; among the
    others the batch rule applies from a clean start.
    """
    width = window_seconds * 1_000_000

    def work(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        state = last_sends(spark, path, dict(batch.dtypes)[key], key)
        old = state.before(epoch, batch.select(key))
        timed = batch.withColumn("__at", micros(batch, ts))
        open_ = timed.join(old, key, "left").filter(F.col("last").isNull() | (F.col("__at") - F.col("last") >= width)).drop("last")
        publish(throttle(open_, window_seconds, key, ts, tie), f"{path}/sent", epoch)
        sent = spark.read.schema(open_.schema).parquet(f"{path}/sent/epoch={epoch}").select(key, F.col("__at").alias("last"))
        newest = timed.agg(F.max("__at")).first()[0]
        forget = None if newest is None else F.col("last") <= newest - width - lateness_seconds * 1_000_000
        state.add(sent, epoch, forget)

    return _batches(alerts, work, checkpoint, available_now)


def exit_batches(
    quotes: DataFrame, positions: DataFrame, path: str, checkpoint: str, levels: list[str], order: list[str],
    available_now: bool = False, **rules,
) -> StreamingQuery:
    """Risk events land in ``path/events``, the highest price per held code in ``path/state``."""

    def work(batch: DataFrame, epoch: int) -> None:
        state = highest_prices(batch.sparkSession, path, dict(batch.dtypes)["code"])
        old = state.before(epoch, batch.select("code"))
        held = positions.join(old, "code", "left").withColumn("watermark", F.greatest("watermark", "high")).drop("high")
        publish(pf.live_exits(held, batch, levels, order, **rules), f"{path}/events", epoch)
        state.add(batch.select("code", F.col("price").alias("high")), epoch)

    return _batches(quotes, work, checkpoint, available_now)
