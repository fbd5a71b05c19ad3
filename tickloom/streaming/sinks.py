"""Where alerts and signals of a stream end up."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tickloom.operators.alerts import full_subject
from tickloom.streaming.state import publish

log = logging.getLogger(__name__)

Handler = Callable[[DataFrame, int], None]


def alert_batch(path: str, handlers: Sequence[Handler] = ()) -> Handler:
    """A foreachBatch function: commit the batch to the alert table, then call each handler.

    A batch appears whole or not at all, and once: readers never see a part of it, and a
    repeated one changes nothing that is stored. Handlers get the stored rows, those of a
    repeated batch too, since the first run may have failed before it called them; one that
    fails is logged and the others still run.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumn("full_subject", full_subject())
        publish(rows, path, epoch)
        stored = batch.sparkSession.read.schema(rows.schema).parquet(f"{path}/epoch={epoch}")
        for handler in handlers:
            try:
                handler(stored, epoch)
            except Exception:
                log.exception("alert handler %r failed on batch %s", handler, epoch)

    return write


def send_alerts(
    alerts: DataFrame, path: str, checkpoint: str, handlers: Sequence[Handler] = (), available_now: bool = False
) -> StreamingQuery:
    trigger = {"availableNow": True} if available_now else {"processingTime": "10 seconds"}
    return (
        alerts.writeStream.foreachBatch(alert_batch(path, handlers))
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )
