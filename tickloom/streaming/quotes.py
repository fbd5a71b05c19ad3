"""Quote streams: reading, latest quote per code, one quote per code and minute, scoring."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tickloom.operators.clean import clean_quotes
from tickloom.operators.live import score_quotes
from tickloom.schemas import QUOTES
from tickloom.streaming.state import KeyedState

SCAN_EVERY = "300 seconds"
RECOMPUTE_EVERY = "60 seconds"
LATENESS = "10 minutes"


def read_files(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType = QUOTES, files_per_batch: int = 1000,
    only: str | None = None,
) -> DataFrame:
    """Quote files as they land in a folder, optionally those matching a name pattern.

    ``files_per_batch`` bounds what one micro-batch holds.
    """
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("pathGlobFilter", only) if only else reader).load(path)


def read_kafka(
    spark: SparkSession, servers: str, topic: str, schema: StructType = QUOTES, per_batch: int = 5_000_000,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Quotes as JSON values of a topic; needs the Kafka connector on the class path."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("maxOffsetsPerTrigger", per_batch).options(**(options or {})).load()
    )
    return clean_quotes(raw.select(F.from_json(F.col("value").cast("string"), schema).alias("q")).select("q.*"))


def latest(quotes: DataFrame, tie: str | None = None) -> DataFrame:
    """Last quote per code, reduced before the shuffle."""
    values = [c for c in quotes.columns if c != "code"]
    at = F.struct("ts", tie) if tie else F.col("ts")
    return quotes.groupBy("code").agg(F.max_by(F.struct(*values), at).alias("q")).select("code", "q.*")


def last_per_window(quotes: DataFrame, width: str = RECOMPUTE_EVERY, tie: str | None = None) -> DataFrame:
    """Last quote per code and tumbling window: the recompute limit."""
    values = [c for c in quotes.columns if c != "code"]
    at = F.struct("ts", tie) if tie else F.col("ts")
    out = quotes.groupBy("code", F.window("ts", width).alias("window")).agg(F.max_by(F.struct(*values), at).alias("q"))
    return out.select("code", "window", "q.*")


def latest_state(spark: SparkSession, table_path: str, schema: StructType, tie: str | None = None) -> KeyedState:
    """The last quote per code that :func:`keep_latest` keeps; ``read()`` gives the table."""
    return KeyedState(spark, table_path, schema, "code", lambda df: latest(df, tie))


def keep_latest(
    quotes: DataFrame, table_path: str, checkpoint: str, trigger: Mapping[str, object], tie: str | None = None
) -> StreamingQuery:
    """Keep a table of the last quote per code.

    A batch adds its own codes to the state, one row each; codes without a new quote are
    neither read nor written. A batch that is run again changes nothing.
    """
    columns = ["code", *[c for c in quotes.columns if c != "code"]]
    kinds = StructType([quotes.schema[c] for c in columns])

    def merge(batch: DataFrame, epoch: int) -> None:
        latest_state(batch.sparkSession, table_path, kinds, tie).add(batch, epoch)

    return quotes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def beside(quotes: DataFrame, static: DataFrame) -> DataFrame:
    """The static side, one row per code, of a join with ``quotes``: shuffled if they are a stream.

    What a watermark closes comes out of a batch without new quotes, which Spark takes for
    empty, and a batch with new ones for as small as its files are compressed: left to choose,
    it would broadcast the quotes through the driver.
    """
    return static.hint("shuffle_hash") if quotes.isStreaming else static


def score_stream(
    quotes: DataFrame, state: DataFrame, strategies=None, lateness: str = LATENESS, tie: str | None = None
) -> DataFrame:
    """Stream-static join: last quote per code and minute, scored by every strategy.

    The static side has one row per code. Both sides are shuffled, of the quotes at most one
    per code and minute, so that no code is large.
    """
    limited = last_per_window(quotes.withWatermark("ts", lateness), tie=tie)
    names = {} if strategies is None else {"strategies": tuple(strategies)}
    return score_quotes(limited, beside(limited, state), **names)


def score_batch(
    quotes: DataFrame, state: DataFrame, width: str = RECOMPUTE_EVERY, tie: str | None = None
) -> DataFrame:
    """A scan over one micro-batch: last quote per code and window, scored."""
    return score_quotes(last_per_window(quotes, width, tie), state)


def run_scans(
    scored: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = SCAN_EVERY
) -> StreamingQuery:
    """Scan on a fixed cadence; ``every=None`` works off what is there and stops."""
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return (
        scored.writeStream.outputMode("append").foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


__all__ = [
    "LATENESS", "RECOMPUTE_EVERY", "SCAN_EVERY", "beside", "keep_latest", "last_per_window", "latest", "latest_state", "read_files",
    "read_kafka", "run_scans", "score_batch", "score_stream",
]
