"""Reading and writing stored tables: bars, sectors, fundamentals, reports, results.

Bars live in one table partitioned by year and sorted by (code, date), not in a file per
code: a scan of some years reads only their folders, and sorting gives row groups narrow
code ranges so that a filter on code skips most of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom import schemas
from tickloom.operators.quality import between_dates


def load_bars(
    spark: SparkSession, path: str, codes: Sequence | DataFrame | None = None, start=None, end=None,
    schema: StructType = schemas.BARS,
) -> DataFrame:
    """Stored bars, ``vol`` renamed to ``volume``; ``codes`` is a short list or a table.

    A table of per-code files without a code column gets the code from the file name.
    """
    df = spark.read.schema(schema).parquet(path)
    if "code" not in df.columns:
        df = df.withColumn("code", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.parquet$", 1))
    if "vol" in df.columns:
        df = df.withColumnRenamed("vol", "volume")
    df = between_dates(df, start, end)
    if isinstance(codes, DataFrame):
        return df.join(codes.select("code").distinct(), "code", "left_semi")
    return df if codes is None else df.filter(F.col("code").isin(list(codes)))


def save_bars(bars: DataFrame, path: str, mode: str = "overwrite", file_rows: int = 4_000_000) -> None:
    """zstd Parquet by year, sorted by (code, date). How many tasks write a year follows from
    its size at run time; a file holds at most ``file_rows``."""
    out = bars.withColumnRenamed("volume", "vol").withColumn("year", F.year("date"))
    dealt = bars.sparkSession.sql("SELECT /*+ REBALANCE(year, code) */ * FROM {out}", out=out)
    (
        dealt.sortWithinPartitions("year", "code", "date")
        .write.mode(mode).partitionBy("year").option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
    )


def save_bucketed(bars: DataFrame, table: str, buckets: int = 64, path: str | None = None, mode: str = "overwrite") -> None:
    """Bars as a table whose layout Spark knows: ``buckets`` by code, each sorted by (code, date).

    Factors, joins and aggregates by code over it need no exchange. Rows are dealt before they
    are written, so that a bucket is one file. ``path`` makes an external table there.
    """
    dealt = bars.repartition(buckets, "code")
    writer = dealt.write.mode(mode).format("parquet").option("compression", "zstd").bucketBy(buckets, "code").sortBy("code", "date")
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


def load_bucketed(spark: SparkSession, table: str, start=None, end=None) -> DataFrame:
    return between_dates(spark.table(table), start, end)


def list_codes(bars: DataFrame, limit: int | None = None) -> DataFrame:
    codes = bars.select("code").distinct().orderBy("code")
    return codes if limit is None else codes.limit(limit)


def load_sector_daily(
    spark: SparkSession, path: str, name: str | None = None, sector_type: str | None = None, start=None, end=None
) -> DataFrame:
    """Filters on the partition column and on date reach the scan."""
    df = spark.read.schema(schemas.SECTOR_DAILY).parquet(path)
    if sector_type is not None:
        df = df.filter(F.col("sector_type") == sector_type)
    if name is not None:
        df = df.filter(F.col("sector_name") == name)
    return between_dates(df, start, end)


def save_sector_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("sector_type").option("compression", "zstd").parquet(path)


def save_sector_map(members: DataFrame, parquet_path: str, csv_path: str) -> None:
    out = members.select("sector_name", "sector_type", "code")
    out.write.mode("overwrite").option("compression", "zstd").parquet(parquet_path)
    out.write.mode("overwrite").option("header", True).csv(csv_path)


def load_sector_map(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schemas.SECTOR_MAP)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)


def fresh_fundamentals(stored: DataFrame, version: int, now: Column, ttl_seconds: int = 86400) -> DataFrame:
    """Rows of the right version and no older than the limit; others count as absent."""
    age = F.unix_timestamp(now) - F.unix_timestamp("as_of")
    return stored.filter((F.col("version") == version) & (age <= ttl_seconds))


# ------------------------------------------------------------------ run reports


def run_stats(log: DataFrame) -> DataFrame:
    """One row: counts by status and the calls per source, ready for JSON."""
    from tickloom.operators.merge import last_records, source_counts

    counts = last_records(log).agg(
        F.count_if(F.col("status") == "success").alias("success"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "validation").alias("validation_failures"),
    ).withColumn("total", F.col("success") + F.col("failed") + F.col("skipped"))
    sources = source_counts(log).agg(
        F.sort_array(F.collect_list(F.struct("source", "calls"))).alias("source_counts")
    )
    # Two one-row results side by side.
    stacked = counts.unionByName(sources, allowMissingColumns=True)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


def run_details(log: DataFrame) -> DataFrame:
    """(status, code, market, reason) of every failed and every invalid code, however many."""
    from tickloom.operators.merge import last_records

    last = last_records(log)
    market = F.col("market") if "market" in last.columns else F.lit(None).cast("int").alias("market")
    return last.filter(F.col("status").isin("failed", "validation")).select("status", "code", market, "reason")


def save_run_stats(log: DataFrame, path: str) -> None:
    """``path/summary`` holds the counts, ``path/details`` a row per failed or invalid code."""
    run_stats(log).write.mode("overwrite").json(f"{path}/summary")
    run_details(log).write.mode("overwrite").json(f"{path}/details")


def save_load(table: DataFrame, log: DataFrame, bars_path: str, report_path: str) -> None:
    """What a daily load leaves: the stored bars, the run report and the failed list, from its own log.

    ``table`` must not read ``bars_path`` itself.
    """
    save_bars(table, bars_path)
    save_run_stats(log, report_path)
    save_failed_list(log.filter("status = 'failed'"), f"{report_path}/failed")


def save_failed_list(failed: DataFrame, path: str) -> None:
    failed.select("code", "market", "reason").write.mode("overwrite").option("sep", "\t").csv(path)


def load_failed_list(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated (code, market, ...); comments and rows without a market number leave."""
    raw = spark.read.schema("code string, market string, reason string").option("sep", "\t").option(
        "comment", "#"
    ).csv(path)
    return raw.select("code", F.col("market").try_cast("int").alias("market")).filter("market IS NOT NULL")


# ------------------------------------------------------------------ results


def save_results(performance: DataFrame, curves: DataFrame, path: str, key: str = "strategy_name") -> None:
    """One JSON document per strategy: its figures and its equity curve as an array.

    The nested array is the file format; a curve holds one point per day.
    """
    points = curves.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("timestamp", "total_value"))).alias("equity_curve")
    )
    figures = [c for c in performance.columns if c != key]
    performance.select(key, F.struct(*figures).alias("performance")).join(points, key).write.mode("overwrite").json(path)


def load_results(spark: SparkSession, path: str, figures: str, key: str = "strategy_name") -> DataFrame:
    """Rows (key, performance.*, timestamp, total_value) of stored results."""
    schema = f"{key} string, performance struct<{figures}>, equity_curve array<struct<timestamp:date,total_value:double>>"
    return spark.read.schema(schema).json(path).select(key, "performance", F.explode("equity_curve").alias("p")).select(
        key, "performance.*", "p.*"
    )
