"""State of a stream, one row per key, of which a micro-batch writes only what it brings.

A key's rows combine by an associative fold, so a batch adds its own rows, one per key, and
never rewrites the others. Keys are dealt into buckets by hash. A bucket is a list of runs;
a new run takes in the runs before it that are at most ``ABSORB`` times its size, so that
sizes at least double from run to run: a bucket has few runs, and a row is written a
logarithm of times. What a batch reads are the runs of the buckets that its keys are in.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tickloom.session import remove

BUCKETS, ABSORB = 64, 2
RUN = "bucket int, epoch long, rows long"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def publish(df: DataFrame, path: str, epoch: int, partition_by: Sequence[str] = ()) -> bool:
    """Write a batch so that readers of ``path`` see all of it or nothing, and once.

    It is written aside, under a name that readers skip, and renamed into ``epoch=n``. A
    batch that is there already is left alone; then the result is false. Needs a file
    system whose rename is atomic, as HDFS and local ones are.
    """
    spark, target = df.sparkSession, f"{path}/epoch={epoch}"
    if _exists(spark, target):
        return False
    aside = f"{path}/_staged/epoch={epoch}-{uuid.uuid4().hex[:8]}"
    df.write.partitionBy(*partition_by).parquet(aside)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    source = hadoop(aside)
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.rename(source, hadoop(target)) and not _exists(spark, target):
        raise OSError(f"{aside} could not be renamed to {target}")
    return True


class KeyedState:
    """Rows of ``schema`` by ``key`` under ``path``; ``fold`` makes one row per key of any rows of it.

    ``fold`` has to be associative and to ignore order and repeats of what it folds.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: StructType | str, key: str, fold: Callable[[DataFrame], DataFrame],
        buckets: int = BUCKETS,
    ):
        self.spark, self.path, self.key, self.fold, self.buckets = spark, path, key, fold, buckets
        self.schema = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _runs(self, epoch: int) -> list:
        """The runs that the batches before ``epoch`` left; some per bucket."""
        at = f"{self.path}/runs/epoch={epoch - 1}"
        if epoch <= 0 or not _exists(self.spark, at):
            return []
        return self.spark.read.schema(RUN).parquet(at).collect()

    def _read(self, runs: list) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/epoch={r.epoch}/bucket={r.bucket}" for r in runs])

    def before(self, epoch: int, keys: DataFrame | None = None) -> DataFrame:
        """The state that the batches before ``epoch`` left: one row per key, of the buckets of ``keys`` only."""
        runs = self._runs(epoch)
        if keys is not None and runs:
            touched = {r.b for r in keys.select(self._bucket().alias("b")).distinct().collect()}
            runs = [r for r in runs if r.bucket in touched]
        return self.fold(self._read(runs))

    def add(self, rows: DataFrame, epoch: int, forget=None) -> None:
        """Fold ``rows`` into the state, as batch ``epoch``; again changes nothing.

        Rows for which the condition ``forget`` holds are left out of what is written.
        """
        if _exists(self.spark, f"{self.path}/runs/epoch={epoch}"):
            return
        runs = self._runs(epoch)
        own = self.fold(rows.select(*self.schema.names)).withColumn("bucket", self._bucket())
        sizes = {r.bucket: r.n for r in own.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        taken = []
        for bucket, size in sizes.items():
            for run in sorted((r for r in runs if r.bucket == bucket), key=lambda r: -r.epoch):
                if run.rows > ABSORB * size:
                    break
                taken.append(run)
                size += run.rows
        merged = own.drop("bucket")
        if taken:
            merged = self.fold(merged.unionByName(self._read(taken)))
        if forget is not None:
            merged = merged.filter(~F.coalesce(forget, F.lit(False)))
        dealt = merged.withColumn("bucket", self._bucket()).repartition("bucket")
        publish(dealt, f"{self.path}/data", epoch, ["bucket"])
        kept = [tuple(r) for r in runs if r not in taken]
        if sizes:
            written = self.spark.read.schema(StructType([*self.schema]).add("bucket", IntegerType())).parquet(f"{self.path}/data/epoch={epoch}")
            found = written.groupBy("bucket").agg(F.count("*").alias("n")).collect()
            kept += [(r.bucket, epoch, r.n) for r in found]
        publish(self.spark.createDataFrame(kept, RUN).coalesce(1), f"{self.path}/runs", epoch)
        self._clean(epoch)

    def _clean(self, epoch: int) -> None:
        """Remove runs that only states before the last two batches had: a repeat of this batch reads the one before."""
        gone = {(r.bucket, r.epoch) for r in self._runs(epoch - 1)} - {(r.bucket, r.epoch) for r in self._runs(epoch)}
        for bucket, at in gone:
            remove(self.spark, f"{self.path}/data/epoch={at}/bucket={bucket}")
        remove(self.spark, f"{self.path}/runs/epoch={epoch - 3}")

    def newest(self) -> int:
        """The last batch that was added, or -1."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/runs")
        fs = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(target):
            return -1
        names = [s.getPath().getName() for s in fs.listStatus(target)]
        return max((int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch=")), default=-1)

    def read(self) -> DataFrame:
        """The whole state as of the last batch."""
        return self.before(self.newest() + 1)
