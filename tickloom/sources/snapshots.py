"""Bars that loads change in place: every load makes a snapshot, and writes only the files it touches.

A table is a folder of data files and manifests. A manifest lists the files of one snapshot
with the codes and dates they hold; files of a year tile the codes, each from its ``lo`` to the
next one's. What it lists is the folder of a file, as a large one is written in parts by several
tasks. A load finds the files its rows fall into, writes their merged rows anew beside
them, and commits a manifest that has the new files in their place. Files are never changed,
so readers of older snapshots go on, and a load that fails leaves nothing but files that no
manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tickloom.operators.merge import upsert
from tickloom.operators.quality import between_dates
from tickloom.session import cut_lineage, remove

#: Rows of a file, about; one code's year is never cut.
FILE_ROWS = 4_000_000
#: Rows of a file that one task writes, about.
PART_ROWS = 1 << 16
#: A file's folder in the path of one of its parts.
FOLDER = "(data/v=[^/]+/year=[^/]+/piece=[^/]+)"
ENTRY = "file string, year int, lo string, rows long, min_code string, max_code string, min_date date, max_date date"


class Conflict(RuntimeError):
    """Another load committed first; nothing of this one is visible. Run it again."""


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def versions(spark: SparkSession, path: str) -> list[int]:
    """The committed snapshots that are still there, oldest first."""
    fs, folder = _files(spark, f"{path}/commits")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def _read_commit(spark: SparkSession, path: str, version: int | None) -> dict | None:
    """What a commit says, of the newest one by default; None for a table that has none yet."""
    if version is None:
        version = max(versions(spark, path), default=None)
        if version is None:
            return None
    # One short line.
    text = "".join(r.value for r in spark.read.text(f"{path}/commits/{version:012d}.json").collect())
    return {**json.loads(text), "version": version}


def _write_commit(spark: SparkSession, path: str, version: int, says: dict) -> None:
    """Whoever creates the version's file first has committed it."""
    fs, target = _files(spark, f"{path}/commits/{version:012d}.json")
    try:
        out = fs.create(target, False)
    except Exception as e:
        if fs.exists(target):
            raise Conflict(f"version {version} of {path} was committed by another load") from e
        raise
    out.write(bytearray(json.dumps(says).encode()))
    out.close()


def _manifest(spark: SparkSession, path: str, commit: dict | None) -> DataFrame:
    if commit is None:
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).parquet(f"{path}/{commit['manifest']}")


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The files of a snapshot, the newest by default, with the codes and dates they hold."""
    return _manifest(spark, path, _read_commit(spark, path, version))


def _open(spark: SparkSession, path: str, schema: StructType, names: Sequence[str]) -> DataFrame:
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{n}" for n in names])


def read(
    spark: SparkSession, path: str, version: int | None = None, codes: Sequence | None = None, start=None, end=None
) -> DataFrame:
    """The bars of a snapshot, the newest by default; only files that can hold the codes and dates are opened.

    ``codes`` is a short list. A table without a snapshot is an error.
    """
    commit = _read_commit(spark, path, version)
    if commit is None:
        raise ValueError(f"{path} has no snapshot")
    wanted = _manifest(spark, path, commit)
    if start is not None:
        wanted = wanted.filter(F.col("max_date") >= F.lit(start).cast("date"))
    if end is not None:
        wanted = wanted.filter(F.col("min_date") <= F.lit(end).cast("date"))
    if codes is not None:
        held = [F.lit(str(c)).between(F.col("min_code"), F.col("max_code")) for c in codes]
        wanted = wanted.filter(reduce(lambda a, b: a | b, held, F.lit(False)))
    names = [r.file for r in wanted.select("file").orderBy("file").collect()]
    out = between_dates(_open(spark, path, StructType.fromJson(commit["schema"]), names), start, end)
    return out if codes is None else out.filter(F.col("code").isin(list(codes)))


def _place(keys: DataFrame, groups: DataFrame) -> DataFrame:
    """``keys`` (year, c) with ``lo`` of the group of files that covers the code; null in a year without files.

    A running last over codes and group starts, sorted by year: no pair is formed.
    """
    marks = groups.select("year", F.col("lo").alias("c"), F.lit(0).alias("k"), "lo")
    both = keys.select("year", "c", F.lit(1).alias("k"), F.lit(None).cast("string").alias("lo")).unionByName(marks)
    upto = Window.partitionBy("year").orderBy("c", "k").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("lo", F.last("lo", ignorenulls=True).over(upto)).filter("k = 1").select("year", "c", "lo")


def _cut(days: DataFrame, file_rows: int) -> DataFrame:
    """One row per code and year of ``days`` (year, __lo, c, date): the piece its rows go into, numbered in a year.

    Codes of every group are cut in pieces of about ``file_rows`` rows, a group of that many rows at most stays one;
    ``__part`` cuts a piece for the tasks that write it. Also has the rows ``n`` and the first and last date.
    """
    days = days.repartition("year", "__lo", "c").distinct()
    counts = days.groupBy("year", "__lo", "c").agg(
        F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last")
    )
    group = Window.partitionBy("year", "__lo")
    before = F.sum("n").over(group.orderBy("c").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    counts = counts.withColumn("before", before)
    counts = counts.withColumns({"at": F.floor(F.col("before") / file_rows), "__part": F.floor(F.col("before") / PART_ROWS)})
    first = F.when(F.col("at") == 0, F.col("__lo")).otherwise(F.min("c").over(Window.partitionBy("year", "__lo", "at")))
    counts = counts.withColumn("lo", first)
    return counts.withColumn("piece", F.dense_rank().over(Window.partitionBy("year").orderBy("lo"))).drop("__lo", "at", "before")


def change(
    rows: DataFrame, path: str, keep: str = "new", whole_codes: bool = False, file_rows: int = FILE_ROWS, base: int | None = None
) -> int:
    """Upsert ``rows`` (code, date, ...) into the table and commit; returns the snapshot's version.

    Stored rows of the same code and date give way, or stay with ``keep="old"``; with
    ``whole_codes`` all stored rows of the codes in ``rows`` give way. Only files that hold
    such rows, or whose codes and year new ones fall into, are read and written. ``base`` is
    the version the rows were made from (the newest by default): if another was committed
    since, :class:`Conflict` is raised and nothing changes. New columns are null in stored
    rows. Rows without code or date make the load fail. No rows make no snapshot, except the
    first. The first load creates the table.
    """
    spark = rows.sparkSession
    commit = _read_commit(spark, path, base)
    version = commit["version"] if commit else 0
    known = F.col("code").isNotNull() & F.col("date").isNotNull()
    rows = rows.withColumn("date", F.when(known, F.col("date")).otherwise(F.raise_error(F.lit("a bar has a code and a date")).cast("date")))
    rows = cut_lineage(rows)
    schema = StructType.fromJson(commit["schema"]) if commit else StructType()
    schema = StructType([*schema, *[f for f in rows.schema if f.name not in schema.names]])
    listed = _manifest(spark, path, commit)
    groups = listed.select("year", "lo").distinct()
    c = F.col("code").cast("string").alias("c")
    keys = rows.select(F.year("date").alias("year"), c).distinct()
    if commit and keys.isEmpty():
        return version
    if whole_codes:
        # A year of stored files is a row here; there are some dozens.
        keys = keys.unionByName(keys.select("c").distinct().crossJoin(F.broadcast(groups.select("year").distinct())), True).distinct()
    placed = cut_lineage(_place(keys, groups))
    touched = placed.filter("lo IS NOT NULL").select("year", "lo").distinct()
    files = listed.join(touched, ["year", "lo"], "left_semi")
    names = [r.file for r in files.select("file").collect()]

    at = {"year": F.year("date"), "c": c}
    lo = placed.select("year", "c", F.coalesce("lo", F.lit("")).alias("__lo"))
    days = rows.select(F.year("date").alias("year"), c, "date").join(lo, ["year", "c"]).select("year", "__lo", "c", "date")
    old = _open(spark, path, schema, names)
    stays = lambda df: df.join(rows.select("code").distinct(), "code", "left_anti") if whole_codes else df
    if names:
        home = files.select(F.regexp_extract("file", FOLDER, 1).alias("__file"), F.col("lo").alias("__lo")).distinct()
        own = F.regexp_extract(F.col("_metadata.file_path"), f"{FOLDER}/[^/]+$", 1)
        held = stays(old.select("code", "date", own.alias("__file")))
        days = days.unionByName(held.join(home, "__file").select(F.year("date").alias("year"), "__lo", c, "date"))
    # Where rows go follows from codes and dates alone, so that whole rows are only dealt to who writes them.
    pieces = cut_lineage(_cut(days, file_rows))

    folder = f"data/v={version + 1}-{uuid.uuid4().hex[:8]}"
    place = ["year", "piece", "__part"]
    whose = pieces.select("year", "c", "piece", "__part")
    deal = lambda both: both.withColumns(at).join(whose, ["year", "c"]).drop("c").repartition(*place)
    merged = upsert(stays(old), rows, [*place, "code", "date"], keep, deal=deal)
    dealt = merged.sortWithinPartitions(*place, "code", "date").select(*schema.names, "year", "piece")
    dealt.write.partitionBy("year", "piece").option("compression", "zstd").parquet(f"{path}/{folder}")
    name = f"manifests/v={version + 1}-{uuid.uuid4().hex[:8]}"
    listed.join(touched, ["year", "lo"], "left_anti").unionByName(_entries(pieces, folder)).write.parquet(f"{path}/{name}")
    _write_commit(spark, path, version + 1, {"manifest": name, "schema": schema.jsonValue()})
    return version + 1


def _entries(pieces: DataFrame, folder: str) -> DataFrame:
    """Manifest rows of the files written to ``folder``: all they say is known before."""
    file = F.concat(F.lit(f"{folder}/year="), F.col("year").cast("string"), F.lit("/piece="), F.col("piece").cast("string"))
    return pieces.groupBy(file.alias("file"), "year", "lo").agg(
        F.sum("n").alias("rows"), F.min("c").alias("min_code"), F.max("c").alias("max_code"),
        F.min("first").alias("min_date"), F.max("last").alias("max_date"),
    )


def expire(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Forget all but the last ``keep`` snapshots and delete the files only they name; returns how many files went."""
    every = versions(spark, path)
    old, new = every[:-keep], every[-keep:]
    if not old or keep < 1:
        return 0
    union = lambda some: reduce(DataFrame.unionByName, [manifest(spark, path, x) for x in some])
    names = union(old).select("file").distinct().join(union(new).select("file").distinct(), "file", "left_anti")
    names = [r.file for r in names.collect()]
    for version in old:
        commit = _read_commit(spark, path, version)
        remove(spark, f"{path}/commits/{version:012d}.json")
        remove(spark, f"{path}/{commit['manifest']}")
    for name in names:
        remove(spark, f"{path}/{name}")
    return len(names)
