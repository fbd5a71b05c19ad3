"""What several operators need: batches of texts in tasks, and links turned into groups."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.session import cut_lineage

SPACES = b" \t\n\r\x0b\x0c"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    return F.concat(F.hex(F.xxhash64(whole)), F.hex(F.xxhash64(F.lit("#"), whole)))


def in_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType, rows: int = 256
) -> DataFrame:
    """``fn`` over Arrow batches of at most ``rows`` rows, so that a task holds few texts at a time."""
    kinds = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    names = kinds.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield fn(batch.slice(at, rows)).select(names)

    return df.mapInArrow(run, kinds)


def worker_state(name: str, make: Callable[[], object]) -> object:
    """What ``make`` returns, once per Python worker: functions travel with each task, their module's globals too."""
    home = sys.modules.setdefault("_tickloom_worker", ModuleType("_tickloom_worker"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b); component is the smallest node reachable.

    Alternates two steps until nothing changes: each node's larger neighbours move to its
    smallest neighbour, then its smaller ones do. Every step is an aggregate and an
    equi-join, so that a node with very many links is reduced before the shuffle and split
    after it. Links to itself and repeats are ignored; rounds grow with the logarithm of the
    longest path. Nodes without a link to another are not returned. Nulls are not nodes.
    """
    edges = cut_lineage(edges.filter("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct())
    seen = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").selectExpr("b a", "m b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a").select("a", "b", "m")
        small = joined.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        edges = cut_lineage(small.selectExpr("e.b a", "e.m b").filter("a <> b").distinct())
        now = _state(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.selectExpr("a node", "b component").union(roots)


def _state(edges: DataFrame) -> tuple:
    bits = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(bits), F.min(bits), F.max(bits)).first())
