"""A training corpus from documents, stage by stage.

Quality classifier, line deduplication, near-duplicate removal, benchmark decontamination,
packing. Every stage reads all that the one before it kept, stored as Parquet.

All stages take null and empty texts, texts of any length, null and repeated ids, repeated
rows, and columns besides those of documents, which pass through whatever their names; an
empty table gives an empty one. Rows that repeat an id and a text share their fate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontaminate, line_dedup, packing, quality_knn, simhash
from tickloom.llm.shared import text_key
from tickloom.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject: those that score 0.5 or more.

    A null text is scored as an empty one. Labels of held-out documents are not learned from,
    and without any label all documents stay.
    """
    return quality_knn.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that come earlier in the corpus, n_chars counted anew.

    Earlier is by id (null first), then by text and place, so that one occurrence of each line
    stays. A document stays though all its lines go; a null text stays null, and so its count.
    """
    left = line_dedup.drop_lines(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near-duplicates.

    Near means that four fifths of the five-word shingles are the same, or a chain of such
    documents; the smallest id is null where there is one. Texts without a word are no
    near-duplicates of each other and stay. An id that is repeated with other texts stands for
    several documents; rows that repeat both stay or go together.
    """
    own = docs.withColumn("__key", F.struct("doc_id", text_key(F.col("text")).alias("body")))
    found = simhash.near_duplicates(own.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")), key="__key")
    extra = found.filter("component < __key").select(F.col("__key").alias("__extra")).distinct()
    same = F.col("__key.doc_id").eqNullSafe(F.col("__extra.doc_id")) & (F.col("__key.body") == F.col("__extra.body"))
    return own.join(extra, same, "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    A passage is twelve words of an item, or all words of one of five to eleven, of which four
    fifths agree. Null and empty texts hold none.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their sequences and offsets.

    One row per piece: every document has one at least, null and empty texts a piece of the
    end token alone. Other columns are left out.
    """
    return packing.pack_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("line dedup", line_deduplication),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: The classifier and the genetic algorithm have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
