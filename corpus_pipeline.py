"""The corpus pipeline: quality classifier, line dedup, near-duplicate removal, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; each is written as Parquet and read again as the next
one's documents. All but the last return the columns of ``documents``. Stages work on all that their predecessor kept.

Defined results: nulls, empty and long texts, ties, repeated rows and empty tables are treated as the operators say.
Line dedup rewrites ``text`` and ``n_chars``, and keeps a row whose text has become empty. The mix has a row per copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from graphloom.llm.common import shared_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines, and single lines as long as a passage, that repeat earlier ones are taken out of the texts."""
    rows, names = line_dedup.deduped(docs)
    of = dict(zip(docs.columns, names, strict=True))
    if "n_chars" in of:
        size = F.length(of["text"]).cast(docs.schema["n_chars"].dataType)
        rows = rows.withColumn(of["n_chars"], F.when(F.col("n_removed") > 0, size).otherwise(F.col(of["n_chars"])))
    return rows.select(*names).toDF(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dedup.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: each document as often as it is taken."""
    return mixing.emit(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicate removal", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing sources to target weights", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written and read again."""
    folder, docs = shared_folder(spark, "corpus-pipeline"), table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: A trained classifier and MinHash can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
