"""The estate: projected nodes and adjacency as temporary views for free SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.plans import store


def open_estate(spark: SparkSession, sf_dir: str, by: str = "src") -> None:
    """Views ``nodes`` and ``adj`` over the compiled store, an edge as often as it stands in the tables; ``adj`` has the corpora of both ends, from the ids alone.

    ``adj`` reads the copy that is clustered ``by`` src or dst: of a question that counts by one end, a task then meets each
    end's edges together, and keeps and sends one row for them.
    """
    held = store.table_store(spark, sf_dir)
    held.nodes.drop("scheme").createOrReplaceTempView("nodes")
    edges = held.walk.by_dst if by == "dst" else held.walk.by_src
    each = edges.select("src", "dst", "edge_type", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i")).drop("i")
    each.select("*", C.scheme(F.col("src")).alias("corpus"), C.scheme(F.col("dst")).alias("dst_corpus")).createOrReplaceTempView("adj")


def sql(spark: SparkSession, sf_dir: str, text: str, by: str = "src") -> DataFrame:
    open_estate(spark, sf_dir, by)
    return spark.sql(text)
