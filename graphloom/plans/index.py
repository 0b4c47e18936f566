"""The estate of a whole index: nodes and edges of all its shards as Parquet, pinned to the catalogue it was made from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import federation, mesh
from graphloom.operators.lookup import Refused
from graphloom.sources import shards

VIEWS = {"nodes": "nodes.json", "adj": "edges.json"}
PROVENANCE = "PROVENANCE.json"


def _current(spark: SparkSession, index: str) -> DataFrame:
    """shard and address: the latest entry of every name in the catalogue."""
    held = federation.catalogue(spark, index)
    if held is None:
        raise Refused(f"no index in {index}")
    return held.groupBy("shard").agg(F.max_by("address", F.struct("at", "address")).alias("address"))


def emit_index(spark: SparkSession, index: str) -> dict[str, str]:
    """Write ``nodes`` and ``adj`` of all shards, each with name, corpus and version; what is fresh isn't written again.

    The corpus is the scheme that the shard's provenance names, else the name before ``==``; the version goes likewise. A
    shard without either file, or with one that isn't JSON, is refused by name before anything is written.
    """
    current = _current(spark, index)
    digest = mesh.rows_digest(current)
    if set(index_state(spark, index, digest).values()) == {"fresh"}:
        return index_state(spark, index, digest)
    wanted = [*VIEWS.values(), PROVENANCE]
    blobs = spark.read.parquet(f"{index}/blobs").filter(F.col("file").isin(*wanted)).join(current, ["shard", "address"], "left_semi")
    files = blobs.select("shard", "file", F.col("content").cast("string").alias("value"))
    good = files.filter(F.col("file").isin(*VIEWS.values()) & F.try_parse_json("value").isNotNull()).groupBy("shard").agg(F.count_distinct("file").alias("n")).filter(F.col("n") == len(VIEWS))
    bad = current.join(good, "shard", "left_anti").orderBy("shard").head(1)
    if bad:
        raise Refused(f"the shard {bad[0]['shard']!r} can't be read")
    told = files.filter(F.col("file") == PROVENANCE).groupBy("shard").agg(F.first("value").alias("told"))
    scheme, version = (F.get_json_object("told", f"$.corpus.{key}") for key in ("scheme", "version"))
    after = F.when(F.col("shard").contains("=="), F.substring_index("shard", "==", -1))
    named = current.join(told, "shard", "left").select("shard", F.coalesce(scheme, F.substring_index("shard", "==", 1)).alias("corpus"), F.coalesce(version, after).alias("version"))
    for view, file in VIEWS.items():
        read = shards.nodes_in if view == "nodes" else shards.edges_in
        rows = read(files.filter(F.col("file") == file).drop("file"))
        kept = rows.filter("id IS NOT NULL") if view == "nodes" else rows
        federation.emit(kept.join(named, "shard").withColumnRenamed("shard", "index_name"), current, f"{index}/estate/{view}")
    return index_state(spark, index, digest)


def index_state(spark: SparkSession, index: str, digest: str | None = None) -> dict[str, str]:
    """absent, pending, stale or fresh for each of the views, against the catalogue as it stands."""
    digest = digest or mesh.rows_digest(_current(spark, index))
    return {view: federation.container_state(spark, f"{index}/estate/{view}", digest) for view in VIEWS}


def open_index(spark: SparkSession, index: str) -> None:
    """Temporary views ``nodes`` and ``adj`` over the whole index; refuses one that isn't fresh, by name and state."""
    for view, state in index_state(spark, index).items():
        if state != "fresh":
            raise Refused(f"{view} of the index is {state}; emit it first")
    for view in VIEWS:
        spark.read.parquet(f"{index}/estate/{view}/rows").createOrReplaceTempView(view)
