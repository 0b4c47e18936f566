"""Containers: the Parquet of each lane, with what it was written from, and those that are still to be written.

A lane's container is ``fresh`` if its receipt names the inputs as they are, ``stale`` if they moved since, ``pending`` if it
was declared and left for later, and ``absent`` without a receipt or without rows. What isn't fresh is written by one job for
all lanes, and its receipts come after its rows, so that a job that fails leaves every state as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.lookup import Refused
from graphloom.plans.laned import Laned
from graphloom.plans.store import _read

RECEIPT = "lane string, digest string, folder string, pending boolean, at timestamp, number long"


def receipts(spark: SparkSession, home: str) -> DataFrame:
    """The last receipt of every lane."""
    if _read(spark, f"{home}/receipts") is None:
        return spark.createDataFrame([], RECEIPT)
    last = F.max_by(F.struct("digest", "folder", "pending", "at"), F.struct("number", "at")).alias("r")
    return spark.read.schema(RECEIPT).parquet(f"{home}/receipts").groupBy("lane").agg(last, F.max("number").alias("number")).select("lane", "r.*", "number")


def states(spark: SparkSession, home: str, inputs: DataFrame) -> DataFrame:
    """lane, state and folder for ``inputs(lane, digest)``; a null digest stands for a lane without inputs, which is absent."""
    told = receipts(spark, home).select("lane", F.col("digest").alias("written"), "folder", "pending")
    state = F.when(F.col("written").isNull() & ~F.coalesce("pending", F.lit(False)) | F.col("digest").isNull(), "absent").when(F.col("pending"), "pending").when(F.col("written") == F.col("digest"), "fresh").otherwise("stale")
    return inputs.select("lane", "digest").join(told, "lane", "left").select("lane", "digest", state.alias("state"), "folder")


def _tell(spark: SparkSession, home: str, rows: DataFrame) -> None:
    number = receipts(spark, home).agg(F.coalesce(F.max("number"), F.lit(0)).alias("n")).first()["n"] + 1
    told = rows.select("lane", "digest", "folder", "pending", F.current_timestamp().alias("at"), F.lit(number).cast("long").alias("number"))
    told.coalesce(1).write.mode("append").parquet(f"{home}/receipts")  # a row per lane


def defer(spark: SparkSession, home: str, lanes: Sequence[str]) -> None:
    """Declare containers without writing them; what stood there no longer counts."""
    none = F.lit(None).cast("string")
    _tell(spark, home, spark.createDataFrame([(lane,) for lane in lanes], "lane string").select("lane", none.alias("digest"), none.alias("folder"), F.lit(True).alias("pending")))


def _write(spark: SparkSession, home: str, todo: DataFrame, nodes: DataFrame, edges: DataFrame) -> list[str]:
    """Write the containers of ``todo(lane, digest)`` in one job, then their receipts."""
    lanes = [r["lane"] for r in todo.select("lane").orderBy("lane").collect()]  # of a roster
    if not lanes:
        return []
    folder = f"{home}/rows/{uuid.uuid4().hex}"
    none = F.lit(None).cast("string")
    held = nodes.filter(F.col("lane").isin(*lanes)).select("lane", F.lit("nodes").alias("part"), "id", none.alias("src"), none.alias("dst"), none.alias("edge_type"))
    lined = edges.filter(F.col("lane").isin(*lanes)).select("lane", F.lit("adjacency").alias("part"), none.alias("id"), "src", "dst", "edge_type")
    held.unionByName(lined).withColumn("of", F.col("lane")).write.partitionBy("of", "part").parquet(folder)
    _tell(spark, home, todo.select("lane", "digest", F.lit(folder).alias("folder"), F.lit(False).alias("pending")))
    return lanes


def emit(spark: SparkSession, home: str, inputs: DataFrame, nodes: DataFrame, edges: DataFrame, lanes: Sequence[str]) -> list[str]:
    """Write the containers of some lanes, fresh or not; refuses a lane without inputs."""
    asked = states(spark, home, inputs).filter(F.col("lane").isin(*lanes))
    empty = asked.filter("digest IS NULL").orderBy("lane").head(1)
    if empty:
        raise Refused(f"lane {empty[0]['lane']!r} has no shard")
    return _write(spark, home, asked, nodes, edges)


def emit_missing(spark: SparkSession, home: str, inputs: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[list[str], int]:
    """Write all that isn't fresh and has inputs; the lanes written, and how many stood fresh."""
    held = states(spark, home, inputs).collect()  # a row per lane
    todo = [(r["lane"], r["digest"]) for r in held if r["state"] != "fresh" and r["digest"] is not None]
    written = _write(spark, home, spark.createDataFrame(todo, "lane string, digest string"), nodes, edges)
    return written, sum(r["state"] == "fresh" for r in held)


def rows(spark: SparkSession, home: str, lane: str, part: str) -> DataFrame:
    """``nodes`` or ``adjacency`` of a lane's container; refuses one that isn't written."""
    last = receipts(spark, home).filter((F.col("lane") == lane) & ~F.col("pending")).head(1)
    if not last:
        raise Refused(f"the container of {lane!r} isn't written")
    names = {"nodes": ["lane", "id"], "adjacency": ["lane", "src", "dst", "edge_type"]}[part]
    found = _read(spark, f"{last[0]['folder']}/of={lane}/part={part}", "lane string, id string, src string, dst string, edge_type string")
    return found.select(*names) if found is not None else spark.createDataFrame([], ", ".join(f"{n} string" for n in names))


def inputs_of(held: Laned) -> DataFrame:
    """lane and digest of what a laned store was compiled from."""
    return held.spark.createDataFrame([(lane, held.manifest["digests"].get(lane)) for lane in held.manifest["roster"]], "lane string, digest string")
