"""What a lane's inputs are by their bytes, and what no longer fits them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.plans import claims

#: Files of a shard; the sidecar may be missing, which has a digest of its own. Fixed values.
REQUIRED, SIDECAR, MISSING = ("nodes.json", "edges.json"), "wormholes.json", "absent"


def lane_digests(spark: SparkSession, lanes: Mapping[str, str], required: Sequence[str] = REQUIRED, sidecar: str | None = SIDECAR) -> DataFrame:
    """lane and digest of the folders of ``lanes``: the first 16 hexadecimal digits of the sha256 of each of its files' own.

    The digest is null for a lane that lacks a required file. Files are read and hashed by the tasks, one file a row.
    """
    names = [*required, *([sidecar] if sidecar else [])]
    files = [(lane, f"{folder.rstrip('/')}/{name}", name) for lane, folder in lanes.items() for name in names]
    files = [(*f, claims.stands(spark, f[1])) for f in files]
    roster, present = spark.createDataFrame(files, "lane string, at string, name string, there boolean"), [f[1] for f in files if f[3]]
    read = spark.read.format("binaryFile").load(present) if present else spark.createDataFrame([], "path string, content binary")
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "^[a-z0-9+.-]+:/*", "/"), "//+", "/")  # noqa: E731  schemes of paths vary
    own = read.select(plain(F.col("path")).alias("path"), F.substring(F.sha2("content", 256), 1, 16).alias("digest"))
    joined = roster.withColumn("path", plain(F.col("at"))).join(own, "path", "left")
    empty = F.substring(F.sha2(F.lit(""), 256), 1, 16)  # files without a byte give no row
    filled = joined.withColumn("digest", F.coalesce("digest", F.when(F.col("there"), empty).when(F.col("name") == F.lit(sidecar), MISSING)))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "digest"))), lambda x: F.concat(x["name"], F.lit(":"), x["digest"])), "\n")
    whole = F.when(F.count("digest") == F.count("*"), F.substring(F.sha2(parts, 256), 1, 16))
    return filled.groupBy("lane").agg(whole.alias("digest"))


def moved(served: DataFrame, live: DataFrame) -> DataFrame:
    """check, subject and level: lanes of ``served(lane, digest)`` whose inputs are others now (RED), or can't be told (lost)."""
    both = served.select("lane", F.col("digest").alias("was"), F.lit(True).alias("known")).join(live.select("lane", F.col("digest").alias("now")), "lane", "full")
    level = F.when(F.col("now").isNull(), "COULD-NOT-TELL").when(~F.col("was").eqNullSafe(F.col("now")), "RED")
    subject = F.concat("lane", F.when(F.col("now").isNull(), ": no shard").when(F.col("known").isNull(), ": not in the store").otherwise(": its shard moved"))
    return both.select(F.lit("store freshness").alias("check"), subject.alias("subject"), level.alias("level")).filter("level IS NOT NULL")


def drifted(pages: DataFrame, heads: DataFrame) -> DataFrame:
    """check, subject and level: journals whose last page isn't at ``heads(journal, cursor)``; without pages or a head it
    can't be told."""
    last = pages.groupBy("journal").agg(F.max_by("cursor", "seq").alias("at"))
    both = last.join(heads.select("journal", F.col("cursor").alias("head")), "journal", "full")
    level = F.when(F.col("at").isNull() | F.col("head").isNull(), "COULD-NOT-TELL").when(F.col("at") != F.col("head"), "RED")
    subject = F.concat("journal", F.lit(": "), F.coalesce("at", F.lit("none")), F.lit(" is not "), F.coalesce("head", F.lit("none")))
    return both.select(F.lit("cursor drift").alias("check"), subject.alias("subject"), level.alias("level")).filter("level IS NOT NULL")


def staleness(built: DataFrame, heads: DataFrame, at: str = "ts") -> DataFrame:
    """lane, built, head, behind (seconds) and stale of ``built(lane, ts)`` against the last change of its sources
    ``heads(lane, ts)``; a lane without a head is not stale, and behind is null."""
    newest = heads.groupBy("lane").agg(F.max(at).alias("head"))
    joined = built.select("lane", F.col(at).alias("built")).join(newest, "lane", "left")
    behind = F.when(F.col("head").isNotNull(), F.greatest(F.col("head").cast("long") - F.col("built").cast("long"), F.lit(0)))
    return joined.withColumn("behind", behind).withColumn("stale", F.coalesce(F.col("behind") > 0, F.lit(False)))


def history_gaps(commits: DataFrame, windows: DataFrame, key: str = "journal") -> DataFrame:
    """check, subject and level: captures of ``windows(key, seq, low, high)`` that no commit of ``commits(key, ts)`` falls into;
    such a window says that its history input is missing commits, or that nothing happened, so it can't be told."""
    order = Window.partitionBy(key).orderBy("at", "mark")
    marks = commits.select(key, F.col("ts").alias("at"), F.lit(0).alias("mark"), F.lit(None).cast("long").alias("seq")).unionByName(windows.select(key, F.col("high").alias("at"), F.lit(1).alias("mark"), "seq"))
    counted = marks.withColumn("n", F.sum((F.col("mark") == 0).cast("int")).over(order)).filter("mark = 1")
    bare = counted.withColumn("before", F.lag("n").over(Window.partitionBy(key).orderBy("at"))).filter("before IS NOT NULL AND n = before")
    return bare.select(F.lit("history").alias("check"), F.concat_ws("#", key, "seq").alias("subject"), F.lit("COULD-NOT-TELL").alias("level"))
