"""Bridges between tenants: which schemes may be crossed, under which releases, and walks across."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.operators import traverse
from graphloom.operators.lookup import Refused

UNPINNED = "unpinned"


def joins(sides: Mapping[str, DataFrame], pins: DataFrame, schemes: Sequence[str]) -> DataFrame:
    """scheme, side, nodes, release and skew, a row per scheme and side.

    ``sides`` maps a name to its nodes (``id``); ``pins(side, scheme, version)`` may pin a scheme more than once a side, which
    reads ``a | b``. ``skew`` is set where sides pin different releases; an unpinned side differs from none.
    """
    spark = pins.sparkSession
    held = None
    for side, nodes in sides.items():
        part = nodes.select(F.lit(side).alias("side"), C.scheme(F.col("id")).alias("scheme"), "id").filter(F.col("scheme").isin(*schemes))
        held = part if held is None else held.unionByName(part)
    asked = spark.createDataFrame([(side, s) for side in sides for s in schemes], "side string, scheme string")
    n = held.groupBy("side", "scheme").agg(F.count_distinct("id").alias("nodes"))
    pinned = pins.filter("version IS NOT NULL").groupBy("side", "scheme").agg(F.array_join(F.array_sort(F.collect_set("version")), " | ").alias("release"))
    rows = asked.join(n, ["side", "scheme"], "left").join(pinned, ["side", "scheme"], "left")
    rows = rows.select("scheme", "side", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("release", F.lit(UNPINNED)).alias("release"))
    skewed = rows.filter(F.col("release") != UNPINNED).groupBy("scheme").agg((F.count_distinct("release") > 1).alias("skew"))
    return rows.join(skewed, "scheme", "left").withColumn("skew", F.coalesce("skew", F.lit(False)))


def verified(sides: Mapping[str, DataFrame], pins: DataFrame, schemes: Sequence[str], allow_skew: bool = False) -> DataFrame:
    """``joins``, or a refusal: without a scheme, with what isn't one, with a side that holds none of its nodes, and with
    releases that differ unless skew is allowed."""
    if not schemes:
        raise Refused("no scheme declared: a bridge crosses only on declared ones")
    for s in schemes:
        if not s or "://" in s or "/" in s:
            raise Refused(f"{s!r} is no scheme")
    rows = joins(sides, pins, schemes).cache()
    try:
        found = rows.orderBy("scheme", "side").collect()  # schemes times sides, as they were named
    finally:
        rows.unpersist()
    for s in schemes:
        of = [r for r in found if r["scheme"] == s]
        missing = [r["side"] for r in of if not r["nodes"]]
        if missing:
            raise Refused(f"no node of {s}:// in {', '.join(missing)}")
        if of[0]["skew"] and not allow_skew:
            raise Refused(f"{s} is pinned to different releases: " + ", ".join(f"{r['side']} {r['release']}" for r in of))
    return pins.sparkSession.createDataFrame([tuple(r) for r in found], "scheme string, side string, nodes long, release string, skew boolean")


def cross(sides: Mapping[str, tuple[DataFrame, DataFrame]], pins: DataFrame, schemes: Sequence[str], seeds: DataFrame, depth: int = 8, allow_skew: bool = False, toward: str | None = None) -> DataFrame:
    """The walk of ``traverse.bridge`` over ``sides`` (name to nodes and edges), only on schemes that are verified; with
    ``toward``, to one side.

    ``skew`` marks the hops that cross on a scheme whose releases differ, and what was reached through one.
    """
    told = verified({side: nodes for side, (nodes, _) in sides.items()}, pins, schemes, allow_skew)
    skewed = [r[0] for r in told.filter("skew").select("scheme").distinct().orderBy("scheme").collect()]  # of the schemes named
    found = traverse.bridge({side: edges for side, (_, edges) in sides.items()}, seeds, schemes, depth, toward)
    crossed = lambda s: (s["relation"] == "join") & C.scheme(F.substring_index(s["node"], "|", -1)).isin(*skewed)
    return found.withColumn("skew", F.exists("trail", crossed) if skewed else F.lit(False))
