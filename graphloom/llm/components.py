"""Connected components of a links table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import BROADCAST_ROWS, cut, join_counted


#: Links that a task takes: steps over few links shouldn't write a file for each shuffle partition.
TASK_LINKS = 10_000


def _tasks(n: int) -> int:
    return 1 + -(-n // TASK_LINKS)


def _with_least(edges: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """``edges(u, v)`` with m of ``least(u, m, n)``: broadcast while its ends are few, else with hot hubs salted."""
    return edges.join(F.broadcast(least.drop("n")), "u") if ends <= BROADCAST_ROWS else join_counted(edges, least, "u")


def components(links: DataFrame) -> DataFrame:
    """(key, root) for every end of ``links(a, b)``; the root is the smallest key of the component.

    Each step is two aggregations and two joins over links, whose number never grows beyond the ends; the number of
    rounds grows with the logarithm of the longest chain. Only counts and one checksum a round reach the driver.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    last, n = None, 2 * edges.count()
    edges = edges.coalesce(_tasks(n))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        k = _tasks(n)
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n").coalesce(k)
        # large-star: larger neighbours of u point at the least of u and its neighbours
        large = _with_least(both.filter("v > u"), low, n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct().coalesce(k)
        # small-star: u and its smaller neighbours point at the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).coalesce(k)
        small = _with_least(large, least, n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.filter("u <> v").distinct().coalesce(k))
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if (state["n"], state["s"]) == last:
            break
        n = 2 * state["n"]
        last = (state["n"], state["s"])
    roots = edges.select(F.col("u").alias("key"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct())
