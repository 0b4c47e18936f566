"""Bounded traversals on one frontier kernel, for many seeds at once.

A level is a join of the frontier with the adjacency, an anti-join with what was visited, and the choice of the first
discoverer; its result is checkpointed, so that lineage stays short and a lost executor costs one level. ``seed`` is a key
of all of it: many questions share the jobs of one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.operators import mesh
from graphloom.operators.lookup import Refused, adjacency
from graphloom.session import cut

#: Frontier rows up to which a level is broadcast against the adjacency.
FRONTIER_BROADCAST = 100_000
MAX_NODES = 250_000
#: Seeds up to which what meets at a node is a list.
LIST = 65_536


class Walkable(NamedTuple):
    """Distinct edges twice, clustered by either end, as a compiled store keeps them: each walk reads the copy it needs."""

    by_src: DataFrame
    by_dst: DataFrame


def steps(edges: DataFrame | Walkable, relations: Sequence[str] | None = None, direction: str = "any") -> DataFrame:
    """The adjacency restricted to relations and to a way of walking: ``with``, ``against`` or ``any``."""
    if not isinstance(edges, Walkable):
        found = adjacency(edges if relations is None else edges.filter(F.col("edge_type").isin(*relations)))
        return found if direction == "any" else found.filter(F.col("direction") == direction)
    ways = []
    for way, held, node, other in (("with", edges.by_src, "src", "dst"), ("against", edges.by_dst, "dst", "src")):
        if direction in (way, "any"):
            kept = held if relations is None else held.filter(F.col("edge_type").isin(*relations))
            ways.append(kept.select(F.col(node).alias("node"), F.col(other).alias("other"), F.col("edge_type").alias("relation"), F.lit(way).alias("direction")))
    return reduce(DataFrame.unionByName, ways)


def reach(seeds: DataFrame, adj: DataFrame, depth: int, first_adj: DataFrame | None = None, target: str | DataFrame | None = None, max_nodes: int | None = None, begun: DataFrame | None = None, ahead: DataFrame | None = None) -> DataFrame:
    """seed, node, hop, via, relation and trail of all nodes within ``depth`` hops; the seed has hop 0.

    Of several discoverers in one level the first counts: by its own order, then outgoing before incoming edges, then by
    neighbour and relation. ``trail`` is that order: a step (against, node, relation) for each hop, so no level is
    numbered in one task. ``first_adj`` holds edges that are only walked from the seed. The loop ends when a level adds
    nothing, once ``target`` (a node, or one of a column ``node``) has been reached from every seed, or once more than
    ``max_nodes`` are held. ``begun`` is what an earlier walk of the same seeds returned: it is gone on with from its last
    level, which is whole, since a walk only stops between levels. ``ahead(node, left)``, as the function of that name gives
    it, keeps the walk to nodes from which a goal is met within ``depth``; whatever it keeps has the hop and trail that it has
    without.
    """
    none = F.lit(None).cast("string")
    goals = seeds.sparkSession.createDataFrame([(target,)], "node string") if isinstance(target, str) else target
    if begun is None:
        start = F.array().cast("array<struct<against:boolean,node:string,relation:string>>")
        visited = frontier = cut(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop"), none.alias("via"), none.alias("relation"), start.alias("trail")))
        held, last = frontier.count(), 0
    else:
        held, last = begun.agg(F.count("*"), F.max("hop")).first()
        visited, frontier = begun, begun.filter(F.col("hop") == last)
    size, n_seeds = frontier.count(), None
    for hop in range((last or 0) + 1, depth + 1):
        walked = adj if hop > 1 or first_adj is None else adj.unionByName(first_adj)
        if ahead is not None:
            near = ahead.filter(F.col("left") <= depth - hop).select(F.col("node").alias("other"))
            walked = walked.join(near, "other", "left_semi")
        left = frontier.select("seed", F.col("node").alias("via"), F.col("trail").alias("before"))
        left = F.broadcast(left) if size <= FRONTIER_BROADCAST else left
        met = walked.join(left, walked["node"] == left["via"]).select("seed", "via", "before", (F.col("direction") == "against").alias("against"), "relation", F.col("other").alias("node"))
        first = met.groupBy("seed", "node").agg(F.min(F.struct("before", "against", "relation", "via")).alias("f")).select("seed", "node", "f.*")
        known = visited.select("seed", "node")
        fresh = first.join(F.broadcast(known) if held <= FRONTIER_BROADCAST else known, ["seed", "node"], "left_anti")
        step = F.struct("against", "node", "relation")
        frontier = cut(fresh.select("seed", "node", F.lit(hop).alias("hop"), "via", "relation", F.concat("before", F.array(step)).alias("trail")))
        size = frontier.count()
        if not size:
            break
        visited, held = visited.unionByName(frontier), held + size
        if max_nodes is not None and held > max_nodes:
            break
        if goals is not None:
            n_seeds = n_seeds or seeds.select("seed").distinct().count()
            if visited.join(goals, "node", "left_semi").select("seed").distinct().count() == n_seeds:
                break
    return visited


def within(seeds: DataFrame, adj: DataFrame, depth: int, first_adj: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """seed, node and hop as ``reach`` has them, without saying by which way: of the nodes at fewer than ``depth`` hops, and of all.

    A level is one aggregation by seed and node, over what was visited and what is met. The last, which is by far the largest and
    which no level goes on from, isn't kept: it is computed by who reads it, and by node, see ``_last_level``.
    """
    inner = whole = cut(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop")).distinct())
    for hop in range(1, depth + 1):
        frontier = whole.filter(F.col("hop") == hop - 1)
        size = frontier.count()
        if not size:
            break
        walked = adj if hop > 1 or first_adj is None else adj.unionByName(first_adj)
        if hop == depth:
            return inner, _last_level(inner, walked, depth, size)
        left = frontier.select("seed", F.col("node").alias("via"))
        left = F.broadcast(left) if size <= FRONTIER_BROADCAST else left
        met = walked.join(left, walked["node"] == left["via"]).select("seed", F.col("other").alias("node"), F.lit(hop).alias("hop"))
        inner = whole = cut(inner.unionByName(met).groupBy("seed", "node").agg(F.min("hop").alias("hop")))
    return inner, whole


def _last_level(inner: DataFrame, walked: DataFrame, depth: int, size: int) -> DataFrame:
    """The pairs of ``inner`` and those one hop on, without moving each: an edge takes along all seeds that stand at its node, in
    lists of bounded length, and these are made distinct where they meet. Nodes where too many meet for a list are aggregated by
    seed and node in the same partition."""
    chunk = F.pmod(F.xxhash64("seed"), F.lit(1 + inner.filter("hop = 0").count() // LIST))
    held = inner.withColumn("chunk", chunk).groupBy("node", "hop", "chunk").agg(F.collect_list("seed").alias("seeds"))
    left = held.filter(F.col("hop") == depth - 1).select(F.col("node").alias("via"), "seeds")
    left = F.broadcast(left) if size <= FRONTIER_BROADCAST else left
    met = walked.join(left, walked["node"] == left["via"]).select(F.col("other").alias("node"), F.lit(depth).alias("hop"), "seeds")
    rows = held.select("node", "hop", "seeds").unionByName(met)
    rows = rows.withColumn("pairs", F.sum(F.size("seeds")).over(Window.partitionBy("node")))
    at = lambda new: F.flatten(F.collect_list(F.when((F.col("hop") == depth) == F.lit(new), F.col("seeds"))))
    # those met before have the hop that they had; of the others, each once
    few = rows.filter(F.col("pairs") <= LIST)
    before = few.filter(F.col("hop") < depth).select(F.explode("seeds").alias("seed"), "node", "hop")
    fresh = few.groupBy("node").agg(F.array_except(at(True), at(False)).alias("seeds")).select(F.explode("seeds").alias("seed"), "node", F.lit(depth).alias("hop"))
    many = rows.filter(F.col("pairs") > LIST).select(F.explode("seeds").alias("seed"), "node", "hop").groupBy("seed", "node").agg(F.min("hop").alias("hop"))
    return before.unionByName(fresh).unionByName(many)


def ahead(goals: DataFrame, adj: DataFrame, depth: int) -> DataFrame:
    """node and left: the least hops from each node to one of ``goals(node)``, of all nodes with at most ``depth``.

    All goals are walked back from together, so a level holds a node once, whatever asks for it.
    """
    found = frontier = cut(goals.select("node").distinct().withColumn("left", F.lit(0)))
    for hop in range(1, depth + 1):
        size = frontier.count()
        if not size:
            break
        at = frontier.select(F.col("node").alias("other"))
        back = adj.join(F.broadcast(at) if size <= FRONTIER_BROADCAST else at, "other", "left_semi").select("node").distinct()
        frontier = cut(back.join(found, "node", "left_anti").withColumn("left", F.lit(hop)))
        found = found.unionByName(frontier)
    return found


def blast(seeds: DataFrame, edges: DataFrame | Walkable, depth: int = 4, relations: Sequence[str] | None = None, vocabulary: DataFrame | None = None) -> DataFrame:
    """Dependents: backward over the relations of class depends, with ``mentions`` from the seed only."""
    walked = relations or mesh.relations_in(vocabulary, "depends")
    return reach(seeds, steps(edges, walked, "against"), depth, steps(edges, ["mentions"], "against"))


def descend(seeds: DataFrame, edges: DataFrame | Walkable, depth: int = 4, relations: Sequence[str] | None = None, vocabulary: DataFrame | None = None) -> DataFrame:
    """What the seed reaches: forward over the relations of class reaches."""
    return reach(seeds, steps(edges, relations or mesh.relations_in(vocabulary, "reaches"), "with"), depth)


def primitives(found: DataFrame, edges: DataFrame, relations: Sequence[str] | None = None, vocabulary: DataFrame | None = None) -> DataFrame:
    """Reached nodes from which no walked edge leaves."""
    walked = relations or mesh.relations_in(vocabulary, "reaches")
    out = edges.filter(F.col("edge_type").isin(*walked)).select(F.col("src").alias("node")).distinct()
    return found.join(out, "node", "left_anti")


def crossings(found: DataFrame) -> DataFrame:
    """Steps of a walk from one corpus to another: how many, and at which hop first."""
    step = found.filter("via IS NOT NULL").select("seed", C.scheme(F.col("via")).alias("from_corpus"), C.scheme(F.col("node")).alias("to_corpus"), "hop")
    return step.filter("from_corpus <> to_corpus").groupBy("seed", "from_corpus", "to_corpus").agg(F.count("*").alias("n"), F.min("hop").alias("first_hop"))


def declined(seeds: DataFrame, edges: DataFrame, admitted: Sequence[str], direction: str) -> DataFrame:
    """Edges at the seed that point the walked way but have a relation that isn't admitted, by relation."""
    end = "src" if direction == "with" else "dst"
    at = edges.select("src", "dst", "edge_type").distinct().join(F.broadcast(seeds.select(F.col("seed").alias(end))), end)
    return at.filter(~F.col("edge_type").isin(*admitted)).groupBy(F.col("edge_type").alias("relation")).agg(F.count("*").alias("n"))


def path_to(edges: DataFrame | Walkable, source: str, target: str, max_depth: int = 6, max_nodes: int | None = None, relations: Sequence[str] | None = None) -> tuple[list[tuple[str, str]], str | None]:
    """(node, relation) steps of a shortest undirected path and None; or no steps and the reason there is none.

    All within ``max_depth`` is searched. A caller's ``max_nodes`` may stop that short; then whether there is a path isn't known,
    and that is no answer: it is refused.
    """
    by_src, by_dst = edges if isinstance(edges, Walkable) else (edges, edges)
    spark = by_src.sparkSession
    ends = by_src.filter(F.col("src").isin(source, target)).select(F.col("src").alias("n")).unionByName(by_dst.filter(F.col("dst").isin(source, target)).select(F.col("dst").alias("n"))).distinct()
    present = {r[0] for r in ends.collect()}  # at most the two ends
    if source not in present or target not in present:
        return [], "seed-absent" if source not in present else "target-absent"
    seeds, adj = spark.createDataFrame([(source,)], "seed string"), steps(edges, relations)
    # whole levels of a hub's neighbours are held only where no path is found and the reason is asked for
    goal = spark.createDataFrame([(target,)], "node string")
    near = None if max_nodes is not None else ahead(goal, adj, max_depth - 1)
    found = cut(reach(seeds, adj, max_depth, target=target, max_nodes=max_nodes, ahead=near))
    if near is not None and frame(found, source, target) is None:
        found = cut(reach(seeds, adj, max_depth))
    steps_, why = outcome(found, source, target, max_depth, max_nodes)
    if why == "max_nodes":
        raise Refused(f"the search from {source} stopped at more than {max_nodes} nodes: whether a path leads to {target} isn't known")
    return steps_, why


def frame(found: DataFrame, source: str, node: str) -> list[tuple[str, str]] | None:
    """(node, relation) steps from the source to a node that a walk of one seed visited, or None."""
    row = found.filter((F.col("seed") == source) & (F.col("node") == node)).select("trail").head(1)
    return [(source, ""), *((s["node"], s["relation"]) for s in row[0]["trail"])] if row else None


def outcome(found: DataFrame, source: str, target: str, max_depth: int, max_nodes: int | None) -> tuple[list[tuple[str, str]], str | None]:
    """What ``path_to`` returns, of a walk that has ended."""
    path = frame(found, source, target)
    if path is not None:
        return path, None
    n, last = found.agg(F.count("*"), F.max("hop")).first()
    return [], "max_nodes" if max_nodes is not None and n > max_nodes else "max_depth" if last is not None and last >= max_depth else None


def doc_endpoints(seeds: DataFrame, edges: DataFrame | Walkable, doc_relations: Sequence[str], depth: int) -> DataFrame:
    """Nearest documenting edges: from nodes at fewer than ``depth`` hops, the least hop per node and relation. Mentions count
    at the seed alone."""
    found = reach(seeds, steps(edges), depth - 1)
    docs = steps(edges, doc_relations)
    met = docs.join(found.select("seed", F.col("node").alias("at"), "hop"), docs["node"] == F.col("at")).select("seed", F.col("other").alias("node"), "relation", (F.col("hop") + 1).alias("hop"))
    met = met.filter((F.col("relation") != "mentions") | (F.col("hop") == 1))
    return met.filter(F.col("node") != F.col("seed")).groupBy("seed", "node", "relation").agg(F.min("hop").alias("hop"))


def activate(seeds: DataFrame, weighted: DataFrame, depth: int, decay: float = 0.5) -> DataFrame:
    """seed, node, hop, energy and the salience of the claiming edge (null for a seed) by spreading activation over ``weighted(node, other, salience)``.

    A node hands decay * energy to its neighbours by their share of its positive salience; parents go by energy, then id;
    the first to hand a node a positive energy claims it, and each node is claimed once.
    """
    positive = F.greatest(F.col("salience"), F.lit(0.0))
    frontier = cut(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop"), F.lit(1.0).alias("energy"), F.lit(None).cast("double").alias("salience")))
    visited, size = frontier, frontier.count()
    for hop in range(1, depth + 1):
        small = (lambda df: F.broadcast(df)) if size <= FRONTIER_BROADCAST else (lambda df: df)
        # only the frontier's edges are read, and their totals are summed before they meet
        at = cut(weighted.join(small(frontier.select("node").distinct()), "node", "left_semi"))
        total = at.groupBy("node").agg(F.sum(positive).alias("total"))
        left = small(frontier.select("seed", F.col("node").alias("parent"), F.col("energy").alias("given")))
        share = positive / F.when(F.col("total") > 0, F.col("total")).otherwise(1.0)
        met = at.join(small(total), "node").withColumn("share", share).join(left, F.col("node") == F.col("parent")).select("seed", "parent", "given", F.col("other").alias("node"), "salience", (F.col("given") * F.lit(decay) * F.col("share")).alias("energy"))
        claim = F.min(F.struct((-F.col("given")).alias("a"), F.col("parent").alias("b"), (-F.col("salience")).alias("c"), F.col("energy").alias("energy")))
        fresh = met.filter("energy > 0").groupBy("seed", "node").agg(claim.alias("f")).join(visited.select("seed", "node"), ["seed", "node"], "left_anti")
        frontier = cut(fresh.select("seed", "node", F.lit(hop).alias("hop"), F.col("f.energy").alias("energy"), (-F.col("f.c")).alias("salience")))
        size = frontier.count()
        if not size:
            break
        visited = visited.unionByName(frontier)
    return visited


def induced(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Distinct edges with both ends among the found nodes."""
    held = found.select("node").distinct()
    inner = edges.select("src", "dst", "edge_type").distinct()
    return inner.join(held.withColumnRenamed("node", "src"), "src", "left_semi").join(held.withColumnRenamed("node", "dst"), "dst", "left_semi")


def bridge(sides: dict[str, DataFrame], seeds: DataFrame, schemes: Sequence[str], depth: int = 8, toward: str | None = None) -> DataFrame:
    """A walk over (side, id) states; ids of a declared scheme that several sides hold are joined by a hop ``join``.

    Seeds and nodes are written ``side|id``. ``sides`` maps a name to its edges. ``toward`` names a side that is asked for: all
    that is met there is found, and of the other sides only what lies on the way, so that a seed's neighbours at home aren't
    all walked.
    """
    tagged, held = None, None
    for side, edges in sides.items():
        put = lambda c, side=side: F.concat(F.lit(side + "|"), F.col(c))
        part = edges.select(put("src").alias("src"), put("dst").alias("dst"), "edge_type")
        ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().filter(C.scheme(F.col("id")).isin(*schemes)).select("id", F.lit(side).alias("side"))
        tagged, held = (part, ids) if tagged is None else (tagged.unionByName(part), held.unionByName(ids))
    chained = held.withColumn("next", F.lead("side").over(Window.partitionBy("id").orderBy("side"))).filter("next IS NOT NULL")
    joins = chained.select(F.concat("side", F.lit("|"), "id").alias("src"), F.concat("next", F.lit("|"), "id").alias("dst"), F.lit("join").alias("edge_type"))
    adj = steps(tagged.unionByName(joins))
    if toward is None:
        return reach(seeds, adj, depth)
    adj = cut(adj)
    return reach(seeds, adj, depth, ahead=ahead(adj.filter(F.col("node").startswith(toward + "|")), adj, depth - 1))
