"""The shape of a corpus: a partition into arms, its comparison with a curated one, scenes, clusters and sections.

Rows are counted in Spark. Units (dotted prefixes) are few whatever the size of the corpus; only they reach the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.operators import mesh
from graphloom.operators.lookup import Refused, triples
from graphloom.session import cut

#: Defaults of a proposal; fixed values.
FLOOR, OWNED, CLIENT, REST = 5, 2 / 3, 1 / 3, "EDGE"
MAX_DEPTH = 4
#: Units that a proposal may bring to the driver.
MOST_UNITS = 200_000


@dataclass
class Units:
    """Weighted edges between units, held on the driver."""

    weight: dict[tuple[str, str], int]
    names: set[str]
    root: str

    @cached_property
    def out(self) -> dict[str, dict[str, int]]:
        found: dict[str, dict[str, int]] = {u: {} for u in self.names}
        for (a, b), w in self.weight.items():
            found[a][b] = w
        return found

    @cached_property
    def into(self) -> dict[str, dict[str, int]]:
        found: dict[str, dict[str, int]] = {u: {} for u in self.names}
        for (a, b), w in self.weight.items():
            found[b][a] = w
        return found


def units(nodes: DataFrame, edges: DataFrame, depth: int, relations: tuple[str, ...]) -> Units:
    """The unit graph of ``nodes(id, dotted, role)`` without test nodes, collected once its size is known to be small."""
    own = nodes.filter("dotted IS NOT NULL AND coalesce(role, '') <> 'test'") if "role" in nodes.columns else nodes
    names = own.select(C.dotted_prefix(F.col("dotted"), depth).alias("u")).distinct()
    if names.count() > MOST_UNITS:
        raise Refused(f"more than {MOST_UNITS} units at depth {depth}: cut less deep")
    found = {r["u"] for r in names.collect()}
    weight = {(r["from_unit"], r["to_unit"]): r["weight"] for r in mesh.unit_graph(own, triples(edges), depth, relations).collect()}
    root = min(found, key=lambda u: (u.count("."), u)).split(".")[0] if found else ""
    return Units(weight, found, root)


@dataclass
class Proposal:
    """arm -> units in the order they joined, arm -> crown, unit -> role, and the floor's name if there is one."""

    arms: dict[str, list[str]] = field(default_factory=dict)
    crowns: dict[str, str] = field(default_factory=dict)
    roles: dict[str, str] = field(default_factory=dict)
    floor_arm: str | None = None
    rest: str = REST

    def arm_of(self) -> dict[str, str]:
        return {u: self.rest for u in self.roles} | {u: a for a, us in self.arms.items() for u in us}


class _Settlement:
    """Placed units and, for every other, how much of its traffic each arm has; kept up to date as units are placed."""

    def __init__(self, g: Units):
        self.g, self.plan = g, Proposal()
        self.fan_in = {u: sum(g.into[u].values()) for u in g.names}
        self.fan_out = {u: sum(g.out[u].values()) for u in g.names}
        self.used_by: dict[str, dict[str, int]] = {u: {} for u in g.names}
        self.uses: dict[str, dict[str, int]] = {u: {} for u in g.names}

    def name(self, unit: str) -> str:
        base = re.sub(r"[^A-Za-z0-9_]+", "_", unit.rsplit(".", 1)[-1]).strip("_").upper() or "ARM"
        tries = [base, *(f"{base}{n}" for n in range(2, len(self.plan.crowns) + 3))]
        return next(t for t in tries if t not in self.plan.crowns)

    def found(self, unit: str) -> str:
        arm = self.name(unit)
        self.plan.crowns[arm], self.plan.arms[arm] = unit, []
        return arm

    def place(self, unit: str, arm: str) -> None:
        self.plan.arms[arm].append(unit)
        for other, w in self.g.out[unit].items():
            self.used_by[other][arm] = self.used_by[other].get(arm, 0) + w
        for other, w in self.g.into[unit].items():
            self.uses[other][arm] = self.uses[other].get(arm, 0) + w

    def strongest(self, counts: dict[str, int]) -> str | None:
        rank = {a: i for i, a in enumerate(self.plan.crowns)}
        return max(counts, key=lambda a: (counts[a], -rank[a]), default=None)


def propose(g: Units, arms: int | None = None, floor: int = FLOOR, owned: float = OWNED, client: float = CLIENT, rest: str = REST) -> Proposal:
    """Units dealt to arms.

    The root (facade) and units with less traffic than ``floor`` (edge) stay out. Of the others, those that use more than
    they are used are orchestrators, the rest foundations. Orchestrators with at least half the leader's fan-out, or the
    first ``arms - 1``, are crowns. Then rounds: an orchestrator joins the arm that uses it most, else the one it spends
    ``client`` of its fan-out on, else founds its own, else leans on the floor. A foundation goes to an arm with ``owned`` of its
    fan-in, else to the floor, whose crown is the first such. Units wait while partners of theirs are open, until
    a round moves nothing; what nothing touches goes to ``rest``.
    """
    for wrong, what in ((arms is not None and arms < 2, "arms is 2 or more"), (floor < 0, "floor is 0 or more"), (not 0.5 < owned <= 1, "owned is in (0.5, 1]"), (not 0 < client <= 1, "client is in (0, 1]")):
        if wrong:
            raise Refused(what)
    s = _Settlement(g)
    plan, fan_in, fan_out = s.plan, s.fan_in, s.fan_out
    plan.rest = rest
    traffic = {u: fan_in[u] + fan_out[u] for u in g.names}
    for u in g.names:
        plan.roles[u] = "facade" if u == g.root else "edge" if traffic[u] < floor else "orchestrator" if fan_out[u] > fan_in[u] else "foundation"
    leaders = sorted((u for u in g.names if plan.roles[u] == "orchestrator"), key=lambda u: (-fan_out[u], u))
    if not leaders:
        raise Refused("no unit uses more than it is used: cut deeper")
    for u in leaders[: arms - 1] if arms else [u for u in leaders if 2 * fan_out[u] >= fan_out[leaders[0]]]:
        s.place(u, s.found(u))
    placed = {u for us in plan.arms.values() for u in us}
    climbing = sorted((u for u in leaders if u not in placed), key=lambda u: (-traffic[u], u))
    resting = sorted((u for u in g.names if plan.roles[u] == "foundation"), key=lambda u: (-fan_in[u], u))
    forced = False
    while climbing or resting:
        before = len(climbing) + len(resting)
        open_ = {*climbing, *resting}
        for u in list(climbing):
            arm = s.strongest(s.used_by[u])
            if arm is None:
                spent = {a: w for a, w in s.uses[u].items() if a != plan.floor_arm}
                arm = s.strongest(spent)
                if arm is None and not forced and any(v in open_ for v in g.out[u]):
                    continue
                if arm is not None and arms is None and spent[arm] < client * fan_out[u]:
                    arm = s.found(u)
                elif arm is None and s.uses[u]:
                    arm = plan.floor_arm
            if arm is not None:
                s.place(u, arm)
                climbing.remove(u)
                open_.discard(u)
        held_back = False
        for u in list(resting):
            arm = s.strongest(s.used_by[u])
            if arm is None or not fan_in[u] or s.used_by[u][arm] < owned * fan_in[u]:
                if not forced and (held_back or any(v in climbing for v in g.into[u])):
                    held_back = True
                    continue
                plan.floor_arm = plan.floor_arm or s.found(u)
                arm = plan.floor_arm
            s.place(u, arm)
            resting.remove(u)
        moved = len(climbing) + len(resting) < before
        if forced and not moved:
            break
        forced = not moved
    return plan


def shape(nodes: DataFrame, edges: DataFrame, relations: tuple[str, ...], depth: int = 2, max_depth: int = MAX_DEPTH, **options) -> tuple[int, Proposal]:
    """The first depth from ``depth`` on at which the corpus has a shape; wrong options aren't tried again."""
    propose(Units({("a", "b"): 9}, {"a", "b"}, ""), **options)  # options are judged before anything is read
    for d in range(depth, max_depth + 1):
        try:
            return d, propose(units(nodes, edges, d, relations), **options)
        except Refused as reason:
            last = reason
    raise last


def diff(proposed: DataFrame, curated: DataFrame) -> DataFrame:
    """unit, proposed and curated of units that ``(unit, arm)`` tables place differently, one-sided ones included."""
    met = proposed.select("unit", F.col("arm").alias("proposed")).join(curated.select("unit", F.col("arm").alias("curated")), "unit", "full_outer")
    return met.filter(~F.col("proposed").eqNullSafe(F.col("curated")))


def _weighed(nodes: DataFrame, edges: DataFrame, relations: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Nodes with fan_in and fan_out, and the distinct inner triples: containment and the given relations."""
    held = nodes.select("id", "arm")
    inner = triples(edges).filter((F.col("src") != F.col("dst")) & F.col("edge_type").isin(*relations, "contains"))
    inner = inner.join(held.toDF("src", "from_arm"), "src").join(held.toDF("dst", "to_arm"), "dst")
    inner = cut(inner.withColumn("kind", F.when(F.col("edge_type") == "contains", "contains").when(F.col("from_arm") != F.col("to_arm"), "cross").otherwise("depends")))
    walked = inner.filter("kind <> 'contains'")
    ends = walked.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(walked.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    fans = ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return nodes.join(fans, "id", "left").fillna(0, ["fan_in", "fan_out"]), inner


def scene(nodes: DataFrame, edges: DataFrame, relations: tuple[str, ...], max_nodes: int = 3000) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, arm, fan_in, fan_out, crown) and links (src, dst, kind, weight) of the ``max_nodes`` with most fan-in.

    ``nodes(id, arm)``. Fans count distinct triples over all nodes, before the cut. Each arm's crown has the greatest
    product of both fans, then the greatest fan-in, then the least id.
    """
    weighed, inner = _weighed(nodes, edges, relations)
    kept = cut(weighed.orderBy(F.col("fan_in").desc(), "id").limit(max_nodes))
    first = kept.groupBy("arm").agg(F.min(F.struct((-F.col("fan_in") * F.col("fan_out")).alias("p"), (-F.col("fan_in")).alias("i"), "id")).alias("b")).select("arm", F.col("b.id").alias("crown_id"))
    shown = kept.join(first, "arm").select("id", "arm", "fan_in", "fan_out", (F.col("id") == F.col("crown_id")).alias("crown"))
    ids = kept.select("id")
    links = inner.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi")
    return shown, links.groupBy("src", "dst", "kind").agg(F.count("*").alias("weight"))


def overview(nodes: DataFrame, edges: DataFrame, relations: tuple[str, ...]) -> DataFrame:
    """module, size, internal, fan_in and fan_out over all nodes of ``nodes(id, module)``."""
    held = nodes.select("id", "module")
    walked = triples(edges).filter((F.col("src") != F.col("dst")) & F.col("edge_type").isin(*relations))
    pairs = walked.join(held.toDF("src", "a"), "src").join(held.toDF("dst", "b"), "dst").groupBy("a", "b").agg(F.count("*").alias("w"))
    zero = F.lit(0).cast("long")
    same = F.col("a") == F.col("b")
    rows = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("module"), F.when(same, F.col("w")).otherwise(zero).alias("internal"), zero.alias("fan_in"), F.when(same, zero).otherwise(F.col("w")).alias("fan_out")), F.struct(F.col("b").alias("module"), zero.alias("internal"), F.when(same, zero).otherwise(F.col("w")).alias("fan_in"), zero.alias("fan_out")))).alias("e")).select("e.*")
    return nodes.groupBy("module").agg(F.count("*").alias("size")).join(rows.groupBy("module").agg(*[F.sum(c).alias(c) for c in ("internal", "fan_in", "fan_out")]), "module", "left").fillna(0, ["internal", "fan_in", "fan_out"])


def arm_joins(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Classes of ``nodes(id, arm)`` that inherit from another arm: src, dst, from_arm, to_arm."""
    held = nodes.select("id", "arm")
    crossing = triples(edges).filter("edge_type = 'inherits'").join(held.toDF("src", "from_arm"), "src").join(held.toDF("dst", "to_arm"), "dst", "left")
    return crossing.filter(~F.col("from_arm").eqNullSafe(F.col("to_arm"))).select("src", "dst", "from_arm", "to_arm")


def arm_crowns(nodes: DataFrame, edges: DataFrame, relations: tuple[str, ...]) -> DataFrame:
    """arm, id and fan_in: each arm's node most used from other modules; modules count only where nothing else does.

    ``nodes(id, arm, module, node_type)``; the least id of equal ones. Arms that no other module uses have none.
    """
    held = nodes.select("id", "module")
    used = triples(edges).filter(F.col("edge_type").isin(*relations)).join(held.toDF("src", "from_module"), "src").join(held.toDF("dst", "to_module"), "dst").filter("from_module <> to_module")
    fan = used.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    best = F.min(F.struct((F.col("node_type") == "module").alias("m"), (-F.col("fan_in")).alias("f"), "id")).alias("b")
    return nodes.join(fan, "id").groupBy("arm").agg(best).select("arm", "b.id", (-F.col("b.f")).alias("fan_in"))


def neighbourhood(edges: DataFrame, centre: str, radius: int = 2, max_nodes: int = 60) -> DataFrame:
    """node and hop of an undirected walk around a centre, ``max_nodes`` of them, in order of discovery; no level begins once
    so many are held."""
    from graphloom.operators import traverse

    seeds = edges.sparkSession.createDataFrame([(centre,)], "seed string")
    found = traverse.reach(seeds, traverse.steps(edges), radius, max_nodes=max_nodes)
    return found.orderBy("hop", "trail").limit(max_nodes).select("node", "hop")


def clusters(nodes: DataFrame, segments: int = 2) -> DataFrame:
    """cluster, size and node types by the first dotted segments."""
    return nodes.groupBy(C.dotted_prefix(F.col("dotted"), segments).alias("cluster")).agg(F.count("*").alias("size"), F.array_sort(F.collect_set("node_type")).alias("types"))


def sections(nodes: DataFrame, edges: DataFrame, cut_table: DataFrame, rest: str = "rest") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with their section, edges with both, and contents (section, nodes, edges, digest).

    The digest is order-free, so that a second export of the same rows has the same contents.
    """
    placed = mesh.cut_members(nodes, cut_table, rest).withColumnRenamed("group", "section")
    own = nodes.join(placed, "id")
    where = placed.select("id", "section")
    linked = triples(edges).join(where.toDF("src", "section"), "src").join(where.toDF("dst", "to_section"), "dst")
    hashed = F.sum(F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(own.columns))), 256), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    toc = own.groupBy("section").agg(F.count("*").alias("nodes"), hashed.alias("digest")).join(linked.groupBy("section").agg(F.count("*").alias("edges")), "section", "left").fillna(0, ["edges"])
    return own, linked, toc


def export_sections(nodes: DataFrame, edges: DataFrame, cut_table: DataFrame, folder: str, rest: str = "rest") -> DataFrame:
    """Write nodes and edges partitioned by section, and the contents; returns the contents."""
    own, linked, toc = sections(nodes, edges, cut_table, rest)
    own.repartition("section", F.pmod(F.xxhash64("id"), F.lit(16))).write.mode("overwrite").partitionBy("section").parquet(f"{folder}/nodes")
    linked.repartition("section", F.pmod(F.xxhash64("src"), F.lit(16))).write.mode("overwrite").partitionBy("section").parquet(f"{folder}/edges")
    toc.write.mode("overwrite").parquet(f"{folder}/contents")
    return nodes.sparkSession.read.parquet(f"{folder}/contents")


def drift(folder: str, nodes: DataFrame, edges: DataFrame, cut_table: DataFrame, rest: str = "rest") -> DataFrame:
    """section and why (new, gone or changed) of sections whose written contents differ from the current ones."""
    now = sections(nodes, edges, cut_table, rest)[2].select("section", F.struct("nodes", "edges", "digest").alias("now"))
    then = nodes.sparkSession.read.parquet(f"{folder}/contents").select("section", F.struct("nodes", "edges", "digest").alias("then"))
    met = now.join(then, "section", "full_outer").filter(~F.col("now").eqNullSafe(F.col("then")))
    return met.select("section", F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "gone").otherwise("changed").alias("why"))
