"""The command line: questions to a folder of tables or to a compiled store.

Ends with 0 for an answer, 1 for an empty one, 2 for a refusal. ``--home`` names a store; without it ``--tables`` are
projected. Tables print at most ``--limit`` rows and then how many there are; answers themselves are whole.
"""

from __future__ import annotations

import argparse
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.functions import layering
from graphloom.operators import bridges, code, federation, journal, lookup, mesh, shape, traverse
from graphloom.operators.lookup import Refused
from graphloom.plans import containers, estate, laned, pages, refresh, store
from graphloom.session import local_session
from graphloom.sources import projection, python_source


def _graph(spark: SparkSession, a: argparse.Namespace) -> store.Store:
    if a.home:
        return store.open_store(spark, a.home)
    if not a.tables:
        raise Refused("name --home or --tables")
    return store.table_store(spark, a.tables)


def _show(found: DataFrame, limit: int) -> int:
    rows, n = found.limit(limit).collect(), found.count()
    print("\t".join(found.columns))
    for r in rows:
        print("\t".join("" if x is None else str(x) for x in r))
    if n > len(rows):
        print(f"... {n - len(rows)} more")
    return 0 if n else 1


def _seed(spark: SparkSession, nodes: DataFrame, symbol: str) -> DataFrame:
    return spark.createDataFrame([(lookup.resolve(nodes, symbol),)], "seed string")


def _journal(spark: SparkSession, a: argparse.Namespace) -> int:
    """Pages, what is torn, gaps, deaths, or the pages that bear or kill a symbol."""
    if a.what == "torn":
        return _show(pages.torn(spark, a.home or "").orderBy("journal", "seq"), a.limit)
    held = pages.read(spark, a.home or "", a.name, a.allow_torn)
    if a.symbol:
        held = journal.events(held, a.symbol, a.contains)
    found = {"log": lambda: held, "gaps": lambda: journal.gaps(held), "deaths": lambda: journal.deaths(held)}[a.what]()
    shown = [c for c in ("journal", "seq", "ts", "cursor", "prev_cursor", "n_born", "n_died", "n_eborn", "n_edied", "before") if c in found.columns]
    return _show(found.select(*shown).orderBy("journal", "seq"), a.limit)


def _bridge(spark: SparkSession, a: argparse.Namespace) -> int:
    """A walk from a symbol of one store into another, over the schemes named, if their releases agree or skew is allowed."""
    left, right = store.open_store(spark, a.home or ""), store.open_store(spark, a.other)
    rows = [(side, *pin.split("=", 1)) for side, given in (("left", a.pins), ("right", a.other_pins)) for pin in (given or "").split(",") if "=" in pin]
    pins = spark.createDataFrame(rows, "side string, scheme string, version string")
    seeds = spark.createDataFrame([("left|" + lookup.resolve(left.nodes, a.symbol),)], "seed string")
    found = bridges.cross({"left": (left.nodes, left.edges), "right": (right.nodes, right.edges)}, pins, [s for s in (a.join or "").split(",") if s], seeds, a.depth, a.allow_release_skew)
    return _show(found.filter("node LIKE 'right|%'").select("hop", "node", "relation", "skew").orderBy("hop", "node"), a.limit)


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.verb == "code":
        files = spark.read.text(a.folder, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        return _show(code.hunt(files, a.symbol, a.glob, a.loose), a.limit)
    if a.verb == "eat":
        files = spark.read.text(a.folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.py")
        path = F.regexp_replace(F.col("_metadata.file_path"), "^.*?" + re.escape(a.folder.strip("/").rsplit("/", 1)[0]) + "/", "")
        from graphloom.operators.resolve import resolve

        records = python_source.mint(files.select(path.alias("path"), F.col("value").alias("text")), a.corpus).drop("sha").cache()
        nodes = records.filter("kind = 'node'").select("id", F.col("type").alias("node_type"), F.lit(a.corpus).alias("corpus"), C.body(F.col("id")).alias("dotted"), C.last(F.col("id")).alias("name"), "role", "docstring", F.col("path").alias("file"), "line")
        known = records.filter("kind = 'edge' AND src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", F.col("type").alias("edge_type"))
        bound = resolve(records).filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", "edge_type")
        declared = spark.createDataFrame([(a.corpus, t, list(c)) for t, c in C.CODE_CLASSES.items()], "lane string, edge_type string, classes array<string>")
        print(store.compile_store(spark, a.home, nodes, known.unionByName(bound), [a.corpus], declared))
        return 0
    if a.verb == "estate":
        if a.home:
            graph = _graph(spark, a)
            nodes, edges = graph.nodes, graph.edges
            nodes.createOrReplaceTempView("nodes")
            edges.select("*", C.scheme(F.col("src")).alias("corpus"), C.scheme(F.col("dst")).alias("dst_corpus")).createOrReplaceTempView("adj")
            return _show(spark.sql(a.sql), a.limit)
        return _show(estate.sql(spark, a.tables, a.sql), a.limit)
    if a.verb == "journal":
        return _journal(spark, a)
    if a.verb == "container":
        held = laned.open_laned(spark, a.home or "")
        inputs = containers.inputs_of(held)
        if a.defer:
            containers.defer(spark, a.to, a.defer.split(","))
        if a.emit:
            containers.emit_missing(spark, a.to, inputs, held.table("lane_nodes"), held.table("lane_edges"))
        return _show(containers.states(spark, a.to, inputs).select("lane", "state").orderBy("lane"), a.limit)
    if a.verb == "generation":
        home = refresh.serving(spark, a.home or "")
        if home is None:
            raise Refused(f"nothing is served in {a.home}")
        print(f"{laned.open_laned(spark, home).generation}\t{home}")
        return 0
    if a.verb == "promote":
        print(refresh.promote(spark, a.home or "", a.release)["generation"])
        return 0
    if a.verb == "traversals":
        held = store.open_store(spark, a.home or "")
        found = store.recall(spark, a.home, held.generation, a.seed, a.target)
        return 1 if found is None else _show(found.drop("trail").orderBy("door", "seed", "hop", "node"), a.limit)
    if a.verb == "bridge":
        return _bridge(spark, a)
    if a.verb in ("catalogue", "pull"):
        found = federation.catalogue(spark, a.index) if a.verb == "catalogue" else federation.pull(spark, a.index, a.name)
        return 1 if found is None else _show(found, a.limit)
    if a.verb == "verify":
        found = federation.verify(spark, a.index).cache()
        _show(found, a.limit)
        return 0 if found.filter("NOT ok").isEmpty() else 1
    graph = _graph(spark, a)
    nodes, edges = graph.nodes, graph.edges
    depends = tuple(a.relations.split(",")) if a.relations else None
    if a.verb == "build":
        print(store.compile_store(spark, a.to, nodes.drop("scheme"), edges, sorted(r[0] for r in nodes.select("corpus").distinct().collect()), graph.vocabulary.withColumn("lane", F.lit("store"))))
        return 0
    if a.verb == "hunt":
        return _show(lookup.hunt(nodes, a.symbol).orderBy("id"), a.limit)
    if a.verb in ("blast", "descend"):
        walk = traverse.blast if a.verb == "blast" else traverse.descend
        return _show(walk(_seed(spark, nodes, a.symbol), graph.walk, a.depth, depends, graph.vocabulary).filter("hop > 0").select("hop", "node", "via", "relation").orderBy("hop", "node"), a.limit)
    if a.verb == "explain":
        held = 0
        for title, found in lookup.explain(nodes, edges, a.symbol, vocabulary=graph.vocabulary).items():
            print(f"# {title}")
            if isinstance(found, DataFrame):
                held |= _show(found, a.limit) == 0
            else:
                print(found or "")
        return 0 if held else 1
    if a.verb == "walk":
        path, why = traverse.path_to(edges, lookup.resolve(nodes, a.symbol), lookup.resolve(nodes, a.target), a.depth)
        print("\n".join(f"{relation}\t{node}" for node, relation in path) or f"no path: {why or 'exhausted'}")
        return 0 if path else 1
    if a.verb == "converge":
        return _show(mesh.seam_matrix(edges, nodes), a.limit)
    if a.verb == "pillars":
        depth, plan = shape.shape(nodes, edges, depends or mesh.relations_in(graph.vocabulary, "depends"), a.depth, arms=a.arms, floor=a.floor)
        print(f"depth {depth}")
        for arm, units in plan.arms.items():
            print(f"{arm}\t{plan.crowns[arm]}\t{' '.join(units)}")
        return 0
    if a.verb == "fanout":
        cut = nodes.select(C.dotted_prefix(F.col("dotted"), a.depth).alias("prefix")).distinct().select(F.col("prefix").alias("group"), "prefix")
        return _show(shape.export_sections(nodes, edges, cut, a.to), a.limit)
    if a.verb == "draw":
        near = [r["node"] for r in shape.neighbourhood(edges, lookup.resolve(nodes, a.symbol), a.depth).collect()]  # at most 60
        held = lookup.triples(edges).filter(F.col("src").isin(near) & F.col("dst").isin(near)).select("src", "dst").distinct().collect()
        draw = layering.svg_picture if a.svg else layering.ascii_picture
        print(draw(near, [tuple(r) for r in held], {n: n.rsplit("/", 1)[-1] for n in near}))
        return 0
    return _show(mesh.dangling(edges, nodes), a.limit)  # check


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("graphloom", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, *words: str, depth: int = 4):
        p = verbs.add_parser(name)
        for w in words:
            p.add_argument(w)
        for flag in ("--home", "--tables", "--relations"):
            p.add_argument(flag)
        p.add_argument("--depth", type=int, default=depth)
        p.add_argument("--limit", type=int, default=50)
        return p

    verb("eat", "folder", "corpus")
    verb("estate", "sql")
    verb("build").add_argument("--to", required=True)
    for name in ("hunt", "blast", "descend", "explain"):
        verb(name, "symbol")
    verb("walk", "symbol", "target", depth=6)
    verb("converge")
    verb("check")
    pillars = verb("pillars", depth=2)
    pillars.add_argument("--arms", type=int)
    pillars.add_argument("--floor", type=int, default=shape.FLOOR)
    verb("fanout", depth=2).add_argument("--to", required=True)
    verb("draw", "symbol", depth=2).add_argument("--svg", action="store_true")
    verb("verify", "index")
    verb("catalogue", "index")
    verb("pull", "index", "name")
    told = verb("journal", "what")
    told.add_argument("--name")
    told.add_argument("--symbol")
    told.add_argument("--contains", action="store_true")
    told.add_argument("--allow-torn", action="store_true")
    box = verb("container")
    box.add_argument("--to", required=True)
    box.add_argument("--defer")
    box.add_argument("--emit", action="store_true")
    verb("generation")
    verb("promote", "release")
    kept = verb("traversals")
    kept.add_argument("--seed")
    kept.add_argument("--target")
    over = verb("bridge", "symbol", "other", depth=8)
    for flag in ("--join", "--pins", "--other-pins"):
        over.add_argument(flag)
    over.add_argument("--allow-release-skew", action="store_true")
    search = verb("code", "folder", "symbol")
    search.add_argument("--glob")
    search.add_argument("--loose", action="store_true")
    return top


def main(words: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(words)
    try:
        return run(spark or local_session(), a)
    except Refused as reason:
        print(f"refused: {reason}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    raise SystemExit(main())
