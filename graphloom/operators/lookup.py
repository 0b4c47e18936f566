"""Lookups over a node and an edge table: membership, symbol search, neighbours and name resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Refused(ValueError):
    """A question that has no single answer."""


def membership(nodes: DataFrame, node: str) -> DataFrame:
    return nodes.filter(F.col("id") == node).select("id", "corpus")


def record(nodes: DataFrame, node: str) -> DataFrame:
    return nodes.filter(F.col("id") == node)


def find(nodes: DataFrame, symbol: str) -> DataFrame:
    """Ids equal to the symbol or ending in ``.symbol`` or ``/symbol``; ASCII case is folded in the tail."""
    low = F.lower("id")
    return nodes.filter((F.col("id") == symbol) | low.endswith("." + symbol.lower()) | low.endswith("/" + symbol.lower()))


def grep(nodes: DataFrame, needle: str) -> DataFrame:
    return nodes.filter(F.lower("id").contains(needle.lower()))


def owned(nodes: DataFrame, corpus: str) -> DataFrame:
    return nodes.filter(F.col("corpus") == corpus)


def triples(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "edge_type").distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """node, other, relation and direction (``with`` the edge or ``against`` it), both ways of every distinct edge."""
    found = triples(edges)
    out = found.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.col("edge_type").alias("relation"), F.lit("with").alias("direction"))
    return out.unionByName(found.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.col("edge_type").alias("relation"), F.lit("against").alias("direction")))


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """other, relation, direction; a relation seen both ways is ``both``. Each side is its own pushed-down filter."""
    out = edges.filter(F.col("src") == node).select(F.col("dst").alias("other"), F.col("edge_type").alias("relation"), F.lit("with").alias("direction"))
    back = edges.filter(F.col("dst") == node).select(F.col("src").alias("other"), F.col("edge_type").alias("relation"), F.lit("against").alias("direction"))
    ways = F.collect_set("direction")
    return out.unionByName(back).groupBy("other", "relation").agg(F.when(F.size(ways) > 1, F.lit("both")).otherwise(F.first("direction")).alias("direction"))


def resolve(nodes: DataFrame, symbol: str) -> str:
    """The id that is the symbol, or the only one that ends in it; refuses with none or several."""
    exact = nodes.filter(F.col("id") == symbol).select("id").head(1)
    found = [r[0] for r in exact] or [r[0] for r in find(nodes, symbol).select("id").orderBy("id").head(21)]
    if len(found) != 1:
        raise Refused(f"{symbol!r} names {'no node' if not found else f'{len(found)} nodes or more: ' + ', '.join(found[:20])}")
    return found[0]


def hunt(nodes: DataFrame, symbol: str) -> DataFrame:
    """Tail matches, or substring matches where there is none."""
    tail = find(nodes, symbol)
    return tail if tail.head(1) else grep(nodes, symbol)


def first_page(found: DataFrame | None, journal: str) -> tuple[dict | None, str]:
    """The first page of a journal and a note of how many there are; or None and why there is none."""
    if found is None:
        return None, "no journal is declared"
    of = found.filter(F.col("journal") == journal)
    page, n = of.orderBy("seq").head(1), of.count()
    return (page[0].asDict(recursive=True), f"{n} page(s)") if page else (None, f"no journal page for {journal}")


def explain(nodes: DataFrame, edges: DataFrame, symbol: str, doc_relations: tuple[str, ...] = ("documents", "mentions"), depth: int = 3, vocabulary: DataFrame | None = None, pages: DataFrame | None = None) -> dict:
    """What is known of a symbol: its record, the documents near it, the tests that depend on it and its first neighbours, as
    frames; the first page of its corpus' journal among ``pages`` and a note of that, and a note where no test reaches it."""
    from graphloom.operators import mesh, traverse

    node = resolve(nodes, symbol)
    seed = nodes.sparkSession.createDataFrame([(node,)], "seed string")
    tests = nodes.filter("role = 'test'").select(F.col("id").alias("node")) if "role" in nodes.columns else nodes.limit(0).select(F.col("id").alias("node"))
    page, note = first_page(pages, node.split("://")[0])
    reaching = traverse.blast(seed, edges, depth, vocabulary=vocabulary).filter("hop > 0").join(tests, "node", "left_semi")
    walked = ", ".join(mesh.relations_in(vocabulary, "depends")) or "no relation"
    return {
        "record": record(nodes, node),
        "docs": traverse.doc_endpoints(seed, edges, doc_relations, depth),
        "tests": reaching,
        "neighbours": neighbours(edges, node),
        "page": page,
        "note": note,
        "tests_note": None if reaching.head(1) else f"none reach it within depth {depth} against {walked}",
    }
