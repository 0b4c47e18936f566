"""Operators over records: schema checks, source text of nodes, numeric leaves, snippets, sessions of files, arms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.operators import mesh, traverse
from graphloom.operators.lookup import Refused
from graphloom.session import cut

#: Keys of a receipt whose values are no numbers of it; fixed values.
NO_NUMBERS = ("profile", "hot", "engine_hot", "argv")


def violations(nodes: DataFrame, edges: DataFrame, node_types: Sequence[str], edge_types: Sequence[str]) -> DataFrame:
    """record (node or edge), name and why of each record that breaks the schema.

    A node needs an id and a known type; an edge a known type, and for each end an id or, in ``src_repr`` and
    ``dst_repr`` where there are such columns, its text.
    """
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    end = lambda e: blank(e) & (blank(f"{e}_repr") if f"{e}_repr" in edges.columns else F.lit(True))
    why = lambda pairs: F.array_compact(F.array(*[F.when(c, F.lit(w)) for w, c in pairs]))
    known = lambda c, held: F.coalesce(F.col(c).isin(*held), F.lit(False))
    of_nodes = nodes.select(F.lit("node").alias("record"), F.col("id").alias("name"), why([("no id", blank("id")), ("no type", blank("node_type")), ("unknown type", ~blank("node_type") & ~known("node_type", node_types))]).alias("why"))
    name = F.concat_ws(" ", F.coalesce("src", F.lit("?")), F.coalesce("edge_type", F.lit("?")), F.coalesce("dst", F.lit("?")))
    of_edges = edges.select(F.lit("edge").alias("record"), name.alias("name"), why([("no type", blank("edge_type")), ("unknown type", ~blank("edge_type") & ~known("edge_type", edge_types)), ("no source", end("src")), ("no target", end("dst"))]).alias("why"))
    return of_nodes.unionByName(of_edges).select("record", "name", F.explode("why").alias("why"))


def validate(nodes: DataFrame, edges: DataFrame, node_types: Sequence[str], edge_types: Sequence[str]) -> int:
    """How many records were checked; refuses the first violation, and a check of nothing, which would prove nothing."""
    wrong = violations(nodes, edges, node_types, edge_types).orderBy("record", "name", "why").head(1)
    if wrong:
        raise Refused(f"{wrong[0]['record']} {wrong[0]['name']}: {wrong[0]['why']}")
    checked = nodes.count() + edges.count()
    if not checked:
        raise Refused("no record was checked")
    return checked


def hydrate(nodes: DataFrame, files: DataFrame, max_chars: int = 64_000) -> DataFrame:
    """id, granularity, origin, text, truncated and error: the source of ``nodes(id, node_type, file, line, loc)`` from
    ``files(path, text)``. A module is its whole file; others are ``loc`` lines from ``line`` on."""
    held = files.select(F.col("path").alias("origin"), F.col("text").alias("body"))
    joined = nodes.select("id", "node_type", "file", "line", "loc").join(held, F.col("file") == F.col("origin"), "left")
    whole = (F.col("node_type") == "module") | F.col("line").isNull()
    lines = F.slice(F.split("body", "\n", -1), F.greatest(F.col("line"), F.lit(1)).cast("int"), F.greatest(F.coalesce("loc", F.lit(1)), F.lit(1)).cast("int"))
    text = F.when(whole, F.col("body")).otherwise(F.array_join(lines, "\n"))
    error = F.when(F.col("file").isNull(), "the record names no file").when(F.col("origin").isNull(), "the file is not held")
    found = joined.withColumn("text", text)
    return found.select("id", F.when(whole, "file").otherwise("span").alias("granularity"), "origin", F.substring("text", 1, max_chars).alias("text"), (F.length("text") > max_chars).alias("truncated"), error.alias("error"))


def numeric_leaves(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, name and value: the numbers in the objects of a JSON column, under dotted names; lists aren't entered.

    A level of nesting is a narrow step, so the loop is as long as the objects are deep.
    """
    level = rows.select(F.col(key).alias("key"), F.lit("").alias("path"), F.try_parse_json(F.col(text)).alias("v"))
    out = None
    while True:
        level.createOrReplaceTempView("graphloom_leaves")
        skipped = ", ".join(f"'{k}'" for k in NO_NUMBERS)
        spark = rows.sparkSession
        parts = spark.sql(f"SELECT l.key, concat(l.path, e.key) AS name, e.value AS v, schema_of_variant(e.value) AS kind FROM graphloom_leaves l, LATERAL variant_explode(l.v) e WHERE e.key IS NOT NULL AND e.key NOT IN ({skipped})")
        parts = cut(parts.select("key", "name", "kind", F.to_json("v").alias("j")))
        numbers = parts.filter(F.col("kind").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")).select(F.col("key").alias(key), "name", F.col("j").cast("double").alias("value"))
        out = numbers if out is None else out.unionByName(numbers)
        level = parts.filter(F.col("kind").startswith("OBJECT")).select("key", F.concat("name", F.lit(".")).alias("path"), F.parse_json("j").alias("v"))
        if level.isEmpty():
            return out


def snippet(text: Column, term: str, width: int) -> Column:
    """About ``width`` characters around the first place of a term, case-blind, white space as one space; the start of the
    text where the term isn't in it."""
    at = F.greatest(F.instr(F.lower(text), term.lower()) - 1, F.lit(0))
    low = F.greatest(F.lit(0), at - width // 2)
    high = F.least(F.length(text), at + width // 2)
    return F.trim(F.regexp_replace(F.substring(text, low + 1, high - low), r"\s+", " "))


def session_of(files: DataFrame, sessions: DataFrame) -> DataFrame:
    """file and session: of ``sessions(id, file)`` the node whose file it is, or whose id's first eight characters the file
    name has after a double underscore."""
    named = sessions.filter("file IS NOT NULL").groupBy("file").agg(F.max("id").alias("by_file"))
    stamp = F.substring(C.last(F.col("id")), 1, 8)
    stamped = sessions.groupBy(stamp.alias("stamp")).agg(F.max("id").alias("by_stamp"))
    tail = F.when(F.col("file").contains("__"), F.substring_index(F.regexp_replace("file", r"\.md$", ""), "__", -1))
    joined = files.select("file", tail.alias("stamp")).join(named, "file", "left").join(stamped, "stamp", "left")
    return joined.select("file", F.coalesce("by_file", "by_stamp").alias("session"))


def arm_inventory(nodes: DataFrame, cut_: DataFrame) -> DataFrame:
    """arm, module, kind (class or func), dotted and methods of ``nodes(id, node_type, dotted, module)``, the modules dealt to
    arms by the cut's longest prefix; a class counts the methods whose name it heads."""
    placed = mesh.cut_members(nodes.select(F.col("module").alias("dotted")).filter("dotted IS NOT NULL").distinct().withColumn("id", F.col("dotted")), cut_).toDF("module", "arm")
    held = nodes.filter("node_type IN ('class', 'func')").select("node_type", "dotted", "module")
    methods = nodes.filter("node_type = 'method'").groupBy("module", F.expr("substring(dotted, 1, length(dotted) - length(substring_index(dotted, '.', -1)) - 1)").alias("dotted")).agg(F.count("*").alias("methods"))
    joined = held.join(methods, ["module", "dotted"], "left").join(placed, "module")
    return joined.select("arm", "module", F.col("node_type").alias("kind"), "dotted", F.when(F.col("node_type") == "class", F.coalesce("methods", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("methods"))


def arm_dependents(crowns: DataFrame, edges, corpus: str, depth: int = 4, vocabulary: DataFrame | None = None) -> DataFrame:
    """arm, crown and dependents: how many nodes of the corpus depend on each crown of ``crowns(arm, id)``, by one walk."""
    found = traverse.blast(crowns.select(F.col("id").alias("seed")).distinct(), edges, depth, vocabulary=vocabulary)
    n = found.filter((F.col("hop") > 0) & (C.scheme(F.col("node")) == corpus)).groupBy(F.col("seed").alias("id")).agg(F.count("*").alias("n"))
    return crowns.join(n, "id", "left").select("arm", F.col("id").alias("crown"), F.coalesce("n", F.lit(0)).alias("dependents"))
