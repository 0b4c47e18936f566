"""History: archive boxes, literals of exchanges bound to code, discussed nodes, sessions of commits, timelines, topics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.operators import text as T
from graphloom.session import cut

MARK = r"(?m)^---[^\S\n]*\[(\d+)\][^\S\n]*(USER|ASSISTANT)[^\S\n]*$"
#: What counts as a literal of an exchange: dotted identifiers and paths with a slash; fixed values.
DOTTED = r"(?U)((?<![\w./-])[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+(?![\w/]))"
PATH = r"(?U)((?<![\w./-])[A-Za-z0-9_.\-]+(?:/[A-Za-z0-9_.\-]+)+(?![\w./-]))"
TOKEN = r"(?U)([\w./-]+)"
CODE_SUFFIXES = (".py", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".svelte", ".vue")


def exchanges(files: DataFrame) -> DataFrame:
    """file, part, n, speaker and text of each marked exchange in ``files(file, text)``; n and speaker are null for what
    stands before the first mark."""
    parts = files.select("file", F.posexplode(F.split("text", r"(?m)(?=^---[^\S\n]*\[\d+\][^\S\n]*(?:USER|ASSISTANT)[^\S\n]*$)")).alias("part", "text"))
    number = F.nullif(F.regexp_extract("text", MARK, 1), F.lit("")).cast("long")
    rows = parts.select("file", "part", number.alias("n"), F.lower(F.nullif(F.regexp_extract("text", MARK, 2), F.lit(""))).alias("speaker"), F.regexp_replace("text", r"^---[^\n]*\n?", "").alias("body"), "text")
    return rows.select("file", "part", "n", "speaker", F.when(F.col("n").isNull(), F.col("text")).otherwise(F.col("body")).alias("text")).filter("n IS NOT NULL OR text <> ''")


def boxes(files: DataFrame) -> DataFrame:
    """file, box, exchange and text: consecutive marks of one number are one box; what stands before them is exchange 0."""
    order = Window.partitionBy("file").orderBy("part")
    rows = exchanges(files).withColumn("exchange", F.coalesce("n", F.lit(0)))
    new = F.coalesce((F.lag("exchange").over(order) != F.col("exchange")) | F.lag("n").over(order).isNull(), F.lit(True))
    runs = rows.withColumn("box", F.sum(new.cast("long")).over(order))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", F.coalesce("text", F.lit("")).alias("x")))), lambda s: s["x"]), "\n")
    return runs.groupBy("file", "box").agg(F.first("exchange").alias("exchange"), joined.alias("text"))


def _suffixes(c: Column) -> Column:
    return C.tails(c, "/")


def code_index(nodes: DataFrame) -> DataFrame:
    """suffix-free file and module of the module nodes of ``nodes(id, node_type, dotted, file)``."""
    return nodes.filter("node_type = 'module' AND file IS NOT NULL").groupBy(C.posix(F.col("file")).alias("file")).agg(F.min("id").alias("module"), F.count_distinct("id").alias("n"))


def symbol_index(nodes: DataFrame) -> DataFrame:
    """literal, node and n: tails of dotted names with two segments or more, and slash suffixes of module files.

    n counts the nodes that a literal names; with more than one it binds nothing.
    """
    tails = F.filter(C.tails(F.col("dotted")), lambda t: t.contains("."))
    files = nodes.filter("node_type = 'module' AND file IS NOT NULL").select(F.explode(_suffixes(C.posix(F.col("file")))).alias("literal"), "id")
    named = nodes.filter(F.col("dotted").contains(".")).select(F.explode(tails).alias("literal"), "id").unionByName(files)
    return named.groupBy("literal").agg(F.min("id").alias("node"), F.count_distinct("id").alias("n"))


def literals(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, literal and count: dotted identifiers and slashed paths of the text, never a bare word."""
    found = F.concat(F.regexp_extract_all("text", F.lit(DOTTED), 1), F.regexp_extract_all("text", F.lit(PATH), 1))
    each = rows.select(*key, F.explode(F.transform(found, lambda x: F.regexp_replace(x, "[.-]+$", ""))).alias("literal"))
    return each.filter(F.col("literal").contains(".") | F.col("literal").contains("/")).groupBy(*key, "literal").agg(F.count("*").alias("count"))


def modules_of(paths: DataFrame, index: DataFrame) -> DataFrame:
    """path and module: the module whose file is the longest suffix of the path at slashes."""
    each = paths.select("path").distinct().select("path", F.explode(_suffixes(F.col("path"))).alias("file"))
    return each.join(index.select("file", "module"), "file").groupBy("path").agg(F.max_by("module", F.length("file")).alias("module"))


def alias_hits(rows: DataFrame, key: list[str], aliases: dict[str, str]) -> DataFrame:
    """key, literal, node and count of registered literals that stand alone in the text.

    Literals of word characters, dots, slashes and hyphens equal a whole token, so that they join by equality; the few
    others are counted by pattern.
    """
    spark = rows.sparkSession
    plain = {k: v for k, v in aliases.items() if re.fullmatch(r"[\w./-]+", k)}
    table = spark.createDataFrame(list(plain.items()), "literal string, node string")
    tokens = rows.select(*key, F.explode(F.regexp_extract_all("text", F.lit(TOKEN), 1)).alias("literal"))
    out = tokens.join(F.broadcast(table), "literal").groupBy(*key, "literal", "node").agg(F.count("*").alias("count"))
    for literal, node in aliases.items():
        if literal not in plain:
            n = F.regexp_count("text", F.lit(r"(?U)(?<![\w./-])" + re.escape(literal) + r"(?![\w./-])")).cast("long")
            out = out.unionByName(rows.select(*key, F.lit(literal).alias("literal"), F.lit(node).alias("node"), n.alias("count")).filter("count > 0"))
    return out


def bind(rows: DataFrame, key: list[str], nodes: DataFrame, aliases: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Mentions (key, node, via, count, literal) of code in texts, and every literal's verdict (literal, verdict).

    A path names the module with its longest known suffix; other literals name the only node with that tail. Two nodes:
    ambiguous, no mention. A node keeps its best spelling: dotted before file before alias, then the shortest, then the
    least. Verdicts are bound, ambiguous or unbound, per distinct literal.
    """
    found = literals(rows, key)
    distinct = found.select("literal").distinct()
    paths = modules_of(distinct.filter(F.col("literal").contains("/")).select(F.col("literal").alias("path")), code_index(nodes)).toDF("literal", "module")
    index = symbol_index(nodes)
    via = F.when(F.col("module").isNotNull() | F.col("literal").contains("/") | F.col("literal").rlike("(" + "|".join(map(re.escape, CODE_SUFFIXES)) + ")$"), "file").otherwise("dotted")
    judged = distinct.join(paths, "literal", "left").join(index, "literal", "left")
    judged = judged.select("literal", F.coalesce("module", F.when(F.col("n") == 1, F.col("node"))).alias("node"), via.alias("via"), F.when(F.col("module").isNotNull() | (F.col("n") == 1), "bound").when(F.col("n") > 1, "ambiguous").otherwise("unbound").alias("verdict"))
    hits = found.join(judged.filter("verdict = 'bound'").drop("verdict"), "literal").select(*key, "node", "via", "count", "literal")
    if aliases:
        hits = hits.unionByName(alias_hits(rows, key, aliases).withColumn("via", F.lit("alias")))
    rank = F.when(F.col("via") == "dotted", 0).when(F.col("via") == "file", 1).otherwise(2)
    best = F.min(F.struct(rank.alias("r"), F.length("literal").alias("l"), "literal", "via")).alias("b")
    return hits.groupBy(*key, "node").agg(F.sum("count").alias("count"), best).select(*key, "node", "b.via", "count", "b.literal"), judged.select("literal", "verdict")


def tally(mentions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """mentions, aliased, literals, bound and ambiguous in one row."""
    counted = mentions.agg(F.count("*").alias("mentions"), F.count_if(F.col("via") == "alias").alias("aliased"))
    judged = verdicts.agg(F.count("*").alias("literals"), F.count_if(F.col("verdict") == "bound").alias("bound"), F.count_if(F.col("verdict") == "ambiguous").alias("ambiguous"))
    return counted.crossJoin(judged)  # one row each


def authored(commits: DataFrame, captures: DataFrame) -> DataFrame:
    """commit and session: the capture whose window (previous, at] holds the commit's time, of ``commits(commit, at)`` and
    ``captures(session, at)``.

    Only captures, which are few beside commits, are sorted together; commits look windows up by day and time. The first
    window has no floor, so it holds nothing; equal times leave the later window empty.
    """
    order = Window.orderBy("at", "session")
    low = captures.withColumn("low", F.lag("at").over(order)).filter("low IS NOT NULL AND low < at").withColumnRenamed("at", "high")
    days = low.withColumn("day", F.explode(F.sequence(F.to_date("low"), F.to_date("high"), F.expr("INTERVAL 1 DAY"))))
    met = commits.withColumn("day", F.to_date("at")).join(days, "day").filter("at > low AND at <= high")
    return met.select("commit", "session")


def discussed(contains: DataFrame, mentions: DataFrame) -> DataFrame:
    """session, node and n: exchanges of a session that mention a node."""
    return contains.select(F.col("src").alias("session"), F.col("dst").alias("x")).distinct().join(mentions.select(F.col("src").alias("x"), F.col("dst").alias("node")).distinct(), "x").groupBy("session", "node").agg(F.count("*").alias("n"))


def story(sessions: DataFrame, edges: DataFrame) -> DataFrame:
    """session, at and, in order, its commits, the sections these record, the issues they name and the receipts that pin
    those issues. ``sessions(session, at)``; a session captured twice has its latest time."""
    last = sessions.groupBy("session").agg(F.max("at").alias("at"))
    of = lambda relation, src, dst: edges.filter(F.col("edge_type") == relation).select(F.col("src").alias(src), F.col("dst").alias(dst)).distinct()
    made = of("authored", "session", "commit")
    named = made.join(of("names", "commit", "issue"), "commit").select("session", "issue").distinct()
    held = {"commits": made.withColumnRenamed("commit", "x"), "sections": made.join(of("records", "commit", "x"), "commit"), "issues": named.withColumnRenamed("issue", "x"), "receipts": named.join(of("pins", "x", "issue"), "issue")}
    out = last
    for name, rows in held.items():
        out = out.join(rows.groupBy("session").agg(F.array_sort(F.collect_set("x")).alias(name)), "session", "left")
    return out.select("session", "at", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in held])


def mint(sessions: DataFrame, files: DataFrame, commits: DataFrame, sections: DataFrame, receipts: DataFrame, code: DataFrame, aliases: dict[str, str] | None = None, issue: str = r"(?:issue |#)(\d+)", section: str = r"§(\d+)") -> tuple[DataFrame, DataFrame]:
    """Nodes (id, node_type, name) and edges (src, dst, edge_type, via) of one repository's history.

    ``sessions(session, at, file)``, ``files(file, text)``, ``commits(sha, at, subject, body, files)``,
    ``sections(number, title)``, ``receipts(name, issue, at)`` and code nodes. Edges: follows, contains, mentions,
    authored, records, names, touches and pins. A session captured twice is one node and two windows, and its last capture
    has its exchanges; records of a section that isn't there give no edge. The chains of ``follows`` are ordered in one
    task each, which one repository bounds.
    """
    put = lambda kind, *c: F.concat(F.lit(f"history://{kind}/"), *[F.col(x).cast("string") if isinstance(x, str) else x for x in c])
    each = lambda text, pattern: F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 1)))
    last = sessions.groupBy("session").agg(F.max_by("file", F.struct("at", "file")).alias("file"), F.max("at").alias("at"), F.min("at").alias("first"))
    spoken = exchanges(files).filter("n IS NOT NULL").join(last.select("session", "file"), "file")
    spoken = spoken.groupBy(put("session", "session").alias("session"), put("exchange", F.concat_ws("/", "session", F.col("n").cast("string"), "speaker")).alias("x")).agg(F.max_by("text", "part").alias("text"))
    mentions, _ = bind(spoken.select("x", "text"), ["x"], code, aliases)
    headed = sections.select(put("section", "number").alias("id"), F.col("number"), F.col("title"))
    made = commits.select(put("commit", "sha").alias("id"), "sha", "at", "subject", "body", "files")
    body = made.select("id", each(F.concat_ws("\n", "subject", "body"), section).alias("number"))
    named = made.select(F.col("id").alias("src"), each(F.concat_ws("\n", "subject", "body"), issue).alias("number"), F.lit("message").alias("via")).unionByName(headed.select(F.col("id").alias("src"), each(F.col("title"), issue).alias("number"), F.lit("title").alias("via")))
    pinned = receipts.filter("issue IS NOT NULL").select(put("receipt", "name").alias("src"), put("issue", "issue").alias("dst"))
    paths = made.select("id", F.explode("files").alias("path"))
    windows = authored(made.select(F.col("id").alias("commit"), "at"), sessions.select(put("session", "session").alias("session"), "at"))
    edge = lambda df, src, dst, kind, via=None: df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("edge_type"), (F.col(via[1:]) if via and via[0] == ":" else F.lit(via)).cast("string").alias("via"))
    chain = lambda df, key: edge(df.select(F.lag("id").over(Window.orderBy(*key)).alias("before"), "id").filter("before IS NOT NULL"), "before", "id", "follows")
    out = chain(last.select(put("session", "session").alias("id"), "first"), ["first", "id"]).unionByName(chain(made, ["at", "id"])).unionByName(chain(headed, ["number"]))
    for part in (
        edge(spoken, "session", "x", "contains"),
        edge(mentions, "x", "node", "mentions", ":via"),
        edge(windows, "session", "commit", "authored", "window"),
        edge(body.withColumn("dst", put("section", "number")).join(headed.select(F.col("id").alias("dst")), "dst", "left_semi"), "id", "dst", "records", "message"),
        edge(named.withColumn("dst", put("issue", "number")), "src", "dst", "names", ":via"),
        edge(paths.join(modules_of(paths, code_index(code)), "path"), "id", "module", "touches"),
        edge(pinned, "src", "dst", "pins"),
    ):
        out = out.unionByName(part)
    node = lambda df, kind, name: df.select("id", F.lit(kind).alias("node_type"), name.alias("name"))
    nodes = node(last.withColumn("id", put("session", "session")), "session", F.substring("session", 1, 8))
    issues = named.select(put("issue", "number").alias("id")).unionByName(pinned.select(F.col("dst").alias("id"))).distinct()
    for part in (node(spoken.withColumnRenamed("x", "id").drop("session"), "exchange", F.col("id")), node(made, "commit", F.substring("sha", 1, 7)), node(headed, "section", F.col("title")), node(issues, "issue", F.substring_index("id", "/", -1)), node(receipts.withColumn("id", put("receipt", "name")), "receipt", F.col("name"))):
        nodes = nodes.unionByName(part)
    return nodes.dropDuplicates(["id"]), out.distinct()


def live_terms(counted: DataFrame, session: str, min_boxes: int = 3, max_share: float = 0.5) -> DataFrame:
    """term and boxes of the terms that have enough boxes and stand in few enough sessions, of ``text.counted_terms``."""
    counted = cut(counted)  # a row for each term of a session
    total = counted.agg(F.count_distinct(session)).first()[0]
    live = counted.groupBy("term").agg(F.sum("n").alias("boxes"), F.count_distinct(session).alias("sessions"))
    return live.filter((F.col("boxes") >= min_boxes) & (F.col("sessions") <= max_share * max(1, total))).select("term", "boxes")


def topic_forest(index: DataFrame, session: str, box: list[str], min_boxes: int = 3, max_share: float = 0.5, min_family: int = 2) -> DataFrame:
    """``forest`` of the live terms of a posting index."""
    total = index.agg(F.count_distinct(session)).first()[0]
    live = index.groupBy("term").agg(F.count_distinct(*box).alias("boxes"), F.count_distinct(session).alias("sessions"))
    return forest(live.filter((F.col("boxes") >= min_boxes) & (F.col("sessions") <= max_share * max(1, total))).select("term", "boxes"), min_family)


def forest(live: DataFrame, min_family: int = 2) -> DataFrame:
    """term, boxes, kind (anchor or symbol) and parent of the topics among live terms.

    Symbols are live terms with segments at dots, underscores and hyphens; anchors are plain live terms that enough symbols have as a segment. A symbol's parent is the
    symbol whose segments are its longest proper contiguous part, else the anchor among its segments with most boxes; the
    least of equal ones. Every symbol lists its own parts and joins by equality; no pairs of symbols are compared. The live
    terms are kept, as six steps read them.
    """
    live = cut(live)
    segments = F.filter(F.split("term", r"[._\-]"), lambda s: (F.length(s) >= 3) & ~s.rlike(r"^\d+$") & ~s.isin(*T.STOP))
    symbols = live.filter(F.col("term").rlike(r"[._\-]")).withColumn("segments", segments).filter(F.size("segments") > 0)
    family = symbols.select("term", F.explode(F.array_distinct("segments")).alias("segment")).groupBy("segment").agg(F.count("*").alias("family"))
    anchors = live.join(symbols.select("term"), "term", "left_anti").join(family.filter(F.col("family") >= min_family).withColumnRenamed("segment", "term"), "term").select("term", "boxes")
    size = F.size("segments")
    parts = symbols.filter(size > 1).select("term", "segments", F.explode(F.sequence(F.lit(1), size - 1)).alias("n")).select("term", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("segments") - F.col("n") + 1), lambda i: F.array_join(F.slice("segments", i, F.col("n")), "\x00"))).alias("key"))
    keyed = symbols.select(F.col("term").alias("parent"), F.array_join("segments", "\x00").alias("key"))
    under = parts.join(keyed, "key").groupBy("term").agg(F.min(F.struct((-F.col("n")).alias("l"), "parent")).alias("b")).select("term", F.col("b.parent").alias("parent"))
    held = symbols.select("term", F.explode(F.array_distinct("segments")).alias("anchor")).join(anchors.toDF("anchor", "weight"), "anchor").groupBy("term").agg(F.min(F.struct((-F.col("weight")).alias("w"), "anchor")).alias("b")).select("term", F.col("b.anchor").alias("anchor"))
    tree = symbols.select("term", "boxes", F.lit("symbol").alias("kind")).join(under, "term", "left").join(held, "term", "left")
    return tree.select("term", "boxes", "kind", F.coalesce("parent", "anchor").alias("parent")).unionByName(anchors.select("term", "boxes", F.lit("anchor").alias("kind"), F.lit(None).cast("string").alias("parent")))
