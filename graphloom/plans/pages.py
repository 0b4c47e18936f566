"""A journal's pages, each a file of its own that is written once.

A page is numbered by the first free number of its journal: it is tried under the next one, and under the one after that if
another writer came first, so concurrent appends lose no page and share no number. A page that names its ``token`` is
appended once, however often it is sent. What was born and died reaches the page from frames: counts are whole, the lists
are sorted and bounded.

A journal is torn when a number is missing, a file isn't a page, or a page has another number than its file; questions refuse
a torn journal unless asked to answer all the same.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.lookup import Refused
from graphloom.plans import claims

NODE_CAP, EDGE_CAP = 5_000, 2_000
#: Fields that stand for an edge's missing target, the first that is there; fixed values.
FOR_TARGET = ("dst_repr", "name", "alias")
EDGE = "array<struct<src:string,edge_type:string,dst:string>>"
PAGE = f"journal string, seq long, ts timestamp, cursor string, prev_cursor string, bootstrap boolean, dirty boolean, token string, gap_after_seq long, truncated boolean, n_born long, n_died long, n_eborn long, n_edied long, born array<string>, died array<string>, eborn {EDGE}, edied {EDGE}"


def cursor(text: str | None) -> str | None:
    """Hexadecimal cursors of 8 to 40 digits are cut to eight."""
    plain = text is not None and 8 <= len(text) <= 40 and all(c in "0123456789abcdef" for c in text)
    return text[:8] if plain else text


def edge_keys(edges: DataFrame) -> DataFrame:
    """src, edge_type and dst of every edge, once each; an edge without a target goes by ``~field:value`` of the first of
    ``FOR_TARGET`` that it has."""
    spare: list[Column] = [F.concat(F.lit(f"~{name}:"), F.col(name).cast("string")) for name in FOR_TARGET if name in edges.columns]
    return edges.select("src", "edge_type", F.coalesce("dst", *spare).alias("dst")).distinct()


def changes_between(before: DataFrame, after: DataFrame, edges_before: DataFrame, edges_after: DataFrame) -> DataFrame:
    """``laned``'s changes (kind, change, id, src, dst, edge_type) between two snapshots, edges by ``edge_keys``; one pass over
    either kind of key."""

    def moved(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
        both = old.select(*key).distinct().withColumn("side", F.lit(1)).unionByName(new.select(*key).distinct().withColumn("side", F.lit(2)))
        told = both.groupBy(*key).agg(F.sum("side").alias("side")).filter("side < 3")
        return told.withColumn("change", F.when(F.col("side") == 2, "born").otherwise("died")).drop("side")

    none = F.lit(None).cast("string")
    nodes = moved(before, after, ["id"]).select(F.lit("node").alias("kind"), "change", "id", none.alias("src"), none.alias("dst"), none.alias("edge_type"))
    edges = moved(edge_keys(edges_before), edge_keys(edges_after), ["src", "edge_type", "dst"])
    return nodes.unionByName(edges.select(F.lit("edge").alias("kind"), "change", none.alias("id"), "src", "dst", "edge_type"))


def _folder(home: str, journal: str) -> str:
    return f"{home}/journals/{journal}"


def tail(spark: SparkSession, home: str, journal: str) -> tuple[int, str | None]:
    """The last number of a journal and the cursor of its page; 0 and None before the first."""
    held = claims.numbers(spark, _folder(home, journal))
    if not held:
        return 0, None
    try:
        return held[-1], json.loads(claims.read(spark, f"{_folder(home, journal)}/{claims.numbered(held[-1])}")).get("cursor")
    except ValueError:
        raise Refused(f"the last page of {journal} can't be read") from None


def _lists(changes: DataFrame) -> dict:
    """Counts and bounded lists of a page; lists are cut at the caps by sorting, so at most so many rows arrive."""
    counts = {(r["kind"], r["change"]): r["n"] for r in changes.groupBy("kind", "change").agg(F.count("*").alias("n")).collect()}
    page: dict = {"truncated": False}
    for kind, cap, mark in (("node", NODE_CAP, ""), ("edge", EDGE_CAP, "e")):
        for change in ("born", "died"):
            n = page[f"n_{mark}{change}"] = counts.get((kind, change), 0)
            page["truncated"] |= n > cap
            if n:
                rows = changes.filter((F.col("kind") == kind) & (F.col("change") == change))
                if kind == "node":
                    page[change] = [r["id"] for r in rows.orderBy("id").limit(cap).collect()]
                else:
                    page[f"e{change}"] = [r.asDict() for r in rows.select("src", "edge_type", "dst").orderBy("src", "edge_type", "dst").limit(cap).collect()]
    return page


def append(spark: SparkSession, home: str, journal: str, changes: DataFrame, at: str | None, before: str | None, bootstrap: bool = False, dirty: bool | None = None, token: str | None = None, ts: str | None = None) -> dict:
    """Append the page of one step from the cursor ``before`` to ``at``; a page already there under the token is returned.

    A bootstrap page has counts and no lists. ``gap_after_seq`` marks a page whose ``before`` isn't where the journal stood.
    """
    page = {"journal": journal, "ts": ts or datetime.now(UTC).isoformat(timespec="seconds"), "cursor": cursor(at), "prev_cursor": cursor(before), "bootstrap": bootstrap, "dirty": dirty, "token": token} | _lists(changes)
    if bootstrap:
        page = {k: v for k, v in page.items() if k not in ("born", "died", "eborn", "edied")} | {"truncated": False}
    seen = 0
    while True:
        held = claims.numbers(spark, _folder(home, journal))
        for number in (n for n in held if n > seen) if token is not None else ():
            kept = json.loads(claims.read(spark, f"{_folder(home, journal)}/{claims.numbered(number)}"))
            if kept.get("token") == token:
                return kept
        seen = held[-1] if held else 0
        last, stood = tail(spark, home, journal)
        full = page | {"seq": last + 1} | ({"gap_after_seq": last} if last and page["prev_cursor"] != stood else {})
        if claims.claim(spark, f"{_folder(home, journal)}/{claims.numbered(last + 1)}", json.dumps(full)):
            return full


def torn(spark: SparkSession, home: str) -> DataFrame:
    """journal, seq and why of what is wrong: ``not a page``, ``numbered otherwise``, or ``missing`` before that number."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(f"{home}/journals")
    path = F.col("_metadata.file_path")
    named = raw.select(F.element_at(F.split(path, "/"), -2).alias("journal"), F.regexp_extract(path, r"([0-9]+)\.json$", 1).cast("long").alias("seq"), F.from_json("value", PAGE).alias("p"))
    before = F.lag("seq", 1, 0).over(Window.partitionBy("journal").orderBy("seq"))
    why = F.when(F.col("p.seq").isNull(), "not a page").when(F.col("p.seq") != F.col("seq"), "numbered otherwise").when(F.col("before") + 1 < F.col("seq"), "missing")
    return named.withColumn("before", before).select("journal", "seq", why.alias("why")).filter("why IS NOT NULL")


def read(spark: SparkSession, home: str, journal: str | None = None, allow_torn: bool = False) -> DataFrame:
    """The pages of all journals of a home, or of one; refuses a torn one, or leaves out what isn't a page if allowed."""
    wrong = torn(spark, home)
    wrong = (wrong if journal is None else wrong.filter(F.col("journal") == journal)).orderBy("journal", "seq").head(1)
    if wrong and not allow_torn:
        raise Refused(f"journal {wrong[0]['journal']} is torn at {wrong[0]['seq']}: {wrong[0]['why']}")
    where = _folder(home, journal) if journal else f"{home}/journals"
    return spark.read.schema(PAGE).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(where).filter("seq IS NOT NULL")
