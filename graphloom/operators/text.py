"""Lexical operators: postings, searches, token clusters, spans, co-occurrence and exchanges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.session import cut

#: Boxes of several rows that are broadcast; more are joined by shuffle.
FEW = 200_000
TERM = r"([A-Za-z][A-Za-z0-9_.-]{2,})"
#: Terms that are not indexed; fixed values.
STOP = (
    "the", "and", "for", "are", "was", "were", "been", "being", "have", "has",
    "had", "does", "did", "will", "would", "could", "should", "can", "may",
    "might", "must", "shall", "not", "with", "from", "this", "that", "these",
    "those", "there", "here", "then", "than", "them", "they", "their", "its",
    "it's", "into", "onto", "over", "under", "about", "after", "before",
    "between", "through", "during", "each", "every", "both", "other", "another",
    "such", "same", "some", "any", "all", "more", "most", "less", "many",
    "few", "now", "just", "only", "very", "really", "actually", "already",
    "still", "even", "ever", "never", "also", "too", "you", "your", "our",
    "what", "when", "where", "how", "why", "who", "which", "but", "out",
    "one", "two", "three", "new", "get", "got", "let", "lets", "like",
    "user", "assistant", "yes", "yeah", "okay", "don", "doesn", "isn",
    "want", "need", "make", "made", "use", "used", "using", "way", "thing",
    "things", "right", "good", "back", "see", "say", "said", "know",
)


def terms(c: Column) -> Column:
    """Lower-cased terms of three characters or more, without trailing dots and hyphens, in order."""
    found = F.transform(F.regexp_extract_all(c, F.lit(TERM), 1), lambda t: F.regexp_replace(F.lower(t), "[.-]+$", ""))
    return F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(*STOP))


def distinct_terms(c: Column) -> Column:
    """The distinct ones of ``terms``, among them empty and short strings and stop words: no step goes term by term, so that
    these are left to a filter of what is exploded."""
    found = F.array_join(F.array_distinct(F.regexp_extract_all(c, F.lit(TERM), 1)), " ")
    return F.array_distinct(F.split(F.regexp_replace(F.lower(found), r"(?<![.-])[.-]++(?= |$)", ""), " "))


def counted_terms(boxes: DataFrame, session: str, box: Sequence[str], text: str = "text", few: int = FEW) -> DataFrame:
    """term, session and n: over a term's sessions, ``n`` adds up to the boxes that hold it.

    Boxes of one row are counted where they are read, so that no postings are shuffled; only those of boxes that several
    rows share are made distinct.
    """
    key, named = list(box), F.lit(True)
    for c in key:
        named = named & F.col(c).isNotNull()
    shared = cut(boxes.filter(named).groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1").select(*key))
    n = shared.count()
    held = lambda rows: rows.select(session, *[c for c in key if c != session], F.explode(distinct_terms(F.col(text))).alias("term")).filter((F.length("term") >= 3) & ~F.col("term").isin(*STOP))
    if not n:
        return held(boxes).groupBy("term", session).agg(F.count_if(named).alias("n"))
    shared = F.broadcast(shared) if n <= few else shared
    once = held(boxes.join(shared, key, "left_anti")).groupBy("term", session).agg(F.count_if(named).alias("n"))
    often = held(boxes.join(shared, key, "left_semi")).distinct()
    where = often.select("term", session).distinct().withColumn("n", F.lit(0).cast("long"))
    parts = often.select("term", *key).distinct().groupBy("term").agg(F.count("*").alias("n")).select("term", F.lit(None).cast(boxes.schema[session].dataType).alias(session), "n")
    return once.unionByName(where).unionByName(parts)


def postings(boxes: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """term, the box's key and how often the box holds the term."""
    return boxes.select(*key, F.explode(terms(F.col(text))).alias("term")).groupBy("term", *key).agg(F.count("*").alias("n"))


def search(index: DataFrame, key: Sequence[str], wanted: Sequence[str], how: str = "all") -> DataFrame:
    """Boxes that hold all (or any) of the terms, with their hits."""
    found = index.filter(F.col("term").isin(*wanted)).groupBy(*key).agg(F.sum("n").alias("hits"), F.count_distinct("term").alias("held"))
    return found.filter(F.col("held") >= (len(set(wanted)) if how == "all" else 1)).select(*key, "hits")


def heat(index: DataFrame, key: Sequence[str], wanted: str, top: int | None = None) -> DataFrame:
    """Terms that share boxes with one: the boxes they share and the percentage of that term's own."""
    own = index.filter(F.col("term") == wanted).select(*key)
    met = index.filter(F.col("term") != wanted).join(own, list(key), "left_semi").groupBy("term").agg(F.count("*").alias("shared"))
    n = own.count()
    out = met.withColumn("percent", F.round(100 * F.col("shared") / F.lit(float(max(n, 1))), 6))
    return out if top is None else out.orderBy(F.col("shared").desc(), "term").limit(top)


def chain(index: DataFrame, session: str, box: str, wanted: str) -> DataFrame:
    """A term through time: per session its hits, first and last box and the box with most."""
    return index.filter(F.col("term") == wanted).groupBy(session).agg(F.sum("n").alias("hits"), F.min(box).alias("first"), F.max(box).alias("last"), F.min(F.struct((-F.col("n")).alias("m"), F.col(box).alias("b"))).alias("top")).select(session, "hits", "first", "last", F.col("top.b").alias("hottest"))


def positions(docs: DataFrame, doc_id: str, text: str = "text") -> DataFrame:
    """doc_id, pos and the lower-cased word at it, words being runs of ASCII letters and digits."""
    return docs.select(F.col(doc_id), F.posexplode(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)).alias("pos", "word"))


def clusters(words: DataFrame, doc_id: str, main: str, partner: str, window: int) -> DataFrame:
    """Islands of hits of two words whose gaps are at most ``window``; those without the main word go.

    The filter runs before the window, so a partition holds one document's hits, not its words.
    """
    hits = words.filter(F.col("word").isin(main, partner))
    order = Window.partitionBy(doc_id).orderBy("pos")
    flagged = hits.withColumn("new", F.coalesce((F.col("pos") - F.lag("pos").over(order) > window).cast("int"), F.lit(1)))
    grouped = flagged.withColumn("cluster", F.sum("new").over(order)).groupBy(doc_id, "cluster").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count_if(F.col("word") == main).alias("hits"), F.count_if(F.col("word") == partner).alias("partners"))
    density = 100.0 * (F.col("hits") + F.col("partners")) / F.greatest(F.lit(1), F.col("end") - F.col("start") + 1 + 2 * window)
    return grouped.filter("hits > 0").select(doc_id, "start", "end", "hits", "partners", F.round(density, 6).alias("density"))


def file_heat(words: DataFrame, doc_id: str, main: str, partner: str) -> DataFrame:
    found = words.groupBy(doc_id).agg(F.count_if(F.col("word") == main).alias("hits"), F.count_if(F.col("word") == partner).alias("partners"), F.count("*").alias("tokens"))
    return found.filter("hits > 0").withColumn("heat", F.round(1000.0 * (F.col("hits") + F.col("partners")) / F.greatest(F.lit(1), "tokens"), 6))


def merge_spans(spans: DataFrame, key: str, gap: int = 50) -> DataFrame:
    """Spans of a key joined where the next starts within ``gap`` of what was covered so far."""
    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = spans.withColumn("new", F.coalesce((F.col("start") - reach > gap).cast("int"), F.lit(1)))
    return flagged.withColumn("chunk", F.sum("new").over(order)).groupBy(key, "chunk").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("spans")).drop("chunk")


def containing(hits: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """The innermost block of each hit: half-open spans, named before nameless, then the shortest."""
    met = hits.join(blocks, key).filter((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end")))
    return met.groupBy(key, "pos").agg(F.min_by("name", F.struct(F.col("name").isNull(), F.col("end") - F.col("start"), "start")).alias("block"))


def cooccurrence(footprint: DataFrame, container: str) -> DataFrame:
    """Of ``footprint(term, container)``: shared containers of each ordered pair and the share of the first's own."""
    own = footprint.select("term", container).distinct()
    size = own.groupBy("term").agg(F.count("*").alias("n"))
    other = own.select(F.col("term").alias("other"), container)
    met = own.join(other, container).filter("term <> other").groupBy("term", "other").agg(F.count("*").alias("shared"))
    return met.join(size, "term").select("term", "other", "shared", F.round(F.col("shared") / F.col("n"), 6).alias("share"))


def nearest_gap(words: DataFrame, doc_id: str, a: str, b: str) -> DataFrame:
    """The least distance between two words in each document, by one ordered pass over the hits of both."""
    order = Window.partitionBy(doc_id).orderBy("pos")
    hits = words.filter(F.col("word").isin(a, b))
    gap = F.when(F.lag("word").over(order) != F.col("word"), F.col("pos") - F.lag("pos").over(order))
    return hits.withColumn("gap", gap).groupBy(doc_id).agg(F.min("gap").alias("gap")).filter("gap IS NOT NULL")


def exchanges(turns: DataFrame, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Consecutive turns of one role merged, an empty line between; a user run and the assistant run after it make an
    exchange, as does an assistant run that no user run precedes; numbered from 1."""
    order = Window.partitionBy(session).orderBy(turn)
    talk = turns.filter(F.col("role").isin("user", "assistant"))
    flagged = talk.withColumn("new", F.coalesce((F.lag("role").over(order) != F.col("role")).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(order))
    merged = flagged.groupBy(session, "run", "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col("text").alias("x")))), lambda s: s["x"]), "\n\n").alias("text"))
    by_run = Window.partitionBy(session).orderBy("run")
    asked = F.col("role") == "user"
    answer = F.when(~asked, F.col("text")).when(F.lead("role").over(by_run) == "assistant", F.lead("text").over(by_run))
    paired = merged.withColumn("answer", answer).withColumn("alone", F.lag("role").over(by_run).isNull()).filter(asked | F.col("alone"))
    return paired.select(session, F.row_number().over(by_run).alias("n"), F.when(asked, F.col("text")).otherwise("").alias("user"), F.coalesce("answer", F.lit("")).alias("assistant"))


def tail(found: DataFrame, session: str, budget: int, overhead: int = 80) -> DataFrame:
    """The newest exchanges within a character budget, at least one."""
    newest = Window.partitionBy(session).orderBy(F.col("n").desc())
    cost = F.sum(F.length("user") + F.length("assistant") + overhead).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("cost", cost).withColumn("age", F.row_number().over(newest)).filter((F.col("cost") <= budget) | (F.col("age") == 1)).select(session, "n", "cost")


def liveness(kinds: DataFrame, key: str) -> DataFrame:
    """The verdict on each key from ``kinds(key, kind)``: where its hits stand (live, prose, test, slop or doc)."""
    counts = kinds.groupBy(key).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("live", "prose", "test", "slop", "doc")])
    return counts.withColumn("verdict", C.liveness(F.col("live"), F.col("prose"), F.col("test") + F.col("slop") + F.col("doc")))


def neighbour_terms(boxes: DataFrame, wanted: str, top: int = 20, least: int = 2) -> DataFrame:
    """term and n: boxes that hold a term beside a wanted one, each counted once a box; the ``top`` of those in ``least`` or
    more, by count, then term."""
    held = boxes.select(F.array_distinct(terms(F.col("text"))).alias("t")).filter(F.array_contains("t", wanted))
    met = held.select(F.explode("t").alias("term")).filter(F.col("term") != wanted).groupBy("term").agg(F.count("*").alias("n"))
    return met.filter(F.col("n") >= least).orderBy(F.col("n").desc(), "term").limit(top)
