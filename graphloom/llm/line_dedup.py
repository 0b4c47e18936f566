"""Line dedup (operator 9) by winnowing over line hashes.

The lines of a document are hashed; of every ``WINDOW`` consecutive hashes of ``GRAM`` lines the smallest is selected as
a fingerprint, so any run of WINDOW + GRAM - 1 lines that two places share is certain to give both the same
fingerprint. Fingerprints that occur once go. Around each of the others the match is extended both ways, a run of the
guaranteed length at a time: equal runs are grouped by their line hashes, never paired, and a run is deleted wherever it
also starts earlier, in a document of smaller doc_id or further up in the same one. Overlapping runs join up.

A line that is a passage by itself, of ``PASSAGE_WORDS`` words or ``PASSAGE_BYTES`` bytes, is a fingerprint and a run of
its own, whatever stands around it and however few lines its document has.

Defined results: lines are compared without leading and trailing spaces; lines of only spaces are never part of a run
and stay; a null text stays null; a text whose lines all go is empty; a null doc_id is later than all others; rows that
share doc_id and text get the same result, since neither is earlier; shorter runs, passages apart, and an empty table
lose nothing; all other columns pass through, whatever their names, but for columns named n_lines, n_removed or n_runs,
which ``line_dedup`` replaces and ``deduped`` keeps. Line identity is a 64-bit hash for each line of a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, cut, join_counted, numbered, table

GRAM = 1
WINDOW = 2
PASSAGE_WORDS = 50
#: About as many words of six bytes, for scripts that don't set words apart by spaces.
PASSAGE_BYTES = 300


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _numbers(lines: Column) -> Column:
    """Places of the lines that are not blank."""
    return F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())


def _passage(line: Column) -> Column:
    """Whether a line is a run of its own; words are counted only where there may be enough."""
    size = F.octet_length(line)
    return (size >= PASSAGE_BYTES) | ((size >= 2 * PASSAGE_WORDS - 1) & (F.regexp_count(line, F.lit(WORD)) >= PASSAGE_WORDS))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW, passages: bool = True) -> DataFrame:
    """doc_id, row (a hash of the text), the fingerprint, its position among the lines, and the runs around it."""
    run = gram + window - 1
    solid = F.filter(F.transform(_lines(text), lambda x: F.trim(x)), lambda x: x != "")
    hashed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("row"), F.transform(solid, lambda x: F.struct(F.xxhash64(x).alias("h"), (_passage(x) if passages else F.lit(False)).alias("alone"))).alias("l"))
    alone = F.filter(F.transform("l", lambda x, i: F.when(x["alone"], i)), lambda i: i.isNotNull())
    hashed = hashed.select("doc_id", "row", F.col("l.h").alias("h"), alone.alias("alone")).filter((F.size("h") >= run) | (F.size("alone") > 0))
    grams = F.col("h") if gram == 1 else F.when(F.size("h") >= gram, F.transform(F.sequence(F.lit(0), F.size("h") - gram), lambda i: F.xxhash64(F.slice("h", i + 1, gram)))).otherwise(F.array().cast("array<long>"))
    hashed = hashed.withColumn("g", grams)

    def least(i: Column) -> Column:
        part = F.slice("g", i + 1, window)
        return (i + F.array_position(part, F.array_min(part)) - 1).cast("int")

    def places(at: Column | str, size: int) -> Column:
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(size).alias("size")))

    least_ones = F.when(F.size("h") >= run, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("g") - window), least))).otherwise(F.array().cast("array<int>"))
    chosen = hashed.withColumn("place", F.explode(F.concat(places(least_ones, run), places("alone", 1)) if passages and run > 1 else places(least_ones, run))).select("*", "place.*")
    whole = F.col("size") == run
    first = F.when(whole, F.greatest(F.lit(0), F.col("at") + gram - run)).otherwise(F.col("at"))
    last = F.when(whole, F.least(F.col("at"), F.size("h") - run)).otherwise(F.col("at"))
    runs = F.transform(F.sequence(first, last), lambda s: F.struct(s.alias("start"), F.slice("h", s + 1, F.col("size")).alias("lines")))
    mark = F.when(whole, F.element_at("g", F.col("at") + 1)).otherwise(F.xxhash64(F.element_at("h", F.col("at") + 1), F.lit("alone")))
    return chosen.select("doc_id", "row", mark.alias("fingerprint"), "at", runs.alias("runs"))


def repeated_runs(prints: DataFrame) -> DataFrame:
    """doc_id, row and the numbers of the lines in runs that also start earlier."""
    shared = prints.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1")
    runs = join_counted(prints, shared, "fingerprint").select("doc_id", "row", F.explode("runs").alias("run")).select("doc_id", "row", "run.*")
    own = runs.groupBy("lines", "doc_id", "row").agg(F.collect_set("start").alias("starts"), F.min("start").alias("own_first"))
    first = own.groupBy("lines").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"), F.max(F.size("starts")).alias("most")).filter("n > 1 OR most > 1").select("lines", "first_doc", "n")
    later = F.coalesce(F.col("doc_id") > F.col("first_doc"), F.col("doc_id").isNull() & F.col("first_doc").isNotNull())
    starts = F.when(later, F.col("starts")).otherwise(F.filter("starts", lambda s: s > F.col("own_first")))
    found = join_counted(own, first, "lines").select("doc_id", "row", F.size("lines").alias("size"), starts.alias("starts")).filter(F.size("starts") > 0)
    hit = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("size") - 1)))
    return found.select("doc_id", "row", hit.alias("hit")).groupBy("doc_id", "row").agg(F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"))


def deduped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW, passages: bool = True) -> tuple[DataFrame, list[str]]:
    """``docs`` under numbered names, the text without its repeated runs, with n_lines, n_removed, n_runs; and those names.

    Fingerprints are made once and written; the texts are read for them and for the result.
    """
    rows, names = numbered(docs)
    key, body = (names[docs.columns.index(c)] for c in (doc_id, text))
    prints = cut(fingerprints(rows, key, body, gram, window, passages))
    found = repeated_runs(prints).select(F.col("doc_id").alias("line_doc"), F.col("row").alias("line_row"), F.col("hit").alias("line_found"))
    joined = rows.join(found, F.col(key).eqNullSafe(F.col("line_doc")) & (F.xxhash64(F.col(body)) == F.col("line_row")), "left")
    joined = joined.withColumn("line_list", _lines(body)).withColumn("line_numbers", _numbers(F.col("line_list"))).withColumn("line_hit", F.sort_array(F.coalesce("line_found", F.array().cast("array<int>"))))
    gone = F.transform("line_hit", lambda i: F.get("line_numbers", i))
    kept = F.array_except(F.sequence(F.lit(0), F.size("line_list") - 1), gone)
    runs = F.size(F.array_except("line_hit", F.transform("line_hit", lambda i: i + 1)))
    text_kept = F.when(F.col("line_found").isNull(), F.col(body)).otherwise(F.array_join(F.transform(kept, lambda i: F.get("line_list", i)), "\n"))
    counts = [F.size("line_numbers").cast("long").alias("n_lines"), F.size("line_hit").cast("long").alias("n_removed"), runs.cast("long").alias("n_runs")]
    return joined.select(*[text_kept.alias(n) if n == body else n for n in names], *counts), names


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW, passages: bool = True) -> DataFrame:
    """``docs`` with the text without its repeated runs, and n_lines, n_removed, n_runs."""
    rows, names = deduped(docs, doc_id, text, gram, window, passages)
    added = ["n_lines", "n_removed", "n_runs"]
    return rows.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c not in added], *added)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), numbered AS (
  SELECT r, doc_id, i AS line, l[i] AS raw, trim(l[i]) AS body FROM (SELECT r, doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM split)
), solid AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY line) AS k FROM numbered WHERE body <> ''
), runs AS (
  SELECT r, doc_id, k, body AS a, lead(body) OVER (PARTITION BY r ORDER BY k) AS b FROM solid
), ranked AS (
  SELECT *, min(doc_id) OVER (PARTITION BY a, b) AS first_doc, min(k) OVER (PARTITION BY a, b, r) AS own_first FROM runs WHERE b IS NOT NULL
), passages AS (
  SELECT r, doc_id, k, min(doc_id) OVER (PARTITION BY body) AS first_doc, min(k) OVER (PARTITION BY body, r) AS own_first
  FROM solid WHERE strlen(body) >= 300 OR len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) >= 50
), gone AS (
  SELECT r, unnest([k, k + 1]) AS k FROM ranked WHERE doc_id > first_doc OR k > own_first
  UNION SELECT r, k FROM passages WHERE doc_id > first_doc OR k > own_first
), marked AS (
  SELECT n.r, n.line, n.raw, s.k, g.k IS NOT NULL AS removed FROM numbered n LEFT JOIN solid s USING (r, line) LEFT JOIN gone g ON g.r = n.r AND g.k = s.k
), edges AS (
  SELECT *, removed AND NOT coalesce(lag(removed) OVER (PARTITION BY r ORDER BY k), false) AS opens FROM marked WHERE k IS NOT NULL
), counts AS (
  SELECT r, count(*) AS n_lines, sum(removed::INT) AS n_removed, sum(opens::INT) AS n_runs FROM edges GROUP BY r
), rebuilt AS (
  SELECT r, string_agg(raw, chr(10) ORDER BY line) AS text FROM marked WHERE NOT removed GROUP BY r
)
SELECT s.doc_id, CAST(coalesce(c.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(c.n_runs, 0) AS BIGINT) AS n_runs,
  sha256(coalesce(b.text, '')) AS kept_sha256
FROM split s LEFT JOIN counts c USING (r) LEFT JOIN rebuilt b USING (r)
"""
