"""Mixing sources to target weights (operator 5), with DataFrame operations only.

Words are aggregated per source; a target for each source follows from the weights by filling up to a cap and sharing
the excess again; the repetition rate is target / size. A document is emitted floor(rate) times, plus once more if its
hash-seeded draw is below the fraction.

Defined results: a null or empty text has size 0 and takes 0 words; a null source is one source, ordered last; a
source of size 0 has target 0 and rate 0; repeated rows with one id share one draw; an empty table gives no rows; other
columns pass through ``mix`` and ``emit`` untouched, whatever their names; only a column that has the name of one which
``mix`` adds (size, source_size, target, rate, copies) is replaced by it, and ``mixed`` keeps even those.

What a source takes comes near its target as far as the draws allow: its variance is the sum of size squared times
fraction times (1 - fraction) over its documents, so a source with a few long documents may miss by a tenth or more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, cut, hint_small, numbered, table

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"
DRAW_BITS = 52
#: Columns that ``mix`` adds.
ADDED = ("size", "source_size", "target", "rate", "copies")


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("size", word_count(text))


def _in_order(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` sorted over all partitions and written, with the partition as ``part``: what windows can then run in."""
    return cut(rows.orderBy(*order).withColumn("part", F.spark_partition_id()))


def _earlier(rows: DataFrame, total: Column) -> DataFrame:
    """(part, earlier): the sum of ``total`` over all earlier parts; one row per part is in the window."""
    per = rows.groupBy("part").agg(total.alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(per.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("earlier")))


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, source: str = "source") -> DataFrame:
    """One row per source: size, weight, cap and target.

    Sorted by cap / weight, the sources that stop at their cap are a prefix: a source stops if what is left for it and
    all after it, shared by weight, reaches its cap. Ranks and running sums are taken in two levels, within the parts of
    a sorted table and over the parts' totals, so that no task sees all sources. Caps and weights are whole numbers in
    doubles, so sums don't depend on how they were parted.
    """
    per = sized.groupBy(F.col(source).alias("mix_source")).agg(F.sum("size").alias("source_size"))
    by_name = F.col("mix_source").asc_nulls_last()
    named = _in_order(per, [by_name])
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rank = F.row_number().over(Window.partitionBy("part").orderBy(by_name)) + F.col("earlier")
    ranked = named.join(_earlier(named, F.count("*")), "part").withColumn("rank", rank).withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.drop("part", "earlier").withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    order = [F.col("cap") / F.col("weight"), F.col("rank")]
    sorted_ = _in_order(ranked, order)
    total = sorted_.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    before = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    level = sorted_
    for column in ("cap", "weight"):
        level = level.join(_earlier(sorted_, F.sum(column)).withColumnRenamed("earlier", f"{column}_earlier"), "part")
    spent = F.coalesce(F.sum("cap").over(before), F.lit(0.0)) + F.col("cap_earlier")
    rest = F.lit(total["weight"]) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)) - F.col("weight_earlier")
    level = level.withColumn("level", (F.lit((total["size"] or 0) * float(share)) - spent) / rest)
    level = cut(level.withColumn("stops", F.col("cap") <= F.col("level") * F.col("weight")))
    first_open = level.filter(~F.col("stops")).agg(F.min(F.struct(F.col("cap") / F.col("weight"), "rank", "level")).alias("f")).first()["f"]
    filled = F.col("cap") if first_open is None else F.when(F.col("stops"), F.col("cap")).otherwise(F.lit(first_open["level"]) * F.col("weight"))
    return level.select("mix_source", "source_size", "weight", "cap", filled.alias("target"))


def draw(seed: str, doc_id: str = "doc_id"):
    """A number in [0, 1) fixed by the seed and the id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("long").cast("double") / F.lit(float(2**DRAW_BITS))


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, list[str]]:
    """``docs`` under numbered names, with size, source_size, target, rate and copies; and those names."""
    rows, names = numbered(docs)
    of = dict(zip(docs.columns, names, strict=True))
    per = cut(targets(rows.select(of[source], word_count(of[text]).alias("size")), weights, share, cap, of[source]))
    joined = rows.withColumn("size", word_count(of[text])).join(hint_small(per.select("mix_source", "source_size", "target"), per.count()), F.col(of[source]).eqNullSafe(F.col("mix_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor("rate")
    drawn = joined.withColumn("rate", rate).withColumn("copies", (whole + (draw(seed, of[doc_id]) < F.col("rate") - whole).cast("int")).cast("int"))
    return drawn.select(*names, *ADDED), names


def mix(docs: DataFrame, keep: Sequence[str] | None = None, **how) -> DataFrame:
    """``docs`` (or its columns ``keep``) with size, source_size, target, rate and copies; ``how`` as for ``mixed``."""
    rows, names = mixed(docs, **how)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    return rows.select(*[F.col(names[docs.columns.index(c)]).alias(c) for c in kept], *ADDED)


def emit(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, all its columns kept, with its number in ``copy``
    (``copy_2`` and so on where ``docs`` has such a column)."""
    rows, names = mixed(docs, **how)
    copy = next(c for c in ("copy", *(f"copy_{i}" for i in range(2, len(names) + 3))) if c not in docs.columns)
    taken = rows.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*names, "copy").toDF(*docs.columns, copy)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk, 1.5 * CAST(sum(source_size) OVER () AS DOUBLE) AS budget, 2.0 * CAST(source_size AS DOUBLE) AS cap FROM per
), weighted AS (
  SELECT *, CAST(CASE (rk - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight FROM ranked
), levelled AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM weighted
), open AS (
  SELECT arg_min(lvl, (cap / weight, rk)) AS lvl FROM levelled WHERE cap > lvl * weight
), targets AS (
  SELECT l.source, l.source_size, CASE WHEN l.cap <= l.lvl * l.weight OR o.lvl IS NULL THEN l.cap ELSE o.lvl * l.weight END AS target
  FROM levelled l CROSS JOIN open o
), drawn AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, size * (CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken,
  CAST(floor(rate) AS INTEGER) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS copies
FROM drawn
"""
