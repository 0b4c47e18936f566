"""Many terms at once: which boxes hold all or any of them, and how far terms share their boxes.

Every box is given the set of asked terms that it holds, once; boxes of the same set are counted together before anything is
compared, so no pairs of rows are made, however many boxes two terms share. Where only counts over numbered boxes are asked,
posting lists are bitmaps: bits of boxes in buckets, combined by the bitmap aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.lookup import Refused
from graphloom.session import cut, shared_folder

CONTAINED = 0.999


def _terms(wanted: Sequence[str]) -> list[str]:
    asked = sorted(set(wanted))
    if not asked:
        raise Refused("no terms asked for")
    return asked


def held_sets(index: DataFrame, key: Sequence[str], wanted: Sequence[str], n: str = "n") -> DataFrame:
    """Of ``index(term, key..., n)``: the boxes that hold a wanted term, with the sorted terms ``held`` and their ``hits``."""
    return index.filter(F.col("term").isin(*_terms(wanted))).groupBy(*key).agg(F.array_sort(F.collect_set("term")).alias("held"), F.sum(n).alias("hits"))


def joint(index: DataFrame, key: Sequence[str], wanted: Sequence[str], session: str | None = None) -> DataFrame:
    """One row: boxes with all wanted terms, boxes with any of them, and of which sessions each."""
    boxes = held_sets(index, key, wanted)
    whole = F.size("held") == len(_terms(wanted))
    of = session or key[0]
    return boxes.agg(F.count_if(whole).alias("joint"), F.count("*").alias("any"), F.count_distinct(F.when(whole, F.col(of))).alias("joint_sessions"), F.count_distinct(of).alias("any_sessions"))


def overlap(footprint: DataFrame, container: str | Sequence[str], wanted: Sequence[str]) -> DataFrame:
    """Of ``footprint(term, container)``: for each ordered pair of wanted terms that share one, the shared containers, the first
    term's own, the share, and ``contained``: almost all of the first's containers hold the second, and not the other way."""
    key = [container] if isinstance(container, str) else list(container)
    asked = _terms(wanted)
    sets = footprint.filter(F.col("term").isin(*asked)).groupBy(*key).agg(F.array_sort(F.collect_set("term")).alias("held"))
    counted = cut(sets.groupBy("held").agg(F.count("*").alias("n")))  # what differs from here on are sets, not containers
    own = counted.select(F.explode("held").alias("term"), "n").groupBy("term").agg(F.sum("n").alias("own"))
    pairs = counted.select(F.explode("held").alias("term"), "held", "n").select("term", F.explode("held").alias("other"), "n").filter("term <> other")
    shared = pairs.groupBy("term", "other").agg(F.sum("n").alias("shared"))
    both = shared.join(own, "term").join(own.select(F.col("term").alias("other"), F.col("own").alias("others")), "other")
    contained = (F.col("shared") >= CONTAINED * F.col("own")) & (F.col("shared") < CONTAINED * F.col("others"))
    return both.select("term", "other", "shared", "own", F.round(F.col("shared") / F.col("own"), 6).alias("share"), contained.alias("contained"))


def fan_out(index: DataFrame, key: Sequence[str], wanted: Sequence[str], top: int | None = None) -> DataFrame:
    """Other terms in the boxes of the wanted ones: ``overlap`` (such boxes), ``percents`` (of each wanted term's boxes, by term)
    and ``joint_percent`` (of the boxes with all of them); the ``top`` by overlap, then term, both from the greatest."""
    asked = _terms(wanted)
    boxes = cut(held_sets(index, key, asked).select(*key, "held"))
    whole = F.size("held") == len(asked)
    own = boxes.agg(*[F.count_if(F.array_contains("held", t)).alias(f"o{i}") for i, t in enumerate(asked)], F.count_if(whole).alias("j")).first()
    met = index.filter(~F.col("term").isin(*asked)).select("term", *key).distinct().join(boxes, list(key))
    each = [F.count_if(F.array_contains("held", t)).alias(f"c{i}") for i, t in enumerate(asked)]
    counted = met.groupBy("term").agg(F.count("*").alias("overlap"), *each, F.count_if(whole).alias("jc"))
    percent = lambda c, n: F.round(100 * F.col(c) / F.lit(float(max(n, 1))), 6)
    percents = F.create_map(*[x for i, t in enumerate(asked) for x in (F.lit(t), percent(f"c{i}", own[f"o{i}"]))])
    out = counted.select("term", "overlap", percents.alias("percents"), percent("jc", own["j"]).alias("joint_percent"))
    return out if top is None else out.orderBy(F.col("overlap").desc(), F.col("term").desc()).limit(top)


def numbered(boxes: DataFrame, key: Sequence[str]) -> DataFrame:
    """The distinct boxes with a number each, from 0 and without holes, in the order of their key.

    Sorted once over all partitions and written; a box's number is its place in its partition and the rows of those before, of
    which there is a row per partition.
    """
    spark = boxes.sparkSession
    path = f"{shared_folder(spark)}/numbered-{spark.sparkContext.applicationId}-{id(boxes)}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    boxes.select(*key).distinct().orderBy(*key).withColumns({"part": F.spark_partition_id(), "place": place}).write.parquet(path)
    rows = spark.read.parquet(path)
    before = rows.groupBy("part").agg(F.count("*").alias("rows")).select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "part").select(*key, (F.col("before") + F.col("place")).alias("box"))


def bitmaps(index: DataFrame, boxes: DataFrame, key: Sequence[str], wanted: Sequence[str]) -> DataFrame:
    """term, bucket and bits of the wanted terms' posting lists, over ``boxes(key..., box)`` as ``numbered`` makes them."""
    held = index.filter(F.col("term").isin(*_terms(wanted))).select("term", *key).distinct().join(boxes, list(key))
    return held.groupBy("term", F.bitmap_bucket_number("box").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("box")).alias("bits"))


def joint_count(lists: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """One row: boxes with all wanted terms and boxes with any, from their bitmaps; a bucket that a term lacks has no joint box."""
    asked = _terms(wanted)
    both = lists.filter(F.col("term").isin(*asked)).groupBy("bucket").agg(F.count("*").alias("terms"), F.bitmap_count(F.bitmap_and_agg("bits")).alias("every"), F.bitmap_count(F.bitmap_or_agg("bits")).alias("some"))
    return both.agg(F.coalesce(F.sum(F.when(F.col("terms") == len(asked), F.col("every"))), F.lit(0)).alias("joint"), F.coalesce(F.sum("some"), F.lit(0)).alias("any"))


def footprint(matches: DataFrame, term: str = "term", file: str = "file", block: str = "block", line: str = "line") -> DataFrame:
    """term, file, block, matches and the first line of every container that a term stands in; what is in no block is in
    ``<module>``."""
    named = matches.withColumn(block, F.coalesce(block, F.lit("<module>")))
    return named.groupBy(term, file, block).agg(F.count("*").alias("matches"), F.min(line).alias("line"))
