"""Importance resampling towards a target distribution (operator 13), in DataFrame functions alone.

Texts become arrays of word n-grams; each n-gram falls into one of ``BUCKETS`` by its crc32. Exploded buckets are counted
over all documents and over all target texts; a bucket's gain is the scaled logarithm of the ratio of the two smoothed
rates. The gain table has ``BUCKETS`` rows, so it is broadcast whatever the corpus; a document's weight is the sum of its
n-grams' gains. Gumbel noise drawn from a hash of the id makes the highest scores a sample without replacement. Ranks
come from one distributed sort: each row's place in its partition plus the rows of the partitions before.

Defined results: a null or empty text has no words; a document without n-grams weighs 0; only documents of ``MIN_WORDS``
words or more may be drawn; a null doc_id is drawn as the text ``null`` and stands after all others among equal scores;
rows that repeat a doc_id are drawn one by one, in any order; empty tables give no rows, and an empty target table gives
gains against a flat rate; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import CRC_TABLE_SQL, crc_sql, shared_folder, table

BUCKETS = 10_000
LENGTHS = (1, 1)
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
SCALE = 1000

_GAPS = "".join(chr(c) for c in range(128) if not (chr(c).isdigit() or chr(c).isalpha()))


def words_of(text: Column) -> Column:
    """Runs of digits, lower-cased letters and non-ASCII characters: all else becomes a space, at which texts are split."""
    folded = F.translate(text, string.ascii_uppercase + _GAPS, string.ascii_lowercase + " " * len(_GAPS))
    return F.filter(F.split(F.coalesce(folded, F.lit("")), " "), lambda w: w != "")


def grams_of(words: Column, low: int, high: int) -> Column:
    """All runs of ``low`` to ``high`` words, joined by one space, repeats kept."""
    if (low, high) == (1, 1):
        return words

    def runs(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.concat(*[runs(n) for n in range(low, high + 1)])


def bucketed(texts: DataFrame, carry: list[Column], text: str = "text", lengths: tuple[int, int] = LENGTHS, buckets: int = BUCKETS) -> DataFrame:
    """The columns ``carry``, n_words, and the buckets of all n-grams as an array of ints, one row per text."""
    worded = texts.select(*carry, words_of(F.col(text)).alias("graphloom_words"))
    grams = grams_of(F.col("graphloom_words"), *lengths)
    names = [c for c in worded.columns if c != "graphloom_words"]
    return worded.select(*names, F.size("graphloom_words").cast("long").alias("n_words"), F.transform(grams, lambda g: (F.crc32(g) % buckets).cast("int")).alias("buckets"))


def bucket_counts(rows: DataFrame, name: str) -> DataFrame:
    """How many n-grams fall into each bucket that has any; counted in the tasks before the shuffle."""
    return rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def gain_table(source: DataFrame, target: DataFrame, buckets: int = BUCKETS, scale: int = SCALE) -> DataFrame:
    """bucket and gain of all buckets, from the counts ``s`` and ``t`` of those that have any."""
    total = lambda c: F.coalesce(F.sum(c).over(Window.partitionBy()), F.lit(0)).cast("double")  # noqa: E731  over the buckets alone
    both = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(source, "bucket", "left").join(target, "bucket", "left").fillna(0, ["s", "t"])
    ratio = ((F.col("t") + 1) * (total("s") + buckets)) / ((F.col("s") + 1) * (total("t") + buckets))
    return both.select("bucket", F.floor(scale * F.log(ratio)).alias("gain"))


def noise(doc_id: Column, seed: str = SEED, scale: int = SCALE) -> Column:
    """Gumbel noise from the first 32 bits of the sha256 of seed and id, scaled and rounded down."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighed(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", lengths: tuple[int, int] = LENGTHS, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """doc_id, row (a number of the row), n_words, n_features, weight and score of every document.

    Buckets are written once and read by both passes, two bytes an n-gram or less.
    """
    folder = shared_folder(docs.sparkSession, "importance")
    carry = [F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row")]
    bucketed(docs, carry, text, lengths, buckets).write.parquet(folder)
    rows = docs.sparkSession.read.parquet(folder)
    gains = gain_table(bucket_counts(rows, "s"), bucket_counts(bucketed(target, [], target_text, lengths, buckets), "t"), buckets)
    each = rows.select("row", F.explode("buckets").alias("bucket")).join(F.broadcast(gains), "bucket")  # BUCKETS rows, a fixed number
    sums = each.groupBy("row").agg(F.sum("gain").alias("weight"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_features"), F.lit(0).alias("of"))
    own = rows.select("row", F.lit(0).cast("long").alias("weight"), "doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), F.lit(1).alias("of"))
    merged = own.unionByName(sums).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"), F.sum("n_features").alias("n_features"), F.sum("weight").alias("weight"))
    return merged.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def ranked(rows: DataFrame, eligible: Column, by: list[Column]) -> DataFrame:
    """``rows`` with ``eligible``, and in ``place`` 1, 2, 3... of the eligible in the order ``by`` (null for others).

    Sorted once over all partitions and written; a row's place is its number in its partition and the rows before that.
    What is summed without a key is a row per partition.
    """
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, "ranked")
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = rows.withColumn("eligible", eligible).orderBy(F.col("eligible").desc(), *by)
    ordered.withColumns({"part": F.spark_partition_id(), "inside": inside}).write.parquet(folder)
    held = spark.read.parquet(folder)
    parts = held.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("part", before.alias("before"))
    joined = held.join(F.broadcast(offsets), "part")  # a row per partition of the sort
    return joined.withColumn("place", F.when(F.col("eligible"), F.col("before") + F.col("inside") + 1)).drop("part", "inside", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, **how) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; rank is null for those not drawn.

    Drawn are ``percent`` of the documents of ``min_words`` words or more; ``how`` as for ``weighed``.
    """
    scored = weighed(docs, target, **how)
    found = ranked(scored, F.col("n_words") >= min_words, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")])
    drawn = found.agg(F.count_if("eligible").alias("n")).first()["n"] * percent // 100
    return found.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


ORACLE = rf"""
WITH RECURSIVE {CRC_TABLE_SQL},
worded AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), aimed AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), seen AS (
  SELECT r, unnest(w) AS f FROM worded
), aim AS (
  SELECT unnest(w) AS f FROM aimed
), vocabulary AS (
  SELECT f, {crc_sql('f')} % {BUCKETS} AS bucket FROM (SELECT f FROM seen UNION SELECT f FROM aim), crc_table
), s AS (
  SELECT bucket, count(*) AS n FROM seen JOIN vocabulary USING (f) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS n FROM aim JOIN vocabulary USING (f) GROUP BY bucket
), totals AS (
  SELECT (SELECT count(*) FROM seen)::DOUBLE AS big_s, (SELECT count(*) FROM aim)::DOUBLE AS big_t
), gains AS (
  SELECT bucket, floor({SCALE} * ln(((coalesce(t.n, 0) + 1) * (big_s + {BUCKETS})) / ((s.n + 1) * (big_t + {BUCKETS}))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket) CROSS JOIN totals
), weights AS (
  SELECT r, sum(gain)::BIGINT AS weight FROM seen JOIN vocabulary USING (f) JOIN gains USING (bucket) GROUP BY r
), scored AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-{SCALE} * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM worded LEFT JOIN weights USING (r)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id ASC NULLS LAST) AS place FROM scored
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= {MIN_WORDS} AND place <= (SELECT count(*) * {PERCENT} // 100 FROM scored WHERE n_features >= {MIN_WORDS}) THEN place END AS rank
FROM placed
"""
