"""Token counts (operator 4): an exact histogram of encoded lengths, and what suffix sums over it answer.

Documents are encoded whole and aggregated by length, so one row per distinct length remains, whatever the number of
documents. Suffix sums over those rows then answer totals, quantiles and truncated totals for every context limit
without reading a text again.

Defined results: a null or empty text has length 0; repeated rows count each; an empty table gives an empty histogram
whose totals are 0 and whose quantiles are null; other columns are never read.
"""

from __future__ import annotations

import ast
import base64
import os
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut, table

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Lengths per block of the two-level suffix sum.
BLOCK = 256


def splitting_pattern(folder: str) -> str:
    """The value of PATTERN in the folder's description of its files, read as a literal: nothing in it is run."""
    with open(os.path.join(folder, "__init__.py"), encoding="utf-8") as described:
        found = [x.value for x in ast.parse(described.read()).body if isinstance(x, ast.Assign) and any(getattr(t, "id", None) == "PATTERN" for t in x.targets)]
    return ast.literal_eval(found[0])


def vocabulary_of(folder: str = TOKENIZERS, name: str = VOCABULARY) -> tuple[str, bytes]:
    """The splitting pattern and the whole rank file, read where the driver runs."""
    with open(os.path.join(folder, name), "rb") as lines:
        return splitting_pattern(folder), lines.read()


@lru_cache(maxsize=2)
def _encoding(pattern: str, lines: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoding(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """The encoder of a public vocabulary file."""
    return _encoding(*vocabulary_of(folder, vocabulary))


def lengths(docs: DataFrame, text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The encoded length of each whole text. The vocabulary (under a megabyte) is shipped, so that executors need no folder."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary_of(folder, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(*shipped.value).encode_ordinary
        for batch in batches:
            counts = [len(encode(x)) if x else 0 for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], ["n_tokens"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "n_tokens long")


def histogram(counts: DataFrame) -> DataFrame:
    return counts.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length L in the histogram: documents and tokens at L or longer, and the total if all are cut at L.

    Sums run within blocks of ``BLOCK`` lengths, then over the blocks' totals, so no task sees all lengths.
    """
    blocked = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    totals = blocked.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    after, every = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    later = totals.select(
        "block",
        F.coalesce(F.sum("block_docs").over(after), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("block_tokens").over(after), F.lit(0)).alias("later_tokens"),
        F.sum("block_docs").over(every).alias("all_docs"),
        F.sum("block_tokens").over(every).alias("all_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = blocked.join(later, "block").withColumn("docs_at_least", F.sum("n_docs").over(within) + F.col("later_docs")).withColumn("tokens_at_least", F.sum("tokens").over(within) + F.col("later_tokens"))
    return summed.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        (F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_at_most"),
    )


def _unpacked(answers: DataFrame) -> DataFrame:
    return answers.select(F.explode("answers").alias("answer")).select("answer.*")


def totals_at(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """Documents, tokens, documents cut and tokens kept at each context limit, from one pass over the suffix sums."""
    zero = F.lit(0).cast("long")
    n_docs, n_tokens = F.coalesce(F.max("docs_at_least"), zero), F.coalesce(F.max("tokens_at_least"), zero)

    def at(limit: int):
        longer = F.col("n_tokens") > limit
        docs, tokens = F.coalesce(F.max(F.when(longer, F.col("docs_at_least"))), zero), F.coalesce(F.max(F.when(longer, F.col("tokens_at_least"))), zero)
        return F.struct(F.lit(int(limit)).cast("long").alias("context_limit"), n_docs.alias("n_docs"), n_tokens.alias("n_tokens"), docs.alias("docs_cut"), (n_tokens - tokens + limit * docs).alias("truncated_total"))

    return _unpacked(sums.agg(F.array(*map(at, limits)).alias("answers")))


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """The smallest length that at least the given share of documents doesn't exceed; null for an empty table.

    A length answers a share if the documents longer than it are at most the rest.
    """
    rest = sums.withColumn("longer", F.col("docs_at_least") - F.col("n_docs")).withColumn("n", F.col("docs_at_most") + F.col("longer"))
    found = [F.struct(F.lit(float(s)).alias("share"), F.min(F.when(F.col("docs_at_most") >= F.lit(float(s)) * F.col("n"), F.col("n_tokens"))).alias("length")) for s in shares]
    return _unpacked(rest.agg(F.array(*found).alias("answers")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(cut(histogram(lengths(table(spark, sf_dir, "documents")))))  # cut: texts are encoded once
