"""Quality rules at host level (operator 10).

Each document is measured and tested by the base rules; failures are aggregated per host; each host's failure rate is
shrunk towards the rate of all hosts by a beta prior whose parameters are fitted to the hosts by moments; the host's
verdict is joined back to its documents. A host is rejected if its posterior says so beyond doubt: the shrunk rate, less
``SURE`` standard deviations of the posterior, is above ``TIMES`` the rate of all documents, or above ``MAX_HOST_RATE``
where that is less. A host of few documents is shrunk so far that it takes many failures to reject it.

Defined results: a null or empty text has no words, so it fails the base rules; null hosts are one host; repeated rows
count each; an empty table gives no rows; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import cut, hint_small, table

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A host is rejected if its failure rate is surely above so many times that of all documents, or above this rate.
TIMES = 2.0
MAX_HOST_RATE = 0.5
#: Standard deviations of the posterior that make it sure (95 % of a normal one).
SURE = 1.645
SLICE_BYTES = 1 << 20

_NOT_CONTINUATION = np.array([(b & 0xC0) != 0x80 for b in range(256)])
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that the text holds at least twice, the first one included.

    Windows are named exactly, by doubling: a name for each word, then for each pair of names, and so on.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    index: dict[bytes, int] = {}
    names = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    width = 1
    while width < window:
        names = names[:-width] * (int(names.max()) + 1) + names[width:]
        names = np.unique(names, return_inverse=True)[1]
        width *= 2
    twice = np.bincount(names)[names] > 1
    change = np.zeros(len(words) + 1, np.int64)
    change[:n] += twice
    change[window:] -= twice
    return int((np.cumsum(change[:-1]) > 0).sum())


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def measure(data: bytes) -> tuple[int, int, int, int, int]:
    words = data.split()  # bytes split at ASCII white space, which is what a word ends at
    raw = np.frombuffer(data, np.uint8)
    chars = int(_NOT_CONTINUATION[raw].sum()) - sum(map(data.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    return len(words), chars, int(_SYMBOL[raw].sum()), duplicate_lines(data), repeated_words(words)


def base_counts(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """The columns ``carry`` with the base counts of each whole text."""
    names = [part.split()[0] for part in BASE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(x.as_py() or b"") for x in batch.column(batch.num_columns - 1)]
            counts = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *counts], [*carry, *names])

    read = docs.select(*carry, F.encode(F.col(text), "UTF-8").alias("graphloom_text"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return read.mapInArrow(run, f"{schema}, {BASE}")


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """alpha and beta by moments from one row per host with n and failed.

    The variance of the hosts' rates, weighted by n, less what sampling alone gives, sets the prior's weight. Without
    any spread beyond sampling, the prior weighs as much as the whole table. One row reaches the driver.
    """
    total = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("square"), F.sum(F.col("n").cast("double") ** 2).alias("n2"), F.count("*").alias("hosts")).first()
    if not total["n"]:
        return 1.0, 1.0
    n, mean = float(total["n"]), total["failed"] / total["n"]
    if mean in (0.0, 1.0):
        return mean * n + 1e-9, (1 - mean) * n + 1e-9
    spread = total["square"] - n * mean**2  # sum of n (rate - mean) squared
    between = (spread - (total["hosts"] - 1) * mean * (1 - mean)) / max(n - total["n2"] / n, 1e-9)
    weight = mean * (1 - mean) / between - 1 if between > 0 else n
    weight = min(max(weight, 1.0), n)
    return mean * weight, (1 - mean) * weight


def host_rates(failures: DataFrame, host: str = "host", times: float = TIMES, max_rate: float = MAX_HOST_RATE, sure: float = SURE) -> DataFrame:
    """One row per host: n, failed, the shrunk rate and whether the host is rejected; ``failures`` has the host and the
    boolean base_failed."""
    hosts = cut(failures.groupBy(host).agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")))
    alpha, beta = beta_prior(hosts)
    rated = hosts.withColumn("host_rate", (F.col("failed") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta)))
    spread = F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (F.col("n") + F.lit(alpha + beta + 1)))
    return rated.withColumn("host_rejected", F.col("host_rate") - sure * spread > F.lit(min(max_rate, times * alpha / (alpha + beta))))


def host_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", times: float = TIMES, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """doc_id, the base counts, base_failed, the host's shrunk rate and verdict, and kept, one row per document."""
    base = base_counts(docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text")), ["doc_id", "host"])
    base = cut(base.withColumn("base_failed", base_failed()))
    rates = host_rates(base.select("host", "base_failed"), times=times, max_rate=max_rate)
    rates = rates.select(F.col("host").alias("rated_host"), "host_rate", "host_rejected")
    joined = base.join(hint_small(rates, rates.count()), F.col("host").eqNullSafe(F.col("rated_host")))
    counts = [p.split()[0] for p in BASE.split(", ")]
    return joined.select("doc_id", *counts, "base_failed", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"), F.round("host_rate", 9).alias("host_rate"), "host_rejected")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules(table(spark, sf_dir, "documents")).drop("host_rate", "host_rejected")


ORACLE = r"""
WITH worded AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT r, unnest(range(1, len(w) - 6)) AS i, w FROM worded WHERE len(w) >= 8
), named AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i:i + 7]) AS c FROM windows
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM named WHERE c > 1) GROUP BY r
), lines AS (
  SELECT r, l FROM (SELECT r, unnest(string_split(body, chr(10))) AS l FROM worded) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT r, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY r
), base AS (
  SELECT d.doc_id, d.source, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(d.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(d.body, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(u.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM worded d LEFT JOIN dup u USING (r) LEFT JOIN covered c USING (r)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base
), hosts AS (
  SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM judged GROUP BY source
), total AS (
  SELECT sum(n) AS n, sum(f) / sum(n) AS m, sum(f * f / n) AS sq, sum(n * n) AS n2, count(*) AS h FROM hosts
), spread AS (
  SELECT *, (sq - n * m * m - (h - 1) * m * (1 - m)) / greatest(n - n2 / n, 1e-9) AS v FROM total
), prior AS (
  SELECT m, CASE WHEN m IN (0, 1) THEN n ELSE least(greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE n END, 1), n) END AS k FROM spread
), shrunk AS (
  SELECT source, n, (f + m * k) / (n + k) AS rate, m, k FROM hosts CROSS JOIN prior
), verdicts AS (
  SELECT source, rate - 1.645 * sqrt(rate * (1 - rate) / (n + k + 1)) > least(0.5, 2 * m) AS rejected FROM shrunk
)
SELECT j.doc_id, j.n_words, j.word_chars, j.n_symbols, j.n_dup_lines, j.n_repeat_words, j.base_failed,
  NOT j.base_failed AND NOT h.rejected AS kept
FROM judged j JOIN verdicts h ON j.source IS NOT DISTINCT FROM h.source
"""
