"""What the corpus operators share: reading tables, cutting lineage, and hashing byte strings in numpy."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast once it has been counted; beyond it the plan joins by shuffle.
BROADCAST_ROWS = 200_000

#: Partitions over which the rows of a hot key are spread.
SALTS = 64

#: A word of whole-text counts: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: CTEs for DuckDB's SQL, which has no crc32: the table of the usual polynomial, made by its rule.
CRC_TABLE_SQL = """crc_step(b, k, v) AS (
  SELECT b::UBIGINT, 0, b::UBIGINT FROM range(256) x(b)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM crc_step WHERE k < 8
), crc_table AS (SELECT list(v ORDER BY b) AS t FROM crc_step WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """DuckDB's SQL for the crc32 of an expression's UTF-8 bytes, with ``t`` of ``CRC_TABLE_SQL`` in scope."""
    data = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ('0x' || hex(encode({text})[i:i]))::UBIGINT)"
    step = "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {data}), {step}), 4294967295::UBIGINT)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or what the context was given.

    A local one is set only in a session that is local itself, where neither is set; a cluster's is refused.
    """
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.nonEmpty() else None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "graphloom-checkpoints")
    if held.isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a table, under the shared one."""
    return f"{_shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder that driver and executors share, cutting its lineage."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Let the shuffle files of a query go as soon as it ends, where Spark knows the setting; for what is written at once."""
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Hand so many rows at once to Python, at most; for what is written at once."""
    with _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    if before is None:
        yield
        return
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Return what freed arrays and batches still hold to the system. Python workers live on into later stages, beside
    others of their executor, so a task calls this after each batch."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def hint_small(side: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``side`` if its counted ``rows`` are within the bound; else leave the choice to the planner."""
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side


def join_counted(left: DataFrame, counted: DataFrame, key: str, least: int = 1_000, share: int = 2_000) -> DataFrame:
    """``left`` joined with ``counted``, which has one row per key and in ``n`` the rows of ``left`` with that key.

    Keys with more than a ``share``-th of all rows (and more than ``least``) are spread over ``SALTS`` partitions. There
    are at most ``share`` of them, so that many are broadcast to mark them; other keys are joined as they are.
    """
    counted = cut(counted)
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = counted.filter(F.col("n") > max(least, total // share)).select(F.col(key).alias("hot_key"))
    salts = F.when(F.col("n") > max(least, total // share), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = counted.withColumn("salt", F.explode(salts)).drop("n")
    spread = F.pmod(F.xxhash64(*[c for c in left.columns if c != key]), F.lit(SALTS)).cast("int")
    marked = left.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left")
    salted = marked.withColumn("salt", F.when(F.col("hot_key").isNull(), F.lit(0)).otherwise(spread)).drop("hot_key")
    return salted.join(right, [key, "salt"]).drop("salt")


def numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns named graphloom_0, graphloom_1 and so on, so that no added column can clash."""
    names = [f"graphloom_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the column's text, mod ``modulus``; null stays null."""
    return F.crc32(F.col(column).cast("string")) % modulus


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (the splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any substring of a byte array, by prefix sums of random byte values times powers mod 2**64."""

    def __init__(self, seed: int):
        base = mix64(np.arange(1, 258, dtype=np.uint64) + np.uint64(seed << 32))
        self.values, self.step = base[:256], int(base[256]) | 1
        self.inverse = pow(self.step, -1, 2**64)
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        """Powers for arrays of up to ``n`` bytes; a copy of this object that a task got may start without them."""
        if len(self.powers) <= n:
            steps = np.ones((2, max(n + 2, 1 << 16)), np.uint64)
            steps[:, 1:] = np.array([[self.step], [self.inverse]], np.uint64)
            self.powers, self.inverses = np.cumprod(steps, axis=1, dtype=np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """P with P[i] the sum over data[:i]; feed it to ``at``."""
        n = len(data)
        self._grow(n)
        out = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.values[data] * self.powers[:n], out=out[1:])
        return out

    def at(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the substrings [start, end), mixed so that all bits are usable."""
        self._grow(len(prefix))
        with np.errstate(over="ignore"):
            return mix64((prefix[end] - prefix[start]) * self.inverses[start])
