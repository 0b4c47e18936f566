"""Append logs read as streams: journals and event tables, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "journal string, seq long, ts timestamp, cursor string, prev_cursor string, n_born long, n_died long, bootstrap boolean"


def journal_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of a folder of JSONL journals as they arrive; repeated captures of a page are dropped within a day."""
    pages = spark.readStream.schema(PAGE).json(folder)
    return pages.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["journal", "seq"])


def sessions(events: DataFrame, key: str = "user_id", at: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Session windows of a key: start, end and number of events. Works on streams and on tables."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
