"""Append logs of snapshots: gaps, deaths, events, windows and moves between receipts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gaps(pages: DataFrame, journal: str = "journal") -> DataFrame:
    """Pages whose ``prev_cursor`` isn't the cursor of the page before."""
    order = Window.partitionBy(journal).orderBy("seq")
    before = F.lag("cursor").over(order)
    return pages.withColumn("expected", before).filter(F.col("expected").isNotNull() & ~F.col("prev_cursor").eqNullSafe(F.col("expected")))


def deaths(pages: DataFrame, journal: str = "journal") -> DataFrame:
    """Pages at which a running node count falls from above 0 to 0; it starts again at bootstraps, and isn't known
    once negative."""
    order = Window.partitionBy(journal).orderBy("seq")
    segment = pages.withColumn("segment", F.sum(F.col("bootstrap").cast("int")).over(order))
    within = Window.partitionBy(journal, "segment").orderBy("seq")
    counted = segment.withColumn("alive", F.sum(F.col("n_born") - F.col("n_died")).over(within))
    counted = counted.withColumn("before", F.lag("alive").over(within)).withColumn("least", F.min("alive").over(within))
    return counted.filter("alive = 0 AND before > 0 AND least >= 0").select(journal, "seq", "before")


def events(pages: DataFrame, symbol: str, contains: bool = False) -> DataFrame:
    """Pages that bear or kill an id that is, ends in, or (asked so) contains the symbol."""

    def hit(x: Column) -> Column:
        return x.contains(symbol) if contains else (x == symbol) | x.endswith("." + symbol) | x.endswith("/" + symbol)

    return pages.filter(F.exists("born", hit) | F.exists("died", hit))


def windows(captures: DataFrame, key: str, at: str) -> DataFrame:
    """(previous, at] for each capture of a key; the first has no floor and so no window."""
    previous = F.lag(at).over(Window.partitionBy(key).orderBy(at))
    return captures.select(key, previous.alias("low"), F.col(at).alias("high")).filter("low IS NOT NULL")


def in_window(points: DataFrame, captures: DataFrame, key: str, at: str) -> DataFrame:
    """Each point with the end of the first window of its key that holds it, by one ordered pass instead of a range join.

    Points and captures are put in one order, from the last backwards, so that the next capture at or after a point, which
    ends its window, is the last one seen: a running value. The window is open below unless a capture came before.
    """
    marks = points.select(key, F.col("point_id"), F.col(at).alias("t"), F.lit(0).alias("is_capture")).unionByName(captures.select(key, F.lit(None).cast("long").alias("point_id"), F.col(at).alias("t"), F.lit(1).alias("is_capture")))
    order = Window.partitionBy(key).orderBy(F.col("t").desc(), F.col("is_capture").desc())
    high = F.last(F.when(F.col("is_capture") == 1, F.col("t")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    first = captures.groupBy(key).agg(F.min(at).alias("earlier"))
    timed = marks.withColumn("high", high).filter("is_capture = 0 AND high IS NOT NULL")
    return timed.join(first, key).filter("earlier < t").select(key, "point_id", "high")


def as_of(points: DataFrame, marks: DataFrame, key: str, at: str) -> DataFrame:
    """Each point with ``since``, the time of the last mark of its key at or before it (null before the first), by one sort of
    both: a running value instead of a range join. ``points`` have the key, the time and ``row``."""
    both = points.select(key, "row", F.col(at).alias("t"), F.lit(1).alias("is_point")).unionByName(marks.select(key, F.lit(None).cast(points.schema["row"].dataType).alias("row"), F.col(at).alias("t"), F.lit(0).alias("is_point")))
    order = Window.partitionBy(key).orderBy("t", "is_point").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("since", F.last(F.when(F.col("is_point") == 0, F.col("t")), ignorenulls=True).over(order))
    return seen.filter("is_point = 1").select(key, "row", F.col("t").alias(at), "since")


#: Metrics that are always told, if they moved at all; fixed values.
KEPT = ("floor.seconds", "floor.passed", "wheel.wheel_bytes", "gate.seconds", "floor.rss_kb")


def moves(receipts: DataFrame, series: str, at: str, top: int = 4, kept: Sequence[str] = KEPT) -> DataFrame:
    """Of ``receipts(series, at, metric, value)``: metrics that moved since the receipt before, the ``kept`` first, then those
    that moved most, relatively (from nought: wholly). Return codes and, unless kept, memory are never told."""
    order = Window.partitionBy(series, "metric").orderBy(at)
    metric, keep = F.col("metric"), F.col("metric").isin(*kept)
    moved = receipts.withColumn("before", F.lag("value").over(order)).filter("before IS NOT NULL AND before <> value")
    moved = moved.filter(~metric.endswith(".rc") & (keep | ~metric.contains("rss")))
    share = F.abs((F.col("value") - F.col("before")) / F.nullif(F.col("before"), F.lit(0.0)))
    moved = moved.withColumn("move", F.coalesce(F.round(share, 9), F.lit(1.0)))
    ranked = moved.withColumn("rank", F.row_number().over(Window.partitionBy(series, at).orderBy(keep.desc(), F.col("move").desc(), "metric")))
    return ranked.filter(F.col("rank") <= top)


def follows(rows: DataFrame, key: str, order_by: str, item: str) -> DataFrame:
    """Each item with the one before it of the same key."""
    return rows.select(key, item, F.lag(item).over(Window.partitionBy(key).orderBy(order_by)).alias("before")).filter("before IS NOT NULL")
