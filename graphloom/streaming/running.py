"""Running counts and gap marks of journals as streams, with state kept per journal.

Pages may arrive in any order and more than once. A page is taken up when it is the next of its journal, or when the
watermark has passed its time, so that a page that never comes holds up the rest no longer than lateness allows; until then
it waits in the state. The rows that come out are those of ``operators.journal``'s ``gaps`` and ``deaths`` over the same pages.
State is a row for each journal and the pages that wait, many packed into a row: they are taken up together, not one by one. A journal is in one task, since its counts run in order; journals are
spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A page that waits; so many are packed into one row of state.
WAITS = {"seq": pa.int64(), "us": pa.int64(), "cursor": pa.string(), "prev_cursor": pa.string(), "bootstrap": pa.bool_(), "n_born": pa.int64(), "n_died": pa.int64()}
PACKED = 20_000
#: ``seq`` and cursor of the last page, the running count since the last bootstrap and its least value.
STANDS = "seq long, cursor string, alive long, least long"
MARK = "journal string, seq long, mark string, before long, expected string, prev_cursor string"
INPUT = ["journal", "seq", "ts", "cursor", "prev_cursor", "bootstrap", "n_born", "n_died"]


def _packed(pages: pd.DataFrame) -> list[tuple]:
    """Pages as rows of state, ``PACKED`` in one."""
    table, sink = pa.table({c: pa.array(pages[c], t, from_pandas=True) for c, t in WAITS.items()}), []
    for batch in table.to_batches(PACKED):
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_batch(batch)
        sink.append((out.getvalue().to_pybytes(),))
    return sink


def _plain(part: pd.DataFrame) -> pd.DataFrame:
    us = part["ts"].to_numpy("datetime64[us]").astype("int64")
    times = np.where(part["ts"].isna(), 0, us)
    kept = {c: part[c].astype(object).where(part[c].notna(), None) for c in ("cursor", "prev_cursor")}
    flags = part["bootstrap"].map(lambda x: x is not None and x == x and bool(x)).astype(bool)
    return pd.DataFrame({"seq": part["seq"].astype("int64"), "us": times, **kept, "bootstrap": flags, "n_born": part["n_born"].astype("int64"), "n_died": part["n_died"].astype("int64")})


class PagesInOrder(StatefulProcessor):
    """``first`` is the number of a journal's first page, None if any page may be the first."""

    def __init__(self, first: int | None = 1):
        self.first = first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stands = handle.getValueState("stands", STANDS)
        self.waiting = handle.getListState("waiting", "pages binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._release(key, [_plain(part) for part in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._release(key, [], timerValues.getCurrentWatermarkInMs())

    def _release(self, key, fresh: list[pd.DataFrame], watermark: int) -> pd.DataFrame:
        """Take up the pages whose turn it is, in order; a timer stands for those that go on waiting."""
        at = self.stands.get() if self.stands.exists() else None
        held = [pa.ipc.open_stream(row[0]).read_pandas() for row in self.waiting.get()] if self.waiting.exists() else []
        if not held and not any(map(len, fresh)):
            return _marks([], [])
        pages = pd.concat([*held, *fresh], ignore_index=True).drop_duplicates("seq")  # of one number, the first that came
        if at is not None:
            pages = pages[pages["seq"] > at[0]]
        pages = pages.sort_values("seq", ignore_index=True)
        seq = pages["seq"].to_numpy()
        due = np.append([False], seq[1:] == seq[:-1] + 1)[: len(seq)]
        if len(seq):
            due[0] = seq[0] == at[0] + 1 if at is not None else self.first is None or seq[0] == self.first
        due |= pages["us"].to_numpy() // 1000 <= watermark
        n = len(seq) if due.all() else int(np.argmin(due))
        left, found = pages[n:], _marks([], [])
        if n:
            stands, found = _taken(key[0], pages[:n], at)
            self.stands.update(stands)
        if len(left):
            self.waiting.put(_packed(left))
            self.handle.registerTimer(max(int(left["us"].min()) // 1000, 1))
        elif held:
            self.waiting.clear()
        return found


def _marks(gaps: list, deaths: list) -> pd.DataFrame:
    out = pd.DataFrame([*gaps, *deaths], columns=["journal", "seq", "mark", "before", "expected", "prev_cursor"], dtype=object)
    return out.astype({"seq": "int64", "before": "Int64"})


def _taken(journal: str, pages: pd.DataFrame, stands) -> tuple[tuple, pd.DataFrame]:
    """Where a journal stands after pages in order that follow where it stood, and their marks."""
    _, expected, alive, least = stands or (None, None, None, 0)
    seq, cursor, previous = (pages[c].to_numpy() for c in ("seq", "cursor", "prev_cursor"))
    before = np.append(np.array([expected], dtype=object), cursor[:-1])
    gap = ~pd.isna(before) & (pd.isna(previous) | (previous != before))
    again, delta = pages["bootstrap"].to_numpy(bool).copy(), (pages["n_born"] - pages["n_died"]).to_numpy()
    again[0] |= alive is None
    total = np.cumsum(delta)
    last = np.maximum.accumulate(np.where(again, np.arange(len(seq)), -1))  # the page that a count began with, -1: an earlier one
    now = total - np.where(last >= 0, (total - delta)[last], -(alive or 0))
    low = pd.Series(now).groupby(last).cummin().to_numpy()
    low = np.where(last >= 0, low, np.minimum(low, least))
    was = np.append([alive or 0], now[:-1])
    dead = ~again & (now == 0) & (was > 0) & (low >= 0)
    gaps = [(journal, s, "gap", None, e, None if pd.isna(p) else p) for s, e, p in zip(seq[gap], before[gap], previous[gap], strict=True)]
    deaths = [(journal, s, "death", w, None, None) for s, w in zip(seq[dead], was[dead], strict=True)]
    end = None if pd.isna(cursor[-1]) else cursor[-1]
    return (int(seq[-1]), end, int(now[-1]), int(low[-1])), _marks(gaps, deaths)


def marks(pages: DataFrame, late: str = "1 day", first: int | None = 1) -> DataFrame:
    """journal, seq, mark (``gap`` or ``death``), before, expected and prev_cursor, as the pages of a stream are taken up."""
    timed = pages.select(*INPUT).withWatermark("ts", late)
    return timed.groupBy("journal").transformWithStateInPandas(PagesInOrder(first), MARK, "Append", "EventTime")


def write_marks(found: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Run the stream into Parquet, each micro-batch under its own number, so that one that is run again replaces itself."""

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return found.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def marks_of(spark: SparkSession, folder: str, work: str, schema: str, files: int = 1, **how) -> DataFrame:
    """The marks of all pages that stand in a folder of JSON files, taken up ``files`` at a time by a stream that then ends.

    State that must take back rows of a batch needs the RocksDB provider, which is set for this query alone.
    """
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)
        running = write_marks(marks(pages, **how), f"{work}/marks", f"{work}/state")
        running.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(f"{MARK}, batch long").parquet(f"{work}/marks").drop("batch")
