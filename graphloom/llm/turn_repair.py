"""Repair of the structure of conversations (operator 11) by a weighted automaton, determinised as it is needed.

A conversation must read as ``s?(ua)+`` in the initials of its roles, or be empty. Four states say how far that is met;
each row may be kept, given another role or deleted, and rows may be put in, at a cost each. A vector with the least cost
of every state, less its own minimum, is a state of the deterministic automaton; its moves are worked out once and kept in
a table, so that a scan of a conversation looks up one entry a row. Costs that a dominated state can't win back are dropped,
which keeps the table small for any length. From the end, the tight arcs (those that least costs are made of) are marked
backwards; going forwards along marked arcs by the least letter gives the audit.

Rows are sorted once, by range of conversation, turn and a digest, over all partitions. Conversations inside a partition
are settled there. Those at its edges, or larger than ``BUFFER_BYTES``, are settled in pieces, so that one that holds a
third of all rows uses all partitions: each piece gives its costs from every state to every state, these are composed,
and each piece is traced from the vector that enters it. Only the sha256 of such a conversation is one task's work, since
it is sequential by definition; the rows stream through it.

Defined results: rows of one turn stand in the order of the sha256 of ``role:text``; a null role, text, or part of the
damage key is one space; null conversations are one conversation, null turns come first and count in no gap; repeated
rows are duplicates; gaps beyond a long are its greatest value; an empty table gives no rows; only the named columns are
read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import CRC_TABLE_SQL, crc_sql, shared_folder, table

#: Costs of the edits, and what a truncated row that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of a repaired prefix: nothing, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (START, ASSISTANT)
SPACES = " \t\n\v\f\r"
#: Texts of a conversation that one task holds at once; a larger one is settled in pieces.
BUFFER_BYTES = 8 << 20
FLUSH_ROWS, FLUSH_BYTES = 5_000, 4 << 20
INFINITE = 1 << 40
LEGAL = ("su", "ua", "au")
#: Kinds of rows: fine, truncated, and those that must go.
FINE, CUT_SHORT, BLANK, DUPLICATE = range(4)


def _next(state: int) -> int:
    """Where a user or assistant row, whichever may follow, leads."""
    return ASSISTANT if state == USER else USER


class Automaton:
    """The lazily determinised automaton: vectors, the moves found so far, and marks and choices found so far."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.index: dict[tuple[int, ...], int] = {}
        self.moves: dict[tuple[int, str, int], tuple[int, int]] = {}
        self.marks: dict[tuple, int] = {}
        self.choices: dict[tuple, tuple[str, int]] = {}
        self.units = [self.enter([0 if q == p else INFINITE for q in range(4)])[0] for p in range(4)]

    def enter(self, costs: Sequence[int]) -> tuple[int, int]:
        """The number of a vector, closed under insertions, normalised and freed of dominated costs, and its minimum."""
        v = list(costs)
        for _ in range(2):
            for p in range(4):
                v[_next(p)] = min(v[_next(p)], v[p] + INSERT)
        if v[START] > v[ASSISTANT] + DELETE:  # all that it could still do costs at most one deletion more from there
            v[START] = INFINITE
        if v[SYSTEM] > v[ASSISTANT]:
            v[SYSTEM] = INFINITE
        least = min(v)
        key = tuple(min(x - least, INFINITE) if x < INFINITE else INFINITE for x in v)
        if key not in self.index:
            self.index[key] = len(self.vectors)
            self.vectors.append(key)
        return self.index[key], least

    @staticmethod
    def arcs(p: int, initial: str, kind: int) -> list[tuple[str, int, int]]:
        """Letter, next state and cost of what may be done with a row, by letter."""
        out = [("D", p, DELETE)]
        if kind in (BLANK, DUPLICATE):
            return out
        more = TRUNCATED if kind == CUT_SHORT else 0
        follows = "a" if p == USER else "u"
        if initial == follows:
            out.append(("K", _next(p), more))
        elif initial == "s" and p == START:
            out.append(("K", SYSTEM, more))
        out.append(("R", _next(p), REROLE + more))
        return out

    def move(self, at: int, initial: str, kind: int) -> tuple[int, int]:
        key = (at, initial, kind)
        if key not in self.moves:
            v, out = self.vectors[at], [INFINITE] * 4
            for p in range(4):
                if v[p] < INFINITE:
                    for _, q, cost in self.arcs(p, initial, kind):
                        out[q] = min(out[q], v[p] + cost)
            self.moves[key] = self.enter(out)
        return self.moves[key]

    def scan(self, at: int, rows: Sequence[tuple[str, int]]) -> tuple[list[int], int]:
        """The numbers of the vectors before each row and at the end, and the least cost of the last."""
        seen, total, moves = [at], 0, self.moves
        for initial, kind in rows:
            found = moves.get((at, initial, kind)) or self.move(at, initial, kind)
            at = found[0]
            total += found[1]
            seen.append(at)
        return seen, total

    def before(self, at: int, mask: int) -> int:
        """``mask`` with the states of a vector whose insertion leads into it at no more than its cost."""
        v = self.vectors[at]
        for _ in range(2):
            for p in range(4):
                if v[p] < INFINITE and mask >> _next(p) & 1 and v[p] + INSERT == v[_next(p)]:
                    mask |= 1 << p
        return mask

    def marked(self, at: int, to: int, initial: str, kind: int, mask: int) -> int:
        """States before a row from which a tight arc leads to the states ``mask`` after it."""
        key = (at, to, initial, kind, mask)
        if key not in self.marks:
            v, after, least, out = self.vectors[at], self.vectors[to], self.move(at, initial, kind)[1], 0
            for p in range(4):
                if v[p] < INFINITE and any(mask >> q & 1 and v[p] + cost == after[q] + least for _, q, cost in self.arcs(p, initial, kind)):
                    out |= 1 << p
            self.marks[key] = self.before(at, out)
        return self.marks[key]

    def choose(self, at: int, to: int, initial: str, kind: int, mask: int, mask_after: int, p: int) -> tuple[str, int]:
        """The letters up to and with that of a row, the least among tight arcs between marked states, and the next state."""
        key = (at, to, initial, kind, mask, mask_after, p)
        if key not in self.choices:
            v, after, least, letters, q = self.vectors[at], self.vectors[to], self.move(at, initial, kind)[1], "", p
            while True:
                ways = [(letter, n) for letter, n, cost in self.arcs(q, initial, kind) if mask_after >> n & 1 and v[q] + cost == after[n] + least]
                if mask >> _next(q) & 1 and v[q] + INSERT == v[_next(q)]:
                    ways.append(("I", _next(q)))
                letter, q = min(ways)
                letters += letter
                if letter != "I":
                    break
            self.choices[key] = (letters, q)
        return self.choices[key]

    def final(self, at: int) -> tuple[int, int]:
        """The least cost of ending in a vector beyond its minimum, and the states that may end at that cost."""
        v = self.vectors[at]
        least = min(v[p] for p in ACCEPTING)
        return least, sum(1 << p for p in ACCEPTING if v[p] == least)

    def trace(self, seen: Sequence[int], rows: Sequence[tuple[str, int]], ends: int, last: bool) -> dict[int, tuple[str, int]]:
        """For every marked state before the first row: the audit letters of the rows, and the state after them.

        ``ends`` are the states after the last row that lie on a cheapest repair; a ``last`` piece adds what is put in at its end.
        """
        masks = [self.before(seen[-1], ends)]
        for i in range(len(rows) - 1, -1, -1):
            masks.append(self.marked(seen[i], seen[i + 1], *rows[i], masks[-1]))
        masks.reverse()
        out = {}
        for start in range(4):
            if masks[0] >> start & 1:
                p, letters = start, []
                for i, row in enumerate(rows):
                    step, p = self.choose(seen[i], seen[i + 1], *row, masks[i], masks[i + 1], p)
                    letters.append(step)
                while last and not ends >> p & 1:
                    letters.append("I")
                    p = _next(p)
                out[start] = ("".join(letters), p)
        return out


class Repaired:
    """The sha256 of the repaired rows, fed letter by letter, from the state ``START``."""

    def __init__(self):
        self.hash, self.state, self.first = hashlib.sha256(), START, True

    def _row(self, role: str, text: str) -> None:
        if not self.first:
            self.hash.update(b"\n")
        self.first = False
        self.hash.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))

    def feed(self, letter: str, role: str = "", text: str = "") -> None:
        if letter == "D":
            return
        named = "assistant" if self.state == USER else "user"
        self.state = SYSTEM if letter == "K" and self.state == START and role[:1] == "s" else _next(self.state)
        self._row(role if letter == "K" else named, "" if letter == "I" else text)


def fault(text: str) -> int:
    """The kind of a text, duplicates apart."""
    bare = text.rstrip(SPACES)
    return BLANK if not bare else FINE if bare[-1] in ".!?" else CUT_SHORT


COUNTS = ("blank", "duplicate", "truncated", "illegal")


class Tally:
    """Counts over rows in order: faults, illegal neighbours, and turns; tallies of adjoining pieces add up."""

    def __init__(self):
        self.kinds, self.illegal, self.first, self.last = [0] * 4, 0, None, None
        self.turns, self.low, self.high = 0, None, None

    def add(self, kind: int, initial: str, turn: int | None) -> None:
        self.kinds[kind] += 1
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def join(self, other: Tally) -> None:
        """Add the tally of the rows that follow."""
        if other.last is None:
            return
        self.illegal += other.illegal + (self.last is not None and self.last + other.first not in LEGAL)
        self.kinds = [a + b for a, b in zip(self.kinds, other.kinds, strict=True)]
        self.first = other.first if self.last is None else self.first
        self.last = other.last
        if other.low is not None:
            self.turns += other.turns - (self.high == other.low)
            self.low = other.low if self.low is None else self.low
            self.high = other.high

    def values(self) -> tuple[int, ...]:
        """gaps, then ``COUNTS``."""
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)
        return gaps, self.kinds[BLANK], self.kinds[DUPLICATE], self.kinds[CUT_SHORT], self.illegal


def settle(auto: Automaton, rows: Sequence[tuple[int | None, str, str, int]]) -> tuple:
    """gaps, counts, cost, audit and hash of the whole conversation ``rows(turn, role, text, kind)``."""
    tally, repaired = Tally(), Repaired()
    for turn, role, _, kind in rows:
        tally.add(kind, role[:1], turn)
    signs = [(role[:1], kind) for _, role, _, kind in rows]
    seen, total = auto.scan(auto.units[START], signs)
    more, ends = auto.final(seen[-1])
    audit = auto.trace(seen, signs, ends, True)[START][0]
    at = iter(rows)
    for letter in audit:
        repaired.feed(letter, *(("", "") if letter == "I" else next(at)[1:3]))
    return *tally.values(), total + more, audit, repaired.hash.hexdigest()


# ---- damage ------------------------------------------------------------------------------------------------------------


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text and n, how often the row stands there: 0 (and no role) for a row that is dropped."""
    spaced = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    read = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), spaced(F.col(role)).alias("role"), spaced(F.col(text)).alias("text"))
    k = F.crc32(F.concat(spaced(F.col("conv_id")), F.lit(":"), spaced(F.col("turn")))) % 20
    kept = lambda c: F.when(F.col("k") != 0, c)
    changed = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    out = read.withColumn("k", k)
    return out.select("conv_id", kept(F.col("turn")).alias("turn"), kept(F.when(F.col("k") == 4, "user").otherwise(F.col("role"))).alias("role"), kept(changed).alias("text"), F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1).alias("n"))


# ---- the sorted pass ---------------------------------------------------------------------------------------------------

RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDGE = "part int, piece int, pos long, turn long, role string, text string, n int"
_EMPTY = hashlib.sha256(b"").hexdigest()


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class _Writer:
    """Collects rows of one schema and hands them on as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def put(self, row: tuple, size: int = 0) -> None:
        self.rows.append(row)
        self.size += size

    def full(self) -> bool:
        return len(self.rows) >= FLUSH_ROWS or self.size >= FLUSH_BYTES

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [()] * len(self.schema)
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)


def _arrow(schema: str, conv: pa.DataType) -> pa.Schema:
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, conv if t == "CONV" else types[t]) for n, t in (c.split() for c in schema.split(", "))])


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for a in range(0, batch.num_rows, 1_000):
            yield from zip(*(c.to_pylist() for c in batch.slice(a, 1_000).columns), strict=True)


def _pass(buffer_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order: results of the conversations that lie inside the partition, and the rows of all others."""
        auto, part, writer, piece = Automaton(), TaskContext.get().partitionId(), None, -1
        held: list[tuple] = []
        size, whole, first, conv, pos = 0, True, True, None, 0

        def edges() -> None:
            nonlocal pos
            for turn, role, text, n in held:
                writer.put((1, conv, *[None] * 8, part, piece, pos, turn, role, text, n), len(text or ""))
                pos += 1
            held.clear()

        def close() -> None:
            seen, rows = set(), []
            for turn, role, text, n in held:
                for _ in range(n):
                    kind = fault(text)
                    if kind != BLANK and (role, text) in seen:
                        kind = DUPLICATE
                    seen.add((role, text))
                    rows.append((turn, role, text, kind))
            writer.put((0, conv, *settle(auto, rows), *[None] * 7), 200 + len(rows))
            held.clear()

        for batch in batches:
            if writer is None:
                writer = _Writer(_arrow(f"kind int, conv_id CONV, {RESULT}, {EDGE}", batch.schema.field(0).type))
            for row in _columns(iter([batch])):
                if first or row[0] != conv:
                    if not first:
                        close() if whole else edges()
                    whole, first, conv, size, piece = not first, False, row[0], 0, piece + 1
                held.append(row[1:])
                size += len(row[3] or "") + len(row[2] or "") + 64
                if size > buffer_bytes:
                    whole = False
                if not whole and len(held) >= 1_000:
                    edges()
                if writer.full():
                    yield writer.batch()
        if writer is not None:
            edges()  # the last conversation may go on in the next partition
            yield writer.batch()

    return run


def _light(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Pieces of rows (conv_id, part, piece, pos, turn, initial, kind, n, first) in order: their key, and rows with kinds."""
    key, rows = None, []
    for conv, part, piece, _, turn, initial, kind, n, first in _columns(batches):
        if (part, piece) != (key or (None,))[:2]:
            if key is not None:
                yield key, rows
            key, rows = (part, piece, conv), []
        for i in range(n):
            rows.append((turn, initial, kind if kind == BLANK or first and i == 0 else DUPLICATE))
    if key is not None:
        yield key, rows


PIECE = "conv_id CONV, part int, piece int, costs array<long>, kinds array<long>, turns array<long>, first string, last string, illegal long"
PLAN = "conv_id CONV, part int, piece int, enter array<long>, ends long, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
TRACE = "conv_id CONV, part int, piece int, state int, letters string, then int"


def _transfer(conv: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, writer = Automaton(), _Writer(_arrow(PIECE, conv))
        for (part, piece, name), rows in _light(batches):
            tally, costs = Tally(), []
            for turn, initial, kind in rows:
                tally.add(kind, initial, turn)
            for p in range(4):
                seen, total = auto.scan(auto.units[p], [r[1:] for r in rows])
                costs += [min(x + total, INFINITE) for x in auto.vectors[seen[-1]]]
            turns = [] if tally.low is None else [tally.turns, tally.low, tally.high]
            writer.put((name, part, piece, costs, tally.kinds, turns, tally.first, tally.last, tally.illegal))
            if writer.full():
                yield writer.batch()
        yield writer.batch()

    return run


def _compose(pieces: pd.DataFrame) -> pd.DataFrame:
    """What enters each piece of one conversation and which states may leave it; the totals stand at its last piece."""
    auto, pieces = Automaton(), pieces.sort_values(["part", "piece"])
    tally, vectors = Tally(), [list(auto.vectors[auto.units[START]])]
    costs = [np.asarray(c, np.int64).reshape(4, 4) for c in pieces["costs"]]
    for c, row in zip(costs, pieces.itertuples(), strict=True):
        part = Tally()
        part.kinds, part.first, part.last, part.illegal = [int(x) for x in row.kinds], row.first, row.last, int(row.illegal)
        if len(row.turns):
            part.turns, part.low, part.high = (int(x) for x in row.turns)
        tally.join(part)
        vectors.append(np.minimum((np.asarray(vectors[-1])[:, None] + c).min(axis=0), INFINITE).tolist())
    least = min(vectors[-1][p] for p in ACCEPTING)
    ends = [sum(1 << p for p in ACCEPTING if vectors[-1][p] == least)]
    for k in range(len(costs) - 1, 0, -1):
        v, after, mask = vectors[k], vectors[k + 1], ends[-1]
        if k == len(costs) - 1:
            for _ in range(2):
                for p in range(4):
                    mask |= (1 << p) if mask >> _next(p) & 1 and after[p] + INSERT == after[_next(p)] else 0
        ends.append(sum(1 << p for p in range(4) if v[p] < INFINITE and any(mask >> q & 1 and v[p] + int(costs[k][p][q]) == after[q] for q in range(4))))
    ends.reverse()
    out = pieces[["conv_id", "part", "piece"]].copy()
    out["enter"] = [[int(x) for x in v] for v in vectors[:-1]]
    out["ends"] = ends
    out["last"] = [False] * (len(out) - 1) + [True]
    for name, value in zip(("gaps", *COUNTS, "cost"), (*tally.values(), least), strict=True):
        out[name] = value
    return out


def _retrace(conv: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, writer = Automaton(), _Writer(_arrow(TRACE, conv))
        plans: dict[tuple[int, int], tuple] = {}

        def rows() -> Iterator[pa.RecordBatch]:  # a plan row comes before the rows of its piece
            for batch in batches:
                is_plan = np.asarray(batch.column("pos").to_numpy(zero_copy_only=False)) < 0
                for row in batch.filter(pa.array(is_plan)).to_pylist():
                    plans[row["part"], row["piece"]] = (row["enter"], row["ends"], row["last"])
                yield batch.filter(pa.array(~is_plan)).select(range(9))

        for (part, piece, name), found in _light(rows()):
            enter, ends, last = plans.pop((part, piece))
            signs = [r[1:] for r in found]
            seen, _ = auto.scan(auto.enter(enter)[0], signs)
            for state, (letters, then) in auto.trace(seen, signs, ends, last).items():
                writer.put((name, part, piece, state, letters, then), len(letters))
            if writer.full():
                yield writer.batch()
        yield writer.batch()

    return run


def _chain(traces: pd.DataFrame) -> pd.DataFrame:
    """The letters of each piece of one conversation, from the state that the piece before left."""
    state, out = START, []
    for _, ways in traces.sort_values(["part", "piece"]).groupby(["part", "piece"], sort=True):
        way = ways[ways["state"] == state].iloc[0]
        out.append((way["conv_id"], way["part"], way["piece"], way["letters"]))
        state = way["then"]
    return pd.DataFrame(out, columns=["conv_id", "part", "piece", "letters"])


def _digest(conv: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (conv_id, pos, role, text, n) by conversation and place; a row with pos -1 has the letters of a piece."""
        writer, repaired, letters, name, begun = _Writer(_arrow("conv_id CONV, repaired_sha256 string", conv)), Repaired(), iter(""), None, False

        def rest() -> None:
            for letter in letters:  # what is put in at the end of a piece
                repaired.feed(letter)

        for conv_id, pos, role, text, n in _columns(batches):
            if not begun or conv_id != name:
                if begun:
                    rest()
                    writer.put((name, repaired.hash.hexdigest()))
                    if writer.full():
                        yield writer.batch()
                repaired, letters, name, begun = Repaired(), iter(""), conv_id, True
            if pos < 0:
                rest()
                letters = iter(text)
                continue
            for _ in range(n):
                letter = next(letters)
                while letter == "I":
                    repaired.feed(letter)
                    letter = next(letters)
                repaired.feed(letter, role, text)
        if begun:
            rest()
            writer.put((name, repaired.hash.hexdigest()))
        yield writer.batch()

    return run


def _in_pieces(edges: DataFrame, conv_type: str) -> DataFrame:
    """Results of the conversations whose rows (``EDGE``) are spread over pieces."""
    spark = edges.sparkSession
    conv = spark.createDataFrame([], f"c {conv_type}").toArrow().schema.field(0).type
    typed = lambda schema: schema.replace("CONV", conv_type)
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = edges.select("conv_id", "part", "piece", "pos", "turn", F.substring("role", 1, 1).alias("initial"), F.when(F.col("n") > 0, kind_of(F.col("text"))).alias("kind"), "n", digest.alias("digest"))
    firsts = rows.filter("n > 0").groupBy("conv_id", "digest").agg(F.min(F.struct("part", "pos")).alias("f")).select("f.part", "f.pos", F.lit(True).alias("first"))
    folder = shared_folder(spark, "turn-repair")
    coded = rows.drop("digest").join(firsts, ["part", "pos"], "left").select("conv_id", "part", "piece", "pos", "turn", "initial", "kind", "n", "first")
    coded.write.parquet(f"{folder}/coded")
    coded = spark.read.parquet(f"{folder}/coded")
    by_piece = lambda df: df.repartition("part").sortWithinPartitions("part", "piece", "pos")
    plan = by_piece(coded).mapInArrow(_transfer(conv), typed(PIECE)).groupBy("conv_id").applyInPandas(_compose, typed(PLAN))
    plan.write.parquet(f"{folder}/plan")
    plan = spark.read.parquet(f"{folder}/plan")
    heads = plan.select("conv_id", "part", "piece", F.lit(-1).cast("long").alias("pos"), "enter", "ends", "last")
    traced = by_piece(coded.unionByName(heads, allowMissingColumns=True)).mapInArrow(_retrace(conv), typed(TRACE))
    traced.groupBy("conv_id").applyInPandas(_chain, typed("conv_id CONV, part int, piece int, letters string")).write.parquet(f"{folder}/letters")
    letters = spark.read.parquet(f"{folder}/letters")
    told = letters.select("conv_id", "part", "piece", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"), F.col("letters").alias("text"), F.lit(0).alias("n"))
    placed = edges.select(*told.columns).unionByName(told).repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece", "pos")
    hashed = placed.select("conv_id", "pos", "role", "text", "n").mapInArrow(_digest(conv), typed("conv_id CONV, repaired_sha256 string"))
    audits = letters.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "piece", "letters"))), lambda x: x["letters"]), "").alias("audit"))
    totals = plan.filter("last").drop("part", "piece", "enter", "ends", "last")
    same = lambda other: totals["conv_id"].eqNullSafe(other["conv_id"])
    joined = totals.join(audits, same(audits)).join(hashed, same(hashed))
    return joined.select(totals["conv_id"], *_names(RESULT))


def kind_of(text: Column) -> Column:
    """``fault`` as a column."""
    bare = F.rtrim(text, F.lit(SPACES))
    return F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT_SHORT)


def repair(rows: DataFrame, buffer_bytes: int = BUFFER_BYTES) -> DataFrame:
    """conv_id with gaps, counts of faults, cost, audit and the hash of the repair, for ``damaged`` rows.

    ``rows(conv_id, turn, role, text, n)``: n says how often the row stands there; rows of n 0 only name a conversation.
    """
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, "turn-repair")
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    # the salt spreads equal rows, whatever their number, over several ranges
    keyed = rows.withColumns({"digest": F.sha2(F.concat("role", F.lit(":"), "text"), 256), "salt": F.monotonically_increasing_id() % 64})
    order = ["conv_id", "turn", "digest", "salt"]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "n")
    ranged.mapInArrow(_pass(buffer_bytes), f"kind int, conv_id {conv_type}, {RESULT}, {EDGE}").write.partitionBy("kind").parquet(folder)
    held = spark.read.schema(f"conv_id {conv_type}, {RESULT}, {EDGE}, kind int").parquet(folder)
    inside = held.filter("kind = 0").select("conv_id", *_names(RESULT))
    return inside.unionByName(_in_pieces(held.filter("kind = 1").select("conv_id", *_names(EDGE)), conv_type))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _way(state: str, cost: str, letter: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}'}}"


_ROW = {
    0: ("c0", []),
    1: ("c1", [f"CASE WHEN k < 2 AND initial = 's' THEN {_way('c0', 'tp', 'K')} ELSE inf END"]),
    2: ("c2", [x for p in ("c0", "c1", "c3") for x in (f"CASE WHEN k < 2 THEN {_way(p, '1 + tp', 'R')} ELSE inf END", f"CASE WHEN k < 2 AND initial = 'u' THEN {_way(p, 'tp', 'K')} ELSE inf END")]),
    3: ("c3", [f"CASE WHEN k < 2 THEN {_way('c2', '1 + tp', 'R')} ELSE inf END", f"CASE WHEN k < 2 AND initial = 'a' THEN {_way('c2', 'tp', 'K')} ELSE inf END"]),
}
_CLOSED = f"s0 AS c0, s1 AS c1, {_least('s2', *(_way(p, '5', 'I') for p in ('s0', 's1', 's3')))} AS c2, {_least('s3', _way('s2', '5', 'I'))} AS c3"
ORACLE = rf"""
WITH RECURSIVE {CRC_TABLE_SQL},
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS k FROM conversations, crc_table
), kept AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM keyed WHERE k <> 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(role || ':' || text)) AS i FROM kept
), judged AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, regexp_matches(text, '[^\x20\x09-\x0D]') AS worded,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) IN ('.', '!', '?') AS ended FROM ordered
), rows AS (
  SELECT *, CASE WHEN NOT worded THEN 2 WHEN again THEN 3 WHEN NOT ended THEN 1 ELSE 0 END AS k, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM judged
), dp(conv_id, i, s0, s1, s2, s3) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'a': ''}}, {{'c': 1000000::BIGINT, 'a': ''}}, {{'c': 1000000::BIGINT, 'a': ''}}, {{'c': 1000000::BIGINT, 'a': ''}} FROM conversations
  UNION ALL
  SELECT conv_id, i, {', '.join(_least(_way(own, '2', 'D'), *ways) for own, ways in _ROW.values())}
  FROM (SELECT dp.conv_id, r.i, {_CLOSED}, r.k, r.initial, CASE r.k WHEN 1 THEN 5 ELSE 0 END AS tp, {{'c': 1000000::BIGINT, 'a': ''}} AS inf
    FROM dp JOIN rows r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1)
), ended AS (
  SELECT conv_id, arg_max({_least('s0', 's3', _way('s2', '5', 'I'))}, i) AS best FROM dp GROUP BY conv_id
), letters AS (
  SELECT conv_id, unnest(string_split(best.a, '')) AS letter, generate_subscripts(string_split(best.a, ''), 1) AS j FROM ended WHERE best.a <> ''
), placed AS (
  SELECT *, sum(CASE letter WHEN 'I' THEN 0 ELSE 1 END) OVER w AS i, sum(CASE letter WHEN 'D' THEN 0 ELSE 1 END) OVER w AS o FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j)
), outs AS (
  SELECT p.conv_id, p.o, p.letter, r.role, CASE p.letter WHEN 'I' THEN '' ELSE r.text END AS text,
    max(CASE WHEN p.o = 1 AND p.letter = 'K' AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS has_s
  FROM placed p LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i WHERE p.letter <> 'D'
), repaired AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - has_s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY o)) AS h FROM outs GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE k = 2) AS blank, count(*) FILTER (WHERE k = 3) AS duplicate,
    count(*) FILTER (WHERE k = 1) AS truncated, count(*) FILTER (WHERE i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id
)
SELECT e.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
  e.best.c AS cost, e.best.a AS audit, coalesce(r.h, sha256('')) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM e.conv_id
"""
