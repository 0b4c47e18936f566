"""Removal of repeated byte strings (operator 2), by blockwise suffix sorting with a difference cover.

A byte goes if a string of ``LENGTH`` bytes over it also starts earlier. Which strings those are is settled by sorting
suffixes to that depth, a bucket of them at a time:

1. Preselection. Positions whose remainder mod ``PERIOD`` is in a thin difference cover are sampled. For any two
   positions some shift below PERIOD leads to two sampled ones, so two equal strings of LENGTH bytes always hold two
   equal sampled strings of LENGTH - PERIOD + 1 bytes at one shift. Sampled strings are named by hashes and dealt into
   buckets by name; only names held twice are kept. A suffix can only tie with another if a sampled position whose name
   is kept lies at one of its first PERIOD shifts. Hashes alike by chance only add candidates.
2. The sort. Candidate suffixes are dealt out by the least gram of their first LENGTH bytes, so that runs of neighbours
   travel as one string. In a bucket the positions of a second difference cover, mod ``STEP``, are ranked first: in byte
   order to ``DEPTH`` bytes, by doubling along the cover. Suffixes are then sorted by their leading (and, for what the
   ranks leave out, last) eight bytes; ties, however long, are resolved by the ranks at the shift below STEP that leads
   both into the cover. No string is compared byte by byte beyond that, and equality is exact. Of equal suffixes all but
   the earliest are marked, and marks are joined into maximal runs.

Both steps combine what a block of documents holds before the shuffle: of equal strings a block sends one, so a string
that every document holds costs a row per block. Buckets grow in number with the corpus, so the memory of a task
doesn't. Later exact copies of a text lose every byte, and take no part in either step.

Defined results: a null text is empty; strings within one document count, overlaps included; a null doc_id is later
than all others; among rows that share a doc_id none is earlier, so they lose nothing to each other; texts shorter
than LENGTH bytes lose nothing; an empty table gives no rows; other columns are not read; an id that isn't a whole
number is refused, and 2**63 - 1 stands for null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from graphloom.llm.common import Rolling, cut, give_back, hint_small, join_counted, table

LENGTH = 100
#: A difference cover: every remainder mod PERIOD is a difference of two of these (each but 0 of exactly one pair).
PERIOD = 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
#: The cover whose positions are ranked in a bucket, likewise, and how many bytes a rank tells apart.
STEP = 7
RANKED = (0, 1, 3)
DEPTH = 92
#: Bytes of the grams whose least hash deals a suffix to its bucket.
GRAM = 16
BUCKET_BYTES = 32 << 20
#: Bytes of text, about, of a block, and of what is hashed at a time.
BLOCK_BYTES = 4 << 20
SLICE_BYTES = 1 << 20
LAST = 2**63 - 1

_A = Rolling(11)
#: For each remainder mod STEP its place among the ranked ones, or -1.
_PLACE = np.array([RANKED.index(r) if r in RANKED else -1 for r in range(STEP)], np.int64)
_COVER = np.array(COVER, np.int64)
_MESSAGE = "bucket int, block binary, payload binary"
_MESSAGE_FIELDS = ["bucket", "block", "payload"]


def pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(a) for a in arrays], np.int64)
    return b"".join([sizes.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(data, np.int64, len(kinds)), 8 * len(kinds), []
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(data, kind, int(size), at))
        at += out[-1].nbytes
    return out


def pack_rising(numbers: np.ndarray) -> bytes:
    """Rising whole numbers as differences, in two bytes each where they fit."""
    steps = np.diff(numbers, prepend=0)
    kind = np.uint16 if not len(steps) or steps.max() < 2**16 else np.int64
    return bytes([np.dtype(kind).itemsize]) + steps.astype(kind).tobytes()


def unpack_rising(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint16 if data[0] == 2 else np.int64, offset=1), dtype=np.int64)


def pack_spans(numbers: np.ndarray) -> bytes:
    """Rising whole numbers as runs of consecutive ones."""
    opens = np.ones(len(numbers), bool)
    opens[1:] = numbers[1:] != numbers[:-1] + 1
    at = np.flatnonzero(opens)
    return pack(np.frombuffer(pack_rising(numbers[at]), np.uint8), np.diff(np.append(at, len(numbers))).astype(np.uint32))


def unpack_spans(data: bytes) -> np.ndarray:
    starts, sizes = unpack(data, "u1", "u4")
    owner, number = _flat(sizes.astype(np.int64))
    return unpack_rising(starts.tobytes())[owner] + number


def sample_count(size: np.ndarray, width: int = LENGTH - PERIOD + 1) -> np.ndarray:
    """How many sampled strings a text of so many bytes has; none if it is too short for a string of LENGTH."""
    places = np.where(size >= LENGTH, size - width + 1, 0)
    whole, rest = places // PERIOD, places % PERIOD
    return whole * len(COVER) + np.searchsorted(_COVER, rest)


def sample_positions(number: np.ndarray) -> np.ndarray:
    """Byte position of the sampled strings with these numbers in their text."""
    return number // len(COVER) * PERIOD + _COVER[number % len(COVER)]


def _slices(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if len(texts) > start:
        yield start, len(texts)


def _flat(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and number within the owner of each of sum(counts) things."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def sample_names(texts: list[bytes]) -> np.ndarray:
    """64-bit names of all sampled strings, text by text."""
    names = [np.zeros(0, np.uint64)]
    for start, end in _slices(texts):
        data = np.frombuffer(b"".join(texts[start:end]), np.uint8)
        sizes = np.array([len(t) for t in texts[start:end]], np.int64)
        owner, number = _flat(sample_count(sizes))
        at = (np.cumsum(sizes) - sizes)[owner] + sample_positions(number)
        names.append(_A.at(_A.prefix(data), at, at + LENGTH - PERIOD + 1))
    return np.concatenate(names)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _block_id(orders: np.ndarray, contents: list[str]) -> bytes:
    return hashlib.blake2b(orders.tobytes() + "".join(contents).encode(), digest_size=12).digest()


def _bucket_rows(block: bytes, buckets: np.ndarray, n: int, payload) -> Iterator[tuple[int, bytes, bytes]]:
    """A message for each bucket that has something, its members in rising order."""
    order = np.argsort(buckets, kind="stable")
    bounds = np.searchsorted(buckets[order], np.arange(n + 1))
    for b in range(n):
        if bounds[b] < bounds[b + 1]:
            yield b, block, payload(order[bounds[b] : bounds[b + 1]])


def _messages(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], _MESSAGE_FIELDS)


def _chunks(rows: Iterator[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > 8 << 20:
            yield _messages(held)
            held, size = [], 0
    yield _messages(held)


def _head(block: bytes, n: int) -> int:
    """The bucket that carries a block's own description: negative, spread over as many as there are buckets."""
    return -1 - int.from_bytes(block[:4], "big") % n


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that none has much more than BLOCK_BYTES of text, unless one text has."""
    for batch in batches:
        ends, start = np.cumsum(pc.binary_length(batch.column("body")).to_numpy(zero_copy_only=False)), 0
        while start < batch.num_rows:
            low = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(ends, low + BLOCK_BYTES, side="right")))
            yield batch.slice(start, end - start)
            give_back()
            start = end


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t.as_py() for t in batch.column("body")]


# ---- sorting to a depth ----------------------------------------------------------------------------------------------


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as numbers in byte order."""
    return np.ndarray((max(0, len(data) - 7),), ">u8", np.ascontiguousarray(data), 0, (1,))


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of whole numbers."""
    order = np.argsort(keys)
    sorted_keys = keys[order]
    steps = np.zeros(len(keys), np.uint32)
    np.cumsum(sorted_keys[1:] != sorted_keys[:-1], out=steps[1:])
    out = np.empty(len(keys), np.uint32)
    out[order] = steps
    return out


def _pairs(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.uint64) << np.uint64(32)) | low


def cover_ranks(data: np.ndarray) -> np.ndarray:
    """Ranks, in byte order to DEPTH bytes, of the strings at all cover positions mod STEP that have so many bytes.

    The cover repeats every STEP bytes, so ranks of longer strings follow from pairs of ranks on the cover: words of eight
    bytes, then 15, 29, 57 and at last, overlapping, 92.
    """
    places = max(0, len(data) - 7)
    at = (np.arange(-(-places // STEP))[:, None] * STEP + np.array(RANKED)).ravel()
    ranks = _ranks(_words(data)[at[at < places]].astype(np.uint64))
    for steps in (1, 2, 4, 5):
        further = steps * len(RANKED)
        ranks = _ranks(_pairs(ranks[:-further], ranks[further:])) if len(ranks) > further else ranks[:0]
    return ranks


def first_equal(data: np.ndarray, at: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For the suffix at each position ``at``, the least ``order`` of those with the same LENGTH bytes.

    Two equal suffixes meet at the shift that leads both into the cover, so every shift is asked once.
    """
    first = order.copy()
    if not len(at):
        return first
    words = _words(data)
    ends = _ranks(_pairs(_ranks(words[at].astype(np.uint64)), _ranks(words[at + DEPTH].astype(np.uint64))))
    ranks = cover_ranks(data)
    for shift in range(STEP):
        place = _PLACE[(at + shift) % STEP]
        held = np.flatnonzero(place >= 0)
        if not len(held):
            continue
        keys = _pairs(ends[held], ranks[(at[held] + shift) // STEP * len(RANKED) + place[held]])
        sort = np.argsort(keys)
        keys, held = keys[sort], held[sort]
        opens = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        least = np.minimum.reduceat(order[held], opens)
        first[held] = np.minimum(first[held], np.repeat(least, np.diff(np.append(opens, len(held)))))
    return first


# ---- the cover sample ------------------------------------------------------------------------------------------------


def _cover_messages(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            orders, contents, texts = batch.column("o").to_numpy(), batch.column("m").to_pylist(), _texts(batch)
            block, names = _block_id(orders, contents), sample_names(texts)
            order = np.argsort(names, kind="stable")
            first = np.ones(len(order), bool)
            first[1:] = names[order][1:] != names[order][:-1]
            alone = first & np.append(first[1:], True)
            repeated = np.sort(order[~alone])
            sent = np.sort(order[first])
            sizes = np.array([len(t) for t in texts], np.int64)

            def rows(block=block, names=names, sent=sent, repeated=repeated, orders=orders, contents=contents, sizes=sizes):
                yield _head(block, n), block, pack(orders, sizes, np.frombuffer("".join(contents).encode(), np.uint8), np.frombuffer(pack_rising(repeated), np.uint8))
                chosen = names[sent]
                # the low half of a name picks the bucket, the high half is what is compared there: a bucket is of one
                # size whatever the corpus, so the share of names that are alike by chance doesn't grow
                kept = (chosen >> np.uint64(32)).astype(np.uint32)
                yield from _bucket_rows(block, ((chosen & np.uint64(0xFFFFFFFF)) % np.uint64(n)).astype(np.int64), n, lambda at: pack(kept[at], np.frombuffer(pack_rising(sent[at]), np.uint8)))

            yield from _chunks(rows())

    return run


def _answers(block_ids: list[bytes], buckets: int, block: np.ndarray, number: np.ndarray, coded=pack_rising) -> pa.Table:
    """For each block the numbers that are marked, rising."""
    order = np.lexsort((number, block))
    block, number = block[order], number[order]
    bounds = np.searchsorted(block, np.arange(len(block_ids) + 1))
    rows = [(buckets, block_ids[b], coded(number[bounds[b] : bounds[b + 1]])) for b in range(len(block_ids)) if bounds[b] < bounds[b + 1]]
    return pa.Table.from_batches([_messages(rows)])


def _cover_shared(group: pa.Table) -> pa.Table:
    """Sort one bucket of sampled strings; answer each block with those of its names that another block has too."""
    bucket = group.column("bucket")[0].as_py()
    if bucket < 0:
        return group
    ids, names, blocks, numbers = [], [], [], []
    for i, (block, payload) in enumerate(zip(group.column("block").to_pylist(), group.column("payload").to_pylist(), strict=True)):
        name, number = unpack(payload, "u4", "u1")
        ids.append(block)
        names.append(name)
        numbers.append(unpack_rising(number.tobytes()).astype(np.int64))
        blocks.append(np.full(len(name), i, np.int32))
    names, blocks, numbers = np.concatenate(names), np.concatenate(blocks), np.concatenate(numbers)
    order = np.argsort(names)
    same = names[order][1:] == names[order][:-1]
    shared = np.zeros(len(names), bool)
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    return _answers(ids, bucket, blocks[shared], numbers[shared])


def _cover_decode(group: pa.Table) -> pa.Table:
    """One block: the positions of its texts' sampled strings whose names are kept."""
    marked, head = [], None
    for bucket, payload in zip(group.column("bucket").to_pylist(), group.column("payload").to_pylist(), strict=True):
        if bucket < 0:
            head = unpack(payload, "i8", "i8", "u1", "u1")
        else:
            marked.append(unpack_rising(payload))
    orders, sizes, contents, repeated = head
    numbers = np.unique(np.concatenate([unpack_rising(repeated.tobytes()), *marked]))
    counts = sample_count(sizes)
    ends = np.cumsum(counts)
    owner = np.searchsorted(ends, numbers, side="right")
    positions = sample_positions(numbers - (ends - counts)[owner])
    held = np.unique(owner)
    bounds = np.append(np.searchsorted(owner, held), len(owner)).astype(np.int32)
    keys = contents.tobytes().decode()
    return pa.table({"o": pa.array(orders[held]), "m": pa.array([keys[32 * k : 32 * k + 32] for k in held], pa.string()), "ranked": pa.ListArray.from_arrays(pa.array(bounds), pa.array(positions))})


# ---- the suffixes ----------------------------------------------------------------------------------------------------


def candidate_mask(size: int, ranked: np.ndarray) -> np.ndarray:
    """Suffixes of a text that have a ranked sampled position at one of their first PERIOD shifts."""
    places = size - LENGTH + 1
    change = np.zeros(places + 1, np.int64)
    np.add.at(change, np.clip(ranked - PERIOD + 1, 0, places), 1)
    np.add.at(change, np.clip(ranked + 1, 0, places), -1)
    return np.cumsum(change[:-1]) > 0


def least_gram(prefix: np.ndarray, size: int) -> np.ndarray:
    """For each suffix of a byte array, the least hash of a gram of ``GRAM`` bytes in its first LENGTH bytes."""
    at = np.arange(size - GRAM + 1)
    least, width, wanted = _A.at(prefix, at, at + GRAM), 1, LENGTH - GRAM + 1
    while width < wanted:
        step = min(width, wanted - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return least


def _suffix_messages(n: int):
    """Deal out the candidate suffixes of each block.

    Suffixes with one least gram go to one bucket. Neighbours mostly share it, so they travel as one string: a run of
    suffixes costs a byte for each, and LENGTH - 1 more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            orders, contents, texts = batch.column("o").to_numpy(), batch.column("m").to_pylist(), _texts(batch)
            ranked = batch.column("ranked")
            run_doc, run_start, run_size, grams, held, places, base = [], [], [], [], [], [], 0
            for start, end in _slices(texts):
                data = np.frombuffer(b"".join(texts[start:end]), np.uint8)
                at, low = [np.zeros(0, np.int64)], 0
                for i in range(start, end):
                    size = len(texts[i])
                    if size >= LENGTH:
                        mask = candidate_mask(size, ranked[i].values.to_numpy())
                        a, b = _runs(mask)
                        run_doc.append(np.full(len(a), i))
                        run_start.append(a)
                        run_size.append(b - a)
                        at.append(np.flatnonzero(mask) + low)
                        for x, y in zip(a.tolist(), b.tolist(), strict=True):  # only the runs are sorted
                            held.append(texts[i][x : y + LENGTH - 1])
                            places.append(np.arange(base, base + y - x))
                            base += y - x + LENGTH - 1
                    low += size
                at = np.concatenate(at)
                if len(at):
                    grams.append(least_gram(_A.prefix(data), len(data))[at])
            join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
            run_doc, run_start, run_size = join(run_doc, np.int64), join(run_start, np.int64), join(run_size, np.int64)
            gram, at = join(grams, np.uint64), join(places, np.int64)
            owner, number = _flat(run_size)
            doc, position = run_doc[owner].astype(np.int32), (run_start[owner] + number).astype(np.int64)
            del owner, number, grams, places
            block = _block_id(orders, contents)
            # suffixes are known by their number in the order of documents, then position; of equal ones the least counts
            by_order = np.argsort(orders, kind="stable")
            turn = np.empty(len(orders), np.int64)
            turn[by_order] = np.arange(len(orders))
            rank = (turn[doc] << 40) | position
            first = first_equal(np.frombuffer(b"".join(held), np.uint8), at, rank)
            earliest = orders[doc] == orders[by_order[first >> 40]]
            # rows that share an id are not earlier than one another: each keeps the first of its own
            own = rank == first
            tied = np.flatnonzero(earliest & (turn[doc] != first >> 40))
            if len(tied):
                _, k = np.unique(np.stack([first[tied], turn[doc[tied]]]), axis=1, return_index=True)  # positions rise within a document
                own[tied[k]] = True
            sent, marked = np.flatnonzero(own), np.flatnonzero(~own)
            del first, rank, earliest, own, at, held
            opens = np.ones(len(sent), bool)
            opens[1:] = (sent[1:] != sent[:-1] + 1) | (position[sent[1:]] != position[sent[:-1]] + 1) | (doc[sent[1:]] != doc[sent[:-1]]) | (gram[sent[1:]] != gram[sent[:-1]])
            at = np.flatnonzero(opens)
            leads, sizes = sent[at], np.diff(np.append(at, len(sent)))

            def rows(block=block, orders=orders, contents=contents, texts=texts, leads=leads, sizes=sizes, doc=doc[leads], position=position[leads], gram=gram[leads], marked=marked, run=(run_doc, run_start, run_size)):
                yield _head(block, n), block, pack(orders, np.frombuffer("".join(contents).encode(), np.uint8), *run, np.frombuffer(pack_spans(marked), np.uint8))

                def payload(at: np.ndarray) -> bytes:
                    held = b"".join([texts[d][p : p + c + LENGTH - 1] for d, p, c in zip(doc[at].tolist(), position[at].tolist(), sizes[at].tolist(), strict=True)])
                    owners, counts = np.unique(doc[at], return_counts=True)
                    return pack(sizes[at].astype(np.uint32), orders[owners], counts.astype(np.uint32), np.frombuffer(pack_rising(leads[at]), np.uint8), np.frombuffer(held, np.uint8))

                yield from _bucket_rows(block, ((gram >> np.uint64(20)) % np.uint64(n)).astype(np.int64), n, payload)

            yield from _chunks(rows())

    return run


def _suffix_sort(group: pa.Table) -> pa.Table:
    """Sort one bucket of suffixes; answer each block with those that another document of smaller order also has."""
    bucket = group.column("bucket")[0].as_py()
    if bucket < 0:
        return group
    ids, parts, strings, base = [], [], [], 0
    for i, (block, payload) in enumerate(zip(group.column("block").to_pylist(), group.column("payload").to_pylist(), strict=True)):
        sizes, owners, counts, leads, data = unpack(payload, "u4", "i8", "u4", "u1", "u1")
        sizes = sizes.astype(np.int64)
        owner, number = _flat(sizes)
        lengths = sizes + LENGTH - 1
        ids.append(block)
        strings.append(data)
        parts.append((base + (np.cumsum(lengths) - lengths)[owner] + number, np.repeat(owners, counts)[owner], np.full(len(owner), i, np.int32), unpack_rising(leads.tobytes())[owner] + number))
        base += len(data)
    at, orders, blocks, numbers = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    later = orders > first_equal(np.concatenate(strings), at, orders)
    return _answers(ids, bucket, blocks[later], numbers[later], pack_spans)


def _suffix_decode(group: pa.Table) -> pa.Table:
    """One block: the maximal removed runs of its texts."""
    marked, head = [], None
    for bucket, payload in zip(group.column("bucket").to_pylist(), group.column("payload").to_pylist(), strict=True):
        if bucket < 0:
            head = unpack(payload, "i8", "u1", "i8", "i8", "i8", "u1")
        else:
            marked.append(unpack_spans(payload))
    orders, contents, run_doc, run_start, run_size, own = head
    numbers = np.unique(np.concatenate([unpack_spans(own.tobytes()), *marked]))
    ends = np.cumsum(run_size)
    at = np.searchsorted(ends, numbers, side="right")
    position, doc = run_start[at] + numbers - (ends - run_size)[at], run_doc[at]
    opens = np.ones(len(numbers), bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (position[1:] > position[:-1] + LENGTH)
    closes = np.append(opens[1:], True) if len(opens) else opens
    starts, stops, owner = position[opens], position[closes] + LENGTH, doc[opens]
    held = np.unique(owner)
    bounds = pa.array(np.append(np.searchsorted(owner, held), len(owner)).astype(np.int32))
    keys = contents.tobytes().decode()
    return pa.table({"o": pa.array(orders[held]), "m": pa.array([keys[32 * k : 32 * k + 32] for k in held], pa.string()), "starts": pa.ListArray.from_arrays(bounds, pa.array(starts)), "ends": pa.ListArray.from_arrays(bounds, pa.array(stops))})


# ---- the operator ----------------------------------------------------------------------------------------------------


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _blocks(batches):
        rows = []
        for body, starts, ends, copy in zip(*(batch.column(c) for c in ("body", "starts", "ends", "copy")), strict=True):
            data = body.as_py()
            if copy.as_py():
                spans = [(0, len(data))]
            else:
                spans = list(zip(starts.values.to_pylist(), ends.values.to_pylist(), strict=True)) if starts.is_valid else []
            kept, at = [], 0
            for a, b in spans:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            rows.append((len(data), sum(b - a for a, b in spans), spans, b"".join(kept)))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("o"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in r[2]] for r in rows], kind), pa.array([r[3] for r in rows], pa.binary())],
            ["o", "n_bytes", "n_removed", "spans", "kept"],
        )


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed byte runs) and kept (the bytes that stay) of every text."""
    spark, kind = docs.sparkSession, docs.schema[doc_id].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{doc_id} orders the documents and must be a whole number, not {kind.simpleString()}")
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    base = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("o"), body.alias("body")).withColumn("m", F.md5("body"))
    base = base.filter(F.col("m").isNotNull())  # always so; written out, it makes both shuffles of the texts one
    keys = cut(base.select("o", "m", F.octet_length("body").alias("size")))
    firsts = keys.groupBy("m").agg(F.min("o").alias("first_o"), F.count("*").alias("n")).filter("n > 1")
    copies = cut(join_counted(keys.filter(F.col("size") >= LENGTH).select("o", "m"), firsts, "m").filter("o > first_o").select("o", "m").distinct())
    n_copies, total = copies.count(), keys.agg(F.sum("size")).first()[0] or 0
    copies = hint_small(copies, n_copies)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))

    originals = base.join(copies, ["o", "m"], "left_anti")
    answers = originals.mapInArrow(_cover_messages(n), _MESSAGE).groupBy("bucket").applyInArrow(_cover_shared, _MESSAGE)
    ranked = cut(answers.groupBy("block").applyInArrow(_cover_decode, "o long, m string, ranked array<long>").dropDuplicates(["o", "m"]))

    suffixes = base.join(ranked.hint("shuffle_hash"), ["o", "m"])
    answers = suffixes.mapInArrow(_suffix_messages(n), _MESSAGE).groupBy("bucket").applyInArrow(_suffix_sort, _MESSAGE)
    found = answers.groupBy("block").applyInArrow(_suffix_decode, "o long, m string, starts array<long>, ends array<long>").dropDuplicates(["o", "m"])
    marked = copies.withColumn("copy", F.lit(True))
    spans = found.join(marked, ["o", "m"], "full").withColumn("copy", F.coalesce("copy", F.lit(False)))
    joined = base.join(spans.hint("shuffle_hash"), ["o", "m"], "left").select("o", "body", "starts", "ends", F.coalesce("copy", F.lit(False)).alias("copy"))
    done = joined.mapInArrow(_finish, "o long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
    return done.select(F.when(F.col("o") != LAST, F.col("o")).cast(kind).alias("doc_id"), "n_bytes", "n_removed", "spans", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), s AS (
  SELECT r, doc_id, i, substr(h, 2 * i - 1, 200) AS w FROM (SELECT r, doc_id, h, unnest(range(1, length(h) // 2 - 98)) AS i FROM d WHERE length(h) >= 200)
), f AS (
  SELECT w, min(doc_id) AS first_doc FROM s GROUP BY w HAVING count(*) > 1
), k AS (
  SELECT r, i, doc_id, first_doc, min(i) OVER (PARTITION BY w, r) AS own_first FROM s JOIN f USING (w)
), g AS (
  SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap FROM k WHERE doc_id > first_doc OR i > own_first
), islands AS (
  SELECT r, i, sum(CASE WHEN gap <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS n FROM g
), spans AS (
  SELECT r, min(i) AS a, max(i) + 100 AS b FROM islands GROUP BY r, n
), cuts AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 1) AS since FROM spans
), pieces AS (
  SELECT r, since, a AS stop FROM cuts UNION ALL SELECT r, max(b), 9223372036854775807 FROM cuts GROUP BY r
), kept AS (
  SELECT r, string_agg(substr(h, 2 * since - 1, 2 * (least(stop, length(h) // 2 + 1) - since)), '' ORDER BY since) AS h FROM pieces JOIN d USING (r) GROUP BY r
), counted AS (
  SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r
)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN counted USING (r)
"""
