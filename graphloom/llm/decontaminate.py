"""Benchmark decontamination (operator 3) by a stored positional inverted index, partitioned by term.

``build_index`` cuts the training documents into shards and writes, once, the postings of every term: for each shard and
bucket of terms a row with the terms, how often the shard holds each, and their positions. Rows are dealt out by bucket
and, so that no term is one task's load, by shard, so that a lookup finds a bucket in few files. The
folder can be opened again for later queries.

A search goes through the test items in blocks of about ``BLOCK_WORDS`` words, one at a time:

1. How often the corpus holds each test term, from the index; it tells which terms of a window are the rarest.
2. The lists of the ``LEAD`` rarest terms of each window, less the terms' offsets, are intersected shard by shard.
3. Only shards with a candidate left give the lists of the other terms, which are intersected in order of rarity. What
   remains are the exact occurrences.

Proximity matches use the same lists with a tolerance. What a task holds is bounded by a shard (one text at least).

Defined results: null and empty texts have no words, no hits and no items; a null item is none; items that repeat a
text are each found; repeated documents each get a row; a null doc_id stays null; no documents give no rows; only the
named columns are read, so others may have any name. Documents must be a table (or another plan that gives the same
rows in the same order when a task is run again), since a shard is known by its partition and number.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import cut, give_back, hint_small, numbered, shared_folder, table

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
ONE_IN = 20
BLOCK_WORDS = 200_000
SHARD_BYTES = 1 << 20
#: Buckets of terms, so many that a row of a shard is a few kilobytes, and how many tasks at most share the rows of one.
BUCKETS = 256
SPREAD = 64
#: Bytes of a row group: what a reader holds at a time.
ROW_GROUP = 16 << 20
#: Rarest terms of a window whose lists are intersected before any other list is read.
LEAD = 2

#: Words are runs of ASCII letters (lower-cased), digits and any other non-ASCII bytes; all else separates.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_HIGH = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def shards(texts: list[str | None], most: int = SHARD_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` characters; a longer text is a shard of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text or "") > most:
            yield start, i
            start, size = i, 0
        size += len(text or "")
    if len(texts) > start:
        yield start, len(texts)


# ---- the index -------------------------------------------------------------------------------------------------------


def bucket_of(term: bytes) -> int:
    return zlib.crc32(term) % BUCKETS


def pack_postings(lists: Sequence[tuple[bytes, int]], positions: np.ndarray) -> tuple[bytes, bytes]:
    """(terms with their counts, positions as steps) of the lists that stand one after the other in ``positions``."""
    counts = np.array([n for _, n in lists], np.uint32)
    steps = np.diff(positions, prepend=0)
    at = np.cumsum(counts, dtype=np.int64) - counts
    steps[at] = positions[at]
    steps = steps.astype(np.uint32)
    held = np.stack([steps & 0xFFFF, steps >> 16]).astype(np.uint16)  # the upper halves are nearly all zero
    return len(counts).to_bytes(4, "little") + counts.tobytes() + b" ".join(t for t, _ in lists), held.tobytes()


def unpack_terms(terms: bytes) -> tuple[list[bytes], np.ndarray]:
    n = int.from_bytes(terms[:4], "little")
    return terms[4 + 4 * n :].split(b" "), np.frombuffer(terms, np.uint32, n, 4).astype(np.int64)


def unpack_lists(counts: np.ndarray, wanted: np.ndarray, places: bytes) -> np.ndarray:
    """Positions of the wanted lists, one list after the other."""
    halves = np.frombuffer(places, np.uint16).reshape(2, -1)
    first, sizes = (np.cumsum(counts) - counts)[wanted], counts[wanted]
    at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    total = np.cumsum(halves[0][at].astype(np.int64) + (halves[1][at].astype(np.int64) << 16))
    starts = np.cumsum(sizes) - sizes
    return total - np.repeat(np.where(starts > 0, total[starts - 1], 0), sizes)


def shard_postings(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[int, bytes, bytes]]]:
    """Words and first position of each document, and (bucket, terms, positions). Documents stand one position apart."""
    index: dict[bytes, int] = defaultdict(count().__next__)
    parts = [np.fromiter(map(index.__getitem__, words), np.int64, len(words)) for words in map(words_of, texts)]
    n_words = np.array([len(x) for x in parts], np.int64)
    starts = np.cumsum(n_words + 1) - n_words - 1
    ids = np.concatenate([np.zeros(0, np.int64), *parts])
    at = np.arange(len(ids)) + np.repeat(np.arange(len(parts)), n_words)
    terms = list(index)
    buckets = np.fromiter(map(bucket_of, terms), np.int64, len(terms))
    by_bucket = np.argsort(buckets, kind="stable")
    rank = np.empty(len(terms), np.uint16 if len(terms) < 2**16 else np.int64)
    rank[by_bucket] = np.arange(len(terms))
    order = np.argsort(rank[ids], kind="stable")
    counts = np.bincount(rank[ids], minlength=len(terms))
    bounds, ends = np.searchsorted(buckets[by_bucket], np.arange(BUCKETS + 1)), np.concatenate([[0], np.cumsum(counts)])

    def rows() -> Iterator[tuple[int, bytes, bytes]]:
        for b in range(BUCKETS):
            low, high = int(bounds[b]), int(bounds[b + 1])
            if low < high:
                lists = [(terms[by_bucket[k]], int(counts[k])) for k in range(low, high)]
                yield (b, *pack_postings(lists, at[order[ends[low] : ends[high]]]))

    return n_words, starts, rows()


class Index:
    """An index in a folder: ``docs`` (shard, number, n_words and the carried columns; bucket -2 of its rows) and
    ``postings`` (bucket, shard, terms, places; bucket -1 has the first positions of the shard's documents)."""

    def __init__(self, spark: SparkSession, folder: str, carry: Sequence[str] = ("doc_id",)):
        self.spark, self.folder, self.carry = spark, folder, list(carry)
        names = [f"graphloom_{i}" for i in range(len(self.carry))]
        held = spark.read.schema(spark.read.parquet(f"{folder}/shape").schema).parquet(f"{folder}/rows")
        self.names, self.docs = names, held.filter("bucket = -2").select("shard", "number", "n_words", *names)
        self.postings = held.filter("bucket >= -1").select("bucket", "shard", "terms", "places")


def build_index(docs: DataFrame, folder: str | None = None, carry: Sequence[str] = ("doc_id",), text: str = "text") -> Index:
    """Write the index of ``docs`` (to a new shared folder if none is named) and open it."""
    spark, carry = docs.sparkSession, list(carry)
    folder = folder or shared_folder(spark, "postings")
    kept, names = numbered(docs.select(*carry))
    kinds = [kept.schema[c].dataType for c in names]
    read = docs.select(*[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)], F.col(text).alias("graphloom_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for start, end in shards(texts):
                n_words, starts, rows = shard_postings(texts[start:end])
                found, n = [(-1, starts.tobytes(), b""), *rows], end - start
                total = n + len(found)
                gap = lambda kind, k=n: pa.nulls(k, kind)
                columns = {
                    "bucket": pa.array([-2] * n + [r[0] for r in found], pa.int32()),
                    "shard": pa.array([number] * total, pa.int64()),
                    "terms": pa.concat_arrays([gap(pa.binary()), pa.array([r[1] for r in found], pa.binary())]),
                    "places": pa.concat_arrays([gap(pa.binary()), pa.array([r[2] for r in found], pa.binary())]),
                    "number": pa.array([*range(n), *[None] * len(found)], pa.int32()),
                    "n_words": pa.concat_arrays([pa.array(n_words), gap(pa.int64(), len(found))]),
                }
                for i, name in enumerate(names):
                    held = batch.column(i).slice(start, n)
                    columns[name] = pa.concat_arrays([held, gap(held.type, len(found))])
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
                number += 1
            give_back()

    schema = ", ".join(["bucket int, shard long, terms binary, places binary, number int, n_words long", *[f"{n} {k.simpleString()}" for n, k in zip(names, kinds, strict=True)]])
    made = read.mapInArrow(run, schema)
    spark.createDataFrame([], made.schema).coalesce(1).write.parquet(f"{folder}/shape")  # an index of no rows can be opened too
    spread = F.when(F.col("bucket") < 0, F.xxhash64("shard", "number")).otherwise(F.pmod(F.xxhash64("shard"), F.lit(SPREAD)))
    made.repartition("bucket", spread).write.option("parquet.block.size", ROW_GROUP).parquet(f"{folder}/rows")
    return Index(spark, folder, carry)


# ---- the search ------------------------------------------------------------------------------------------------------


class Phrases:
    """Test items as term numbers, and their windows: item, first term and width of each."""

    def __init__(self, items: Sequence[tuple[str, str | None]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = defaultdict(count().__next__)
        self.items, parts, owner, first, width, at = [], [], [], [], [], 0
        for item_id, text in items:
            words = words_of(text)
            if words:
                size = min(window, len(words))
                places = np.arange(len(words) - size + 1)
                owner.append(np.full(len(places), len(self.items)))
                first.append(at + places)
                width.append(np.full(len(places), size))
                parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
                self.items.append(str(item_id))
                at += len(words)
        self.numbers = dict(self.numbers)
        join = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
        self.terms, self.owner, self.first, self.width = join(parts), join(owner), join(first), join(width)
        self.window = int(self.width.max()) if len(self.width) else 0
        self.order = np.zeros((len(self.width), self.window), np.int64)

    def rank(self, held: np.ndarray) -> None:
        """Put the offsets of each window in order of how often the corpus holds their terms; drop those it can't hold."""
        offsets = np.arange(self.window)
        at = np.minimum(self.first[:, None] + offsets, max(0, len(self.terms) - 1))
        often = np.where(offsets < self.width[:, None], held[self.terms[at]] if len(self.terms) else 0, np.iinfo(np.int64).max)
        self.order = np.argsort(often, axis=1, kind="stable")
        possible = (often > 0).all(axis=1)
        self.owner, self.first, self.width, self.order = self.owner[possible], self.first[possible], self.width[possible], self.order[possible]

    def leading(self, n: int = LEAD) -> np.ndarray:
        """Numbers of the ``n`` rarest terms of every window."""
        held = [self.terms[self.first[self.width > r] + self.order[self.width > r, r]] for r in range(min(n, self.window))]
        return np.unique(np.concatenate([np.zeros(0, np.int64), *held]))

    def starts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) for every posting of each window's rarest term, less its offset."""
        if not len(self.width):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        offset = self.order[:, 0]
        term = self.terms[self.first + offset].astype(np.uint64)
        low, high = np.searchsorted(keys, term << _HIGH), np.searchsorted(keys, (term + np.uint64(1)) << _HIGH)
        sizes = high - low
        window = np.repeat(np.arange(len(sizes)), sizes)
        at = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        start = (keys[at] & _LOW).astype(np.int64) - offset[window]
        return window[start >= 0], start[start >= 0]

    def intersect(self, keys: np.ndarray, window: np.ndarray, start: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """The candidates that the offset-adjusted lists of each window's terms of rank ``low`` up to ``high`` also have."""
        for r in range(low, min(high, self.window)):
            if not len(window):
                break
            offset = self.order[window, r]
            asked = self.width[window] > r
            term = self.terms[np.minimum(self.first[window] + offset, len(self.terms) - 1)]
            wanted = (term.astype(np.uint64) << _HIGH) | (start + offset).astype(np.uint64)
            at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
            kept = ~asked | (keys[at] == wanted if len(keys) else False)
            window, start = window[kept], start[kept]
        return window, start


def _lists(terms: bytes, places: bytes, known: dict[bytes, int]) -> np.ndarray:
    """The lists of the known terms of one row, as keys of (term number, position)."""
    listed, counts = unpack_terms(terms)
    held = np.array([i for i, t in enumerate(listed) if t in known], np.int64)
    if not len(held):
        return np.zeros(0, np.uint64)
    number = np.array([known[listed[i]] for i in held], np.uint64)
    return (np.repeat(number, counts[held]) << _HIGH) | unpack_lists(counts, held, places).astype(np.uint64)


def _wanted_rows(postings: DataFrame, numbers, wanted: set[int] | None = None) -> DataFrame:
    """shard, part (0: first positions, 1: keys) and data: the lists of the wanted terms (all of ``numbers`` without a set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value if wanted is None else {t: n for t, n in numbers.value.items() if n in wanted}
        for batch in batches:
            shards_, parts, keys = [], [], []
            for shard, bucket, terms, places in zip(*(batch.column(c) for c in ("shard", "bucket", "terms", "places")), strict=True):
                head = bucket.as_py() < 0
                data = terms.as_py() if head else _lists(terms.as_py(), places.as_py(), known).tobytes()
                if head or data:
                    shards_.append(shard.as_py())
                    parts.append(0 if head else 1)
                    keys.append(data)
            yield pa.RecordBatch.from_arrays([pa.array(shards_, pa.int64()), pa.array(parts, pa.int32()), pa.array(keys, pa.binary())], ["shard", "part", "data"])
            give_back()

    return postings.mapInArrow(run, "shard long, part int, data binary")


def _group(group: pa.Table) -> tuple[int, dict[int, list[bytes]]]:
    held = defaultdict(list)
    for part, data in zip(group.column("part").to_pylist(), group.column("data").to_pylist(), strict=True):
        held[part].append(data)
    return group.column("shard")[0].as_py(), held


def _keys(parts: list[bytes]) -> np.ndarray:
    return np.sort(np.frombuffer(b"".join(parts), np.uint64))


def _frequencies(index: Index, postings: DataFrame, numbers, n: int) -> np.ndarray:
    """How often the corpus holds each of the ``n`` test terms; as many rows, at most, reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for terms in batch.column("terms"):
                for term, often in zip(*unpack_terms(terms.as_py()), strict=True):
                    number = numbers.value.get(term)
                    if number is not None:
                        total[number] += often
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["number", "often"])

    found = postings.filter("bucket >= 0").select("terms").mapInArrow(run, "number long, often long").groupBy("number").agg(F.sum("often").alias("often"))
    out = np.zeros(n, np.int64)
    for row in found.collect():  # a row per test term of the block
        out[row["number"]] = row["often"]
    return out


#: Where a shard's candidates stand among its rows.
CANDIDATES = -3
HIT = "shard long, number int, spans array<struct<start:long,end:long>>, items array<string>"


def _hits(shard: int, phrases: Phrases, first: np.ndarray, window: np.ndarray, start: np.ndarray) -> pa.Table:
    """For each document with an occurrence: maximal hit spans [start, end) in words, and the items that occur."""
    order = np.argsort(start, kind="stable")
    window, start = window[order], start[order]
    end, doc = start + phrases.width[window], np.searchsorted(first, start, side="right") - 1
    spans, items = defaultdict(list), defaultdict(set)
    for d, a, b, w in zip(doc.tolist(), start.tolist(), end.tolist(), window.tolist(), strict=True):
        items[d].add(phrases.items[phrases.owner[w]])
        if spans[d] and a <= spans[d][-1][1]:
            spans[d][-1][1] = max(b, spans[d][-1][1])
        else:
            spans[d].append([a, b])
    docs = sorted(spans)
    listed = [[{"start": a - int(first[d]), "end": b - int(first[d])} for a, b in spans[d]] for d in docs]
    return pa.table({"shard": pa.array([shard] * len(docs), pa.int64()), "number": pa.array(docs, pa.int32()), "spans": pa.array(listed, _SPANS), "items": pa.array([sorted(items[d]) for d in docs], pa.list_(pa.string()))})


def _buckets(postings: DataFrame, terms: Sequence[bytes]) -> DataFrame:
    """The rows of the buckets that the terms fall into."""
    held = sorted({bucket_of(t) for t in terms})
    return postings.filter(F.col("bucket").isin(*held)) if held else postings.filter("false")


def _occurrences(index: Index, phrases: Phrases) -> DataFrame:
    """The hits of one block of test items (``HIT``)."""
    spark, terms = index.spark, list(phrases.numbers)
    numbers = spark.sparkContext.broadcast(phrases.numbers)
    phrases.rank(_frequencies(index, _buckets(index.postings, terms), numbers, len(terms)))
    lead = set(phrases.leading().tolist())
    shipped = spark.sparkContext.broadcast(phrases)

    def candidates(group: pa.Table) -> pa.Table:
        shard, held = _group(group)
        keys, block = _keys(held[1]), shipped.value
        window, start = block.intersect(keys, *block.starts(keys), 1, LEAD)
        data = [np.stack([window, start]).tobytes()] if len(window) else []
        return pa.table({"shard": pa.array([shard] * len(data), pa.int64()), "part": pa.array([2] * len(data), pa.int32()), "data": pa.array(data, pa.binary())})

    row = "shard long, part int, data binary"
    leads = _wanted_rows(_buckets(index.postings, [terms[i] for i in lead]), numbers, lead)
    found = cut(leads.groupBy("shard").applyInArrow(candidates, row))

    def settle(group: pa.Table) -> pa.Table:
        rows = {c: group.column(c) for c in ("bucket", "terms", "places")}
        bucket, block = rows["bucket"].to_numpy(), shipped.value
        held = lambda k: rows["terms"][int(np.flatnonzero(bucket == k)[0])].as_py()
        window, start = np.frombuffer(held(CANDIDATES), np.int64).reshape(2, -1)
        asked = np.unique(window)
        at = np.minimum(block.first[asked][:, None] + np.arange(block.window), len(block.terms) - 1)
        known = {terms[i]: i for i in np.unique(block.terms[at]).tolist()}
        lists = [_lists(rows["terms"][int(i)].as_py(), rows["places"][int(i)].as_py(), known).tobytes() for i in np.flatnonzero(bucket >= 0)]
        window, start = block.intersect(_keys(lists), window, start, LEAD, block.window)
        return _hits(group.column("shard")[0].as_py(), block, np.frombuffer(held(-1), np.int64), window, start)

    # whole rows of the shards with a candidate; of their lists only those that a candidate asks for are unpacked
    held = index.postings.join(hint_small(found.select("shard"), found.count()), "shard", "left_semi")
    asked = found.select("shard", F.lit(CANDIDATES).alias("bucket"), F.col("data").alias("terms"), F.lit(None).cast("binary").alias("places"))
    return cut(held.unionByName(asked).groupBy("shard").applyInArrow(settle, HIT))


def blocks(items: DataFrame, item_id: str = "item_id", text: str = "text", most: int = BLOCK_WORDS, window: int = WINDOW) -> Iterator[Phrases]:
    """The test items in blocks that are each small enough to be shipped; the driver holds one at a time."""
    chars = F.coalesce(F.length(text), F.lit(0))
    total = items.agg(F.sum(chars)).first()[0] or 0
    n = max(1, -(-int(total) // (2 * most)))  # a word and its separator take at least two characters
    for block in range(n):
        part = items.filter(F.pmod(F.xxhash64(item_id, text), F.lit(n)) == block)
        yield Phrases([(r[0], r[1]) for r in part.select(item_id, text).collect()], window)


def search(index: Index, items: DataFrame, window: int = WINDOW, most: int = BLOCK_WORDS) -> DataFrame:
    """The carried columns of every document with n_words, its maximal hit spans in words, and the items that occur."""
    found = None
    for phrases in blocks(items, most=most, window=window):
        part = _occurrences(index, phrases)
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("shard", "number").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = cut(merged.withColumn("spans", merge_spans("spans")))
    joined = index.docs.join(hint_small(merged, merged.count()), ["shard", "number"], "left")
    spans, listed = F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(*[F.col(n).alias(c) for n, c in zip(index.names, index.carry, strict=True)], "n_words", spans.alias("spans"), listed.alias("items"))


def find(docs: DataFrame, items: DataFrame, carry: Sequence[str] = ("doc_id",), text: str = "text", window: int = WINDOW, most: int = BLOCK_WORDS) -> DataFrame:
    """``search`` over an index that is made for it."""
    return search(build_index(docs, None, carry, text), items, window, most)


def merge_spans(column: str):
    """Overlapping and touching spans of a column made one."""
    start = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(done, span):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= span["start"]), joined).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(column), start, add)


def judged(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (ONE_IN * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the contaminated ones, all columns kept. The verdict depends on the text alone, so its digest
    tells which rows go."""
    rows, names = numbered(docs)
    body = F.col(names[docs.columns.index(text)])
    digest = F.sha2(body, 256)
    found = judged(find(rows.select(digest.alias("key"), body.alias("text")), items, ("key",)))
    gone = cut(found.filter("contaminated").select("key").distinct())
    return rows.join(hint_small(gone, gone.count()), digest == F.col("key"), "left_anti").toDF(*docs.columns)


def near(index: Index, phrases: Sequence[tuple[str, str]], slop: int) -> DataFrame:
    """The carried columns, item_id and position: each place of a phrase's rarest term that has all its other terms
    within ``slop`` words, in one document."""
    spark, block = index.spark, Phrases(phrases, 1)
    numbers = spark.sparkContext.broadcast(block.numbers)
    terms = [np.unique(block.terms[block.owner == i]) for i in range(len(block.items))]
    often = _frequencies(index, _buckets(index.postings, list(block.numbers)), numbers, len(block.numbers))
    terms = [t[np.argsort(often[t], kind="stable")] for t in terms]
    shipped = spark.sparkContext.broadcast((terms, block.items))

    def run(group: pa.Table) -> pa.Table:
        shard, held = _group(group)
        keys, first, rows = _keys(held[1]), np.frombuffer(held[0][0], np.int64), []
        asked, names = shipped.value
        ends = np.append(first[1:], np.iinfo(np.int64).max)

        def postings(term: int) -> np.ndarray:
            a, b = np.searchsorted(keys, np.array([term, term + 1], np.uint64) << _HIGH)
            return (keys[a:b] & _LOW).astype(np.int64)

        for name, order in zip(names, asked, strict=True):
            at = postings(int(order[0]))
            doc = np.searchsorted(first, at, side="right") - 1
            for term in order[1:]:
                listed = postings(int(term))
                low, high = np.maximum(at - slop, first[doc]), np.minimum(at + slop, ends[doc] - 1)
                kept = np.searchsorted(listed, low) < np.searchsorted(listed, high, side="right")
                at, doc = at[kept], doc[kept]
            rows += [(shard, d, name, p - int(first[d])) for d, p in zip(doc.tolist(), at.tolist(), strict=True)]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("shard", "number", "item_id", "position"), columns, (pa.int64(), pa.int32(), pa.string(), pa.int64()), strict=True)})

    chosen = index.postings.filter(F.col("bucket").isin(-1, *sorted({bucket_of(t) for t in block.numbers})))
    found = cut(_wanted_rows(chosen, numbers).groupBy("shard").applyInArrow(run, "shard long, number int, item_id string, position long"))
    joined = index.docs.join(hint_small(found, found.count()), ["shard", "number"])
    return joined.select(*[F.col(n).alias(c) for n, c in zip(index.names, index.carry, strict=True)], "item_id", "position")


def proximity(docs: DataFrame, phrases: Sequence[tuple[str, str]], slop: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``near`` over an index that is made for it: doc_id, item_id, position."""
    return near(build_index(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))), phrases, slop)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), wins AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, w[i:i + least(13, len(w)) - 1] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), grams AS (
  SELECT r, k, i, w[i:i + k - 1] AS win FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT DISTINCT k FROM wins) WHERE len(w) >= k)
), found AS (
  SELECT g.r, g.i, g.k, x.item_id FROM grams g JOIN wins x ON g.k = x.k AND g.win = x.win
), hit AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM found) GROUP BY r
), named AS (
  SELECT r, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY r
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(n.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w.w) AS contaminated
FROM words w LEFT JOIN hit h USING (r) LEFT JOIN named n USING (r)
"""
