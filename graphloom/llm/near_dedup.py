"""Near-duplicate documents (operator 6) by DartMinHash.

A document is the weighted set of its five-word shingles, weighted by how often it holds them. Every unit of weight of
an element is a region at which darts are thrown: a Poisson process along the rank axis, fixed by a hash of the element,
the unit and the dart's number alone. A document sees the darts inside its own regions up to a rank that depends on its
total weight, so about K ln K + 2 K darts fall whatever its size. Each dart belongs to one of K coordinates by its hash,
and the earliest dart of each coordinate is kept; two documents agree in a coordinate with the probability of their
weighted Jaccard similarity. Bands of ``ROWS`` coordinates are joined; candidates are compared exactly.

Copies: texts with the same words are one node from the start. A band bucket is cut into blocks of bounded size. First
every block is compared within itself and with two leaders of the bucket, on whole 64-bit elements, by products of the
element matrices; so a member is sent once a band, however many near copies it has. What the links so far join needs no
further comparison, and neither do buckets of the same members in several bands, or buckets of later bands whose members
earlier ones have joined: only members outside the largest component of their bucket are then compared with the members of
the other blocks. A task returns a spanning forest of the similar pairs that it finds, at most a row per member.
No link between components is lost: every two members of a bucket have been compared or were joined by checked links.

Defined results: words are lower-cased runs of letters, digits and non-ASCII characters; a text of one to four words is
one shingle; a text without words is in a class by itself; the class is the smallest doc_id in it (null only if all
its doc_ids are null); rows that repeat a doc_id and a text are each returned; an empty table gives no rows; other columns are
not read. Shingles and texts are told apart by 64-bit and 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from graphloom.llm.common import Rolling, cut, give_back, hint_small, mix64, numbered, table
from graphloom.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 4
#: Bands whose buckets are compared first.
FIRST_BANDS = 4
SLICE_BYTES = 1 << 20
#: Most members or elements, about, of a block of a band bucket, and columns of an element matrix at a time.
BLOCK = 512
BLOCK_ELEMENTS = 1_000_000
COLUMNS = 2_048
#: Elements of a group after which its memory is given back at once.
GIVE_BACK = 200_000

_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SHINGLES = Rolling(7)
_UNIT = 1.0 / 2**53


def words_joined(text: str | None) -> bytes:
    """The words of a text with one space between them."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD).split())


def elements(texts: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """One number per shingle and occurrence number of it in its text, and how many each text has.

    The weighted set of a text is written as a plain set of (shingle, unit of weight), which has the same similarity.
    """
    data = np.frombuffer(b"".join(t + b" " for t in texts), np.uint8)
    prefix = _SHINGLES.prefix(data)
    ends = np.flatnonzero(data == 32)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    owner = np.searchsorted(first, starts, side="right") - 1
    n_words = np.bincount(owner, minlength=len(texts))
    n_words[[i for i, t in enumerate(texts) if not t]] = 0
    word_first = np.cumsum(np.bincount(owner, minlength=len(texts))) - np.bincount(owner, minlength=len(texts))
    counts = np.where(n_words > 0, np.maximum(1, n_words - width + 1), 0)
    total = int(counts.sum())
    doc = np.repeat(np.arange(len(texts)), counts)
    word = np.repeat(word_first, counts) + np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    last = np.minimum(word + width, np.repeat(word_first + n_words, counts)) - 1
    hashed = _SHINGLES.at(prefix, starts[word], ends[last])
    order = np.lexsort((hashed, doc))
    same = np.zeros(total, bool)
    same[1:] = (hashed[order][1:] == hashed[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    run_start = np.maximum.accumulate(np.where(same, 0, np.arange(total)))
    unit = (np.arange(total) - run_start).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mix64(hashed[order] + unit * _GOLDEN), counts


def signatures(hashed: np.ndarray, counts: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """The id of the earliest dart of each of ``k`` coordinates, one row per text (zeros for texts without elements)."""
    out = np.zeros((len(counts), k), np.uint64)
    todo = np.flatnonzero(counts > 0)
    darts = k * np.log(k) + 2 * k
    while len(todo):
        limit = darts / counts[todo]
        chosen = np.zeros(len(counts), bool)
        chosen[todo] = True
        element = hashed[np.repeat(chosen, counts)]
        row = np.repeat(np.arange(len(todo)), counts[todo])
        rank, ids, ranks, rows, number = np.zeros(len(element)), [], [], [], 0
        while len(element):
            with np.errstate(over="ignore"):
                dart = mix64(element + np.uint64(2 * number + 1) * _GOLDEN)
                rank = rank - np.log((mix64(dart + _GOLDEN) >> np.uint64(11)).astype(float) * _UNIT + _UNIT / 2)
            inside = rank < limit[row]
            element, row, rank = element[inside], row[inside], rank[inside]
            ids.append(dart[inside])
            ranks.append(rank)
            rows.append(row)
            number += 1
        dart, rank, row = np.concatenate(ids), np.concatenate(ranks), np.concatenate(rows)
        cell = row * k + (dart % np.uint64(k)).astype(np.int64)
        order = np.lexsort((rank, cell))
        first = np.ones(len(order), bool)
        first[1:] = cell[order][1:] != cell[order][:-1]
        kept = order[first]
        filled = np.zeros(len(todo) * k, np.uint64)
        filled[cell[kept]] = dart[kept]
        hit = np.zeros(len(todo) * k, bool)
        hit[cell[kept]] = True
        done = hit.reshape(-1, k).all(axis=1)
        out[todo[done]] = filled.reshape(-1, k)[done]
        todo, darts = todo[~done], 2 * darts  # a coordinate without a dart: look further along the ranks
    return out


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    hashed = np.zeros((len(signature), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            hashed = mix64(hashed * _GOLDEN + parts[:, :, r])
    return hashed


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > SLICE_BYTES:
            yield start, i
            start, size = i, 0
        size += len(text)
    if len(texts) > start:
        yield start, len(texts)


def nodes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, key (a hash of the words, null without words), weight, and the band hashes of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [words_joined(t.as_py()) for t in batch.column(1)]
            for start, end in _slices(texts):
                part = texts[start:end]
                hashed, counts = elements(part)
                banded = band_hashes(signatures(hashed, counts, bands * rows), bands, rows).view(np.int64)
                keys = pa.array([hashlib.blake2b(t, digest_size=16).digest() if t else None for t in part], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * bands), pa.array(banded.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), keys, pa.array(counts, pa.int64()), lists], ["doc_id", "key", "weight", "bands"])
            give_back()

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, key binary, weight long, bands array<long>")


def element_sets(docs: DataFrame, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """key and the sorted elements of the texts that stand for the keys in ``wanted(key, rep)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [words_joined(t.as_py()) for t in batch.column(0)]
            for start, end in _slices(texts):
                part = texts[start:end]
                hashed, counts = elements(part)
                keys = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in part], pa.binary())
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashed.view(np.int64)))], ["key", "elements"])
            give_back()

    chosen = docs.join(hint_small(wanted.select("rep").distinct(), n_wanted), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    made = chosen.select("text").mapInArrow(run, "key binary, elements array<long>")
    return made.join(hint_small(wanted.select("key"), n_wanted), "key", "left_semi").dropDuplicates(["key"])


def forest(similar_pairs: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    n, edges = len(similar_pairs), []
    unseen = np.ones(n, bool)
    for root in range(n):
        if unseen[root]:
            unseen[root] = False
            level = np.array([root])
            while len(level):
                near = similar_pairs[level] & unseen
                reached = np.flatnonzero(near.any(axis=0))
                edges += list(zip(level[near[:, reached].argmax(axis=0)].tolist(), reached.tolist(), strict=True))
                unseen[reached] = False
                level = reached
    return edges


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share."""
    n = len(sets)
    out = np.zeros((n, n))
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = held[column] > 1
    row, column = row[kept], (np.cumsum(held > 1) - 1)[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    last = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, last, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((n, COLUMNS), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        out += part @ part.T
    return out


def _bucket_links(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        held = dict(zip(group.column("key").to_pylist(), group.column("elements").combine_chunks(), strict=True))  # a leader may come twice
        keys, edges = list(held), []
        if len(keys) > 1:
            sets = [x.values.to_numpy() for x in held.values()]
            size = np.array([len(x) for x in sets], float)
            shared = shared_counts(sets)
            near = shared >= threshold * (size[:, None] + size[None, :] - shared)
            edges = [tuple(sorted((keys[a], keys[b]))) for a, b in forest(near)]
            if size.sum() > GIVE_BACK:
                del sets, size, shared, near
                give_back()
        return pa.table({"a": pa.array([e[0] for e in edges], pa.binary()), "b": pa.array([e[1] for e in edges], pa.binary())})

    return run


def _compared(dealt: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links among the members that ``dealt(key, places)`` puts at one place (band, h, part, block)."""
    met = dealt.join(sets, "key").select("key", "elements", F.explode("places").alias("place")).select("key", "elements", "place.*")
    return met.groupBy("band", "h", "part", "block").applyInArrow(_bucket_links(threshold), "a binary, b binary")


def _place(part, block):
    return F.named_struct(F.lit("band"), F.col("band"), F.lit("h"), F.col("h"), F.lit("part"), part.cast("int"), F.lit("block"), block.cast("int"))


def _numbers(n):
    return F.sequence(F.lit(0), F.col(n) - 1)


def _round(keys: DataFrame, bands, read: DataFrame, threshold: float, roots: DataFrame | None) -> DataFrame | None:
    """``roots`` and what the buckets of some bands add to them; buckets whose members are joined already add nothing."""
    if roots is not None:
        keys = keys.join(hint_small(roots, roots.count()), "key", "left").withColumn("root", F.coalesce("root", "key"))
    else:
        keys = keys.withColumn("root", F.col("key"))
    entries = keys.select("key", "rep", "weight", "root", F.posexplode("bands").alias("band", "h")).filter(bands)
    cuts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("weight") / BLOCK_ELEMENTS)).cast("int")
    sums = [F.count("*").alias("members"), cuts.alias("blocks"), F.min("key").alias("low"), F.max("key").alias("high"), F.min("root").alias("r0"), F.max("root").alias("r1")]
    found = entries.groupBy("band", "h").agg(*sums, F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"))
    # buckets of one set of members have the same pairs, so one of them, of whatever band, does for all
    buckets = found.filter("members > 1 AND r0 <> r1").groupBy("members", "low", "high", "x", "y").agg(F.min_by(F.struct("band", "h", "blocks"), F.struct("band", "h")).alias("b")).select("b.*", "low", "high")
    buckets = cut(buckets)
    n = buckets.count()
    if not n:
        return roots
    large = buckets.filter("blocks > 1").select("band", "h", "blocks", F.array("low", "high").alias("leaders"))
    member = F.struct("band", "h", "blocks", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"))
    members = entries.join(hint_small(buckets.select("band", "h", "blocks"), n), ["band", "h"]).groupBy("key").agg(F.first("rep").alias("rep"), F.collect_list(member).alias("held"))
    members = cut(members)
    at_block = lambda m: F.named_struct(F.lit("band"), m["band"], F.lit("h"), m["h"], F.lit("part"), F.lit(0), F.lit("block"), m["block"])
    dealt = members.select("key", F.transform("held", at_block).alias("places"))
    if not large.isEmpty():
        led = large.select(F.explode("leaders").alias("key"), F.transform(_numbers("blocks"), lambda j: _place(F.lit(0), j)).alias("places"))
        dealt = dealt.unionByName(led)
    known = lambda found: found if roots is None else found.unionByName(roots.select(F.col("key").alias("a"), F.col("root").alias("b")))
    roots = cut(components(known(_compared(dealt, element_sets(read, members, members.count()), threshold))))
    # members of large buckets that this left outside the largest component of their bucket
    placed = members.select("key", "rep", F.explode(F.filter("held", lambda m: m["blocks"] > 1)).alias("m")).select("key", "rep", "m.*")
    rooted = placed.join(hint_small(roots, roots.count()), "key", "left").withColumn("root", F.coalesce("root", "key"))
    sizes = rooted.groupBy("band", "h", "root").agg(F.count("*").alias("n"))
    split = cut(sizes.groupBy("band", "h").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.sum("n").alias("n"), F.max("n").alias("n_most")).filter("n > n_most"))
    if split.isEmpty():
        return roots
    split = split.select("band", "h", "most", F.ceil((F.col("n") - F.col("n_most")) / BLOCK).cast("int").alias("parts"))
    rooted = cut(rooted.join(split, ["band", "h"]))
    part = F.pmod(F.xxhash64("key", F.lit("outside")), F.col("parts")).cast("int")
    asked = rooted.filter("root <> most").select("key", F.transform(_numbers("blocks"), lambda j: _place(part, j)).alias("places"))
    others = rooted.select("key", F.transform(_numbers("parts"), lambda i: _place(i, F.col("block"))).alias("places"))
    wanted = cut(rooted.groupBy("key").agg(F.first("rep").alias("rep")))
    return cut(components(known(_compared(asked.unionByName(others), element_sets(read, wanted, wanted.count()), threshold))))


def links(keys: DataFrame, read: DataFrame, threshold: float) -> DataFrame:
    """(key, root) of all that is linked, from ``keys(key, rep, weight, bands)``: a few bands first, which join most near
    copies, then, of the others, only buckets whose members aren't all joined yet."""
    roots = None
    for bands in (F.col("band") < FIRST_BANDS, F.col("band") >= FIRST_BANDS):
        roots = _round(keys, bands, read, threshold, roots)
    return keys.select("key", F.col("key").alias("root")).limit(0) if roots is None else roots


def classes(docs: DataFrame, threshold: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id, class_size, key and class_key of every document.

    A bucket is cut into blocks of about ``BLOCK`` members or ``BLOCK_ELEMENTS`` elements; a task sees two blocks at most.
    """
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    made = cut(nodes(read, bands=bands, rows=rows))
    distinct = made.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    roots = links(cut(distinct), read, threshold)
    named = made.select("doc_id", "key").join(roots.withColumnRenamed("root", "found"), "key", "left").withColumn("root", F.coalesce("found", "key"))
    sizes = named.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("class_doc"), F.count("*").alias("class_rows")).filter("class_rows > 1")
    sizes = cut(sizes)
    joined = named.join(hint_small(sizes, sizes.count()), "root", "left")
    return joined.select("doc_id", F.coalesce("class_doc", "doc_id").alias("class_id"), F.coalesce("class_rows", F.lit(1)).cast("long").alias("class_size"), "key", F.col("root").alias("class_key"))


def _keys(texts: pd.Series) -> pd.Series:
    joined = texts.map(words_joined)
    return joined.map(lambda t: hashlib.blake2b(t, digest_size=16).digest() if t else None)


def keep_one(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One document of each class: the row with its smallest doc_id, and one of them if rows share that id.

    Ids that go are few against those that stay, so what is joined with the texts is the former. All columns are kept,
    whatever their names.
    """
    rows, names = numbered(docs)
    key, body = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    found = cut(classes(rows, threshold, doc_id=key, text=body))
    stays = F.col("class_id").eqNullSafe(F.col("doc_id"))
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(stays.cast("int")).alias("n_stay"), F.max("class_size").alias("size"))
    ids = cut(ids.filter("n_stay = 0 OR (n > 1 AND size > 1)").withColumnRenamed("doc_id", "touched_id"))
    n, same = ids.count(), lambda c: F.col(c).eqNullSafe(F.col("touched_id"))
    kept = rows.join(hint_small(ids.select("touched_id"), n), same(key), "left_anti")
    tied = ids.filter("n_stay > 0").select("touched_id")
    if not tied.isEmpty():
        shared = rows.join(hint_small(tied, n), same(key), "left_semi").withColumn("near_key", F.pandas_udf(_keys, BinaryType())(F.col(body).cast("string")))
        judged = found.filter(stays).join(hint_small(tied, n), same("doc_id"), "left_semi").filter("key IS NOT NULL").select(F.col("doc_id").alias("near_id"), F.col("key").alias("stay_key"), "class_key").distinct()
        one = shared.join(judged, F.col(key).eqNullSafe(F.col("near_id")) & (F.col("near_key") == F.col("stay_key"))).dropDuplicates(["class_key"])
        kept = kept.unionByName(one.select(*names)).unionByName(shared.filter("near_key IS NULL").select(*names))
    return kept.toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")
