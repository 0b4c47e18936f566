"""Federation of shards by literal ids: ownership, edge admission, audits, digests and incremental update."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.operators.lookup import Refused
from graphloom.session import cut

#: Schemes that are never looked up in a shard; fixed values.
RESERVED = ("fetch", "artifact", "impl", "doctrine", "scrape")
#: Schemes up to which their owners are broadcast.
FEW = 200_000
#: Pairs of schemes up to which those that a join asks for are listed.
ASKED = 1_000


def ownership(lane_nodes: DataFrame) -> DataFrame:
    """One row per id of ``lane_nodes(id, lane, lane_rank, seq, stub, ...)``: the first that isn't a stub, else the first."""
    others = [c for c in lane_nodes.columns if c != "id"]
    best = F.min_by(F.struct(*others), F.struct("stub", "lane_rank", "seq")).alias("best")
    return lane_nodes.groupBy("id").agg(best).select("id", "best.*")


def _tagged(edges: DataFrame, schemes: DataFrame, ends: tuple[str, ...], standard: tuple[str, ...]) -> DataFrame:
    """``edges`` with each end's scheme, its owners, and the verdict where the scheme settles it (else null).

    Owners of a scheme are as many as the lanes that declare it; they are broadcast if the schemes were counted and are few.
    """
    owners = schemes.groupBy(F.col("scheme").alias("owned_scheme")).agg(F.collect_set("lane").alias("owned_by"))
    small = F.broadcast if owners.count() <= FEW else (lambda df: df)
    out = edges
    for end in ends:
        scheme, owned = f"{end}_scheme", f"{end}_owned"
        of = small(owners.select(F.col("owned_scheme").alias(f"{end}_of"), F.col("owned_by").alias(owned)))
        out = out.withColumn(scheme, C.scheme(F.col(end))).join(of, F.col(scheme) == F.col(f"{end}_of"), "left").drop(f"{end}_of")
        own = (F.col(scheme) == F.col("lane")) | F.coalesce(F.array_contains(owned, F.col("lane")), F.lit(False))
        out = out.withColumn(f"{end}_plain", F.when(F.col(end).isNull(), "malformed").when(F.col(scheme).isNull() | F.col(scheme).isin(*RESERVED, *standard) | own, "ok"))
    return out


def _fits(lane: Column, end: str, literal: tuple[str, ...]) -> Column:
    """Whether a lane that holds an end may answer for it."""
    scheme = F.col(f"{end}_scheme")
    return (lane == scheme) | F.coalesce(F.array_contains(f"{end}_owned", lane), F.lit(False)) | (scheme.isin(*literal) & (lane == F.col("lane")))


def _resolves(rows: DataFrame, held: DataFrame, end: str, literal: tuple[str, ...], how: str) -> DataFrame:
    """``rows`` joined with the lanes that hold their end and may answer for it."""
    # the nodes are hashed, so that the edges, which are many more, aren't sorted
    of = held.select(F.col("id").alias("held_id"), F.col("lane").alias("held_lane")).hint("shuffle_hash")
    return rows.join(of, (F.col(end) == F.col("held_id")) & _fits(F.col("held_lane"), end, literal), how)


def verdicts(edges: DataFrame, held: DataFrame, schemes: DataFrame, end: str = "dst", standard: tuple[str, ...] = (), literal: tuple[str, ...] = ()) -> DataFrame:
    """``edges`` (with the ``lane`` that carries each) and ok, unresolved or malformed for one end.

    A null end is malformed. Ok is one without a scheme, of a reserved or standard scheme, or of a scheme that the
    carrying lane is or owns, held or not; one that the lane of its scheme, or a lane that owns the scheme, holds; and one
    of a ``literal`` scheme that the carrying lane holds. All else, so a scheme that nobody owns too, is unresolved.
    ``held(id, lane)`` has the nodes of every lane, ``schemes(scheme, lane)`` who owns what.
    """
    plain = f"{end}_plain"
    tagged = _tagged(edges, schemes, (end,), standard)
    kept = [*edges.columns, "verdict"]
    asked = tagged.filter(F.col(plain).isNull())
    out = tagged.filter(F.col(plain).isNotNull()).withColumn("verdict", F.col(plain)).select(*kept)
    # one join tells both verdicts, so that the edges asked are shuffled once
    of = held.groupBy(F.col("id").alias("held_id")).agg(F.collect_set("lane").alias("held_by"))
    ok = F.exists("held_by", lambda lane: _fits(lane, end, literal))
    met = asked.join(of, F.col(end) == F.col("held_id"), "left").withColumn("verdict", F.when(ok, "ok").otherwise("unresolved"))
    return out.unionByName(met.select(*kept))


def _passed(edges: DataFrame, held: DataFrame, schemes: DataFrame, standard: tuple[str, ...], literal: tuple[str, ...], like: DataFrame | None = None) -> DataFrame:
    """The rows of ``edges`` whose ends are both ok. Ends that their schemes settle are looked up nowhere, and where that holds
    for all of one end, as for the sources of edges that their own lanes carry, so is that end. Of the nodes, only those of schemes
    that are asked for are hashed, where these are few."""
    rows = _tagged(edges, schemes, ("src", "dst"), standard).filter("NOT (src_plain <=> 'malformed' OR dst_plain <=> 'malformed')")
    unsettled = [F.when(F.col(f"{end}_plain").isNull(), F.col(f"{end}_scheme")).alias(end) for end in ("src", "dst")]
    told = rows if like is None else _tagged(like, schemes, ("src", "dst"), standard)
    asked = told.select(*unsettled).distinct().limit(ASKED + 1).collect()  # a row per pair of schemes, so many at most
    for end in ("src", "dst"):
        found = sorted({r[end] for r in asked} - {None})
        if found or len(asked) > ASKED:
            plain, of = F.col(f"{end}_plain"), held if len(asked) > ASKED else held.filter(C.scheme(F.col("id")).isin(*found))
            rows = rows.filter(plain.isNotNull()).unionByName(_resolves(rows.filter(plain.isNull()), of, end, literal, "left_semi"))
    return rows.select(*edges.columns)


def admitted(edges: DataFrame, held: DataFrame, schemes: DataFrame, standard: tuple[str, ...] = (), literal: tuple[str, ...] = (), unique: bool = False) -> DataFrame:
    """Distinct triples whose ends are both ok; ``unique`` says that the edges are distinct already, as a store's are."""
    found = _passed(edges, held, schemes, standard, literal).select("src", "dst", "edge_type")
    return found if unique else found.distinct()


def admitted_by_lane(edges: DataFrame, held: DataFrame, schemes: DataFrame, standard: tuple[str, ...] = (), literal: tuple[str, ...] = (), repeated: bool = False, like: DataFrame | None = None) -> DataFrame:
    """Distinct lane, src, dst and edge_type of edges whose ends are both ok: what ``readmitted`` goes on from; ``repeated``
    leaves them as often as they stand, to a caller that makes them distinct. ``like(lane, src, dst)`` has ends of all the lanes and
    schemes that the edges have, where the caller has counted these."""
    found = _passed(edges.select("lane", "src", "dst", "edge_type"), held, schemes, standard, literal, like)
    return found if repeated else found.distinct()


def readmitted(before: DataFrame, edges: DataFrame, held: DataFrame, schemes: DataFrame, moved: tuple[str, ...], standard: tuple[str, ...] = (), literal: tuple[str, ...] = (), repeated: bool = False) -> DataFrame:
    """``admitted_by_lane`` after the lanes ``moved`` changed, equal to judging all edges again.

    ``before`` is what was admitted then; ``edges`` and ``held`` have all lanes as they are now, ``schemes`` hasn't changed
    (else all is judged again). Judged are the edges of a moved lane, and those of other lanes with an end whose scheme is a
    moved lane or is owned by one, whether they were admitted or not; no other verdict can turn. The schemes that moved
    lanes own reach the driver, a row each. ``repeated`` is that of ``admitted_by_lane``.
    """
    through = sorted({*moved, *(r[0] for r in schemes.filter(F.col("lane").isin(*moved)).select("scheme").distinct().collect())})
    ends = [F.coalesce(C.scheme(F.col(e)).isin(*through), F.lit(False)) for e in ("src", "dst")]
    turns = F.col("lane").isin(*moved) | ends[0] | ends[1]
    again = admitted_by_lane(edges.filter(turns), held, schemes, standard, literal, repeated)
    return before.filter(~turns).select(*again.columns).unionByName(again)


def dangling(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Ends that no owner holds, with how many edge instances point there."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return ends.join(owners.select("id"), "id", "left_anti")


def mesh_stats(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Edge instances inside and across corpora and with an end nobody owns, counted before distinct."""
    held = owners.select("id", "corpus")
    joined = edges.join(held.toDF("src", "src_corpus"), "src", "left").join(held.toDF("dst", "dst_corpus"), "dst", "left")
    same = F.col("src_corpus") == F.col("dst_corpus")
    return joined.agg(F.count("*").alias("instances"), F.count_if(same).alias("intra"), F.count_if(~same).alias("cross"), F.count_if(F.col("src_corpus").isNull() | F.col("dst_corpus").isNull()).alias("unresolved"))


def admission_stats(edges: DataFrame, held: DataFrame, schemes: DataFrame, owners: DataFrame, standard: tuple[str, ...] = (), literal: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """One row of edge instances by what the admission made of them, and the crossing ones by unordered pair of owners.

    Malformed is an edge with a malformed end, unresolved another with one that doesn't resolve; of the rest, cross is one
    whose ends have two owners in the roster of ``owners(id, owner)``, an end that nobody holds counting as the carrying
    lane's, and intra all else. Instances are counted before they are made distinct.
    """
    given = edges.select("lane", "src", "dst", "edge_type")
    both = verdicts(verdicts(given, held, schemes, "src", standard, literal).withColumnRenamed("verdict", "from_verdict"), held, schemes, "dst", standard, literal)
    counted = both.groupBy("lane", "src", "dst", F.when(F.col("from_verdict").eqNullSafe("malformed") | (F.col("verdict") == "malformed"), "malformed").when((F.col("from_verdict") == "unresolved") | (F.col("verdict") == "unresolved"), "unresolved").alias("out")).agg(F.count("*").alias("n"))
    of = owners.select("id", "owner")
    placed = counted.join(of.toDF("src", "src_owner"), "src", "left").join(of.toDF("dst", "dst_owner"), "dst", "left")
    a, b = F.coalesce("src_owner", "lane"), F.coalesce("dst_owner", "lane")
    judged = cut(placed.select("n", F.coalesce("out", F.when(a == b, "intra").otherwise("cross")).alias("out"), F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).groupBy("out", "low", "high").agg(F.sum("n").alias("n")))
    total = lambda name: F.coalesce(F.sum(F.when(F.col("out") == name, F.col("n"))), F.lit(0)).alias(name)
    whole = judged.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("instances"), *[total(n) for n in ("malformed", "unresolved", "intra", "cross")])
    return whole, judged.filter("out = 'cross'").select("low", "high", "n")


def seams_by_lane(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Per lane that carries edges, other owner and edge type: ends that land on the other's nodes, sources and targets both;
    and in ``targets`` how many distinct nodes of that owner the lane's edges of all types land on."""
    ends = edges.select("lane", "edge_type", F.explode(F.array("src", "dst")).alias("id")).filter("id IS NOT NULL")
    counted = ends.groupBy("lane", "edge_type", "id").agg(F.count("*").alias("n"))
    met = counted.join(owners.select("id", "owner"), "id").filter("owner <> lane")
    hits = met.groupBy("lane", "owner", "edge_type").agg(F.sum("n").alias("hits"))
    targets = met.groupBy("lane", "owner").agg(F.count_distinct("id").alias("targets"))
    return hits.join(targets, ["lane", "owner"])


def seam_matrix(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Per ordered pair of corpora and edge type: edges that cross, and distinct nodes they arrive at."""
    held = owners.select("id", "corpus")
    joined = edges.join(held.toDF("src", "from_corpus"), "src").join(held.toDF("dst", "to_corpus"), "dst")
    return joined.filter("from_corpus <> to_corpus").groupBy("from_corpus", "to_corpus", "edge_type").agg(F.count("*").alias("hits"), F.count_distinct("dst").alias("targets"))


def fold_vocabulary(declared: DataFrame) -> DataFrame:
    """edge_type and classes from ``declared(lane, edge_type, classes)``; refuses where two lanes disagree."""
    folded = declared.withColumn("classes", F.array_sort("classes")).groupBy("edge_type").agg(F.count_distinct("classes").alias("n"), F.first("classes").alias("classes"), F.array_sort(F.collect_set("lane")).alias("lanes"))
    wrong = folded.filter("n > 1").orderBy("edge_type").head(1)
    if wrong:
        raise Refused(f"lanes {', '.join(wrong[0]['lanes'])} declare {wrong[0]['edge_type']!r} differently")
    return folded.select("edge_type", "classes")


def relations_in(vocabulary: DataFrame | None, cls: str) -> tuple[str, ...]:
    """The edge types that ``vocabulary(edge_type, classes)`` puts in a class; the defaults where it puts none there.

    A row per declared type, so what reaches the driver is bounded by the vocabulary.
    """
    found = () if vocabulary is None else tuple(sorted({r[0] for r in vocabulary.filter(F.array_contains("classes", cls)).select("edge_type").collect()}))
    return found or C.DEFAULTS.get(cls, ())


def release_collisions(pins: DataFrame) -> DataFrame:
    """Schemes of ``pins(scheme, lane, version)`` owned under more than one version."""
    return pins.groupBy("scheme").agg(F.count_distinct("version").alias("n"), F.array_sort(F.collect_set("version")).alias("versions")).filter("n > 1")


def _summed(rows: DataFrame, key: Column) -> DataFrame:
    """Sums of the eight 32-bit limbs of each row's sha256 by a key, in halves; rows are hashed and taken apart a batch at a time."""
    halves = [f"{h}{i}" for i in range(8) for h in "hb"]

    def limbs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, list[int]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(1).cast(pa.large_binary())
            at, held = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist(), memoryview(texts.buffers()[2] or b"")
            hashes = b"".join([hashlib.sha256(held[a:b]).digest() for a, b in pairwise(at)])
            found = np.frombuffer(hashes, ">u4").reshape(-1, 8).astype(np.uint64)
            keys = batch.column(0).dictionary_encode(null_encoding="encode")
            of = keys.indices.to_numpy(zero_copy_only=False)
            for i, value in enumerate(keys.dictionary.to_pylist()):
                own = found if len(keys.dictionary) == 1 else found[of == i]
                sums[value] = [x + int(y) for x, y in zip(sums.get(value, [0] * 8), own.sum(axis=0), strict=True)]
        split = [[part for x in held for part in (x >> 32, x & 0xFFFFFFFF)] for held in sums.values()]
        columns = [pa.array([held[j] for held in split], pa.int64()) for j in range(16)]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *columns], names=["graphloom_key", *halves])

    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (F.col(n).cast("string") for n in sorted(rows.columns))]
    told = rows.select(key.alias("graphloom_key"), F.concat(*parts).alias("graphloom_row")).mapInArrow(limbs, "graphloom_key string, " + ", ".join(f"{h} long" for h in halves))
    return told.groupBy("graphloom_key").agg(*[F.sum(h).alias(h) for h in halves])


def _carried(found) -> int:
    return sum((found[f"h{i}"] * 2**32 + found[f"b{i}"]) << (32 * (7 - i)) for i in range(8)) % 2**256


def rows_digest(rows: DataFrame) -> str:
    """An order-free digest: the sum mod 2**256 of each row's sha256.

    Columns go by name, each with its length in front (or a minus for null), so that no two rows are written alike. The
    sum is taken by halves of the sums of 32-bit limbs, as longs, in one aggregation; only sixteen numbers reach the driver,
    where carries are made. It can be updated by adding and subtracting rows.
    """
    return f"{sum(map(_carried, _summed(rows, F.lit('')).collect())):064x}"  # a row, or none


def rows_digests(rows: DataFrame, by: str) -> dict[str, int]:
    """``rows_digest`` of the rows of each value of a column, as numbers; a row per value reaches the driver."""
    return {r["graphloom_key"]: _carried(r) for r in _summed(rows, F.col(by).cast("string")).collect()}


def generation(nodes: DataFrame, edges: DataFrame, roster: list[str]) -> str:
    return hashlib.sha256("\n".join([*roster, rows_digest(nodes), rows_digest(edges)]).encode()).hexdigest()


def snapshot_diff(before: DataFrame, after: DataFrame, key: tuple[str, ...] = ("id",)) -> DataFrame:
    """Keys born and died between two snapshots."""
    left, right = before.select(*key).distinct(), after.select(*key).distinct()
    return right.join(left, list(key), "left_anti").withColumn("change", F.lit("born")).unionByName(left.join(right, list(key), "left_anti").withColumn("change", F.lit("died")))


def changes(before: DataFrame, after: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """Births and deaths of ids between two node tables, and of the edges that went and came: kind, change, id, src, dst,
    edge_type."""
    none = F.lit(None).cast("string")
    ids = snapshot_diff(before, after).select(F.lit("node").alias("kind"), "change", "id", none.alias("src"), none.alias("dst"), none.alias("edge_type"))
    ends = [rows.select(F.lit("edge").alias("kind"), F.lit(change).alias("change"), none.alias("id"), "src", "dst", "edge_type") for rows, change in ((come, "born"), (gone, "died"))]
    return ids.unionByName(ends[0]).unionByName(ends[1])


def snapshot_counts(before: DataFrame, after: DataFrame, key: tuple[str, ...] = ("src", "edge_type", "dst"), by: str = "lane") -> DataFrame:
    """Per value of ``by``: keys born, died and kept between two snapshots, in one full outer pass over the keys.

    ``before`` and ``after`` have the keys (nulls are keys, too) and ``by``; keys that repeat count once.
    """
    left, right = (rows.select(by, *key).distinct().withColumn(side, F.lit(True)) for rows, side in ((before, "was"), (after, "is")))
    on = [by, *key]
    both = left.unionByName(right, allowMissingColumns=True).groupBy(*on).agg(F.max("was").alias("was"), F.max("is").alias("is"))
    return both.groupBy(by).agg(F.count_if(F.col("was").isNull()).alias("born"), F.count_if(F.col("is").isNull()).alias("died"), F.count_if(F.col("was").isNotNull() & F.col("is").isNotNull()).alias("kept"))


def update(owners: DataFrame, kept_lanes: DataFrame, new_lane: DataFrame, lane: str) -> DataFrame:
    """Ownership after one lane is replaced: only ids held there before or after are decided again.

    ``kept_lanes`` are the lane rows without that lane. The result equals ``ownership`` over all rows.
    """
    touched = owners.filter(F.col("lane") == lane).select("id").unionByName(new_lane.select("id")).distinct()
    again = ownership(kept_lanes.join(touched, "id", "left_semi").unionByName(new_lane))
    return owners.join(touched, "id", "left_anti").unionByName(again.select(*owners.columns))


def unit_graph(nodes: DataFrame, edges: DataFrame, depth: int, relations: tuple[str, ...]) -> DataFrame:
    """Weighted edges between units: dotted names cut at ``depth``, over the given relations, across units only. Edges with
    a column ``n`` stand for so many."""
    weight = F.sum("n") if "n" in edges.columns else F.count("*")
    unit = nodes.select("id", C.dotted_prefix(F.col("dotted"), depth).alias("unit"))
    joined = edges.filter(F.col("edge_type").isin(*relations)).join(unit.toDF("src", "from_unit"), "src").join(unit.toDF("dst", "to_unit"), "dst")
    return joined.filter("from_unit <> to_unit").groupBy("from_unit", "to_unit").agg(weight.alias("weight"))


def fans(units: DataFrame) -> DataFrame:
    """Fan-in, fan-out, consumers and suppliers of every unit."""
    ends = units.select(F.explode(F.array(F.struct(F.col("from_unit").alias("unit"), F.lit(0).cast("long").alias("i"), F.col("weight").alias("o")), F.struct(F.col("to_unit").alias("unit"), F.col("weight").alias("i"), F.lit(0).cast("long").alias("o")))).alias("e")).select("e.*")
    return ends.groupBy("unit").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"), F.count_if(F.col("i") > 0).alias("consumers"), F.count_if(F.col("o") > 0).alias("suppliers"))


def crowns(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The node of each corpus with most edge instances from other corpora; the smallest id of equal ones."""
    held = nodes.select("id", "corpus")
    joined = edges.join(held.toDF("src", "from_corpus"), "src").join(held.toDF("dst", "corpus"), "dst").filter("from_corpus <> corpus")
    per = joined.groupBy("corpus", F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    return per.groupBy("corpus").agg(F.min(F.struct((-F.col("fan_in")).alias("f"), "id")).alias("b")).select("corpus", "b.id", (-F.col("b.f")).alias("fan_in"))


def cut_members(nodes: DataFrame, cut: DataFrame, rest: str = "rest") -> DataFrame:
    """id and group: the longest of the cut's ``(group, prefix)`` that a dotted name starts with, at dot boundaries."""
    exploded = nodes.select("id", F.explode(C.prefixes(F.col("dotted"))).alias("prefix"))
    met = exploded.join(cut, "prefix").groupBy("id").agg(F.max_by("group", F.length("prefix")).alias("group"))
    return nodes.select("id").join(met, "id", "left").select("id", F.coalesce("group", F.lit(rest)).alias("group"))


def ranked(found: DataFrame, top: int, least: float = 0.0) -> tuple[DataFrame, int, bool]:
    """The seeds and the ``top`` of the other activated nodes whose salience is ``least`` or more, by energy, salience and
    id; how many qualify; and whether some were cut. Seeds are the rows without salience."""
    others = found.filter(F.col("salience") >= least)
    n = others.count()
    kept = others.orderBy(F.col("energy").desc(), F.col("salience").desc(), "node").limit(top)
    return found.filter("salience IS NULL").unionByName(kept), n, n > top
