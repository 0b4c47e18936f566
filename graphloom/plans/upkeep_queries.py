"""Registered queries over the store's upkeep: updates in place, facts behind doors, journals and their streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.operators import bridges, journal, mesh, overlap
from graphloom.plans import containers, doors, laned, refresh
from graphloom.plans.catalog import _CITED, _TERMS, BLAST, _free, _held, _index, _lined, _list, _same, query
from graphloom.session import cut, shared_folder
from graphloom.sources import freshness, shards
from graphloom.sources import projection as P
from graphloom.streaming import running

ROSTER = ("sales", "catalog", "party", "geo", "talk", "text", "web", "log")


def _home(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _lanes(spark, sf_dir, thinned):
    """Nodes and edges of the tables in a lane for each corpus; ``thinned``: the lane of parts has lost every seventh."""
    nodes = P.nodes(spark, sf_dir).select(F.col("corpus").alias("lane"), F.lit(0).alias("seq"), "id", F.lit(False).alias("stub"), "node_type", "dotted", "name")
    edges = P.edges(spark, sf_dir).withColumn("lane", C.scheme(F.col("src")))
    if thinned:
        gone = "lane = 'catalog' AND CAST(substring_index({}, '.', -1) AS BIGINT) % 7 = 0"
        nodes, edges = nodes.filter(f"NOT ({gone.format('id')})"), edges.filter(f"NOT ({gone.format('src')})")
    schemes = spark.createDataFrame([(lane, lane) for lane in ROSTER], "scheme string, lane string")
    return nodes, edges, schemes


_SEVENTH = "split_part({0}, '://', 1) = 'catalog' AND CAST(list_last(string_split({0}, '.')) AS BIGINT) % 7 = 0"
_THIN = f" , kept AS (SELECT * FROM nodes WHERE NOT ({_SEVENTH.format('id')})), left_ AS (SELECT * FROM triples WHERE NOT ({_SEVENTH.format('src')}) AND NOT ({_SEVENTH.format('dst')}))"


@query(_THIN + " SELECT 'node' AS kind, corpus AS name, count(*) AS n FROM kept GROUP BY ALL UNION ALL SELECT 'edge', edge_type, count(*) FROM left_ GROUP BY ALL UNION ALL SELECT 'edge by dst', edge_type, count(*) FROM left_ GROUP BY ALL UNION ALL SELECT 'died', 'node', count(*) FROM nodes WHERE id NOT IN (SELECT id FROM kept) UNION ALL SELECT 'died', 'edge', (SELECT count(*) FROM triples) - (SELECT count(*) FROM left_) UNION ALL VALUES ('same generation as a full compile', 'catalog', 1), ('slots kept', 'some', 1)")
def store_update(spark, sf_dir):
    """The lane of parts loses every seventh; the store is updated in place, and its generation held against a full compile."""
    home = _home(spark, "laned")
    laned.compile_lanes(spark, home, *_lanes(spark, sf_dir, False), ROSTER)
    thin = _lanes(spark, sf_dir, True)
    told = laned.compile_lanes(spark, home, *thin, ROSTER)
    held = laned.open_laned(spark, home, told["generation"])
    counts = held.nodes.groupBy(F.lit("node").alias("kind"), F.col("owner").alias("name")).agg(F.count("*").alias("n"))
    for name, kind in (("edges", "edge"), ("edges_in", "edge by dst")):
        counts = counts.unionByName(held.table(name).groupBy(F.lit(kind).alias("kind"), F.col("edge_type").alias("name")).agg(F.count("*").alias("n")))
    moved = held.changes().groupBy(F.col("change").alias("kind"), F.col("kind").alias("name")).agg(F.count("*").alias("n"))
    judged = [("same generation as a full compile", ",".join(told["recompiled"]), int(told["generation"] == laned.generation_of(*thin, ROSTER))), ("slots kept", "some", int(told["kept"] > 0))]
    return counts.unionByName(moved).unionByName(spark.createDataFrame(judged, "kind string, name string, n long"))


_DOORS = (
    _THIN
    + ", asked AS (SELECT id AS seed FROM nodes WHERE node_type = 'supplier'), back AS (SELECT seed, seed AS node, 0 AS hop FROM asked UNION SELECT b.seed, t.src, b.hop + 1 FROM back b JOIN {0} t ON t.dst = b.node WHERE b.hop < 2 AND t.edge_type IN "
    + _list(BLAST)
    + ")"
)


@query(_DOORS.format("triples") + " SELECT seed, node, min(hop) AS hop, 'facts' AS how FROM back GROUP BY seed, node")
def door_facts(spark, sf_dir):
    """What depends on each supplier, asked twice: the second answer is given from the facts that the first one left."""
    home = _home(spark, "laned")
    laned.compile_lanes(spark, home, *_lanes(spark, sf_dir, False), ROSTER)
    held, seeds = laned.open_laned(spark, home), P.nodes(spark, sf_dir).filter("node_type = 'supplier'").select(F.col("id").alias("seed"))
    words = P.vocabulary(spark)
    doors.ask(held, home, "blast", seeds, 2, words, trails=False)
    return doors.ask(held, home, "blast", seeds, 2, words, trails=False).select("seed", "node", "hop", "how")


@query(_DOORS.format("triples") + f", hit AS (SELECT seed, count(*) AS n FROM (SELECT DISTINCT b.seed, b.node, t.src, t.dst, t.edge_type FROM back b JOIN triples t ON b.node IN (t.src, t.dst) WHERE b.hop < 2 AND ({_SEVENTH.format('t.src')} OR {_SEVENTH.format('t.dst')})) GROUP BY seed) SELECT seed, coalesce(n, 0) AS n_edges, CASE WHEN n IS NULL THEN 'facts' ELSE 'replayed' END AS how FROM asked LEFT JOIN hit USING (seed)")
def door_replay(spark, sf_dir):
    """Of each supplier's facts: the edges at expanded nodes that an update took away, and whether the facts are still good."""
    home = _home(spark, "laned")
    laned.compile_lanes(spark, home, *_lanes(spark, sf_dir, False), ROSTER)
    held, seeds = laned.open_laned(spark, home), P.nodes(spark, sf_dir).filter("node_type = 'supplier'").select(F.col("id").alias("seed"))
    doors.ask(held, home, "blast", seeds, 2, P.vocabulary(spark), trails=False)
    laned.compile_lanes(spark, home, *_lanes(spark, sf_dir, True), ROSTER)
    after = laned.open_laned(spark, home)
    good = doors.carry(held.generation, after, home).select("seed").withColumn("how", F.lit("facts"))
    dead = doors.replayed(after, home).filter("why = 'edge died'").groupBy("seed").agg(F.sum("n").alias("n_edges"))
    told = seeds.join(dead, "seed", "left").join(good, "seed", "left")
    return told.select("seed", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("how", F.lit("replayed")).alias("how"))


#: Pages of a journal per nation's customers, numbered in order of their orders; some are bootstraps, some have lost touch.
_NUMBERED = "WITH o AS (SELECT 'j' || (o_custkey % 25) AS journal, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY o_orderkey) AS seq FROM orders), p AS (SELECT journal, seq, k, (k % 10)::VARCHAR AS cursor, (k % 2 = 0)::INT AS n_born, (k % 2 = 1)::INT AS n_died, seq = 1 OR k % 50 = 0 AS bootstrap FROM o), q AS (SELECT *, CASE WHEN k % 7 = 0 THEN '-1' ELSE lag(cursor) OVER (PARTITION BY journal ORDER BY seq) END AS prev_cursor FROM p)"


def _numbered(spark, sf_dir):
    order = Window.partitionBy("journal").orderBy("k")
    rows = P.read(spark, sf_dir, "orders").select(F.concat(F.lit("j"), F.col("o_custkey") % 25).alias("journal"), F.col("o_orderkey").alias("k"))
    rows = rows.withColumn("seq", F.row_number().over(order).cast("long")).withColumn("cursor", (F.col("k") % 10).cast("string"))
    born = (F.col("k") % 2 == 0).cast("long")
    rows = rows.select("*", born.alias("n_born"), (1 - born).alias("n_died"), ((F.col("seq") == 1) | (F.col("k") % 50 == 0)).alias("bootstrap"))
    return rows.withColumn("prev_cursor", F.when(F.col("k") % 7 == 0, "-1").otherwise(F.lag("cursor").over(order))).withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))


_MARKS = _NUMBERED + ", s AS (SELECT *, sum(bootstrap::INT) OVER (PARTITION BY journal ORDER BY seq) AS g, lag(cursor) OVER (PARTITION BY journal ORDER BY seq) AS expected FROM q), a AS (SELECT *, sum(n_born - n_died) OVER (PARTITION BY journal, g ORDER BY seq) AS alive FROM s), b AS (SELECT *, lag(alive) OVER w AS before, min(alive) OVER w AS least FROM a WINDOW w AS (PARTITION BY journal, g ORDER BY seq)) SELECT journal, seq, 'death' AS mark, before::BIGINT AS before FROM b WHERE alive = 0 AND before > 0 AND least >= 0 UNION ALL SELECT journal, seq, 'gap', NULL FROM b WHERE expected IS NOT NULL AND expected IS DISTINCT FROM prev_cursor"


@query(_MARKS, graph=False)
def journal_marks_streamed(spark, sf_dir):
    """Gaps and deaths by a stream over files of pages that are dealt out of order, and come twice in part."""
    work = _home(spark, "journal-stream")
    rows = _numbered(spark, sf_dir).select(*running.INPUT)
    pieces = 1 + P.read(spark, sf_dir, "orders").count() // 1_000_000  # a file has so many rows, however large the table is
    file, again = F.pmod(F.xxhash64("journal", "seq"), F.lit(4 * pieces)), F.lit(4 * pieces) + F.pmod(F.xxhash64("seq", "journal"), F.lit(pieces))
    dealt = rows.withColumn("file", F.explode(F.when(F.col("seq") % 5 == 0, F.array(file, again)).otherwise(F.array(file))))
    dealt.repartition(5 * pieces, "file").drop("file").write.json(f"{work}/pages")
    found = running.marks_of(spark, f"{work}/pages", work, ", ".join(f"{n} {t}" for n, t in rows.dtypes), files=3 * pieces, late="36500 days")
    return found.select("journal", "seq", "mark", "before")


@query(_MARKS, graph=False)
def journal_marks(spark, sf_dir):
    """The same from tables, by ``operators.journal``."""
    rows = _numbered(spark, sf_dir)
    dead = journal.deaths(rows).select("journal", "seq", F.lit("death").alias("mark"), "before")
    return dead.unionByName(journal.gaps(rows).select("journal", "seq", F.lit("gap").alias("mark"), F.lit(None).cast("long").alias("before")))


# ---- many terms --------------------------------------------------------------------------------------------------------

_TOP = _TERMS + ", top AS (SELECT term FROM postings GROUP BY term ORDER BY count(*) DESC, term LIMIT #), held AS (SELECT * FROM postings SEMI JOIN top USING (term)), boxes AS (SELECT conv_id, turn, count(*) AS k FROM held GROUP BY ALL), whole AS (SELECT * FROM boxes WHERE k = #)"


def _frequent(index, n):
    """The terms of most boxes, by number and then by term."""
    return [r["term"] for r in index.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "term").limit(n).collect()]


@query(_TOP.replace("#", "3") + " SELECT 'sets' AS how, (SELECT count(*) FROM whole) AS joint, (SELECT count(*) FROM boxes) AS any, (SELECT count(DISTINCT conv_id) FROM whole) AS joint_sessions, (SELECT count(DISTINCT conv_id) FROM boxes) AS any_sessions UNION ALL SELECT 'bitmaps', (SELECT count(*) FROM whole), (SELECT count(*) FROM boxes), NULL, NULL", graph=False)
def joint_search(spark, sf_dir):
    """Turns that hold all or any of the three most frequent terms, by sets and by bitmaps over numbered turns."""
    key, index = ["conv_id", "turn"], _index(spark, sf_dir)
    wanted = _frequent(index, 3)
    sets = overlap.joint(index, key, wanted, "conv_id").select(F.lit("sets").alias("how"), "*")
    lists = overlap.bitmaps(index, overlap.numbered(index, key), key, wanted)
    bits = overlap.joint_count(lists, wanted).select(F.lit("bitmaps").alias("how"), "joint", "any", *[F.lit(None).cast("long").alias(c) for c in ("joint_sessions", "any_sessions")])
    return sets.unionByName(bits)


@query(_TOP.replace("#", "100") + ", own AS (SELECT term, count(*) AS own FROM held GROUP BY term), pairs AS (SELECT a.term, b.term AS other, count(*) AS shared FROM held a JOIN held b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.term <> b.term GROUP BY ALL) SELECT p.term, other, shared, a.own, round(shared / a.own, 6) AS share, shared >= 0.999 * a.own AND shared < 0.999 * b.own AS contained FROM pairs p JOIN own a ON a.term = p.term JOIN own b ON b.term = p.other", graph=False)
def term_overlap(spark, sf_dir):
    """How far each of the hundred most frequent terms stands in the turns of each other one."""
    index = _index(spark, sf_dir)
    return overlap.overlap(index.drop("n"), ["conv_id", "turn"], _frequent(index, 100))


@query(_TOP.replace("#", "2") + ", one AS (SELECT min(term) AS a, max(term) AS b FROM top), met AS (SELECT p.term, conv_id, turn FROM postings p SEMI JOIN boxes USING (conv_id, turn) WHERE term NOT IN (SELECT term FROM top)), flagged AS (SELECT m.*, EXISTS (SELECT 1 FROM held h WHERE h.conv_id = m.conv_id AND h.turn = m.turn AND h.term = one.a) AS ha, EXISTS (SELECT 1 FROM held h WHERE h.conv_id = m.conv_id AND h.turn = m.turn AND h.term = one.b) AS hb FROM met m, one) SELECT term, count(*) AS overlap, round(100.0::DOUBLE * count(*) FILTER (WHERE ha) / (SELECT count(*) FROM held, one WHERE term = a), 6) AS first_percent, round(100.0::DOUBLE * count(*) FILTER (WHERE hb) / (SELECT count(*) FROM held, one WHERE term = b), 6) AS second_percent, round(100.0::DOUBLE * count(*) FILTER (WHERE ha AND hb) / greatest((SELECT count(*) FROM whole), 1), 6) AS joint_percent FROM flagged GROUP BY term", graph=False)
def fan_out(spark, sf_dir):
    """The terms that ride with the two most frequent ones, and how much of their turns each takes."""
    index = _index(spark, sf_dir)
    wanted = sorted(_frequent(index, 2))
    found = overlap.fan_out(index, ["conv_id", "turn"], wanted)
    return found.select("term", "overlap", F.col("percents")[wanted[0]].alias("first_percent"), F.col("percents")[wanted[1]].alias("second_percent"), "joint_percent")


# ---- snapshots, containers, rebuilds -------------------------------------------------------------------------------------

_SNAPSHOTS = "WITH lanes AS (SELECT 'orders' AS lane, o_custkey AS src, 'placed' AS edge_type, extract(month FROM o_orderdate) AS dst, o_orderdate AS day FROM orders UNION ALL SELECT 'lineitem', l_partkey, 'supplied', l_suppkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey), was AS (SELECT DISTINCT lane, src, edge_type, dst FROM lanes WHERE day < DATE '1996-01-01'), now AS (SELECT DISTINCT lane, src, edge_type, dst FROM lanes WHERE day >= DATE '1994-01-01')"


@query(_SNAPSHOTS + " SELECT lane, count(*) FILTER (WHERE s = 2) AS born, count(*) FILTER (WHERE s = 1) AS died, count(*) FILTER (WHERE s = 3) AS kept FROM (SELECT lane, src, edge_type, dst, sum(side) AS s FROM (SELECT *, 1 AS side FROM was UNION ALL SELECT *, 2 FROM now) GROUP BY ALL) GROUP BY lane", graph=False)
def snapshot_edges(spark, sf_dir):
    """Edges of orders and line items born, died and kept between two overlapping spans of years."""
    orders, items = P.read(spark, sf_dir, "orders"), P.read(spark, sf_dir, "lineitem")
    placed = orders.select(F.lit("orders").alias("lane"), F.col("o_custkey").alias("src"), F.lit("placed").alias("edge_type"), F.month("o_orderdate").cast("long").alias("dst"), F.col("o_orderdate").alias("at"))
    dated = items.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("at")), "l_orderkey")
    supplied = dated.select(F.lit("lineitem").alias("lane"), F.col("l_partkey").alias("src"), F.lit("supplied").alias("edge_type"), F.col("l_suppkey").cast("long").alias("dst"), "at")
    lines = placed.unionByName(supplied)
    return mesh.snapshot_counts(lines.filter("at < DATE '1996-01-01'"), lines.filter("at >= DATE '1994-01-01'"))


_OF_LANE = _THIN + ", lanes AS (SELECT corpus AS lane, count(*) AS nodes FROM nodes GROUP BY 1), lined AS (SELECT split_part(src, '://', 1) AS lane, count(*) AS edges FROM edges GROUP BY 1), thin_nodes AS (SELECT count(*) AS n FROM kept WHERE corpus = 'catalog'), thin_edges AS (SELECT count(*) AS n FROM edges WHERE split_part(src, '://', 1) = 'catalog' AND NOT (" + _SEVENTH.format("src") + "))"


@query(_OF_LANE + " SELECT lane, CASE lane WHEN 'talk' THEN 'pending' WHEN 'web' THEN 'absent' WHEN 'catalog' THEN 'stale' ELSE 'fresh' END AS before, 'fresh' AS after, CASE lane WHEN 'catalog' THEN (SELECT n FROM thin_nodes) ELSE nodes END AS nodes, CASE lane WHEN 'catalog' THEN (SELECT n FROM thin_edges) ELSE coalesce(edges, 0) END AS edges FROM lanes LEFT JOIN lined USING (lane)")
def container_states(spark, sf_dir):
    """Containers of all lanes: one left for later, one never written, one whose lane moved; then all that isn't fresh is written
    by one call, and the rows of every container are counted."""
    home = _home(spark, "containers")
    nodes, edges, _ = _lanes(spark, sf_dir, False)
    inputs = lambda n, e: spark.createDataFrame(list(laned.lane_digests(n, e, ROSTER).items()), "lane string, digest string")
    containers.emit(spark, home, inputs(nodes, edges), nodes, edges, [x for x in ROSTER if x not in ("web", "talk")])
    containers.defer(spark, home, ["talk"])
    nodes, edges, _ = _lanes(spark, sf_dir, True)
    live = inputs(nodes, edges)
    before = cut(containers.states(spark, home, live).select("lane", F.col("state").alias("before")))
    containers.emit_missing(spark, home, live, nodes, edges)
    after = containers.states(spark, home, live).select("lane", F.col("state").alias("after"))
    counted = None
    for lane in ROSTER:
        parts = [containers.rows(spark, home, lane, part).select(F.lit(lane).alias("lane"), F.lit(part).alias("part")) for part in ("nodes", "adjacency")]
        both = parts[0].unionByName(parts[1])
        counted = both if counted is None else counted.unionByName(both)
    sizes = counted.groupBy("lane").agg(F.count_if(F.col("part") == "nodes").alias("nodes"), F.count_if(F.col("part") == "adjacency").alias("edges"))
    return before.join(after, "lane").join(sizes, "lane")


def _loose(held):
    """Findings of a staged store: a RED row per lane with edges that were not admitted."""
    left = held.table("lane_edges").join(held.table("admitted"), ["lane", "src", "dst", "edge_type"], "left_anti")
    return left.groupBy("lane").agg(F.count("*").alias("n")).select(F.lit("endpoints").alias("check"), F.concat_ws(": ", "lane", F.col("n").cast("string")).alias("subject"), F.lit("RED").alias("level"))


@query(_OF_LANE + ", gone AS (SELECT split_part(src, '://', 1) AS lane, count(*) AS n FROM triples WHERE NOT (" + _SEVENTH.format("src") + ") AND " + _SEVENTH.format("dst") + " GROUP BY 1), all_ AS (SELECT CAST(sum(nodes) AS BIGINT) AS n FROM lanes) SELECT 'rebuild' AS step, 'landed' AS verdict, n FROM all_ UNION ALL SELECT 'rebuild with loose ends', 'CHECK FAILED', n FROM all_ UNION ALL SELECT 'refresh 1.0', 'CURRENT', 0 UNION ALL SELECT 'refresh 1.1, asked', 'NEWER', 0 UNION ALL SELECT 'refresh 1.1', 'OK', (SELECT count(*) FROM nodes) - (SELECT count(*) FROM kept) UNION ALL SELECT 'promoted', 'landed', count(*) FROM kept")
def rebuild_verdicts(spark, sf_dir):
    """A rebuild lands; one whose check is RED leaves what is served; a newer release is compared, built aside, and promoted."""
    base = _home(spark, "tenant")
    whole, thin = refresh.World(*_lanes(spark, sf_dir, False)), refresh.World(*_lanes(spark, sf_dir, True))
    declared = [refresh.Lane(x, placed=x == "web") for x in ROSTER]
    served = lambda: laned.open_laned(spark, refresh.serving(spark, base)).nodes.count()
    refresh.rebuild(spark, base, declared, whole, _loose)
    told = [("rebuild", "landed", served())]
    try:
        refresh.rebuild(spark, base, declared, thin, _loose)
    except refresh.CheckFailed:
        told.append(("rebuild with loose ends", "CHECK FAILED", served()))
    for release, only in (("1.0", False), ("1.1", True), ("1.1", False)):
        receipt = refresh.refresh(spark, base, "1.0", release, lambda: (thin, ROSTER), check_only=only)
        told.append((f"refresh {release}" + (", asked" if only else ""), receipt["verdict"], sum(r["died"] for r in receipt.get("diff", []))))
    refresh.promote(spark, base, "1.1")
    told.append(("promoted", "landed", served()))
    return spark.createDataFrame(told, "step string, verdict string, n long")


# ---- bridges and freshness -------------------------------------------------------------------------------------------------

#: Two tenants: who trades, and where they are. Each pins the scheme of places by the tables that it holds.
_PINS = "pins AS (SELECT 'trade' AS side, 'geo' AS scheme, '1.' || max(c_nationkey) AS version FROM customer UNION ALL SELECT 'places', 'geo', '1.' || count(*) FROM nation)"


def _sides(spark, sf_dir):
    nodes, edges = P.nodes(spark, sf_dir), P.edges(spark, sf_dir).distinct()
    trade = nodes.filter("corpus = 'party' OR node_type = 'nation'"), edges.filter("edge_type = 'in_nation'")
    places = nodes.filter("corpus = 'geo'"), edges.filter("edge_type = 'within'")
    pins = P.read(spark, sf_dir, "customer").agg(F.concat(F.lit("1."), F.max("c_nationkey")).alias("version")).select(F.lit("trade").alias("side"), F.lit("geo").alias("scheme"), "version")
    other = P.read(spark, sf_dir, "nation").agg(F.concat(F.lit("1."), F.count("*")).alias("version")).select(F.lit("places").alias("side"), F.lit("geo").alias("scheme"), "version")
    return {"trade": trade, "places": places}, pins.unionByName(other)


@query(f", {_PINS} SELECT scheme, side, (SELECT count(*) FROM nodes WHERE corpus = 'geo' AND (node_type = 'nation' OR side = 'places')) AS nodes, version AS release, (SELECT count(DISTINCT version) > 1 FROM pins) AS skew FROM pins")
def bridge_pins(spark, sf_dir):
    """What two tenants hold under a scheme that both declare, the releases they pin, and that these differ."""
    sides, pins = _sides(spark, sf_dir)
    return bridges.verified({s: nodes for s, (nodes, _) in sides.items()}, pins, ["geo"], allow_skew=True)


@query(f", {_PINS}, sides AS (SELECT DISTINCT 'trade|' || src AS a, 'trade|' || dst AS b FROM triples WHERE edge_type = 'in_nation' UNION SELECT 'places|' || src, 'places|' || dst FROM triples WHERE edge_type = 'within' UNION SELECT 'trade|' || id, 'places|' || id FROM (SELECT dst AS id FROM triples WHERE edge_type = 'in_nation' INTERSECT SELECT src FROM triples WHERE edge_type = 'within')), both_ways AS (SELECT a, b FROM sides UNION SELECT b, a FROM sides), walk(seed, node, hop) AS (SELECT 'trade|' || id, 'trade|' || id, 0 FROM nodes WHERE node_type = 'supplier' UNION SELECT w.seed, e.b, w.hop + 1 FROM walk w JOIN both_ways e ON e.a = w.node WHERE w.hop < 3 AND (w.hop > 0 OR e.a = w.seed)), first AS (SELECT seed, node, min(hop) AS hop FROM walk GROUP BY seed, node) SELECT seed, node, hop, node LIKE 'places|%' AND (SELECT count(DISTINCT version) > 1 FROM pins) AS skew FROM first WHERE node LIKE 'places|%'")
def bridge_crossings(spark, sf_dir):
    """Where suppliers get to on the other side in three hops, flagged since the crossing is under two releases."""
    sides, pins = _sides(spark, sf_dir)
    seeds = P.nodes(spark, sf_dir).filter("node_type = 'supplier'").select(F.concat(F.lit("trade|"), "id").alias("seed"))
    found = bridges.cross(sides, pins, ["geo"], seeds, 3, allow_skew=True, toward="places")
    return found.filter("node LIKE 'places|%'").select("seed", "node", "hop", "skew")


@query(_NUMBERED.replace("WITH o AS", ", o AS") + ", last AS (SELECT journal, arg_max(cursor, seq) AS stands FROM q GROUP BY journal), heads AS (SELECT journal, arg_max(cursor, seq) AS head FROM q WHERE k % 3 > 0 GROUP BY journal) SELECT 'store freshness' AS \"check\", 'catalog: its shard moved' AS subject, 'RED' AS level UNION ALL SELECT 'store freshness', 'log: no shard', 'COULD-NOT-TELL' UNION ALL SELECT 'cursor drift', coalesce(l.journal, h.journal) || ': ' || coalesce(stands, 'none') || ' is not ' || coalesce(head, 'none'), CASE WHEN stands IS NULL OR head IS NULL THEN 'COULD-NOT-TELL' ELSE 'RED' END FROM last l FULL JOIN heads h ON h.journal = l.journal WHERE stands IS DISTINCT FROM head")
def freshness_findings(spark, sf_dir):
    """Lanes that moved since the store was compiled, one whose shard is lost, and journals that aren't where their sources are."""
    home = _home(spark, "laned")
    laned.compile_lanes(spark, home, *_lanes(spark, sf_dir, False), ROSTER)
    nodes, edges, _ = _lanes(spark, sf_dir, True)
    live = spark.createDataFrame([(lane, d) for lane, d in laned.lane_digests(nodes, edges, ROSTER).items() if lane != "log"], "lane string, digest string")
    found = freshness.moved(containers.inputs_of(laned.open_laned(spark, home)), live)
    rows = _numbered(spark, sf_dir)
    heads = rows.filter("k % 3 > 0").groupBy("journal").agg(F.max_by("cursor", "seq").alias("cursor"))
    return found.unionByName(freshness.drifted(rows, heads))


# ---- more of free SQL --------------------------------------------------------------------------------------------------------

_free(
    "sql_recursive",
    f"WITH RECURSIVE up(node, hop) AS (SELECT 'party://supplier/party.supplier.7' AS node, 0 AS hop UNION ALL SELECT a.dst, u.hop + 1 FROM up u JOIN (SELECT DISTINCT src, dst FROM adj WHERE edge_type IN {_list(('in_nation', 'within'))}) a ON a.src = u.node WHERE u.hop < 4) SELECT node, min(hop) AS hop FROM up GROUP BY node",
    f" , up(node, hop) AS (SELECT 'party://supplier/party.supplier.7', 0 UNION ALL SELECT a.dst, u.hop + 1 FROM up u JOIN (SELECT DISTINCT src, dst FROM adj WHERE edge_type IN {_list(('in_nation', 'within'))}) a ON a.src = u.node WHERE u.hop < 4) SELECT node, min(hop) AS hop FROM up GROUP BY node",
)
_same("sql_offset", "SELECT dst, count(*) AS n FROM adj GROUP BY dst ORDER BY n DESC, dst LIMIT 10 OFFSET 5", by="dst")
_free(
    "sql_map_and_list",
    "SELECT node_type, map_from_entries(array_sort(collect_list(struct(k, n))))['geo'] AS geo, CAST(size(collect_list(k)) AS BIGINT) AS kinds, array_max(collect_list(n)) AS most FROM (SELECT n.node_type, a.dst_corpus AS k, count(*) AS n FROM nodes n JOIN adj a ON a.src = n.id GROUP BY n.node_type, a.dst_corpus) x GROUP BY node_type",
    "SELECT node_type, max(n) FILTER (WHERE k = 'geo') AS geo, count(*) AS kinds, max(n) AS most FROM (SELECT n.node_type, a.dst_corpus AS k, count(*) AS n FROM nodes n JOIN adj a ON a.src = n.id GROUP BY n.node_type, a.dst_corpus) x GROUP BY node_type",
)
_free(
    "sql_approximate",
    # the exact count stands apart: beside it, Spark would keep a sketch of each kind for every distinct dst
    "SELECT corpus, abs(near - n) <= 1 + 0.1 * n AS distinct_near, abs(near_median - median) <= 1 AS median_near FROM (SELECT corpus, approx_count_distinct(dst, 0.02) AS near, approx_percentile(length(dst), 0.5, 10000) AS near_median, percentile(length(dst), 0.5) AS median FROM adj GROUP BY corpus) a JOIN (SELECT corpus, count(DISTINCT dst) AS n FROM adj GROUP BY corpus) d USING (corpus)",
    "SELECT corpus, true AS distinct_near, true AS median_near FROM adj GROUP BY corpus",
)
_free(
    "sql_variant",
    "SELECT node_type, variant_get(attrs, '$.corpus', 'string') AS corpus, sum(variant_get(attrs, '$.length', 'int')) AS total, count(try_variant_get(attrs, '$.none', 'string')) AS nothing FROM (SELECT node_type, parse_json(to_json(named_struct('corpus', corpus, 'length', length(id), 'path', split(dotted, '[.]')))) AS attrs FROM nodes) x GROUP BY node_type, variant_get(attrs, '$.corpus', 'string')",
    "SELECT node_type, corpus, CAST(sum(length(id)) AS BIGINT) AS total, CAST(0 AS BIGINT) AS nothing FROM nodes GROUP BY node_type, corpus",
)


@query("SELECT e.event_id, o.ts AS since FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF JOIN (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'purchase') o ON e.user_id = o.user_id AND e.ts >= o.ts", graph=False)
def sql_as_of(spark, sf_dir):
    """Each event with its user's last purchase at or before it, by one sort instead of a range join."""
    events = P.read(spark, sf_dir, "events")
    points = events.filter("event_type <> 'purchase'").select("user_id", F.col("event_id").alias("row"), "ts")
    marks = events.filter("event_type = 'purchase'").select("user_id", "ts").distinct()
    return journal.as_of(points, marks, "user_id", "ts").filter("since IS NOT NULL").select(F.col("row").alias("event_id"), "since")


@query(r"SELECT conv_id::VARCHAR AS file, CASE WHEN role = 'user' AND turn % 4 = 0 THEN 2 * turn ELSE 2 * turn + 1 END AS line, role, text FROM (SELECT conv_id, turn, role, regexp_replace(text, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS text FROM conversations) WHERE role IN ('user', 'assistant') AND text <> ''", graph=False)
def transcript_turns(spark, sf_dir):
    """The turns of transcripts written from conversations in three shapes, in part queued before they are delivered."""
    rows = P.read(spark, sf_dir, "conversations")
    role, text, turn = F.col("role"), F.col("text"), F.col("turn")
    block = lambda kind: F.array(F.struct(F.lit(kind).alias("type"), text.alias("text")))
    message = F.struct(role.alias("type"), F.struct(text.alias("content")).alias("message"))
    payload = F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), role.alias("role"), block("input_text").alias("content")).alias("payload"))
    plain = F.struct(role.alias("role"), block("text").alias("content"))
    value = F.when(turn % 3 == 0, F.to_json(message)).when(turn % 3 == 1, F.to_json(payload)).otherwise(F.to_json(plain))
    file = F.col("conv_id").cast("string").alias("file")
    told = rows.select(file, (2 * turn + 1).alias("line"), value.alias("value"))
    queued = F.struct(F.lit("queue-operation").alias("type"), F.lit("enqueue").alias("operation"), text.alias("content"))
    asked = rows.filter("role = 'user' AND turn % 4 = 0").select(file, (2 * turn).alias("line"), F.to_json(queued).alias("value"))
    return shards.transcript_turns(told.unionByName(asked))


_LANED = _CITED + ", verdicts AS (SELECT *, src IS NULL AS bad FROM judged), ended AS (SELECT *, CASE WHEN bad OR verdict = 'malformed' THEN 'malformed' WHEN verdict = 'unresolved' THEN 'unresolved' END AS out, coalesce((SELECT corpus FROM held WHERE id = src), lane) AS a, coalesce((SELECT corpus FROM held WHERE id = dst), lane) AS b FROM verdicts)"


@query(_LANED + " SELECT coalesce(out, CASE WHEN a = b THEN 'intra' ELSE 'cross' END) AS what, '' AS pair, count(*) AS n FROM ended GROUP BY ALL UNION ALL SELECT 'pair', least(a, b) || ' ' || greatest(a, b), count(*) FROM ended WHERE out IS NULL AND a <> b GROUP BY ALL")
def admission_stats(spark, sf_dir):
    """Edge instances by what admission makes of them, and the crossing ones by pair of owners."""
    held, own = _held(spark, sf_dir)
    whole, pairs = mesh.admission_stats(_lined(spark, sf_dir, P.edges(spark, sf_dir)), held, own, held.withColumnRenamed("lane", "owner"), ("std",))
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("what"), F.col(n).alias("n")) for n in ("malformed", "unresolved", "intra", "cross")])).alias("k")
    told = whole.select(kinds).select("k.what", F.lit("").alias("pair"), "k.n").filter("n > 0")
    return told.unionByName(pairs.select(F.lit("pair").alias("what"), F.concat_ws(" ", "low", "high").alias("pair"), "n"))


@query(" , ends AS (SELECT split_part(src, '://', 1) AS lane, edge_type, unnest([src, dst]) AS id FROM edges), met AS (SELECT e.*, n.corpus AS owner FROM ends e JOIN nodes n USING (id) WHERE n.corpus <> e.lane) SELECT lane, owner, edge_type, count(*) AS hits, (SELECT count(DISTINCT id) FROM met x WHERE x.lane = m.lane AND x.owner = m.owner) AS targets FROM met m GROUP BY ALL")
def seams_by_lane(spark, sf_dir):
    """Where the edges of each lane land on nodes of others, both ends counted."""
    edges = P.edges(spark, sf_dir).withColumn("lane", C.scheme(F.col("src")))
    return mesh.seams_by_lane(edges, P.nodes(spark, sf_dir).select("id", F.col("corpus").alias("owner")))
