"""Registered graph queries over the projected tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.operators import code, federation, history, journal, lookup, mesh, records, resolve, shape, text, traverse
from graphloom.plans import estate, store
from graphloom.session import cut
from graphloom.sources import projection as P
from graphloom.sources import python_source

SUPPLIER, ORDER, PART = "party://supplier/party.supplier.7", "sales://order/sales.order.33", "catalog://part/catalog.part.11"
PREFIX = P.GRAPH_SQL
BLAST, REACH = C.relations("depends"), C.relations("reaches")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, graph: bool = True):
    """Register a query under its function's name, with its oracle; graph oracles get the projection in front."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = (PREFIX + oracle) if graph else oracle
        return f

    return add


def _seeds(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "seed string")


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# ---- estate and census -----------------------------------------------------------------------------------------------


@query(" SELECT split_part(src, '://', 1) AS corpus, split_part(dst, '://', 1) AS other, count(*) AS n FROM edges WHERE split_part(src, '://', 1) <> split_part(dst, '://', 1) GROUP BY ALL")
def estate_cross_corpus(spark, sf_dir):
    return estate.sql(spark, sf_dir, "SELECT a.corpus, a.dst_corpus AS other, count(*) AS n FROM adj a WHERE a.corpus <> a.dst_corpus GROUP BY a.corpus, a.dst_corpus")


@query(" SELECT split_part(src, '://', 1) AS corpus, count(*) AS n, count(DISTINCT dst) AS targets FROM triples GROUP BY 1")
def estate_edges_per_corpus(spark, sf_dir):
    return store.table_store(spark, sf_dir).edges.groupBy(C.scheme(F.col("src")).alias("corpus")).agg(F.count("*").alias("n"), F.count_distinct("dst").alias("targets"))


@query(" SELECT id, split_part(id, '://', 1) AS scheme, regexp_extract(id, '^[^:]+://([^/]*)/', 1) AS kind, regexp_replace(id, '^[^:]*://[^/]*/', '') AS body, list_last(string_split(id, '.')) AS last FROM nodes")
def node_forms(spark, sf_dir):
    c = F.col("id")
    return store.table_store(spark, sf_dir).nodes.select("id", C.scheme(c).alias("scheme"), C.kind(c).alias("kind"), C.body(c).alias("body"), C.last(c).alias("last"))


@query(" SELECT corpus, node_type, count(*) AS n FROM nodes GROUP BY ALL")
def census_nodes(spark, sf_dir):
    return store.table_store(spark, sf_dir).nodes.groupBy("corpus", "node_type").agg(F.count("*").alias("n"))


@query(" SELECT edge_type, count(*) AS instances, (SELECT count(*) FROM triples t WHERE t.edge_type = e.edge_type) AS n FROM edges e GROUP BY edge_type")
def census_edges(spark, sf_dir):
    return store.table_store(spark, sf_dir).edges.groupBy("edge_type").agg(F.sum("n").alias("instances"), F.count("*").alias("n"))


@query(" SELECT count(*) AS instances, CAST(count_if(a.corpus = b.corpus) AS BIGINT) AS intra, CAST(count_if(a.corpus <> b.corpus) AS BIGINT) AS cross, CAST(count_if(a.corpus IS NULL OR b.corpus IS NULL) AS BIGINT) AS unresolved FROM edges e LEFT JOIN nodes a ON e.src = a.id LEFT JOIN nodes b ON e.dst = b.id")
def mesh_stats(spark, sf_dir):
    return store.table_store(spark, sf_dir).stats()


@query(" SELECT a.corpus AS from_corpus, b.corpus AS to_corpus, edge_type, count(*) AS hits, count(DISTINCT dst) AS targets FROM edges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id WHERE a.corpus <> b.corpus GROUP BY ALL")
def seam_matrix(spark, sf_dir):
    return store.table_store(spark, sf_dir).seams()


@query(", n AS (SELECT corpus, count(*) AS nodes, count(DISTINCT node_type) AS node_types FROM nodes GROUP BY 1), e AS (SELECT split_part(src, '://', 1) AS corpus, count(*) AS edges, count(DISTINCT edge_type) AS relations FROM triples GROUP BY 1) SELECT n.*, coalesce(edges, 0) AS edges, coalesce(relations, 0) AS relations FROM n LEFT JOIN e USING (corpus)")
def corpus_inventory(spark, sf_dir):
    held = store.table_store(spark, sf_dir)
    return store.inventory(held.nodes, held.edges)


# ---- federation ------------------------------------------------------------------------------------------------------


def _lanes(spark, sf_dir):
    """Nodes in two lanes: all, with stubs for customers, and customers of even key again."""
    found = P.nodes(spark, sf_dir)
    first = found.select("id", F.lit("a").alias("lane"), F.lit(1).alias("lane_rank"), F.lit(0).alias("seq"), (F.col("node_type") == "customer").alias("stub"))
    return first.unionByName(found.filter("node_type = 'customer' AND CAST(name AS INT) % 2 = 0").select("id", F.lit("b").alias("lane"), F.lit(2).alias("lane_rank"), F.lit(0).alias("seq"), F.lit(False).alias("stub")))


@query(" SELECT id, CASE WHEN node_type = 'customer' AND TRY_CAST(list_last(string_split(id, '.')) AS INT) % 2 = 0 THEN 'b' ELSE 'a' END AS lane FROM nodes")
def ownership_dedup(spark, sf_dir):
    return mesh.ownership(_lanes(spark, sf_dir)).select("id", "lane")


@query(" SELECT id, CASE WHEN node_type = 'customer' AND TRY_CAST(list_last(string_split(id, '.')) AS INT) % 2 = 0 THEN 'b' ELSE 'a' END AS lane FROM nodes")
def ownership_update(spark, sf_dir):
    rows = _lanes(spark, sf_dir)
    kept, new = rows.filter("lane = 'a'"), rows.filter("lane = 'b'")
    return mesh.update(mesh.ownership(kept), kept, new, "b").select("id", "lane")


def _broken(spark, sf_dir):
    """The nodes without nations of odd key, so that some ends dangle."""
    return P.nodes(spark, sf_dir).filter("NOT (node_type = 'nation' AND CAST(name AS INT) % 2 = 1)")


_HELD = " , held AS (SELECT * FROM nodes WHERE NOT (node_type = 'nation' AND CAST(list_last(string_split(id, '.')) AS INT) % 2 = 1))"


#: What the reference's rule settles without a look: reserved schemes, and one that the query names as standard.
_SETTLED = "('fetch', 'artifact', 'impl', 'doctrine', 'scrape', 'std')"
_CITED = _HELD + " , lined AS (SELECT src, dst, edge_type, split_part(src, '://', 1) AS lane FROM edges UNION ALL SELECT 'text://benchmark/text.benchmark.' || item_id, CASE item_id % 4 WHEN 0 THEN 'scrape://page/' || item_id WHEN 1 THEN 'nobody://thing/' || item_id WHEN 3 THEN 'std://lib/' || item_id END, 'cites', 'text' FROM benchmark), judged AS (SELECT *, CASE WHEN dst IS NULL THEN 'malformed' WHEN split_part(dst, '://', 1) IN " + _SETTLED + " OR split_part(dst, '://', 1) = lane OR dst IN (SELECT id FROM held) THEN 'ok' ELSE 'unresolved' END AS verdict FROM lined)"


def _lined(spark, sf_dir, edges, cited_once=False):
    """Edges with the lane that carries them, and citations whose ends are reserved, owned by nobody, standard or missing."""
    item = F.col("item_id")
    cited = F.when(item % 4 == 0, F.concat(F.lit("scrape://page/"), item)).when(item % 4 == 1, F.concat(F.lit("nobody://thing/"), item)).when(item % 4 == 3, F.concat(F.lit("std://lib/"), item))
    extra = P.read(spark, sf_dir, "benchmark").select(P.node_id("text", "benchmark", "item_id").alias("src"), cited.alias("dst"), F.lit("cites").alias("edge_type"))
    return edges.select("src", "dst", "edge_type").unionByName(extra.distinct() if cited_once else extra).withColumn("lane", C.scheme(F.col("src")))


def _held(spark, sf_dir):
    """Nodes by lane without nations of odd key, and the scheme that each lane owns."""
    held = store.table_store(spark, sf_dir).nodes.filter("NOT (node_type = 'nation' AND CAST(name AS INT) % 2 = 1)")
    own = spark.createDataFrame([(c, c) for c in sorted({n[0] for n in P.NODES})], "scheme string, lane string")
    return held.select("id", F.col("corpus").alias("lane")), own


@query(_CITED + " SELECT edge_type, verdict, count(*) AS n FROM judged GROUP BY ALL")
def endpoint_verdicts(spark, sf_dir):
    held, own = _held(spark, sf_dir)
    return mesh.verdicts(_lined(spark, sf_dir, P.edges(spark, sf_dir)), held, own, standard=("std",)).groupBy("edge_type", "verdict").agg(F.count("*").alias("n"))


@query(_CITED + " SELECT edge_type, count(*) AS n FROM (SELECT DISTINCT src, dst, edge_type FROM judged WHERE verdict = 'ok') GROUP BY edge_type")
def edge_admission(spark, sf_dir):
    held, own = _held(spark, sf_dir)
    return mesh.admitted(_lined(spark, sf_dir, store.table_store(spark, sf_dir).edges), held, own, ("std",), unique=True).groupBy("edge_type").agg(F.count("*").alias("n"))


@query(_CITED.replace(_HELD, " , held AS (SELECT * FROM nodes)") + " SELECT lane, edge_type, count(*) AS n FROM (SELECT DISTINCT lane, src, dst, edge_type FROM judged WHERE verdict = 'ok') GROUP BY ALL")
def lane_readmission(spark, sf_dir):
    """The nations of odd key come back: of what was admitted without them, only edges that reach their lane are judged again."""
    every = store.table_store(spark, sf_dir)
    (held, own), edges = _held(spark, sf_dir), _lined(spark, sf_dir, every.edges, cited_once=True)
    # the store's edges are distinct, and a triple's lane is that of its source
    before = mesh.admitted_by_lane(edges, held, own, ("std",), repeated=True)
    after = mesh.readmitted(before, edges, every.nodes.select("id", F.col("corpus").alias("lane")), own, ("geo",), ("std",), repeated=True)
    return after.groupBy("lane", "edge_type").agg(F.count("*").alias("n"))


@query(_HELD + " SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) WHERE id NOT IN (SELECT id FROM held) GROUP BY id")
def dangling_endpoints(spark, sf_dir):
    return mesh.dangling(P.edges(spark, sf_dir), _broken(spark, sf_dir))


@query("SELECT p_brand AS scheme, count(DISTINCT p_size) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_size) > 1", graph=False)
def release_collision(spark, sf_dir):
    pins = P.read(spark, sf_dir, "part").select(F.col("p_brand").alias("scheme"), F.col("p_type").alias("lane"), F.col("p_size").cast("string").alias("version"))
    return mesh.release_collisions(pins).select("scheme", F.col("n").cast("long").alias("n"))


@query("SELECT DISTINCT o_orderpriority AS edge_type, CASE WHEN o_orderpriority LIKE '1%' THEN 'depends,reaches' WHEN o_orderpriority LIKE '2%' THEN 'depends' ELSE 'lexical' END AS classes FROM orders", graph=False)
def vocabulary_fold(spark, sf_dir):
    """Every status is a lane that declares all priorities alike, in another order of classes."""
    word = F.col("o_orderpriority")
    classes = F.when(word.startswith("1"), F.when(F.col("o_orderstatus") == "O", F.array(F.lit("reaches"), F.lit("depends"))).otherwise(F.array(F.lit("depends"), F.lit("reaches")))).when(word.startswith("2"), F.array(F.lit("depends"))).otherwise(F.array(F.lit("lexical")))
    declared = P.read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("lane"), word.alias("edge_type"), classes.alias("classes")).distinct()
    return mesh.fold_vocabulary(declared).select("edge_type", F.array_join("classes", ",").alias("classes"))


def _digest_sql(name: str, columns: tuple[str, ...], source: str) -> str:
    """The order-free digest in SQL: sums of 32-bit limbs of each row's sha256, carried from the lowest up."""
    row = " || ".join(f"length({c}) || ':' || {c}" for c in columns)
    limbs = ", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT) AS l{i}" for i in range(8))
    steps = "".join(f", {name}_{i} AS (SELECT *, l{i} + c{i + 1} // 4294967296 AS c{i} FROM {name}_{i + 1})" for i in range(6, -1, -1))
    word = " || ".join(f"format('{{:08x}}', (c{i} % 4294967296)::BIGINT)" for i in range(8))
    return f"{name}_7 AS (SELECT *, l7 AS c7 FROM (SELECT {limbs} FROM (SELECT sha256({row}) AS h FROM {source}))){steps}, {name} AS (SELECT {word} AS d FROM {name}_0)"


_FULL = "(SELECT *, regexp_replace(id, '^[^:]*://[^/]*/', '') AS dotted, list_last(string_split(id, '.')) AS name FROM nodes)"


@query(" , " + _digest_sql("nd", ("corpus", "dotted", "id", "name", "node_type"), _FULL) + ", " + _digest_sql("ed", ("dst", "edge_type", "src"), "triples") + " SELECT sha256('all' || chr(10) || nd.d || chr(10) || ed.d) AS generation FROM nd, ed")
def generation_digest(spark, sf_dir):
    held = store.table_store(spark, sf_dir)
    found = mesh.generation(held.nodes.drop("scheme"), held.edges.select("src", "dst", "edge_type"), ["all"])
    return spark.createDataFrame([(found,)], "generation string")


# ---- lookups ---------------------------------------------------------------------------------------------------------


@query(f" SELECT id, corpus FROM nodes WHERE id = '{SUPPLIER}'")
def membership(spark, sf_dir):
    return lookup.membership(store.table_store(spark, sf_dir).nodes, SUPPLIER)


@query(" SELECT id FROM nodes WHERE id = 'SUPPLIER.7' OR lower(id) LIKE '%.supplier.7' OR lower(id) LIKE '%/supplier.7'")
def find_tail(spark, sf_dir):
    return store.table_store(spark, sf_dir).find("SUPPLIER.7").select("id")


@query(" SELECT id FROM nodes WHERE contains(lower(id), 'supplier.1')")
def grep_substring(spark, sf_dir):
    return lookup.grep(store.table_store(spark, sf_dir).nodes, "Supplier.1").select("id")


@query(f" SELECT other, edge_type AS relation, CASE WHEN count(DISTINCT d) > 1 THEN 'both' ELSE min(d) END AS direction FROM (SELECT dst AS other, edge_type, 'with' AS d FROM triples WHERE src = '{PART}' UNION ALL SELECT src, edge_type, 'against' FROM triples WHERE dst = '{PART}') GROUP BY ALL")
def neighbours(spark, sf_dir):
    return store.table_store(spark, sf_dir).neighbours(PART)


@query(" SELECT id, corpus FROM nodes WHERE corpus = 'party'")
def owned(spark, sf_dir):
    return lookup.owned(store.table_store(spark, sf_dir).nodes, "party").select("id", "corpus")


# ---- traversal -------------------------------------------------------------------------------------------------------

_BACK = f", walk(node, hop) AS (SELECT '{SUPPLIER}', 0 UNION SELECT t.src, w.hop + 1 FROM walk w JOIN triples t ON t.dst = w.node WHERE w.hop < 4 AND t.edge_type IN {_list(BLAST)}), reached AS (SELECT node, min(hop) AS hop FROM walk GROUP BY node)"
_FORE = f", walk(node, hop) AS (SELECT '{ORDER}', 0 UNION SELECT t.dst, w.hop + 1 FROM walk w JOIN triples t ON t.src = w.node WHERE w.hop < 4 AND t.edge_type IN {_list(REACH)}), reached AS (SELECT node, min(hop) AS hop FROM walk GROUP BY node)"
_ANY = f", both_ways AS (SELECT src AS a, dst AS b FROM triples WHERE edge_type IN ('in_nation', 'within') UNION SELECT dst, src FROM triples WHERE edge_type IN ('in_nation', 'within')), walk(node, hop) AS (SELECT '{SUPPLIER}', 0 UNION SELECT e.b, w.hop + 1 FROM walk w JOIN both_ways e ON e.a = w.node WHERE w.hop < 3), reached AS (SELECT node, min(hop) AS hop FROM walk GROUP BY node)"


def _blast(spark, sf_dir, seed):
    held = store.table_store(spark, sf_dir)
    return traverse.blast(_seeds(spark, seed), held.walk, vocabulary=held.vocabulary)


def _descend(spark, sf_dir, seed):
    held = store.table_store(spark, sf_dir)
    return traverse.descend(_seeds(spark, seed), held.walk, vocabulary=held.vocabulary)


@query(_BACK + f" SELECT '{SUPPLIER}' AS seed, node, hop FROM reached")
def blast_radius(spark, sf_dir):
    return _blast(spark, sf_dir, SUPPLIER).select("seed", "node", "hop")


@query(_BACK + " SELECT hop, split_part(node, '://', 1) AS corpus, count(*) AS n FROM reached GROUP BY ALL")
def blast_by_hop(spark, sf_dir):
    return _blast(spark, sf_dir, SUPPLIER).groupBy("hop", C.scheme(F.col("node")).alias("corpus")).agg(F.count("*").alias("n"))


@query(_FORE + f" SELECT '{ORDER}' AS seed, node, hop FROM reached")
def descend_reach(spark, sf_dir):
    return _descend(spark, sf_dir, ORDER).select("seed", "node", "hop")


@query(_FORE + f" SELECT node FROM reached WHERE node NOT IN (SELECT src FROM triples WHERE edge_type IN {_list(REACH)})")
def primitives(spark, sf_dir):
    held = store.table_store(spark, sf_dir)
    return traverse.primitives(_descend(spark, sf_dir, ORDER), held.edges, vocabulary=held.vocabulary).select("node")


@query(_FORE + " SELECT split_part(p, '://', 1) AS from_corpus, split_part(node, '://', 1) AS to_corpus, min(hop) AS first_hop FROM (SELECT r.node, r.hop, t.src AS p FROM reached r JOIN triples t ON t.dst = r.node JOIN reached q ON q.node = t.src AND q.hop = r.hop - 1 WHERE t.edge_type IN " + _list(REACH) + ") WHERE split_part(p, '://', 1) <> split_part(node, '://', 1) GROUP BY ALL")
def crossings(spark, sf_dir):
    return traverse.crossings(_descend(spark, sf_dir, ORDER)).select("from_corpus", "to_corpus", "first_hop")


@query(f" SELECT edge_type AS relation, count(*) AS n FROM triples WHERE dst = 'geo://nation/geo.nation.3' AND edge_type NOT IN {_list(REACH)} GROUP BY 1")
def declined(spark, sf_dir):
    held = store.table_store(spark, sf_dir)
    return traverse.declined(_seeds(spark, "geo://nation/geo.nation.3"), held.walk.by_dst, mesh.relations_in(held.vocabulary, "reaches"), "against")


@query(_ANY + " SELECT node, hop FROM reached")
def path_hops(spark, sf_dir):
    return traverse.reach(_seeds(spark, SUPPLIER), traverse.steps(store.table_store(spark, sf_dir).walk, ["in_nation", "within"]), 3).select("node", "hop")


_WALK = f", both_ways AS (SELECT src AS a, dst AS b FROM triples UNION SELECT dst, src FROM triples), walk(node, hop) AS (SELECT '{SUPPLIER}', 0 UNION SELECT e.b, w.hop + 1 FROM walk w JOIN both_ways e ON e.a = w.node WHERE w.hop < 3)"


@query(_WALK + " SELECT CAST(coalesce(min(hop), -1) AS INTEGER) AS hops FROM walk WHERE node = 'geo://nation/geo.nation.0'")
def path_exists(spark, sf_dir):
    """The hops of a shortest path of three at most; -1 says that all within three was searched and there is none."""
    found, _ = traverse.path_to(store.table_store(spark, sf_dir).walk, SUPPLIER, "geo://nation/geo.nation.0", max_depth=3)
    return spark.createDataFrame([(len(found) - 1,)], "hops int")


@query(f", sides AS (SELECT DISTINCT 'l|' || src AS a, 'l|' || dst AS b FROM triples WHERE edge_type = 'in_nation' UNION SELECT 'r|' || src, 'r|' || dst FROM triples WHERE edge_type = 'within' UNION SELECT 'l|' || id, 'r|' || id FROM (SELECT dst AS id FROM triples WHERE edge_type = 'in_nation' INTERSECT SELECT src FROM triples WHERE edge_type = 'within')), both_ways AS (SELECT a, b FROM sides UNION SELECT b, a FROM sides), walk(node, hop) AS (SELECT 'l|{SUPPLIER}', 0 UNION SELECT e.b, w.hop + 1 FROM walk w JOIN both_ways e ON e.a = w.node WHERE w.hop < 4) SELECT node, min(hop) AS hop FROM walk GROUP BY node")
def bridge_hops(spark, sf_dir):
    found = store.table_store(spark, sf_dir).edges
    sides = {"l": found.filter("edge_type = 'in_nation'"), "r": found.filter("edge_type = 'within'")}
    return traverse.bridge(sides, _seeds(spark, f"l|{SUPPLIER}"), ["geo"], 4).select("node", "hop")


@query(", docs AS (SELECT src AS a, dst AS b, edge_type FROM triples UNION SELECT dst, src, edge_type FROM triples), walk(node, hop) AS (SELECT 'talk://session/talk.session.3', 0 UNION SELECT d.b, w.hop + 1 FROM walk w JOIN docs d ON d.a = w.node WHERE w.hop < 1), reached AS (SELECT node, min(hop) AS hop FROM walk GROUP BY node) SELECT d.b AS node, d.edge_type AS relation, min(r.hop + 1) AS hop FROM reached r JOIN docs d ON d.a = r.node WHERE d.edge_type = 'follows' AND d.b <> 'talk://session/talk.session.3' GROUP BY ALL")
def doc_explanations(spark, sf_dir):
    return traverse.doc_endpoints(_seeds(spark, "talk://session/talk.session.3"), store.table_store(spark, sf_dir).walk, ["follows"], 2).select("node", "relation", "hop")


def _weighted(spark, sf_dir):
    """Parts and suppliers, joined both ways, with the number of line items as salience."""
    pairs = store.table_store(spark, sf_dir).edges.filter("edge_type = 'supplied_by'").select("src", "dst", F.col("n").cast("double").alias("salience"))
    return pairs.select(F.col("src").alias("node"), F.col("dst").alias("other"), "salience").unionByName(pairs.select(F.col("dst").alias("node"), F.col("src").alias("other"), "salience"))


_SPREAD = f""", pairs AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS s FROM edges WHERE edge_type = 'supplied_by' GROUP BY ALL), w AS (SELECT src AS n, dst AS o, s FROM pairs UNION ALL SELECT dst, src, s FROM pairs),
 shares AS (SELECT n, o, s, s / sum(s) OVER (PARTITION BY n) AS share FROM w),
 l1 AS (SELECT o AS node, 1 AS hop, 0.5 * share AS energy FROM shares WHERE n = '{PART}'),
 l2 AS (SELECT o AS node, 2 AS hop, arg_min(e, (-g, n, -s)) AS energy FROM (SELECT x.o, x.n, x.s, l1.energy AS g, l1.energy * 0.5 * x.share AS e FROM shares x JOIN l1 ON x.n = l1.node) WHERE o <> '{PART}' AND o NOT IN (SELECT node FROM l1) GROUP BY o),
 spread AS (SELECT '{PART}' AS node, 0 AS hop, 1.0::DOUBLE AS energy UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)"""


@query(_SPREAD + " SELECT node, hop, round(energy, 9) AS energy FROM spread")
def activation(spark, sf_dir):
    return traverse.activate(_seeds(spark, PART), _weighted(spark, sf_dir), 2).select("node", "hop", F.round("energy", 9).alias("energy"))


@query(_SPREAD + " SELECT src, dst, edge_type FROM triples WHERE src IN (SELECT node FROM spread WHERE hop < 2) AND dst IN (SELECT node FROM spread WHERE hop < 2)")
def induced_subgraph(spark, sf_dir):
    return traverse.induced(store.table_store(spark, sf_dir).edges, traverse.activate(_seeds(spark, PART), _weighted(spark, sf_dir), 1))


# ---- aggregation -----------------------------------------------------------------------------------------------------


@query("WITH p AS (SELECT DISTINCT l_orderkey AS o, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT b, count(*) AS n FROM p GROUP BY b), s AS (SELECT x.b AS a, y.b AS b, count(*) AS support FROM p x JOIN p y ON x.o = y.o AND x.b < y.b GROUP BY ALL) SELECT s.a, s.b, s.support, round(s.support * (SELECT count(DISTINCT o) FROM p) / (na.n * nb.n), 9) AS lift, round(s.support / (s.support + 5), 9) AS credibility FROM s JOIN n na ON na.b = s.a JOIN n nb ON nb.b = s.b", graph=False)
def lift_salience(spark, sf_dir):
    held = P.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).join(P.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), F.col("p_brand").alias("b")), "p").select("o", "b").distinct()
    n, total = held.groupBy("b").agg(F.count("*").alias("n")), held.select("o").distinct().count()
    pairs = held.withColumnRenamed("b", "a").join(held, "o").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("support"))
    joined = pairs.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")
    return joined.select("a", "b", "support", F.round(C.lift(F.col("support"), F.col("na"), F.col("nb"), F.lit(total)), 9).alias("lift"), F.round(C.credibility(F.col("support")), 9).alias("credibility"))


_UNITS = ", units AS (SELECT split_part(regexp_replace(src, '^.*/', ''), '.', 1) || '.' || split_part(regexp_replace(src, '^.*/', ''), '.', 2) AS from_unit, split_part(regexp_replace(dst, '^.*/', ''), '.', 1) || '.' || split_part(regexp_replace(dst, '^.*/', ''), '.', 2) AS to_unit, count(*) AS weight FROM edges WHERE edge_type IN " + _list(BLAST) + " GROUP BY ALL)"


@query(_UNITS + " SELECT * FROM units WHERE from_unit <> to_unit")
def unit_graph(spark, sf_dir):
    held = store.table_store(spark, sf_dir)
    return mesh.unit_graph(held.nodes, held.edges, 2, BLAST)


@query(_UNITS + " SELECT unit, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out, CAST(count_if(i > 0) AS BIGINT) AS consumers, CAST(count_if(o > 0) AS BIGINT) AS suppliers FROM (SELECT from_unit AS unit, 0 AS i, weight AS o FROM units WHERE from_unit <> to_unit UNION ALL SELECT to_unit, weight, 0 FROM units WHERE from_unit <> to_unit) GROUP BY unit")
def fan_in_out(spark, sf_dir):
    held = store.table_store(spark, sf_dir)
    return mesh.fans(mesh.unit_graph(held.nodes, held.edges, 2, BLAST))


@query(" , per AS (SELECT b.corpus, e.dst AS id, count(*) AS fan_in FROM edges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id WHERE a.corpus <> b.corpus GROUP BY ALL) SELECT corpus, id, fan_in FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY fan_in DESC, id) AS r FROM per) WHERE r = 1")
def crown(spark, sf_dir):
    return store.table_store(spark, sf_dir).crowns()


@query(" SELECT CASE WHEN regexp_matches(id, 'party\\.customer\\.1(\\..*)?$') THEN 'one' WHEN contains(id, '/party.customer.') THEN 'customers' WHEN corpus = 'party' THEN 'party' WHEN corpus = 'geo' THEN 'geo' ELSE 'rest' END AS \"group\", count(*) AS n FROM nodes GROUP BY 1")
def cut_longest_prefix(spark, sf_dir):
    cut = spark.createDataFrame([("party", "party"), ("customers", "party.customer"), ("one", "party.customer.1"), ("geo", "geo")], "group string, prefix string")
    return mesh.cut_members(store.table_store(spark, sf_dir).nodes, cut).groupBy("group").agg(F.count("*").alias("n"))


# ---- text ------------------------------------------------------------------------------------------------------------

_TERMS = "WITH t AS (SELECT conv_id, turn, unnest(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_.-]{2,}'), lambda x: regexp_replace(lower(x), '[.-]+$', ''))) AS term FROM conversations), postings AS (SELECT term, conv_id, turn, count(*) AS n FROM t WHERE length(term) >= 3 AND term NOT IN " + _list(t.replace("'", "''") for t in text.STOP) + " GROUP BY ALL)"


def _index(spark, sf_dir):
    return text.postings(P.read(spark, sf_dir, "conversations"), ["conv_id", "turn"])


@query(_TERMS + " SELECT * FROM postings", graph=False)
def postings(spark, sf_dir):
    return _index(spark, sf_dir)


@query(_TERMS + " SELECT conv_id, turn, CAST(sum(n) AS BIGINT) AS hits FROM postings WHERE term IN ('der', 'die') GROUP BY ALL HAVING count(*) = 2", graph=False)
def search_all(spark, sf_dir):
    return text.search(_index(spark, sf_dir), ["conv_id", "turn"], ["der", "die"], "all")


@query(_TERMS + " SELECT conv_id, turn, CAST(sum(n) AS BIGINT) AS hits FROM postings WHERE term IN ('que', 'der') GROUP BY ALL", graph=False)
def search_any(spark, sf_dir):
    return text.search(_index(spark, sf_dir), ["conv_id", "turn"], ["que", "der"], "any")


@query(_TERMS + " SELECT conv_id, CAST(sum(n) AS BIGINT) AS hits, min(turn) AS first, max(turn) AS last, arg_min(turn, (-n, turn)) AS hottest FROM postings WHERE term = 'der' GROUP BY conv_id", graph=False)
def term_chain(spark, sf_dir):
    return text.chain(_index(spark, sf_dir), "conv_id", "turn", "der")


@query(_TERMS + ", own AS (SELECT conv_id, turn FROM postings WHERE term = 'der') SELECT term, count(*) AS shared, round(100.0::DOUBLE * count(*) / greatest((SELECT count(*) FROM own), 1), 6) AS percent FROM postings SEMI JOIN own USING (conv_id, turn) WHERE term <> 'der' GROUP BY term", graph=False)
def topic_heat(spark, sf_dir):
    return text.heat(_index(spark, sf_dir), ["conv_id", "turn"], "der")


_WORDS = "WITH words AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)))"


def _words(spark, sf_dir):
    return text.positions(P.read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query(_WORDS + ", hits AS (SELECT *, coalesce(CAST(pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) > 10 AS INT), 1) AS new FROM words WHERE word IN ('the', 'with')), c AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM hits) SELECT doc_id, min(pos) AS start, max(pos) AS \"end\", CAST(count_if(word = 'the') AS BIGINT) AS hits, CAST(count_if(word = 'with') AS BIGINT) AS partners, round(100.0::DOUBLE * count(*) / greatest(1, max(pos) - min(pos) + 21), 6) AS density FROM c GROUP BY doc_id, k HAVING CAST(count_if(word = 'the') AS BIGINT) > 0", graph=False)
def token_clusters(spark, sf_dir):
    return text.clusters(_words(spark, sf_dir), "doc_id", "the", "with", 10)


@query(_WORDS + " SELECT doc_id, CAST(count_if(word = 'the') AS BIGINT) AS hits, CAST(count_if(word = 'with') AS BIGINT) AS partners, count(*) AS tokens, round(1000.0::DOUBLE * (CAST(count_if(word = 'the') AS BIGINT) + CAST(count_if(word = 'with') AS BIGINT)) / count(*), 6) AS heat FROM words GROUP BY doc_id HAVING CAST(count_if(word = 'the') AS BIGINT) > 0", graph=False)
def file_heat(spark, sf_dir):
    return text.file_heat(_words(spark, sf_dir), "doc_id", "the", "with")


@query(_WORDS + ", f AS (SELECT DISTINCT word AS term, doc_id FROM words WHERE word IN ('the', 'with', 'die', 'from')), n AS (SELECT term, count(*) AS n FROM f GROUP BY term) SELECT a.term, b.term AS other, count(*) AS shared, round(count(*) / any_value(n.n), 6) AS share FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.term <> b.term JOIN n ON n.term = a.term GROUP BY ALL", graph=False)
def cooccur_directed(spark, sf_dir):
    found = _words(spark, sf_dir).filter("word IN ('the', 'with', 'die', 'from')").select(F.col("word").alias("term"), "doc_id")
    return text.cooccurrence(found, "doc_id")


@query(_WORDS + " SELECT doc_id, min(gap) AS gap FROM (SELECT doc_id, CASE WHEN lag(word) OVER o <> word THEN pos - lag(pos) OVER o END AS gap FROM words WHERE word IN ('die', 'from') WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) GROUP BY doc_id HAVING min(gap) IS NOT NULL", graph=False)
def nearest_gap(spark, sf_dir):
    return text.nearest_gap(_words(spark, sf_dir), "doc_id", "die", "from")


@query(_WORDS + ", s AS (SELECT doc_id, pos AS a, pos + 20 AS b FROM words WHERE word = 'from'), f AS (SELECT *, coalesce(CAST(a - max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 50 AS INT), 1) AS new FROM s), c AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY a, b) AS k FROM f) SELECT doc_id, min(a) AS start, max(b) AS \"end\", count(*) AS spans FROM c GROUP BY doc_id, k", graph=False)
def span_merge(spark, sf_dir):
    spans = _words(spark, sf_dir).filter("word = 'from'").select("doc_id", F.col("pos").alias("start"), (F.col("pos") + 20).alias("end"))
    return text.merge_spans(spans, "doc_id")


@query("WITH t AS (SELECT * FROM conversations WHERE role IN ('user', 'assistant')), f AS (SELECT *, coalesce(CAST(lag(role) OVER (PARTITION BY conv_id ORDER BY turn) <> role AS INT), 1) AS new FROM t), r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM f), m AS (SELECT conv_id, run, role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM r GROUP BY ALL), a AS (SELECT a.conv_id, a.run, u.text AS asked, a.text AS answer FROM m a LEFT JOIN m u ON u.conv_id = a.conv_id AND u.run = a.run - 1 WHERE a.role = 'assistant'), e AS (SELECT conv_id, run, coalesce(asked, '') AS asked, answer FROM a UNION ALL SELECT conv_id, run, text, '' FROM m WHERE role = 'user' AND (conv_id, run + 1) NOT IN (SELECT (conv_id, run) FROM m)) SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY run) AS INTEGER) AS n, asked AS \"user\", answer AS assistant FROM e", graph=False)
def exchange_pairs(spark, sf_dir):
    return text.exchanges(P.read(spark, sf_dir, "conversations"))


@query("WITH c AS (SELECT conv_id, turn, sum(length(text) + 80) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations) SELECT conv_id, turn AS n, CAST(cost AS BIGINT) AS cost FROM c WHERE cost <= 1500 OR age = 1", graph=False)
def tail_budget(spark, sf_dir):
    turns = P.read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("n"), F.col("text").alias("user"), F.lit("").alias("assistant"))
    return text.tail(turns, "conv_id", 1500)


@query("SELECT conv_id, turn, before FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NOT NULL", graph=False)
def follows_chain(spark, sf_dir):
    return journal.follows(P.read(spark, sf_dir, "conversations"), "conv_id", "turn", "turn")


@query("WITH h AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS p FROM pages) SELECT page_id, array_to_string(list_transform(string_split(p, '/'), lambda s: CASE WHEN regexp_matches(s, '^[0-9]+$|@|%40') THEN '{}' ELSE s END), '/') AS route FROM (SELECT page_id, CASE p WHEN '' THEN '/' ELSE p END AS p FROM h)", graph=False)
def route_normalise(spark, sf_dir):
    return P.read(spark, sf_dir, "pages").select("page_id", C.route(F.col("url")).alias("route"))


@query("SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_name, '[A-Z]+[a-z]*|[a-z]+|[0-9]+'), lambda x: lower(x)), '_') AS snake FROM part", graph=False)
def identifier_variants(spark, sf_dir):
    return P.read(spark, sf_dir, "part").select("p_partkey", F.get(C.spellings(F.col("p_name")), F.lit(0)).alias("snake"))


# ---- journals --------------------------------------------------------------------------------------------------------


@query("WITH m AS (SELECT DISTINCT o_custkey AS k, date_trunc('month', o_orderdate) AS m FROM orders), x AS (SELECT k FROM m WHERE m = (SELECT min(m) FROM m)), y AS (SELECT k FROM m WHERE m = (SELECT max(m) FROM m)) SELECT k, 'born' AS change FROM y WHERE k NOT IN (SELECT k FROM x) UNION ALL SELECT k, 'died' FROM x WHERE k NOT IN (SELECT k FROM y)", graph=False)
def snapshot_diff(spark, sf_dir):
    months = P.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.date_trunc("month", "o_orderdate").alias("m"))
    low, high = months.agg(F.min("m"), F.max("m")).first()
    return mesh.snapshot_diff(months.filter(F.col("m") == F.lit(low)), months.filter(F.col("m") == F.lit(high)), ("k",))


def _pages(spark, sf_dir):
    """A journal per customer nation from its orders: a page per order, born or died by status."""
    born = F.col("o_orderkey") % 2 == 0
    rows = P.read(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("journal"), F.col("o_orderkey").alias("seq"), born.cast("int").alias("n_born"), (~born).cast("int").alias("n_died"), (F.col("o_orderkey") % 50 == 0).alias("bootstrap"), (F.col("o_orderkey") % 10).alias("cursor"))
    return rows.withColumn("prev_cursor", F.when(F.col("seq") % 7 == 0, -1).otherwise(F.lag("cursor").over(Window.partitionBy("journal").orderBy("seq"))))


_PAGES = "WITH pages_ AS (SELECT o_custkey % 25 AS journal, o_orderkey AS seq, CAST(o_orderkey % 2 = 0 AS INT) AS n_born, CAST(o_orderkey % 2 <> 0 AS INT) AS n_died, o_orderkey % 50 = 0 AS bootstrap, o_orderkey % 10 AS cursor FROM orders)"


@query(_PAGES + " SELECT journal, seq FROM (SELECT *, lag(cursor) OVER (PARTITION BY journal ORDER BY seq) AS e FROM pages_) WHERE e IS NOT NULL AND seq % 7 = 0", graph=False)
def journal_gaps(spark, sf_dir):
    return journal.gaps(_pages(spark, sf_dir)).select("journal", "seq")


@query(_PAGES + ", s AS (SELECT *, sum(bootstrap::INT) OVER (PARTITION BY journal ORDER BY seq) AS g FROM pages_), a AS (SELECT *, sum(n_born - n_died) OVER (PARTITION BY journal, g ORDER BY seq) AS alive FROM s), b AS (SELECT *, lag(alive) OVER w AS before, min(alive) OVER w AS least FROM a WINDOW w AS (PARTITION BY journal, g ORDER BY seq)) SELECT journal, seq, CAST(before AS BIGINT) AS before FROM b WHERE alive = 0 AND before > 0 AND least >= 0", graph=False)
def graph_deaths(spark, sf_dir):
    return journal.deaths(_pages(spark, sf_dir))


@query("WITH c AS (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'purchase'), w AS (SELECT user_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS lo, ts AS hi FROM c) SELECT e.event_id, w.hi AS high FROM events e JOIN w ON e.user_id = w.user_id AND e.ts > w.lo AND e.ts <= w.hi WHERE e.event_type <> 'purchase'", graph=False)
def session_window_join(spark, sf_dir):
    events = P.read(spark, sf_dir, "events")
    points = events.filter("event_type <> 'purchase'").select("user_id", F.col("event_id").alias("point_id"), "ts")
    captures = events.filter("event_type = 'purchase'").select("user_id", "ts").distinct()
    return journal.in_window(points, captures, "user_id", "ts").select(F.col("point_id").alias("event_id"), "high")


@query("WITH d AS (SELECT event_type AS metric, CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY ALL), m AS (SELECT *, lag(v) OVER (PARTITION BY metric ORDER BY day) AS before FROM d), x AS (SELECT day, metric, round(abs((v - before) / before), 9) AS move FROM m WHERE before IS NOT NULL AND before <> v) SELECT CAST(day AS VARCHAR) AS day, metric, move FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY move DESC, metric) AS r FROM x) WHERE r <= 4", graph=False)
def receipt_moves(spark, sf_dir):
    daily = P.read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric"), F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("value"))
    return journal.moves(daily.withColumn("series", F.lit("events")), "series", "day").select(F.col("day").cast("string").alias("day"), "metric", "move")


# ---- shape, federation, history and code -----------------------------------------------------------------------------

_SCENE = " , w AS (SELECT t.*, CASE WHEN edge_type = 'contains' THEN 'contains' WHEN a.corpus <> b.corpus THEN 'cross' ELSE 'depends' END AS kind, a.node_type AS a_type, b.node_type AS b_type FROM triples t JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE src <> dst AND edge_type IN " + _list((*BLAST, "contains")) + "), k AS (SELECT id, corpus AS arm, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM nodes LEFT JOIN (SELECT dst AS id, count(*) AS n FROM w WHERE kind <> 'contains' GROUP BY 1) i USING (id) LEFT JOIN (SELECT src AS id, count(*) AS n FROM w WHERE kind <> 'contains' GROUP BY 1) o USING (id) ORDER BY fan_in DESC, id LIMIT 3000)"


def _scene(spark, sf_dir):
    return shape.scene(P.nodes(spark, sf_dir).withColumnRenamed("corpus", "arm"), P.edges(spark, sf_dir), BLAST)


@query(_SCENE + " SELECT id, arm, fan_in, fan_out, row_number() OVER (PARTITION BY arm ORDER BY fan_in * fan_out DESC, fan_in DESC, id) = 1 AS crown FROM k")
def scene_nodes(spark, sf_dir):
    return _scene(spark, sf_dir)[0]


@query(_SCENE + " SELECT src, dst, kind, count(*) AS weight FROM w WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k) GROUP BY ALL")
def scene_links(spark, sf_dir):
    return _scene(spark, sf_dir)[1]


@query(_SCENE + ", d AS (SELECT * FROM w WHERE kind <> 'contains') SELECT node_type AS module, count(*) AS size, (SELECT count(*) FROM d WHERE a_type = node_type AND b_type = node_type) AS internal, (SELECT count(*) FROM d WHERE b_type = node_type AND a_type <> node_type) AS fan_in, (SELECT count(*) FROM d WHERE a_type = node_type AND b_type <> node_type) AS fan_out FROM nodes GROUP BY node_type")
def module_overview(spark, sf_dir):
    return shape.overview(P.nodes(spark, sf_dir).withColumnRenamed("node_type", "module"), P.edges(spark, sf_dir), BLAST)


@query(_SCENE + ", f AS (SELECT dst AS id, count(*) AS fan_in FROM w WHERE kind <> 'contains' AND a_type <> b_type GROUP BY 1) SELECT arm, id, fan_in FROM (SELECT corpus AS arm, id, fan_in, row_number() OVER (PARTITION BY corpus ORDER BY fan_in DESC, id) AS r FROM f JOIN nodes USING (id)) WHERE r = 1")
def arm_crowns(spark, sf_dir):
    found = P.nodes(spark, sf_dir).withColumnRenamed("corpus", "arm").withColumn("module", F.col("node_type"))
    return shape.arm_crowns(found, P.edges(spark, sf_dir), BLAST)


@query(" SELECT corpus || '.' || node_type AS cluster, count(*) AS size, node_type AS types FROM nodes GROUP BY corpus, node_type")
def clusters(spark, sf_dir):
    return shape.clusters(P.nodes(spark, sf_dir)).withColumn("types", F.array_join("types", ","))


@query(" , s AS (SELECT id, CASE WHEN corpus IN ('party', 'geo') THEN corpus ELSE 'rest' END AS section FROM nodes), e AS (SELECT section, count(*) AS edges FROM triples JOIN s ON src = id WHERE dst IN (SELECT id FROM nodes) GROUP BY 1) SELECT section, count(*) AS nodes, coalesce(any_value(edges), 0) AS edges FROM s LEFT JOIN e USING (section) GROUP BY section")
def section_contents(spark, sf_dir):
    cut = spark.createDataFrame([("party", "party"), ("geo", "geo")], "group string, prefix string")
    return shape.sections(P.nodes(spark, sf_dir), P.edges(spark, sf_dir), cut)[2].drop("digest")


@query()
def partition_proposal(spark, sf_dir):
    plan = shape.propose(shape.units(P.nodes(spark, sf_dir), P.edges(spark, sf_dir), 2, BLAST))
    arms = plan.arm_of()
    return spark.createDataFrame([(u, arms[u], r) for u, r in sorted(plan.roles.items())], "unit string, arm string, role string")


_SCHEMES = " , schemes AS (SELECT DISTINCT corpus AS slug, corpus AS scheme, 'own' AS role FROM nodes WHERE corpus <> 'geo' UNION SELECT DISTINCT split_part(src, '://', 1), split_part(dst, '://', 1), 'out' FROM edges WHERE split_part(src, '://', 1) <> split_part(dst, '://', 1)), pairs AS (SELECT o.slug, w.slug AS other FROM schemes o JOIN schemes w ON o.role = 'out' AND w.role = 'own' AND o.scheme = w.scheme AND o.slug <> w.slug), partners AS (SELECT * FROM pairs UNION SELECT other, slug FROM pairs)"


def _schemes(spark, sf_dir):
    """What corpora own and refer to; geo is taken out, so that a scheme has no owner."""
    crossing = P.edges(spark, sf_dir).select(C.scheme(F.col("src")).alias("slug"), C.scheme(F.col("dst")).alias("scheme"), F.lit("out").alias("role")).filter("slug <> scheme")
    own = P.nodes(spark, sf_dir).filter("corpus <> 'geo'").select(F.col("corpus").alias("slug"), F.col("corpus").alias("scheme"), F.lit("own").alias("role"))
    return own.unionByName(crossing).distinct()


@query(_SCHEMES + " SELECT slug, CASE WHEN slug = 'catalog' THEN 'core' WHEN slug = 'web' THEN 'parked' WHEN bool_or(p.other = 'catalog') THEN 'joined-to-core' WHEN bool_or(p.other IS NOT NULL) THEN 'joined-within-axis' WHEN bool_or(s.role = 'out' AND s.scheme NOT IN (SELECT scheme FROM schemes WHERE role = 'own')) THEN 'cross-axis-gap' ELSE 'solo' END AS state FROM schemes s LEFT JOIN partners p USING (slug) GROUP BY slug")
def federation_gate(spark, sf_dir):
    return federation.gate(_schemes(spark, sf_dir), ("catalog",), ("web",))


@query(_SCHEMES + " SELECT 'catalog' AS slug UNION SELECT other FROM partners WHERE slug = 'catalog'")
def roster(spark, sf_dir):
    return federation.roster(_schemes(spark, sf_dir), PART, 1).select("slug")


@query("WITH v AS (SELECT p_brand AS name, p_size AS a, p_partkey % 12 AS b FROM part WHERE p_partkey % 5 <> 0) SELECT name, arg_max(a || '.' || b, a * 100 + b) AS version FROM v GROUP BY name", graph=False)
def newest_release(spark, sf_dir):
    """Releases of each brand by size and key; every fifth is a candidate of a far later release, which doesn't count."""
    number = F.concat(F.col("p_size"), F.lit("."), F.col("p_partkey") % 12)
    version = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("9"), number, F.lit("rc1"))).otherwise(number)
    return federation.newest(P.read(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), version.alias("version")))


@query("SELECT CAST(item_id % 4 AS VARCHAR) AS shard, count(*) AS files, sha256(string_agg(item_id::VARCHAR || chr(0) || sha256(text) || chr(10), '' ORDER BY item_id::VARCHAR)) AS address FROM benchmark GROUP BY 1", graph=False)
def content_addresses(spark, sf_dir):
    found = P.read(spark, sf_dir, "benchmark")
    return federation.addresses(found.select((F.col("item_id") % 4).cast("string").alias("shard"), F.col("item_id").cast("string").alias("file"), F.col("text").cast("binary").alias("content")))


@query(_HELD + " SELECT 'endpoints' AS \"check\", split_part(src, '://', 1) || ': ' || count(DISTINCT id) AS subject, CASE WHEN split_part(src, '://', 1) = 'party' THEN 'RED' ELSE 'NOTE' END AS level FROM (SELECT src, unnest([src, dst]) AS id FROM triples) WHERE id NOT IN (SELECT id FROM held) GROUP BY split_part(src, '://', 1) UNION ALL VALUES ('release', 'core', 'RED')")
def audit_findings(spark, sf_dir):
    pins = spark.createDataFrame([("core", "a", "1.0"), ("core", "b", "1.1")], "scheme string, lane string, version string")
    pages = spark.createDataFrame([("j", 1, "c1", None, 5, 0, True), ("j", 2, "c2", "c1", 1, 2, False)], "journal string, seq long, cursor string, prev_cursor string, n_born long, n_died long, bootstrap boolean")
    return federation.audit(_broken(spark, sf_dir), P.edges(spark, sf_dir), pins, pages, ("party",))


@query(" , t AS (SELECT id, unnest([array_to_string(list_slice(p, i, len(p)), '.') for i in range(1, len(p))]) AS literal FROM (SELECT id, string_split(regexp_replace(id, '^[^:]*://[^/]*/', ''), '.') AS p FROM nodes)) SELECT literal, min(id) AS node, count(DISTINCT id) AS n FROM t GROUP BY literal")
def symbol_literals(spark, sf_dir):
    return history.symbol_index(P.nodes(spark, sf_dir).withColumn("file", F.lit(None).cast("string")))


@query("WITH c AS (SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS session, min(o_orderdate) AS opened FROM orders GROUP BY 1), w AS (SELECT session, opened AS high, lag(opened) OVER (ORDER BY opened, session) AS low FROM c) SELECT CAST(o_orderkey AS VARCHAR) AS \"commit\", session FROM orders JOIN w ON o_orderdate > low AND o_orderdate <= high", graph=False)
def commit_windows(spark, sf_dir):
    found = P.read(spark, sf_dir, "orders")
    captures = found.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("session")).agg(F.min("o_orderdate").alias("at"))
    return history.authored(found.select(F.col("o_orderkey").cast("string").alias("commit"), F.col("o_orderdate").alias("at")), captures)


@query("SELECT CAST(conv_id AS VARCHAR) AS file, count(DISTINCT turn // 2) AS boxes, count(*) AS marks FROM conversations GROUP BY 1", graph=False)
def archive_boxes(spark, sf_dir):
    turns = P.read(spark, sf_dir, "conversations")
    mark = F.concat(F.lit("--- ["), F.floor(F.col("turn") / 2).cast("string"), F.lit("] "), F.when(F.col("role") == "assistant", "ASSISTANT").otherwise("USER"), F.lit("\n"), F.coalesce("text", F.lit("")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", mark.alias("x")))), lambda s: s["x"]), "\n")
    files = turns.groupBy(F.col("conv_id").cast("string").alias("file")).agg(joined.alias("text"))
    per_box = history.boxes(files).groupBy("file").agg(F.count("*").alias("boxes"))
    return per_box.join(history.exchanges(files).groupBy("file").agg(F.count("*").alias("marks")), "file")


_STOPS = _list(t.replace("'", "''") for t in text.STOP)


@query("WITH t AS (SELECT source, doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_.-]{2,}'), lambda x: regexp_replace(lower(x), '[.-]+$', ''))) AS term FROM documents), p AS (SELECT DISTINCT term, source, doc_id FROM t WHERE length(term) >= 3 AND term NOT IN " + _STOPS + "), live AS (SELECT term, count(DISTINCT doc_id) AS boxes FROM p GROUP BY term HAVING count(DISTINCT doc_id) >= 3), sym AS (SELECT * FROM (SELECT term, boxes, list_filter(regexp_split_to_array(term, '[._-]'), lambda s: length(s) >= 3 AND NOT regexp_matches(s, '^[0-9]+$') AND s NOT IN " + _STOPS + ") AS seg FROM live WHERE regexp_matches(term, '[._-]')) WHERE len(seg) > 0), family AS (SELECT s, count(*) AS n FROM (SELECT unnest(list_distinct(seg)) AS s FROM sym) GROUP BY s), anchors AS (SELECT term, boxes FROM live WHERE term NOT IN (SELECT term FROM sym) AND term IN (SELECT s FROM family WHERE n >= 2)), under AS (SELECT a.term, arg_min(b.term, (-len(b.seg), b.term)) AS parent FROM sym a JOIN sym b ON len(b.seg) < len(a.seg) AND contains('.' || array_to_string(a.seg, '.') || '.', '.' || array_to_string(b.seg, '.') || '.') GROUP BY a.term), near AS (SELECT sym.term, arg_min(a.term, (-a.boxes, a.term)) AS anchor FROM sym JOIN anchors a ON list_contains(sym.seg, a.term) GROUP BY sym.term) SELECT term, boxes, 'symbol' AS kind, coalesce(parent, anchor) AS parent FROM sym LEFT JOIN under USING (term) LEFT JOIN near USING (term) UNION ALL SELECT term, boxes, 'anchor', NULL FROM anchors", graph=False)
def topic_forest(spark, sf_dir):
    counted = text.counted_terms(P.read(spark, sf_dir, "documents"), "source", ["doc_id"])
    return history.forest(history.live_terms(counted, "source", 3, 1.0), 2)


@query(_TERMS + ", own AS (SELECT conv_id, turn FROM postings WHERE term = 'que') SELECT term, count(*) AS n FROM postings SEMI JOIN own USING (conv_id, turn) WHERE term <> 'que' GROUP BY term HAVING count(*) >= 2 ORDER BY n DESC, term LIMIT 20", graph=False)
def neighbour_terms(spark, sf_dir):
    return text.neighbour_terms(P.read(spark, sf_dir, "conversations"), "que")


@query("SELECT CAST(doc_id AS VARCHAR) AS path, len(regexp_extract_all(text, '[0-9]+')) AS n FROM documents WHERE regexp_matches(text, '[0-9]+')", graph=False)
def match_stats(spark, sf_dir):
    return code.file_stats(P.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"), "[0-9]+")


# ---- code ------------------------------------------------------------------------------------------------------------


def _files(spark, sf_dir):
    """Python source written from the tables, a small file a row: a module of each region, one of each nation that calls its
    region, and one of each supplier that calls its nation. No file grows with a table."""

    def module(rows, kind, key, head, call):
        name = F.concat(F.lit(kind), F.col(key))
        body = F.concat(*head, F.lit("def "), name, F.lit("():\n    return "), *call, F.lit("()\n"))
        return rows.select(F.concat(F.lit("pkg/m"), name, F.lit(".py")).alias("path"), body.alias("text"))

    regions = module(P.read(spark, sf_dir, "region"), "r", "r_regionkey", [], [F.lit("dict")])
    nations = module(P.read(spark, sf_dir, "nation"), "n", "n_nationkey", [F.lit("from pkg import mr"), F.col("n_regionkey"), F.lit("\n")], [F.lit("mr"), F.col("n_regionkey"), F.lit(".r"), F.col("n_regionkey")])
    head = [F.lit("from pkg.mn"), F.col("s_nationkey"), F.lit(" import n"), F.col("s_nationkey"), F.lit("\n")]
    suppliers = module(P.read(spark, sf_dir, "supplier"), "s", "s_suppkey", head, [F.lit("n"), F.col("s_nationkey")])
    return regions.unionByName(nations).unionByName(suppliers).unionByName(spark.createDataFrame([("pkg/__init__.py", "")], "path string, text string"))


def _code(spark, sf_dir):
    """Calls of that source, the edges of the tables, and an undeclared type that ties suppliers to their functions, by either
    end; with what the code's lane and the tables' declare."""
    calls = resolve.resolve(python_source.records(_files(spark, sf_dir), "pkg")).filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", "edge_type")
    ties = P.read(spark, sf_dir, "supplier").select(P.node_id("party", "supplier", "s_suppkey").alias("src"), F.concat(F.lit("pkg://func/pkg.ms"), "s_suppkey", F.lit(".s"), "s_suppkey").alias("dst"), F.lit("ties").alias("edge_type"))
    code_lane = spark.createDataFrame([("pkg", t, list(c)) for t, c in C.CODE_CLASSES.items()], "lane string, edge_type string, classes array<string>")
    own = cut(calls.unionByName(ties).distinct())  # none of these is among the tables' edges, which their store keeps distinct
    held = store.table_store(spark, sf_dir).walk
    edges = traverse.Walkable(*[side.select("src", "dst", "edge_type").unionByName(own) for side in held])
    shared = P.vocabulary(spark).filter("edge_type <> 'contains'").unionByName(code_lane)  # both declare contains alike
    return edges, mesh.fold_vocabulary(shared)


_CALLS = "WITH calls AS (SELECT 'pkg://func/pkg.mn' || n_nationkey || '.n' || n_nationkey AS src, 'pkg://func/pkg.mr' || n_regionkey || '.r' || n_regionkey AS dst FROM nation UNION ALL SELECT 'pkg://func/pkg.ms' || s_suppkey || '.s' || s_suppkey, 'pkg://func/pkg.mn' || s_nationkey || '.n' || s_nationkey FROM supplier)"


@query(_CALLS + " SELECT 'pkg://func/pkg.mr1.r1' AS node, 0 AS hop UNION ALL SELECT src, 1 FROM calls WHERE dst = 'pkg://func/pkg.mr1.r1' UNION ALL SELECT b.src, 2 FROM calls a JOIN calls b ON b.dst = a.src WHERE a.dst = 'pkg://func/pkg.mr1.r1'", graph=False)
def code_blast(spark, sf_dir):
    """Over code and tables together; ``ties`` is declared by nobody, so it is lexical and not walked."""
    edges, words = _code(spark, sf_dir)
    return traverse.blast(_seeds(spark, "pkg://func/pkg.mr1.r1"), edges, vocabulary=words).select("node", "hop")


@query(_CALLS + " SELECT 'pkg://func/pkg.mn3.n3' AS node, 0 AS hop UNION ALL SELECT dst, 1 FROM calls WHERE src = 'pkg://func/pkg.mn3.n3'", graph=False)
def code_descend_by_default(spark, sf_dir):
    """A vocabulary that puts nothing in the class asked for leaves the walk to its defaults."""
    edges, words = _code(spark, sf_dir)
    return traverse.descend(_seeds(spark, "pkg://func/pkg.mn3.n3"), edges, vocabulary=words.filter("NOT array_contains(classes, 'reaches')")).select("node", "hop")


@query("WITH f AS (SELECT count(*) AS n FROM (SELECT r_regionkey FROM region UNION ALL SELECT n_nationkey FROM nation UNION ALL SELECT s_suppkey FROM supplier)) SELECT 'func' AS type, n FROM f UNION ALL SELECT 'contains', n FROM f UNION ALL SELECT 'calls', n FROM f UNION ALL SELECT 'module', n + 1 FROM f UNION ALL SELECT 'imports', (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier)", graph=False)
def python_records(spark, sf_dir):
    return python_source.records(_files(spark, sf_dir), "pkg").groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT 'dict' AS label, NULL AS dst, NULL AS via, 'builtin' AS why, count(*) AS n FROM region UNION ALL SELECT 'mr' || n_regionkey || '.r' || n_regionkey, 'pkg://func/pkg.mr' || n_regionkey || '.r' || n_regionkey, 'import', NULL, count(*) FROM nation GROUP BY n_regionkey UNION ALL SELECT 'n' || s_nationkey, 'pkg://func/pkg.mn' || s_nationkey || '.n' || s_nationkey, 'import', NULL, count(*) FROM supplier GROUP BY s_nationkey", graph=False)
def label_resolution(spark, sf_dir):
    found = resolve.resolve(python_source.records(_files(spark, sf_dir), "pkg")).filter("edge_type = 'calls'")
    return found.groupBy("label", "dst", "via", "why").agg(F.count("*").alias("n"))


@query("SELECT 'pkg/ms' || s_suppkey || '.py' AS path, 3 AS line, 's' || s_suppkey AS block, 'code' AS kind FROM supplier UNION ALL SELECT 'pkg/ms' || s_suppkey || '.py', 1, NULL, 'code' FROM supplier UNION ALL SELECT 'pkg/mn' || n_nationkey || '.py', 2, 'n' || n_nationkey, 'code' FROM nation", graph=False)
def code_matches(spark, sf_dir):
    return code.matches(_files(spark, sf_dir), r"\bn[0-9]+\b").select("path", F.col("line").cast("int").alias("line"), "block", "kind")


# ---- records ---------------------------------------------------------------------------------------------------------


@query("SELECT event_id, key AS name, CAST(value AS DOUBLE) AS value FROM (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events), LATERAL (SELECT json_extract_string(props, '$.' || key) AS value, json_type(props, '$.' || key) AS t) WHERE t IN ('UBIGINT', 'BIGINT', 'DOUBLE')", graph=False)
def numeric_leaves(spark, sf_dir):
    return records.numeric_leaves(P.read(spark, sf_dir, "events"), "event_id", "props")


@query("SELECT doc_id, trim(regexp_replace(substr(text, a + 1, least(length(text), spot + 40) - a), '\\s+', ' ', 'g')) AS snippet FROM (SELECT *, greatest(0, spot - 40) AS a FROM (SELECT doc_id, text, greatest(0, instr(lower(text), 'from') - 1) AS spot FROM documents))", graph=False)
def snippets(spark, sf_dir):
    return P.read(spark, sf_dir, "documents").select("doc_id", records.snippet(F.col("text"), "from", 80).alias("snippet"))


@query(_CITED + " SELECT 'edge' AS record, why, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN edge_type IN ('cites', 'emits') THEN 'unknown type' END, CASE WHEN dst IS NULL THEN 'no target' END], lambda x: x IS NOT NULL)) AS why FROM lined) GROUP BY why UNION ALL SELECT 'node', 'unknown type', count(*) FROM nodes WHERE node_type = 'page'")
def schema_violations(spark, sf_dir):
    found = records.violations(P.nodes(spark, sf_dir), _lined(spark, sf_dir, P.edges(spark, sf_dir)), [n[1] for n in P.NODES if n[1] != "page"], [t for t in C.CLASSES if t != "emits"])
    return found.groupBy("record", "why").agg(F.count("*").alias("n"))


@query("SELECT 'pkg://func/pkg.ms' || s_suppkey || '.s' || s_suppkey AS id, 'def s' || s_suppkey || '():' || chr(10) || '    return n' || s_nationkey || '()' AS text FROM supplier", graph=False)
def hydrated_sources(spark, sf_dir):
    files = _files(spark, sf_dir)
    held = python_source.records(files, "pkg").filter("kind = 'node' AND type = 'func' AND path LIKE 'pkg/ms%'").select("id", F.col("type").alias("node_type"), F.col("path").alias("file"), "line", F.lit(2).alias("loc"))
    return records.hydrate(held, files).select("id", "text")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN 'talk://session/' || CASE o_orderkey % 3 WHEN 0 THEN 'named' ELSE 'stamped' END || '.' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || 'ff' END AS session FROM orders", graph=False)
def session_files(spark, sf_dir):
    """Files of sessions: one in three under the node's own name, one with a stamp of its id, one of neither."""
    key = F.col("o_orderkey")
    stamp = F.lpad(key.cast("string"), 8, "0")
    rows = P.read(spark, sf_dir, "orders").select(key, F.when(key % 3 == 1, F.concat(F.lit("2024__"), stamp, F.lit(".md"))).otherwise(F.concat(F.lit("f"), key)).alias("file"))
    sessions = P.read(spark, sf_dir, "orders").filter("o_orderkey % 3 < 2").select(F.concat(F.lit("talk://session/"), F.when(key % 3 == 0, "named").otherwise("stamped"), F.lit("."), stamp, F.lit("ff")).alias("id"), F.when(key % 3 == 0, F.concat(F.lit("f"), key)).alias("file"))
    return records.session_of(rows.select("file"), sessions).join(rows, "file").select("o_orderkey", "session")


@query(_SPREAD + ", firsts AS (SELECT o AS node, 0.5 * share AS energy, s FROM shares WHERE n = '" + PART + "' AND s >= 2) SELECT node, round(energy, 9) AS energy FROM (SELECT '" + PART + "' AS node, 1.0::DOUBLE AS energy UNION ALL (SELECT node, energy FROM firsts ORDER BY energy DESC, s DESC, node LIMIT 3))")
def activation_ranked(spark, sf_dir):
    kept, _, _ = mesh.ranked(traverse.activate(_seeds(spark, PART), _weighted(spark, sf_dir), 1), 3, 2.0)
    return kept.select("node", F.round("energy", 9).alias("energy"))


@query("SELECT arm, m AS module, 'func' AS kind, m || '.' || f AS dotted, CAST(0 AS BIGINT) AS methods FROM (SELECT 'base' AS arm, 'pkg.mr' || r_regionkey AS m, 'r' || r_regionkey AS f FROM region UNION ALL SELECT 'middle', 'pkg.mn' || n_nationkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'rest', 'pkg.ms' || s_suppkey, 's' || s_suppkey FROM supplier)", graph=False)
def arm_inventory(spark, sf_dir):
    held = python_source.records(_files(spark, sf_dir), "pkg").filter("kind = 'node'")
    dotted = C.body(F.col("id"))
    nodes = held.select("id", F.col("type").alias("node_type"), dotted.alias("dotted"), F.expr("substring(regexp_replace(id, '^[^:]*://[^/]*/', ''), 1, length(regexp_replace(id, '^[^:]*://[^/]*/', '')) - length(substring_index(id, '.', -1)) - 1)").alias("module"))
    arms = [P.read(spark, sf_dir, name).select(F.lit(arm).alias("group"), F.concat(F.lit(prefix), key).alias("prefix")) for arm, name, prefix, key in (("base", "region", "pkg.mr", "r_regionkey"), ("middle", "nation", "pkg.mn", "n_nationkey"))]
    return records.arm_inventory(nodes, arms[0].unionByName(arms[1]))


@query(_CALLS + " SELECT r_name AS arm, 'pkg://func/pkg.mr' || r_regionkey || '.r' || r_regionkey AS crown, (SELECT count(*) FROM calls a WHERE a.dst = 'pkg://func/pkg.mr' || r_regionkey || '.r' || r_regionkey) + (SELECT count(*) FROM calls a JOIN calls b ON b.dst = a.src WHERE a.dst = 'pkg://func/pkg.mr' || r_regionkey || '.r' || r_regionkey) AS dependents FROM region", graph=False)
def arm_dependents(spark, sf_dir):
    edges, words = _code(spark, sf_dir)
    crowns = P.read(spark, sf_dir, "region").select(F.col("r_name").alias("arm"), F.concat(F.lit("pkg://func/pkg.mr"), "r_regionkey", F.lit(".r"), "r_regionkey").alias("id"))
    return records.arm_dependents(crowns, edges, "pkg", vocabulary=words)


# ---- free SQL over the estate ----------------------------------------------------------------------------------------


def _free(name: str, spark_sql: str, oracle: str, by: str = "src") -> None:
    """Register a query of free SQL over the views ``nodes`` and ``adj``, the latter clustered ``by`` an end, and what DuckDB
    says to the same question."""

    def run(spark, sf_dir):
        return estate.sql(spark, sf_dir, spark_sql, by)

    run.__name__ = name
    query(" , adj AS (SELECT *, split_part(src, '://', 1) AS corpus, split_part(dst, '://', 1) AS dst_corpus FROM edges) " + oracle)(run)


def _same(name: str, sql: str, by: str = "src") -> None:
    _free(name, sql, sql, by)


_same("sql_left_join", "SELECT n.node_type, count(*) AS n, count(a.src) AS with_edges FROM nodes n LEFT JOIN adj a ON a.src = n.id AND a.edge_type = 'in_nation' GROUP BY n.node_type")
_same("sql_full_join", "SELECT coalesce(a.c, b.c) AS corpus, a.n AS outgoing, b.n AS incoming FROM (SELECT corpus AS c, count(*) AS n FROM adj GROUP BY corpus) a FULL JOIN (SELECT dst_corpus AS c, count(*) AS n FROM adj WHERE corpus <> dst_corpus GROUP BY dst_corpus) b ON a.c = b.c")
_free("sql_semi_join", "SELECT n.corpus, count(*) AS n FROM nodes n LEFT SEMI JOIN adj a ON a.dst = n.id GROUP BY n.corpus", "SELECT n.corpus, count(*) AS n FROM nodes n SEMI JOIN adj a ON a.dst = n.id GROUP BY n.corpus")
_free("sql_anti_join", "SELECT n.node_type, count(*) AS n FROM nodes n LEFT ANTI JOIN adj a ON a.src = n.id GROUP BY n.node_type", "SELECT n.node_type, count(*) AS n FROM nodes n ANTI JOIN adj a ON a.src = n.id GROUP BY n.node_type")
_same("sql_theta_join", "SELECT a.node_type AS low, b.node_type AS high, b.n - a.n AS more FROM (SELECT node_type, count(*) AS n FROM nodes GROUP BY node_type) a JOIN (SELECT node_type, count(*) AS n FROM nodes GROUP BY node_type) b ON a.n < b.n")
_same("sql_cube", "SELECT corpus, edge_type, count(*) AS n FROM adj GROUP BY CUBE (corpus, edge_type)")
_same("sql_rollup", "SELECT corpus, node_type, count(*) AS n FROM nodes GROUP BY ROLLUP (corpus, node_type)")
_same("sql_grouping_sets", "SELECT corpus, dst_corpus, edge_type, count(*) AS n FROM adj GROUP BY GROUPING SETS ((corpus, dst_corpus), (edge_type), ())")
_same("sql_window", "SELECT corpus, dst, n, place FROM (SELECT corpus, dst, n, row_number() OVER (PARTITION BY corpus ORDER BY n DESC, dst) AS place FROM (SELECT corpus, dst, count(*) AS n FROM adj GROUP BY corpus, dst) x) y WHERE place <= 3", by="dst")
_same("sql_running", "SELECT edge_type, n, CAST(sum(n) OVER (ORDER BY edge_type ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto, lag(n) OVER (ORDER BY edge_type) AS before FROM (SELECT edge_type, count(*) AS n FROM adj GROUP BY edge_type) x")
_same("sql_union_intersect_except", "(SELECT dst AS id FROM adj WHERE edge_type = 'in_nation' INTERSECT SELECT src FROM adj WHERE edge_type = 'within') EXCEPT SELECT id FROM nodes WHERE id LIKE '%.3' UNION SELECT dst FROM adj WHERE edge_type = 'within'")
_same("sql_having_distinct", "SELECT src, count(DISTINCT dst) AS n FROM adj WHERE edge_type = 'orders' GROUP BY src HAVING count(DISTINCT dst) >= 6")
_same("sql_correlated", "SELECT n.id FROM nodes n WHERE n.corpus = 'geo' AND EXISTS (SELECT 1 FROM adj a WHERE a.dst = n.id AND a.corpus = 'party') AND n.id NOT IN (SELECT dst FROM adj WHERE edge_type = 'within')")
_same("sql_top", "SELECT dst, count(*) AS n FROM adj GROUP BY dst ORDER BY n DESC, dst LIMIT 10", by="dst")
_free("sql_json_attributes", "SELECT node_type, sum(get_json_object(to_json(named_struct('k', length(id))), '$.k')) AS total FROM nodes GROUP BY node_type", "SELECT node_type, CAST(sum(CAST(json_extract_string(json_object('k', length(id)), '$.k') AS DOUBLE)) AS DOUBLE) AS total FROM nodes GROUP BY node_type")


from graphloom.plans import upkeep_queries  # noqa: E402, F401  registers its queries, with what stands above
