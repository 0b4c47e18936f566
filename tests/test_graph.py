import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.operators import journal, lookup, mesh, records, text, traverse
from graphloom.operators.lookup import Refused
from graphloom.session import cut
from graphloom.sources import shards


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, edge_type string")


def seeds_of(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "seed string")


def brute(rows, seed, depth, way):
    seen, level = {seed: 0}, [seed]
    for hop in range(1, depth + 1):
        fresh = []
        for s, d, _ in rows:
            for a, b in (((s, d),) if way == "with" else ((d, s),) if way == "against" else ((s, d), (d, s))):
                if a in level and b not in seen and b not in fresh:
                    fresh.append(b)
        seen.update({n: hop for n in fresh})
        level = fresh
    return seen


@pytest.mark.parametrize("way", ["with", "against", "any"])
def test_reach_matches_brute_force_on_random_graphs(spark, way):
    rng = random.Random(5)
    rows = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", "calls") for _ in range(60)]
    found = traverse.reach(seeds_of(spark, "n1", "n2"), traverse.steps(edges_of(spark, rows), None, way), 3)
    got = {(r["seed"], r["node"]): r["hop"] for r in found.collect()}
    assert got == {(s, n): h for s in ("n1", "n2") for n, h in brute(rows, s, 3, way).items()}


def test_cycles_self_loops_and_unknown_seeds(spark):
    e = edges_of(spark, [("a", "b", "x"), ("b", "c", "x"), ("c", "a", "x"), ("a", "a", "x")])
    assert {r["node"]: r["hop"] for r in traverse.reach(seeds_of(spark, "a"), traverse.steps(e, None, "with"), 9).collect()} == {"a": 0, "b": 1, "c": 2}
    assert [r["node"] for r in traverse.reach(seeds_of(spark, "zz"), traverse.steps(e), 2).collect()] == ["zz"]


def test_path_reasons(spark):
    e = edges_of(spark, [("a", "b", "x"), ("b", "c", "y"), ("p", "q", "x")])
    assert traverse.path_to(e, "a", "c") == ([("a", ""), ("b", "x"), ("c", "y")], None)
    assert traverse.path_to(e, "a", "nope") == ([], "target-absent")
    assert traverse.path_to(e, "nope", "a") == ([], "seed-absent")
    assert traverse.path_to(e, "a", "q") == ([], None)
    assert traverse.path_to(e, "a", "c", max_depth=1) == ([], "max_depth")


def test_activation_shares_energy_by_salience(spark):
    w = spark.createDataFrame([("s", "a", 3.0), ("s", "b", 1.0), ("s", "z", 0.0), ("a", "c", 1.0), ("b", "c", 1.0)], "node string, other string, salience double")
    got = {r["node"]: round(r["energy"], 6) for r in traverse.activate(seeds_of(spark, "s"), w, 2).collect()}
    assert got == {"s": 1.0, "a": 0.375, "b": 0.125, "c": 0.1875}


def test_resolve_refuses(spark):
    nodes = spark.createDataFrame([("x://func/m.go",), ("x://func/n.go",), ("x://func/m.stop",)], "id string")
    assert lookup.resolve(nodes, "stop") == "x://func/m.stop"
    for symbol in ("go", "none"):
        with pytest.raises(lookup.Refused):
            lookup.resolve(nodes, symbol)


def test_neighbour_seen_both_ways(spark):
    e = edges_of(spark, [("a", "b", "x"), ("b", "a", "x"), ("a", "c", "x")])
    assert {(r["other"], r["direction"]) for r in lookup.neighbours(e, "a").collect()} == {("b", "both"), ("c", "with")}


def test_verdicts(spark):
    """Own schemes are ok, held or not; those of others if a lane that is or owns them holds the id; nobody's never are."""
    held = spark.createDataFrame([("b://f/x", "b"), ("own://f/x", "b"), ("lit://f/x", "a"), ("lit://f/y", "b")], "id string, lane string")
    schemes = spark.createDataFrame([("own", "b"), ("mine", "a")], "scheme string, lane string")
    want = {
        None: "malformed", "plain": "ok", "a://f/none": "ok", "mine://f/none": "ok", "b://f/x": "ok", "b://f/none": "unresolved", "own://f/x": "ok", "own://f/none": "unresolved",
        "nobody://f/x": "unresolved", "scrape://p": "ok", "fetch://p": "ok", "std://os": "ok", "builtin://len": "unresolved", "lit://f/x": "ok", "lit://f/y": "unresolved",
    }
    e = spark.createDataFrame([("a://f/s", d, "r", "a") for d in want], "src string, dst string, edge_type string, lane string")
    assert {r["dst"]: r["verdict"] for r in mesh.verdicts(e, held, schemes, standard=("std",), literal=("lit",)).collect()} == want
    assert {r["dst"] for r in mesh.admitted(e, held, schemes, ("std",), ("lit",)).collect()} == {d for d, v in want.items() if v == "ok"}


def test_relation_classes_come_from_the_vocabulary(spark):
    e = edges_of(spark, [("a", "b", "calls"), ("b", "c", "wires"), ("c", "d", "near"), ("x", "a", "imports"), ("y", "a", "wires")])
    words = spark.createDataFrame([("wires", ["depends", "reaches"]), ("near", ["lexical"])], "edge_type string, classes array<string>")
    names = lambda found: {r["node"] for r in found.filter("hop > 0").collect()}
    assert names(traverse.descend(seeds_of(spark, "b"), e, vocabulary=words)) == {"c"} and names(traverse.blast(seeds_of(spark, "a"), e, vocabulary=words)) == {"y"}
    for nothing in (None, words.limit(0), words.filter("edge_type = 'near'")):  # what declares no class leaves the defaults
        assert names(traverse.descend(seeds_of(spark, "a"), e, vocabulary=nothing)) == {"b"} and names(traverse.blast(seeds_of(spark, "b"), e, vocabulary=nothing)) == {"a", "x"}


def test_first_discoverer_counts(spark):
    """In a level nodes are found in the order of their parents, then outgoing before incoming, then by name."""
    e = edges_of(spark, [("s", "b", "r"), ("c", "s", "r"), ("s", "a", "r"), ("a", "z", "r"), ("b", "z", "r"), ("c", "y", "r"), ("b", "y", "q")])
    got = {r["node"]: (r["via"], r["relation"]) for r in traverse.reach(seeds_of(spark, "s"), traverse.steps(e), 2).collect()}
    assert got["z"] == ("a", "r") and got["y"] == ("b", "q")


def test_exchanges_join_runs_and_keep_a_leading_answer(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "hello"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "system", "x"), (1, 4, "assistant", "c"), (1, 5, "assistant", "d"), (1, 6, "user", "e")], "conv_id int, turn int, role string, text string")
    got = [(r["n"], r["user"], r["assistant"]) for r in text.exchanges(turns).orderBy("n").collect()]
    assert got == [(1, "", "hello"), (2, "a\n\nb", "c\n\nd"), (3, "e", "")]


def test_liveness_and_source_kinds(spark):
    rows = [("l", "live"), ("l", "doc"), ("p", "prose"), ("q", "prose"), ("q", "test"), ("d", "doc"), ("s", "slop"), ("o", "none")]
    got = {r["k"]: r["verdict"] for r in text.liveness(spark.createDataFrame(rows, "k string, kind string"), "k").collect()}
    assert got == {"l": "LIVE", "p": "MENTION-ONLY", "q": "FALSE LIVENESS", "d": "FALSE LIVENESS", "s": "FALSE LIVENESS", "o": "DARK"}
    paths = {"a/tests/x.md": "test", "logs/test_a.py": "test", "a/b_test.py": "test", "a/b.spec.ts": "test", "logs/a.py": "slop", "Archive/readme.md": "slop", "a/b.YML": "doc", "handoffs/x.py": "doc", "src/a.py": "live", "dist/a.py": "live"}
    found = spark.createDataFrame([(p,) for p in paths], "p string").select("p", C.source_kind(F.col("p")).alias("k")).collect()
    assert {r["p"]: r["k"] for r in found} == paths
    cursors = {"abcdef0123": "abcdef01", "a" * 40: "a" * 8, "a" * 41: "a" * 41, "xyz": "xyz"}
    assert {r["c"]: r["k"] for r in spark.createDataFrame([(c,) for c in cursors], "c string").select("c", C.cursor(F.col("c")).alias("k")).collect()} == cursors


def test_ranking_keeps_seeds_and_tells_what_was_cut(spark):
    rows = [("s", 1.0, None), ("a", 0.5, 2.0), ("b", 0.5, 3.0), ("c", 0.5, 3.0), ("d", 0.9, 0.5)]
    kept, n, cut = mesh.ranked(spark.createDataFrame(rows, "node string, energy double, salience double"), 2, 1.0)
    assert {r["node"] for r in kept.collect()} == {"s", "b", "c"} and (n, cut) == (3, True)


def test_records(spark):
    nodes = spark.createDataFrame([("a", "func"), ("b", "odd"), (None, "func"), ("d", None)], "id string, node_type string")
    edges = edges_of(spark, [("a", "b", "calls"), ("a", None, "calls"), (None, "b", "odd")])
    got = {(r["record"], r["why"]) for r in records.violations(nodes, edges, ["func"], ["calls"]).collect()}
    assert got == {("node", "unknown type"), ("node", "no id"), ("node", "no type"), ("edge", "no target"), ("edge", "unknown type"), ("edge", "no source")}
    assert records.validate(nodes.limit(1), edges.limit(1), ["func"], ["calls"]) == 2
    for n, e in ((nodes, edges), (nodes.limit(0), edges.limit(0))):
        with pytest.raises(lookup.Refused):
            records.validate(n, e, ["func"], ["calls"])
    files = spark.createDataFrame([("m.py", "x\ndef f():\n    pass\ny")], "path string, text string")
    held = spark.createDataFrame([("f", "func", "m.py", 2, 2), ("m", "module", "m.py", 1, 4), ("g", "func", "gone.py", 1, 1), ("h", "func", None, 1, 1)], "id string, node_type string, file string, line int, loc int")
    found = {r["id"]: (r["text"], r["truncated"], r["error"]) for r in records.hydrate(held, files, 12).collect()}
    assert found["f"] == ("def f():\n   ", True, None) and found["m"] == ("x\ndef f():\n ", True, None) and found["g"][2] == "the file is not held" and found["h"][2] == "the record names no file"
    leaves = spark.createDataFrame([(1, '{"a": 1, "b": {"c": 2.5, "d": {"e": 3}, "f": "4"}, "hot": {"x": 9}, "g": [1], "h": true}'), (2, "not json"), (3, None)], "k int, t string")
    assert {(r["k"], r["name"], r["value"]) for r in records.numeric_leaves(leaves, "k", "t").collect()} == {(1, "a", 1.0), (1, "b.c", 2.5), (1, "b.d.e", 3.0)}
    cut = spark.createDataFrame([("x" * 50 + " The\n\nTerm here " + "y" * 50,), ("none",)], "t string").select(records.snippet(F.col("t"), "term", 20).alias("s")).collect()
    assert [r["s"] for r in cut] == ["xxxx The Term here", "none"]


def test_digest_is_order_free_and_sees_changes(spark):
    rows = spark.createDataFrame([(i, str(i)) for i in range(50)], "a int, b string")
    assert mesh.rows_digest(rows) == mesh.rows_digest(rows.orderBy(F.col("a").desc()).repartition(3)) != mesh.rows_digest(rows.filter("a <> 7"))


def test_vocabulary_conflict_names_lanes(spark):
    bad = spark.createDataFrame([("l1", "calls", ["depends"]), ("l2", "calls", ["reaches"])], "lane string, edge_type string, classes array<string>")
    with pytest.raises(lookup.Refused, match="l1, l2"):
        mesh.fold_vocabulary(bad)


def test_ids(spark):
    got = spark.createDataFrame([("s://k/a.b",), ("s://a.b",), ("plain",)], "id string").select(C.scheme(F.col("id")).alias("s"), C.kind(F.col("id")).alias("k"), C.body(F.col("id")).alias("b"), C.last(F.col("id")).alias("l")).collect()
    assert [tuple(r) for r in got] == [("s", "k", "a.b", "b"), ("s", "", "a.b", "b"), (None, "", "plain", "plain")]


def test_spellings_and_patterns(spark):
    row = spark.createDataFrame([("parseHTTPHeader2",)], "n string").select(C.spellings(F.col("n")).alias("v")).first()["v"]
    assert row[:3] == ["parse_http_header_2", "parse-http-header-2", "parse.http.header.2"] and row[5:] == ["parseHttpHeader2", "ParseHttpHeader2"]
    hits = spark.createDataFrame([("parse_http_header2",), ("parse http",)], "t string").filter(F.col("t").rlike(C.tolerant_pattern("parseHTTPHeader2")))
    assert hits.count() == 1


def test_containing_block_is_innermost_and_named(spark):
    hits = spark.createDataFrame([("f", 5)], "file string, pos int")
    blocks = spark.createDataFrame([("f", 0, 10, "outer"), ("f", 4, 8, "inner"), ("f", 5, 6, None), ("f", 5, 5, "empty")], "file string, start int, end int, name string")
    assert text.containing(hits, blocks, "file").first()["block"] == "inner"


def test_journal_window_join_bounds(spark):
    captures = spark.createDataFrame([(1, 10), (1, 20), (1, 30)], "k int, t int")
    points = spark.createDataFrame([(1, i, t) for i, t in enumerate((5, 10, 11, 20, 21, 31))], "k int, point_id long, t int")
    got = {r["point_id"]: r["high"] for r in journal.in_window(points, captures, "k", "t").collect()}
    assert got == {2: 20, 3: 20, 4: 30}


def test_outline_and_readers(spark, tmp_path):
    assert shards.outline_rows("d", "Top\n  One\n  One\n\tDeep\n") == [("outline://node/d.top", None, "Top"), ("outline://node/d.top.one", "outline://node/d.top", "One"), ("outline://node/d.top.one~2", "outline://node/d.top", "One"), ("outline://node/d.top.one~2.deep", "outline://node/d.top.one~2", "Deep")]
    (tmp_path / "nodes.json").write_text('{"a": {"id": "a", "node_type": "func", "file": "x\\\\y.py"}, "b": {"node_type": "func"}}')
    (tmp_path / "edges.json").write_text('[{"from": "a", "to": "b", "relation": "calls"}, {"src": "a"}]')
    (tmp_path / "co.jsonl").write_text('{"from": "a", "to": "b", "relation": "r", "salience": 1.5, "witnesses": ["w"]}\n\nnot json\n')
    assert [(r["file"], r["residual"]) for r in shards.shard_nodes(spark, str(tmp_path / "nodes.json")).orderBy("residual").collect()] == [("x/y.py", False), (None, True)]
    assert [(r["src"], r["dst"], r["edge_type"], r["residual"]) for r in shards.shard_edges(spark, str(tmp_path / "edges.json")).orderBy("residual").collect()] == [("a", "b", "calls", False), ("a", None, None, True)]
    assert sorted(r["malformed"] for r in shards.cochange(spark, str(tmp_path / "co.jsonl")).collect()) == [False, True]
    log = spark.createDataFrame([('1.1.1.1 - - "GET /u/123/x?q=1 HTTP/1.1" 200 12 ms',), ("noise",)], "value string")
    assert [tuple(r) for r in shards.access_log(log).collect()] == [(None, "GET", "/u/{}/x", 200, 12.0)]


def test_journal_stream_drops_repeats(spark, tmp_path):
    from graphloom.streaming.logs import journal_stream

    (tmp_path / "in").mkdir()
    line = '{"journal": "j", "seq": %d, "ts": "2024-01-01T00:00:0%d", "cursor": "c", "n_born": 1, "n_died": 0, "bootstrap": false}\n'
    (tmp_path / "in/a.json").write_text(line % (1, 1) + line % (1, 1) + line % (2, 2))
    running = journal_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("pages").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    running.awaitTermination(60)
    assert spark.table("pages").count() == 2


def test_a_search_that_was_stopped_is_no_answer(spark):
    """More nodes than a walk once held, and a path that leads on from one of them; a cap of the caller's is refused, not -1 or none."""
    hub = spark.range(260_000).select(F.lit("hub").alias("src"), F.concat(F.lit("n"), F.col("id")).alias("dst"), F.lit("x").alias("edge_type"))
    e = cut(hub.unionByName(spark.createDataFrame([("n7", "far", "x"), ("far", "t", "x"), ("a", "hub", "x"), ("p", "q", "x")], "src string, dst string, edge_type string")))
    assert traverse.path_to(e, "a", "t", max_depth=4) == ([(n, "x" if n != "a" else "") for n in ("a", "hub", "n7", "far", "t")], None)
    assert traverse.path_to(e, "a", "q", max_depth=3) == ([], "max_depth")
    with pytest.raises(Refused, match="isn't known"):
        traverse.path_to(e, "a", "t", max_depth=4, max_nodes=1000)
