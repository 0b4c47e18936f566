from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphloom.operators import lookup, mesh, traverse
from graphloom.operators.lookup import Refused
from graphloom.plans import store
from graphloom.sources import projection as P


def tables(spark, nodes, edges):
    return spark.createDataFrame([(n, "func", "a") for n in nodes], "id string, node_type string, corpus string"), spark.createDataFrame(edges, "src string, dst string, edge_type string")


def test_compile_serves_the_last_generation_and_skips_unchanged_content(spark, tmp_path):
    home = str(tmp_path / "home")
    with pytest.raises(Refused):
        store.open_store(spark, home)
    n, e = tables(spark, ["x://k/a", "x://k/b"], [("x://k/a", "x://k/b", "calls")] * 2)
    first = store.compile_store(spark, home, n, e, ["a"])
    folder = store.served(spark, home)[1]
    assert store.compile_store(spark, home, n.orderBy(n["id"].desc()), e, ["a"]) == first and store.served(spark, home)[1] == folder
    n2, e2 = tables(spark, ["x://k/a", "x://k/c"], [("x://k/a", "x://k/c", "calls")])
    second = store.compile_store(spark, home, n2, e2, ["a"])
    held = store.open_store(spark, home)
    assert held.generation == second != first and held.edges.count() == 1 and {r["id"] for r in held.nodes.collect()} == {"x://k/a", "x://k/c"}
    with pytest.raises(Refused):
        store.open_store(spark, home, expected=first)


def test_walk_is_cached_per_generation_and_replay_names_what_died(spark, tmp_path):
    n, e = tables(spark, ["a", "b", "c"], [("a", "b", "calls"), ("b", "c", "calls")])
    asked = []

    def walk():
        asked.append(1)
        return traverse.reach(spark.createDataFrame([("a",)], "seed string"), traverse.steps(e), 3)

    for _ in range(2):
        found = store.cached_walk(spark, str(tmp_path), "g1", "walk", "a", 3, walk)
        assert {r["node"]: r["hop"] for r in found.collect()} == {"a": 0, "b": 1, "c": 2}
    store.cached_walk(spark, str(tmp_path), "g2", "walk", "a", 3, walk)
    assert len(asked) == 2
    n2, e2 = tables(spark, ["a", "b"], [("b", "c", "calls")])
    assert {(r["node"], r["why"]) for r in store.replay(found, n2, e2).collect()} == {("c", "node died"), ("b", "edge died")}


def test_journal_pages(spark, tmp_path):
    a, _ = tables(spark, ["x", "y"], [("x", "y", "r")])
    b, _ = tables(spark, ["y", "z"], [("y", "z", "r")])
    path = str(tmp_path / "journal")
    one, two = store.append_page(spark, path, "j", "c1", None, a), store.append_page(spark, path, "j", "c2", a, b)
    assert (one["seq"], one["bootstrap"], one["born"], one["died"]) == (1, True, ["x", "y"], [])
    assert (two["seq"], two["prev_cursor"], two["born"], two["died"], two["truncated"]) == (2, "c1", ["z"], ["x"], False)


def test_store_answers_as_the_operators_over_raw_edges_do(spark, tmp_path):
    names = ["x://k/a.B", "x://k/c.b", "y://k/b", "y://k/d", "x://k/zb"]
    n = spark.createDataFrame([(i, "func", i[0]) for i in names], "id string, node_type string, corpus string")
    rows = [("x://k/a.B", "y://k/b", "calls")] * 3 + [("y://k/b", "x://k/c.b", "calls"), ("x://k/c.b", "y://k/b", "calls"), ("y://k/b", "y://k/d", "near"), ("x://k/zb", "q://gone", "calls")]
    e = spark.createDataFrame(rows, "src string, dst string, edge_type string")
    words = spark.createDataFrame([("l", "near", ["reaches"]), ("m", "near", ["reaches"])], "lane string, edge_type string, classes array<string>")
    store.compile_store(spark, str(tmp_path), n, e, ["x", "y"], words)
    held = store.open_store(spark, str(tmp_path))
    same = lambda a, b: sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(a.columns)).collect()))
    assert same(held.seams(), mesh.seam_matrix(e, n)) and same(held.stats(), mesh.mesh_stats(e, n)) and same(held.crowns(), mesh.crowns(n, e))
    for symbol in ("b", "B", "x://k/zb", "k/b", "none"):
        assert same(held.find(symbol).select("id"), lookup.find(n, symbol).select("id"))
    assert same(held.neighbours("y://k/b"), lookup.neighbours(e, "y://k/b"))
    seed = spark.createDataFrame([("x://k/a.B",)], "seed string")
    for way in ("with", "against", "any"):
        assert same(traverse.reach(seed, traverse.steps(held.walk, None, way), 3).drop("trail"), traverse.reach(seed, traverse.steps(e, None, way), 3).drop("trail"))
    assert {r["node"] for r in traverse.descend(seed.select(F.lit("y://k/b").alias("seed")), held.walk, vocabulary=held.vocabulary).collect()} == {"y://k/b", "y://k/d"}
    with pytest.raises(Refused, match="differently"):
        store.compile_store(spark, str(tmp_path), n, e, ["x"], words.unionByName(words.limit(1).withColumn("lane", F.lit("z")).withColumn("classes", F.array(F.lit("depends")))))


def test_table_store_is_compiled_again_when_a_file_changes(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for name in P.TABLES:  # the bytes alone: the folder they come from can't be written to
        (tmp_path / f"t/{name}.parquet").write_bytes(Path(f"/root/testdata/sf0.001/{name}.parquet").read_bytes())
    first = store.table_store(spark, str(tmp_path / "t"))
    assert store.table_store(spark, str(tmp_path / "t")).generation == first.generation
    (tmp_path / "t/region.parquet").unlink()
    spark.read.parquet("/root/testdata/sf0.001/region.parquet").limit(2).write.parquet(str(tmp_path / "t/region.parquet"))
    second = store.table_store(spark, str(tmp_path / "t"))
    assert second.generation != first.generation and first.nodes.count() - second.nodes.count() == 3


def test_table_store_of_another_projection_is_compiled_anew(spark, tmp_path, monkeypatch):
    for name in P.TABLES:
        (tmp_path / f"{name}.parquet").write_bytes(Path(f"/root/testdata/sf0.001/{name}.parquet").read_bytes())
    first = store.table_store(spark, str(tmp_path))
    monkeypatch.setattr(P, "EDGES", P.EDGES[1:])
    second = store.table_store(spark, str(tmp_path))
    assert second.generation != first.generation
    assert first.edges.filter("edge_type = 'placed_by'").head(1) and not second.edges.filter("edge_type = 'placed_by'").head(1)
    monkeypatch.undo()
    monkeypatch.setattr(store, "LAYOUT", -1)
    assert store.table_store(spark, str(tmp_path)).generation not in (first.generation, second.generation)


def test_a_damaged_pointer_is_an_error_and_not_an_empty_home(spark, tmp_path):
    assert store.served(spark, str(tmp_path)) is None
    spark.range(3).write.parquet(str(tmp_path / "pointer"))
    with pytest.raises(Exception, match="at"):
        store.served(spark, str(tmp_path))
