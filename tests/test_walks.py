import pytest
from pyspark.sql import functions as F

from graphloom.operators import mesh, traverse
from graphloom.operators.lookup import Refused
from graphloom.plans import store

LINE = [(f"x://k/{i}", f"x://k/{i + 1}", "calls") for i in range(5)]


def opened(spark, home, edges):
    nodes = spark.createDataFrame([(f"x://k/{i}", "func", "x") for i in range(6)], "id string, node_type string, corpus string")
    store.compile_store(spark, home, nodes, spark.createDataFrame(edges, "src string, dst string, edge_type string"), ["x"])
    return store.open_store(spark, home)


def test_a_stopped_walk_is_resumed_and_another_generation_refused(spark, tmp_path):
    home = str(tmp_path)
    held = opened(spark, home, LINE)
    whole, reason = traverse.path_to(held.walk, "x://k/0", "x://k/5", max_depth=6)
    assert reason is None and [n for n, _ in whole] == [f"x://k/{i}" for i in range(6)]
    seed = spark.createDataFrame([("x://k/0",)], "seed string")
    cursor = store.save_cursor(home, held.generation, traverse.reach(seed, traverse.steps(held.walk), 2))
    steps, reason, cursor = store.resume(spark, held, home, cursor, "x://k/5", max_depth=3)
    assert (steps, reason) == ([], "max_depth")
    steps, reason, cursor = store.resume(spark, held, home, cursor, "x://k/5", max_depth=6)
    assert (steps, reason) == (whole, None)
    assert traverse.frame(store.open_cursor(spark, held, home, cursor), "x://k/0", "x://k/2") == whole[:3]
    assert traverse.frame(store.open_cursor(spark, held, home, cursor), "x://k/0", "gone") is None
    with pytest.raises(Refused, match="no walk"):
        store.resume(spark, held, home, "none", "x://k/5")
    moved = opened(spark, home, LINE[:4])
    with pytest.raises(Refused, match="generation"):
        store.resume(spark, moved, home, cursor, "x://k/5")


def test_walks_are_spliced_and_recalled(spark, tmp_path):
    home = str(tmp_path)
    held = opened(spark, home, LINE)
    assert store.recall(spark, home, held.generation, target="x://k/5") is None
    live = store.spliced_path(spark, held, home, "x://k/0", "x://k/5")
    assert live[2] == "live" and len(live[0]) == 6
    seed = spark.createDataFrame([("x://k/3",)], "seed string")
    store.cached_walk(spark, home, held.generation, "walk", "x://k/3", 2, lambda: traverse.reach(seed, traverse.steps(held.walk), 2))
    assert store.spliced_path(spark, held, home, "x://k/3", "x://k/5")[1:] == (None, "store")
    assert store.spliced_path(spark, held, home, "x://k/0", "x://k/5", max_depth=3) == (live[0], None, "spliced")
    assert store.spliced_path(spark, held, home, "x://k/0", "x://k/5", max_depth=2) == ([], "max_depth", "live")
    assert {(r["seed"], r["hop"]) for r in store.recall(spark, home, held.generation, target="x://k/5").collect()} == {("x://k/3", 2)}
    assert {r["node"] for r in store.recall(spark, home, held.generation, seed="x://k/3").collect()} == {f"x://k/{i}" for i in range(1, 6)}
    with pytest.raises(Refused):
        store.recall(spark, home, held.generation)


def test_readmission_equals_judging_all_edges(spark):
    own = spark.createDataFrame([("a", "a"), ("b", "b"), ("b2", "b"), ("c", "c")], "scheme string, lane string")
    ids = lambda *rows: spark.createDataFrame(rows, "id string, lane string")
    was = ids(("a://k/1", "a"), ("b://k/1", "b"), ("b2://k/1", "b"), ("c://k/1", "c"))
    now = ids(("a://k/1", "a"), ("b://k/2", "b"), ("b2://k/2", "b"), ("c://k/1", "c"), ("lit://k/1", "b"))
    rows = [(lane, src, dst, "r") for lane in "abc" for src in ("a://k/1", "c://k/1") for dst in ("b://k/1", "b://k/2", "b2://k/1", "b2://k/2", "c://k/1", "c://k/9", "lit://k/1", "q://k/1", "plain", None)] * 2
    edges = spark.createDataFrame(rows, "lane string, src string, dst string, edge_type string")
    before = mesh.admitted_by_lane(edges, was, own, literal=("lit",))
    full = mesh.admitted_by_lane(edges, now, own, literal=("lit",))
    found = mesh.readmitted(before, edges, now, own, ("b",), literal=("lit",))
    assert sorted(map(str, found.collect())) == sorted(map(str, full.collect())) and full.count() == full.distinct().count()
    assert before.exceptAll(full).count() and full.exceptAll(before).count()
    assert not found.filter(F.col("dst") == "q://k/1").count()
