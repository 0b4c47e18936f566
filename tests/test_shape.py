import itertools

import pytest

from graphloom.operators import shape as S
from graphloom.operators.lookup import Refused


def made(weight, root="r"):
    return S.Units(weight, {u for pair in weight for u in pair} | {root}, root)


def test_roles_and_arms():
    g = made({("r.api", "r.core"): 20, ("r.api", "r.util"): 4, ("r.cli", "r.core"): 3, ("r.cli", "r.util"): 12, ("r.x", "r.y"): 1, ("r", "r.api"): 1})
    plan = S.propose(g)
    assert plan.roles == {"r": "facade", "r.x": "edge", "r.y": "edge", "r.api": "orchestrator", "r.cli": "orchestrator", "r.core": "foundation", "r.util": "foundation"}
    assert plan.crowns == {"API": "r.api", "CLI": "r.cli"} and plan.floor_arm is None
    assert plan.arm_of() == {"r": "EDGE", "r.x": "EDGE", "r.y": "EDGE", "r.api": "API", "r.core": "API", "r.cli": "CLI", "r.util": "CLI"}


def test_floor_forms_where_no_arm_owns():
    g = made({("r.a", "r.f"): 10, ("r.b", "r.f"): 10, ("r.a", "r.g"): 3, ("r.b", "r.g"): 3})
    plan = S.propose(g)
    assert plan.floor_arm == "F" and plan.crowns["F"] == "r.f" and plan.arms["F"] == ["r.f", "r.g"]


def test_client_joins_or_stands_alone():
    weights = {("r.a", "r.f"): 40, ("r.b", "r.f"): 2, ("r.b", "r.a"): 5}
    assert S.propose(made(weights)).arm_of()["r.b"] == "A"
    lone = {("r.a", "r.f"): 40, **{("r.b", f"r.q{i}"): 2 for i in range(8)}, ("r.b", "r.f"): 2}
    assert S.propose(made(lone)).crowns["B"] == "r.b"
    assert S.propose(made(lone), arms=2).arm_of()["r.b"] == "A"


def test_equal_names_get_numbers_and_everything_is_placed():
    plan = S.propose(made({("a.x", "a.f"): 9, ("b.x", "b.f"): 9}))
    assert set(plan.crowns) == {"X", "X2"}
    g = made({(a, b): (i * 7) % 11 for i, (a, b) in enumerate(itertools.permutations("abcdefgh", 2)) if (i * 7) % 11 > 4})
    plan = S.propose(g)
    assert set(plan.arm_of()) == g.names and sum(map(len, plan.arms.values())) == len({u for us in plan.arms.values() for u in us})


def test_refusals():
    g = made({("r.a", "r.b"): 9})
    for wrong in ({"arms": 1}, {"floor": -1}, {"owned": 0.5}, {"client": 0}):
        with pytest.raises(Refused):
            S.propose(g, **wrong)
    with pytest.raises(Refused):
        S.propose(made({("r.a", "r.b"): 9, ("r.b", "r.a"): 9}))


def tables(spark):
    nodes = spark.createDataFrame([("a", "p", "m1"), ("b", "p", "m1"), ("c", "q", "m2"), ("d", "q", "m3")], "id string, arm string, module string")
    edges = spark.createDataFrame([("a", "b", "calls"), ("a", "b", "calls"), ("b", "c", "calls"), ("a", "c", "calls"), ("c", "d", "imports"), ("a", "a", "calls"), ("c", "d", "contains"), ("d", "z", "calls")], "src string, dst string, edge_type string")
    return nodes, edges


def test_scene_counts_before_the_cut(spark):
    nodes, edges = tables(spark)
    shown, links = S.scene(nodes, edges, ("calls", "imports"), 3)
    assert {r["id"]: (r["fan_in"], r["fan_out"], r["crown"]) for r in shown.collect()} == {"b": (1, 1, True), "c": (2, 1, True), "d": (1, 0, False)}
    assert {(r["src"], r["dst"], r["kind"], r["weight"]) for r in links.collect()} == {("b", "c", "cross", 1), ("c", "d", "depends", 1), ("c", "d", "contains", 1)}
    seen = {r["module"]: tuple(r)[1:] for r in S.overview(nodes, edges, ("calls", "imports")).collect()}
    assert seen == {"m1": (2, 1, 0, 2), "m2": (1, 0, 2, 1), "m3": (1, 0, 1, 0)}


def test_diff_crowns_and_joins(spark):
    nodes, edges = tables(spark)
    left = spark.createDataFrame([("u", "A"), ("v", "A"), ("w", "B")], "unit string, arm string")
    right = spark.createDataFrame([("u", "A"), ("v", "B"), ("x", "B")], "unit string, arm string")
    assert {tuple(r) for r in S.diff(left, right).collect()} == {("v", "A", "B"), ("w", "B", None), ("x", None, "B")}
    typed = nodes.withColumn("node_type", S.F.when(S.F.col("id") == "d", "module").otherwise("func"))
    assert {tuple(r) for r in S.arm_crowns(typed, edges, ("calls", "imports")).collect()} == {("q", "c", 2)}
    inherits = spark.createDataFrame([("a", "b", "inherits"), ("a", "c", "inherits"), ("a", "z", "inherits")], "src string, dst string, edge_type string")
    assert {(r["dst"], r["to_arm"]) for r in S.arm_joins(nodes, inherits).collect()} == {("c", "q"), ("z", None)}


def test_sections_are_written_and_drift_is_named(spark, tmp_path):
    nodes = spark.createDataFrame([("i1", "a.b", "f"), ("i2", "a.c", "f"), ("i3", "z", "f")], "id string, dotted string, node_type string")
    edges = spark.createDataFrame([("i1", "i2", "calls")], "src string, dst string, edge_type string")
    cut = spark.createDataFrame([("one", "a"), ("two", "a.c")], "group string, prefix string")
    toc = S.export_sections(nodes, edges, cut, str(tmp_path / "out"))
    assert {(r["section"], r["nodes"], r["edges"]) for r in toc.collect()} == {("one", 1, 1), ("two", 1, 0), ("rest", 1, 0)}
    assert S.drift(str(tmp_path / "out"), nodes, edges, cut).isEmpty()
    assert {tuple(r) for r in S.drift(str(tmp_path / "out"), nodes.filter("id <> 'i3'"), edges, cut).collect()} == {("rest", "gone")}
    assert {(r["cluster"], r["size"]) for r in S.clusters(nodes).collect()} == {("a.b", 1), ("a.c", 1), ("z", 1)}
