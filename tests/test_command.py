from graphloom.__main__ import main

TABLES = ["--tables", "/root/testdata/sf0.001"]


def test_source_to_store_to_answers(spark, tmp_path, capsys):
    (tmp_path / "src/pkg").mkdir(parents=True)
    (tmp_path / "src/pkg/__init__.py").write_text("from .core import run\n")
    (tmp_path / "src/pkg/core.py").write_text("def run():\n    return help_out()\ndef help_out():\n    pass\n")
    home = ["--home", str(tmp_path / "home")]
    assert main(["eat", str(tmp_path / "src/pkg"), "pkg", *home], spark) == 0
    assert main(["blast", "help_out", *home], spark) == 0
    assert "pkg://func/pkg.core.run" in capsys.readouterr().out
    assert main(["walk", "pkg.core", "help_out", *home], spark) == 0
    assert main(["hunt", "nothing_like_it", *home], spark) == 1
    assert main(["blast", "nothing_like_it", *home], spark) == 2
    assert main(["draw", "run", *home], spark) == 0 and "[pkg.core.run]" in capsys.readouterr().out
    assert main(["estate", "SELECT count(*) AS n FROM adj WHERE edge_type = 'calls'", *home], spark) == 0
    assert capsys.readouterr().out.split() == ["n", "1"]
    assert main(["code", str(tmp_path / "src"), "helpOut", "--glob", "*.py"], spark) == 0


def test_tables(spark, capsys):
    assert main(["estate", "SELECT corpus, count(*) AS n FROM nodes GROUP BY corpus", "--limit", "2", *TABLES], spark) == 0
    assert "more" in capsys.readouterr().out
    assert main(["check", *TABLES], spark) == 1
    assert main(["hunt", "party.supplier.7"], spark) == 2


def test_journals_containers_generations_and_bridges(spark, tmp_path, capsys):
    from graphloom.plans import laned, pages, refresh, store

    base, home = str(tmp_path / "t"), ["--home", str(tmp_path / "t")]
    nodes = spark.createDataFrame([("a", 0, "a://k/x", False), ("b", 0, "b://k/y", False)], "lane string, seq int, id string, stub boolean")
    edges = spark.createDataFrame([("a", "a://k/x", "b://k/y", "calls")], "lane string, src string, dst string, edge_type string")
    schemes = spark.createDataFrame([("a", "a"), ("b", "b")], "scheme string, lane string")
    assert main(["generation", *home], spark) == 2
    told = refresh.rebuild(spark, base, [refresh.Lane("a"), refresh.Lane("b")], refresh.World(nodes, edges, schemes))
    assert main(["generation", *home], spark) == 0 and told["generation"] in capsys.readouterr().out
    assert main(["promote", "2.0", *home], spark) == 2
    box = ["container", "--home", told["home"], "--to", str(tmp_path / "c")]
    assert main([*box, "--defer", "a"], spark) == 0 and "pending" in capsys.readouterr().out
    assert main([*box, "--emit"], spark) == 0 and capsys.readouterr().out.count("fresh") == 2
    born = spark.createDataFrame([("node", "born", "a://k/x", None, None, None)], laned.CHANGES)
    pages.append(spark, base, "a", born, "c1", None)
    pages.append(spark, base, "a", born.limit(0), "c2", "c0")
    assert main(["journal", "log", *home], spark) == 0 and "c2" in capsys.readouterr().out
    assert main(["journal", "gaps", *home], spark) == 0 and main(["journal", "torn", *home], spark) == 1
    capsys.readouterr()
    assert main(["journal", "log", "--symbol", "k/x", *home], spark) == 0 and "c2" not in capsys.readouterr().out
    for side, rows in (("l", [("a://k/x", "lib://k/f", "calls")]), ("r", [("lib://k/f", "b://k/y", "calls")])):
        ids = sorted({i for r in rows for i in r[:2]})
        held = spark.createDataFrame([(i, "func", i[0]) for i in ids], "id string, node_type string, corpus string")
        store.compile_store(spark, str(tmp_path / side), held, spark.createDataFrame(rows, "src string, dst string, edge_type string"), [side])
    cross = ["bridge", "a://k/x", str(tmp_path / "r"), "--home", str(tmp_path / "l"), "--join", "lib"]
    assert main(cross, spark) == 0 and "b://k/y" in capsys.readouterr().out
    assert main([*cross, "--pins", "lib=1", "--other-pins", "lib=2"], spark) == 2
    assert main([*cross, "--pins", "lib=1", "--other-pins", "lib=2", "--allow-release-skew"], spark) == 0 and "true" in capsys.readouterr().out.lower()
    assert main(["traversals", "--seed", "a://k/x", "--home", str(tmp_path / "l")], spark) == 1
