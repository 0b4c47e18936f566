import datetime

from pyspark.sql import functions as F

from graphloom.operators import history as H
from graphloom.operators import text as T

NODES = "id string, node_type string, dotted string, file string"


def code(spark):
    return spark.createDataFrame([("c://module/app.cli", "module", "app.cli", "app/cli.py"), ("c://func/app.cli.run", "func", "app.cli.run", "app/cli.py"), ("c://func/app.web.run", "func", "app.web.run", None), ("c://func/app.cli.go", "func", "app.cli.go", None)], NODES)


def test_boxes(spark):
    text = "intro\n--- [1] USER\nhello\n--- [1] ASSISTANT\nyes\n--- [2] USER\nmore"
    files = spark.createDataFrame([("f", text), ("plain", "no marks"), ("empty", ""), ("none", None)], "file string, text string")
    got = [(r["file"], r["exchange"], r["text"]) for r in H.boxes(files).orderBy("file", "box").collect()]
    assert [g[:2] for g in got] == [("f", 0), ("f", 1), ("f", 2), ("plain", 0)]
    assert "hello" in got[1][2] and "yes" in got[1][2] and got[2][2] == "more"
    assert [(r["n"], r["speaker"]) for r in H.exchanges(files).filter("file = 'f'").orderBy("part").collect()] == [(None, None), (1, "user"), (1, "assistant"), (2, "user")]


def test_literals_bind_to_the_only_node_they_name(spark):
    rows = spark.createDataFrame([(1, "see cli.run and app.cli.go. in engine/app/cli.py, or cli.py; bare run stays. web.run x.y.z main entry"), (2, "main, the main.thing"), (3, None)], "k long, text string")
    mentions, verdicts = H.bind(rows, ["k"], code(spark), {"main": "c://func/app.cli.go", "main entry": "c://module/app.cli"})
    got = {(r["k"], r["node"]): (r["via"], r["count"], r["literal"]) for r in mentions.collect()}
    assert got == {
        (1, "c://func/app.cli.run"): ("dotted", 1, "cli.run"),
        (1, "c://func/app.cli.go"): ("dotted", 2, "app.cli.go"),
        (1, "c://module/app.cli"): ("file", 3, "cli.py"),
        (1, "c://func/app.web.run"): ("dotted", 1, "web.run"),
        (2, "c://func/app.cli.go"): ("alias", 1, "main"),
    }
    assert {r["literal"]: r["verdict"] for r in verdicts.collect() if r["verdict"] != "bound"} == {"x.y.z": "unbound", "main.thing": "unbound"}
    assert H.tally(mentions, verdicts).first().asDict() == {"mentions": 5, "aliased": 1, "literals": 7, "bound": 5, "ambiguous": 0}


def test_a_literal_of_two_nodes_binds_nothing(spark):
    nodes = spark.createDataFrame([("a", "func", "x.m.f", None), ("b", "func", "y.m.f", None)], NODES)
    mentions, verdicts = H.bind(spark.createDataFrame([(1, "m.f and x.m.f")], "k long, text string"), ["k"], nodes)
    assert [(r["node"], r["literal"]) for r in mentions.collect()] == [("a", "x.m.f")]
    assert {r["literal"]: r["verdict"] for r in verdicts.collect()} == {"m.f": "ambiguous", "x.m.f": "bound"}


def test_commits_fall_into_windows(spark):
    at = lambda d, h: datetime.datetime(2024, 1, d, h)
    captures = spark.createDataFrame([("s1", at(1, 10)), ("s2", at(4, 10)), ("s3", at(4, 12))], "session string, at timestamp")
    commits = spark.createDataFrame([(str(i), t) for i, t in enumerate((at(1, 9), at(1, 10), at(2, 5), at(4, 10), at(4, 11), at(5, 1)))], "commit string, at timestamp")
    assert {r["commit"]: r["session"] for r in H.authored(commits, captures).collect()} == {"2": "s2", "3": "s2", "4": "s3"}


def test_story_and_discussed(spark):
    edges = spark.createDataFrame([("s", "c1", "authored"), ("s", "c2", "authored"), ("c1", "i9", "names"), ("c2", "t", "records"), ("r", "i9", "pins")], "src string, dst string, edge_type string")
    sessions = spark.createDataFrame([("s", 1), ("s", 2), ("idle", 1)], "session string, at int")
    got = {r["session"]: tuple(r)[1:] for r in H.story(sessions, edges).collect()}
    assert got == {"s": (2, ["c1", "c2"], ["t"], ["i9"], ["r"]), "idle": (1, [], [], [], [])}
    contains = spark.createDataFrame([("s", "x1"), ("s", "x2")], "src string, dst string")
    mentions = spark.createDataFrame([("x1", "n"), ("x2", "n"), ("x2", "m")], "src string, dst string")
    assert {(r["session"], r["node"]): r["n"] for r in H.discussed(contains, mentions).collect()} == {("s", "n"): 2, ("s", "m"): 1}


def test_topic_forest(spark):
    terms = {"store": 4, "federated.store": 3, "federated.store.walk": 3, "store_page": 3, "rare.store": 1, "everywhere.x": 3}
    rows = [(t, f"s{i % 2}", i) for t, n in terms.items() for i in range(n)] + [("filler", f"t{i}", i) for i in range(3)] + [("everywhere.x", f"t{i}", i) for i in range(3)]
    index = spark.createDataFrame(rows, "term string, session string, box int")
    got = {r["term"]: (r["kind"], r["parent"], r["boxes"]) for r in H.topic_forest(index, "session", ["session", "box"], 3, 0.5, 2).collect()}
    assert got == {"store": ("anchor", None, 4), "federated.store": ("symbol", "store", 3), "federated.store.walk": ("symbol", "federated.store", 3), "store_page": ("symbol", "store", 3)}


def test_terms_of_texts_are_counted_without_postings(spark):
    rows = [("s", 1, "Store.walk store.walk-- the .. a-b"), ("s", 2, "store.walk. Zed-.- zed"), ("t", 2, "STORE.WALK only"), ("t", 3, "x---------- zed_q"), ("t", None, "zed"), (None, 4, "zed"), ("u", 5, None), ("u", 6, "")]
    texts = spark.createDataFrame(rows, "session string, box int, text string")
    index = T.postings(texts, ["session", "box"])
    want = {r["term"]: (r["boxes"], r["sessions"]) for r in index.groupBy("term").agg(F.count_distinct("box").alias("boxes"), F.count_distinct("session").alias("sessions")).collect()}
    for few in (10, 0):  # the shared box by broadcast and by shuffle
        found = T.counted_terms(texts, "session", ["box"], few=few)
        assert {r["term"]: (r["boxes"], r["sessions"]) for r in found.groupBy("term").agg(F.sum("n").alias("boxes"), F.count_distinct("session").alias("sessions")).collect()} == want
    assert want["store.walk"] == (2, 2) and want["zed"] == (2, 2)
    plan = T.counted_terms(texts.filter("box <> 2"), "session", ["box"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not any("box" in line for line in plan.split("\n") if "Exchange" in line)
    forest = lambda live: sorted(map(str, H.forest(live, 1).collect()))
    assert forest(H.live_terms(T.counted_terms(texts, "session", ["box"]), "session", 1, 0.7)) == sorted(map(str, H.topic_forest(index, "session", ["box"], 1, 0.7, 1).collect()))


def test_history_is_minted(spark):
    at = lambda d: datetime.datetime(2024, 1, d)
    sessions = spark.createDataFrame([("aaaa1111", at(1), "f1"), ("bbbb2222", at(3), "f2")], "session string, at timestamp, file string")
    files = spark.createDataFrame([("f2", "--- [1] USER\nlook at cli.run\n--- [1] ASSISTANT\ndone")], "file string, text string")
    commits = spark.createDataFrame([("c0ffee0", at(2), "fix #7", "see §1 and §9", ["engine/app/cli.py"]), ("c0ffee1", at(4), "late", None, None)], "sha string, at timestamp, subject string, body string, files array<string>")
    sections = spark.createDataFrame([(1, "first (#8)"), (2, "second")], "number long, title string")
    receipts = spark.createDataFrame([("r7", 7, at(2)), ("r0", None, at(2))], "name string, issue long, at timestamp")
    nodes, edges = H.mint(sessions, files, commits, sections, receipts, code(spark))
    h = "history://"
    assert {(r["src"].removeprefix(h), r["dst"].removeprefix(h), r["edge_type"]) for r in edges.collect()} == {
        ("session/aaaa1111", "session/bbbb2222", "follows"),
        ("commit/c0ffee0", "commit/c0ffee1", "follows"),
        ("section/1", "section/2", "follows"),
        ("session/bbbb2222", "exchange/bbbb2222/1/user", "contains"),
        ("session/bbbb2222", "exchange/bbbb2222/1/assistant", "contains"),
        ("exchange/bbbb2222/1/user", "c://func/app.cli.run", "mentions"),
        ("session/bbbb2222", "commit/c0ffee0", "authored"),
        ("commit/c0ffee0", "section/1", "records"),
        ("commit/c0ffee0", "issue/7", "names"),
        ("section/1", "issue/8", "names"),
        ("commit/c0ffee0", "c://module/app.cli", "touches"),
        ("receipt/r7", "issue/7", "pins"),
    }
    assert nodes.groupBy("node_type").count().count() == 6 and nodes.count() == 12
