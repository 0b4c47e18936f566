import json
import pytest

from graphloom.operators import resolve
from graphloom.sources import python_source as S

FILES = [
    ("pkg/__init__.py", "from .core import Base, make\n"),
    ("pkg/core.py", '"""Core."""\nimport os.path\nclass Base:\n    def run(self):\n        self.stop()\n    def stop(self):\n        pass\ndef make(base: Base, other: "Base"):\n    base.run()\n    other.run()\n    return os.path.join("a")\n'),
    ("pkg/use.py", "import pkg\nfrom pkg import Base as B, make\nimport json as j\nimport far.away\n@make\nclass Child(B):\n    def run(self):\n        super().run()\n        self.gone()\n        pkg.make()\n        j.dumps(make)\n        far.away.go()\n        len([])\n        B.stop()\n        pkg.nothing()\nmake()\n"),
    ("pkg/bad.py", "def ("),
    ("pkg/tests/test_x.py", None),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "path string, text string")


def test_records(spark, files):
    rows = S.records(files, "pkg").collect()
    nodes = {r["id"]: r for r in rows if r["kind"] == "node"}
    assert set(nodes) == {"pkg://module/pkg", "pkg://module/pkg.core", "pkg://class/pkg.core.Base", "pkg://method/pkg.core.Base.run", "pkg://method/pkg.core.Base.stop", "pkg://func/pkg.core.make", "pkg://module/pkg.use", "pkg://class/pkg.use.Child", "pkg://method/pkg.use.Child.run", "pkg://module/pkg.bad", "pkg://module/pkg.tests.test_x"}
    assert nodes["pkg://module/pkg.core"]["docstring"] == "Core." and nodes["pkg://module/pkg.tests.test_x"]["role"] == "test"
    assert nodes["pkg://func/pkg.core.make"]["args"] == ["base", "other"]
    assert [(r["src_repr"], r["dst"]) for r in rows if r["type"] == "decorates"] == [("make", "pkg://class/pkg.use.Child")]
    assert {(r["src"], r["dst_repr"]) for r in rows if r["type"] == "references"} == {("pkg://method/pkg.use.Child.run", "make")}
    assert {(r["at"], r["held"]) for r in rows if r["type"] == "imports" and r["src"] == "pkg://module/pkg"} == {("pkg.core", "Base"), ("pkg.core", "make")}


def test_hidden_names_are_no_references():
    text = "import a\nX = 1\ndef f(a):\n    def g():\n        X = 2\n        return X\n    return a, (lambda q: X)\n"
    assert [r["dst_repr"] for r in S.source_records("c", "m.py", text) if r["type"] == "references"] == ["X"]


def test_labels_bind_through_every_scope(spark, files):
    got = {(r["edge_type"], r["label"]): (r["src"] if r["edge_type"] == "decorates" else r["dst"], r["via"], r["why"]) for r in resolve.resolve(S.records(files, "pkg")).collect()}
    run, stop, make = "pkg://method/pkg.core.Base.run", "pkg://method/pkg.core.Base.stop", "pkg://func/pkg.core.make"
    assert got == {
        ("inherits", "B"): ("pkg://class/pkg.core.Base", "reexport", None),
        ("decorates", "make"): (make, "reexport", None),
        ("references", "make"): (make, "reexport", None),
        ("calls", "self.stop"): (stop, "self", None),
        ("calls", "base.run"): (run, "annotation", None),
        ("calls", "other.run"): (None, None, "unresolved"),
        ("calls", "os.path.join"): (None, None, "stdlib"),
        ("calls", "super(...).run"): (run, "super", None),
        ("calls", "super"): (None, None, "builtin"),
        ("calls", "self.gone"): (None, None, "unbound-attribute"),
        ("calls", "pkg.make"): (make, "reexport", None),
        ("calls", "j.dumps"): (None, None, "stdlib"),
        ("calls", "far.away.go"): (None, None, "unminted"),
        ("calls", "len"): (None, None, "builtin"),
        ("calls", "B.stop"): (stop, "reexport", None),
        ("calls", "pkg.nothing"): (None, None, "missing"),
    }


def test_mint_reuses_unchanged_files(spark, files):
    held = S.mint(files, "pkg").cache()
    marked = held.withColumn("role", S.F.when(S.F.col("path") == "pkg/core.py", "reused").otherwise(S.F.col("role")))
    changed = spark.createDataFrame([*FILES[:2], ("pkg/use.py", "def only(): pass\n")], "path string, text string")
    got = S.mint(changed, "pkg", marked)
    assert {r["path"] for r in got.filter("role = 'reused'").collect()} == {"pkg/core.py"}
    key = ["kind", "id", "type", "src", "dst", "dst_repr", "line", "path", "sha"]
    assert sorted(map(str, got.select(*key).collect())) == sorted(map(str, S.mint(changed, "pkg").select(*key).collect()))


def test_ring_closes_over_imports(spark):
    site = spark.createDataFrame([("a", "a/__init__.py", "import b\nimport os\nimport nowhere\n"), ("b", "b/__init__.py", "from c import x\n"), ("c", "c/__init__.py", "x = 1\n"), ("d", "d/__init__.py", "")], "package string, path string, text string")
    found, skipped = S.ring(site, "a")
    assert {r["package"] for r in found.collect()} == {"a", "b", "c"}
    assert {(r["scheme"], r["reason"]) for r in skipped.collect()} == {("os", "standard"), ("nowhere", "not held")}


def test_transcripts_of_three_shapes(spark, tmp_path):
    import json

    from graphloom.sources import shards

    rows = [
        {"type": "user", "message": {"content": "first <system-reminder>x</system-reminder>"}},
        {"type": "user", "isMeta": True, "message": {"content": "meta"}},
        {"type": "assistant", "message": {"content": [{"type": "text", "text": "one"}, {"type": "tool_use"}, {"type": "text", "text": "two"}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result"}, {"type": "text", "text": "result"}]}},
        {"type": "user", "toolUseResult": {}, "message": {"content": "tool"}},
        {"type": "queue-operation", "operation": "enqueue", "content": "later"},
        {"type": "assistant", "message": {"content": "three"}},
        {"type": "user", "message": {"content": "later"}},
        {"type": "queue-operation", "operation": "enqueue", "content": "/command"},
        {"type": "user", "message": {"content": "<command-name>x</command-name>"}},
        {"type": "progress", "message": {"content": "noise"}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "<user_instructions> no"}]}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "asked"}]}},
        {"type": "response_item", "payload": {"type": "message", "role": "developer", "content": [{"type": "input_text", "text": "no"}]}},
        {"type": "session_meta", "payload": {"type": "message", "role": "user"}},
        {"role": "user", "content": "plain"},
        {"role": "assistant", "content": [{"type": "text", "text": "answer"}]},
        {"role": "assistant", "content": [{"type": "tool_use"}, {"type": "text", "text": "no"}]},
        [1],
    ]
    (tmp_path / "t.jsonl").write_text("\n".join([*map(json.dumps, rows), '{"torn']))
    got = [(r["line"], r["role"], r["text"]) for r in shards.transcript(spark, str(tmp_path / "t.jsonl")).orderBy("line").collect()]
    want = [(0, "user", "first"), (2, "assistant", "one\ntwo"), (5, "user", "later"), (6, "assistant", "three"), (12, "user", "asked"), (15, "user", "plain"), (16, "assistant", "answer")]
    assert got == want


def test_queued_prompts_are_taken_once(spark):
    from graphloom.sources import shards

    ask = lambda op, text: {"type": "queue-operation", "operation": op, "content": text}
    say = lambda text: {"type": "user", "message": {"content": text}}
    rows = [say("a"), ask("enqueue", "a"), ask("enqueue", "a"), say("a"), ask("remove", "a"), say("a"), ask("remove", "b"), ask("enqueue", "b"), say("b"), say("b"), {"type": "assistant", "message": {"content": "a"}}, ask("enqueue", "<command-name>"), {"type": "user", "isSidechain": False, "toolUseResult": None, "message": {"content": "c"}}]
    lines = spark.createDataFrame([("f", i, json.dumps(r)) for i, r in enumerate(rows)] + [("g", 0, json.dumps(say("a")))], "file string, line long, value string")
    got = sorted((r["file"], r["line"], r["role"], r["text"]) for r in shards.transcript_turns(lines).collect())
    assert got == [("f", 0, "user", "a"), ("f", 1, "user", "a"), ("f", 2, "user", "a"), ("f", 5, "user", "a"), ("f", 7, "user", "b"), ("f", 9, "user", "b"), ("f", 10, "assistant", "a"), ("f", 12, "user", "c"), ("g", 0, "user", "a")]


def test_records_of_small_files_are_handed_over_together_and_parsed_on_all_cores(spark, monkeypatch):
    made, plain = [], S.pd.DataFrame

    def counted(rows, **more):
        made.append(len(rows))
        return plain(rows, **more)

    class Files:
        """Stands in for a frame, to run what it is given for Spark's workers here."""

        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            return list(run([plain({"path": [f"pkg/m{i}.py" for i in range(100)], "text": ["def f():\n    return g()\n"] * 100})] * 2))

    monkeypatch.setattr(S, "HANDED", 250)
    monkeypatch.setattr(S, "dealt", lambda files: files)
    monkeypatch.setattr(S.pd, "DataFrame", counted)
    frames = S.records(Files(), "pkg")
    assert sum(map(len, frames)) == 200 * 4 and max(made) < 254 and len(made) == 4
    monkeypatch.undo()
    files = spark.range(200).selectExpr("concat('pkg/m', id, '.py') AS path", "'def f(): pass' AS text").coalesce(1)
    assert S.dealt(files).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1
    assert S.records(files, "pkg").count() == 200 * 3
