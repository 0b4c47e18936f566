import json

import pytest

from graphloom.operators import federation
from graphloom.operators.lookup import Refused
from graphloom.plans import index as I


def pushed(spark, folder, shard, files):
    rows = [(shard, name, bytearray(text if isinstance(text, bytes) else json.dumps(text).encode())) for name, text in files.items()]
    federation.push(spark.createDataFrame(rows, "shard string, file string, content binary"), folder)


def test_index_estate_follows_the_catalogue(spark, tmp_path):
    folder = str(tmp_path / "index")
    with pytest.raises(Refused, match="no index"):
        I.emit_index(spark, folder)
    node = lambda i: {"id": i, "node_type": "func"}
    pushed(spark, folder, "p==1.0", {"nodes.json": {"p://k/a": node("p://k/a")}, "edges.json": [{"src": "p://k/a", "dst": "q://k/b", "edge_type": "calls"}]})
    pushed(spark, folder, "q", {"nodes.json": [node("q://k/b"), {"node_type": "func"}], "edges.json": [], "PROVENANCE.json": {"corpus": {"scheme": "qq", "version": "2"}}})
    with pytest.raises(Refused, match="absent"):
        I.open_index(spark, folder)
    assert I.emit_index(spark, folder) == I.emit_index(spark, folder) == {"nodes": "fresh", "adj": "fresh"}
    I.open_index(spark, folder)
    assert sorted(map(tuple, spark.sql("SELECT index_name, corpus, version, id FROM nodes").collect())) == [("p==1.0", "p", "1.0", "p://k/a"), ("q", "qq", "2", "q://k/b")]
    assert [tuple(r) for r in spark.sql("SELECT a.src, n.corpus FROM adj a JOIN nodes n ON a.dst = n.id").collect()] == [("p://k/a", "qq")]
    pushed(spark, folder, "q", {"nodes.json": [node("q://k/c")], "edges.json": []})
    with pytest.raises(Refused, match="stale"):
        I.open_index(spark, folder)
    I.emit_index(spark, folder)
    I.open_index(spark, folder)
    assert {r[0] for r in spark.sql("SELECT id FROM nodes").collect()} == {"p://k/a", "q://k/c"}
    pushed(spark, folder, "r", {"nodes.json": b"{torn", "edges.json": []})
    with pytest.raises(Refused, match="'r'"):
        I.emit_index(spark, folder)
