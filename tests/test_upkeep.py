"""Journals, their streams, containers, rebuilds, bridges, overlap and freshness, each on small cases worked out by hand."""

import json
import random
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom.operators import bridges, journal, overlap
from graphloom.operators.lookup import Refused
from graphloom.plans import claims, containers, laned, pages, refresh
from graphloom.sources import freshness
from graphloom.streaming import running

NODES = "lane string, seq int, id string, stub boolean"
EDGES = "lane string, src string, dst string, edge_type string"


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


# ---- journals ----------------------------------------------------------------------------------------------------------


def moved(spark, born=(), died=(), edges=()):
    rows = [("node", "born", i, None, None, None) for i in born] + [("node", "died", i, None, None, None) for i in died] + [("edge", change, None, *e) for change, e in edges]
    return spark.createDataFrame(rows, laned.CHANGES)


def test_pages_are_numbered_marked_and_bounded(spark, tmp_path, monkeypatch):
    home = str(tmp_path)
    assert pages.tail(spark, home, "j") == (0, None)
    first = pages.append(spark, home, "j", moved(spark, ["b", "a"]), "0123456789abcdef", None, bootstrap=True)
    assert (first["seq"], first["cursor"], first["n_born"], first["truncated"]) == (1, "01234567", 2, False) and "born" not in first
    monkeypatch.setattr(pages, "NODE_CAP", 2)
    second = pages.append(spark, home, "j", moved(spark, ["d", "c", "e"], ["a"], [("born", ("x", "y", "t"))]), "two", "0123456789abcdef")
    assert second["born"] == ["c", "d"] and second["n_born"] == 3 and second["truncated"] and second["died"] == ["a"] and "gap_after_seq" not in second
    assert second["eborn"] == [{"src": "x", "edge_type": "t", "dst": "y"}]
    third = pages.append(spark, home, "j", moved(spark), "three", "elsewhere")
    assert third["seq"] == 3 and third["gap_after_seq"] == 2
    assert pages.append(spark, home, "other", moved(spark), "x", None)["seq"] == 1
    held = pages.read(spark, home, "j")
    assert [r["seq"] for r in held.orderBy("seq").collect()] == [1, 2, 3] and pages.read(spark, home).count() == 4
    assert [r["seq"] for r in journal.gaps(held).collect()] == [3]
    assert [r["seq"] for r in journal.events(held, "d").collect()] == [2]


def test_concurrent_appends_share_no_number_and_a_token_is_appended_once(spark, tmp_path):
    home = str(tmp_path)
    with ThreadPoolExecutor(6) as pool:
        seqs = list(pool.map(lambda i: pages.append(spark, home, "j", moved(spark), f"c{i}", None)["seq"], range(12)))
    assert sorted(seqs) == list(range(1, 13))
    sent = [pages.append(spark, home, "k", moved(spark, ["a"]), "c", None, token="t1") for _ in range(3)]
    assert {p["seq"] for p in sent} == {1} and pages.append(spark, home, "k", moved(spark), "d", "c", token="t2")["seq"] == 2
    assert pages.torn(spark, home).count() == 0


@pytest.mark.parametrize(("name", "text", "why"), [("000000000003.json", "{torn", "not a page"), ("000000000003.json", '{"seq": 9}', "numbered otherwise"), ("000000000004.json", '{"seq": 4}', "missing")])
def test_a_torn_journal_refuses(spark, tmp_path, name, text, why):
    home = str(tmp_path)
    for cursor in ("a", "b"):
        pages.append(spark, home, "j", moved(spark), cursor, None)
    pages.append(spark, home, "whole", moved(spark), "c", None)
    (tmp_path / "journals/j" / name).write_text(text)
    assert [tuple(r) for r in pages.torn(spark, home).collect()] == [("j", int(name[:12]), why)]
    with pytest.raises(Refused, match=f"torn at {int(name[:12])}: {why}"):
        pages.read(spark, home)
    assert pages.read(spark, home, "whole").count() == 1 and pages.read(spark, home, "j", allow_torn=True).count() >= 2


def test_changes_between_snapshots_name_edges_without_a_target(spark):
    cols = "src string, edge_type string, dst string, dst_repr string, name string"
    before = spark.createDataFrame([("a", "t", "b", None, None), ("a", "t", None, "r", "n")], cols)
    after = spark.createDataFrame([("a", "t", "b", "x", None), ("a", "t", "b", "x", None), ("a", "t", None, None, "n")], cols)
    nodes = [spark.createDataFrame([(i,) for i in ids], "id string") for ids in ("ab", "bc")]
    got = {(r["kind"], r["change"], r["id"] or r["dst"]) for r in pages.changes_between(*nodes, before, after).collect()}
    assert got == {("node", "born", "c"), ("node", "died", "a"), ("edge", "born", "~name:n"), ("edge", "died", "~dst_repr:r")}


def test_a_journal_follows_the_updates_of_a_store(spark, tmp_path):
    home = str(tmp_path)
    schemes = spark.createDataFrame([("a", "a"), ("b", "b")], "scheme string, lane string")
    edges = spark.createDataFrame([("a", "a://k/x", "b://k/z", "calls"), ("b", "b://k/z", "a://k/y", "calls")], EDGES)
    for ids in (("x", "y"), ("x", "w")):
        nodes = spark.createDataFrame([*(("a", 0, f"a://k/{i}", False) for i in ids), ("b", 0, "b://k/z", False)], NODES)
        told = laned.compile_lanes(spark, home, nodes, edges, schemes, ["a", "b"])
        held = laned.open_laned(spark, home)
        pages.append(spark, home, "store", held.changes(), held.generation, pages.tail(spark, home, "store")[1], bootstrap=told["recompiled"] == "all", token=held.generation)
    last = pages.read(spark, home, "store").orderBy(F.col("seq").desc()).first()
    assert (last["seq"], last["born"], last["died"], last["gap_after_seq"]) == (2, ["a://k/w"], ["a://k/y"], None)
    assert [tuple(e) for e in last["edied"]] == [("b://k/z", "calls", "a://k/y")] and last["eborn"] is None


# ---- streams -----------------------------------------------------------------------------------------------------------

SCHEMA = "journal string, seq long, ts timestamp, cursor string, prev_cursor string, bootstrap boolean, n_born long, n_died long"


def page(journal_, seq, born, died, cursor="c", previous="c", bootstrap=False, minute=None):
    return {"journal": journal_, "seq": seq, "ts": f"2024-01-01T00:{seq if minute is None else minute:02d}:00Z", "cursor": cursor, "prev_cursor": previous, "bootstrap": bootstrap, "n_born": born, "n_died": died}


def stream(spark, tmp_path, files, **how):
    (tmp_path / "pages").mkdir()
    import os

    for i, rows in enumerate(files):
        path = tmp_path / f"pages/{i}.json"
        path.write_text("\n".join(map(json.dumps, rows)))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))  # the order in which files are taken up
    got = running.marks_of(spark, str(tmp_path / "pages"), str(tmp_path / "work"), SCHEMA, **how)
    return sorted((r["journal"], r["seq"], r["mark"], r["before"]) for r in got.collect())


def test_stream_marks_equal_those_of_the_table_whatever_the_order(spark, tmp_path):
    rows = [page("a", 1, 3, 0, "x", None, True), page("a", 2, 0, 3, "y", "x"), page("a", 3, 2, 0, "z", "w"), page("a", 4, 0, 2, "q", "z"), page("b", 1, 1, 0, "x", None, True), page("b", 2, 0, 2, "y", "x"), page("b", 3, 1, 0, "z", "y"), page("b", 4, 5, 0, "u", "z", True), page("b", 5, 0, 5, "v", "t")]
    files = [[rows[3], rows[5]], [rows[1], rows[8], rows[0]], [rows[0], rows[4], rows[7]], [rows[2], rows[6], rows[3]]]
    got = stream(spark, tmp_path, files, late="10 days")
    table = spark.read.schema(SCHEMA).json(spark.sparkContext.parallelize(map(json.dumps, rows)))
    want = [(r["journal"], r["seq"], "death", r["before"]) for r in journal.deaths(table).collect()] + [(r["journal"], r["seq"], "gap", None) for r in journal.gaps(table).collect()]
    assert got == sorted(want, key=str) or sorted(map(str, got)) == sorted(map(str, want))
    assert ("a", 2, "death", 3) in got and ("b", 5, "death", 5) in got and ("a", 3, "gap", None) in got and len([g for g in got if g[0] == "b" and g[2] == "death"]) == 1


def test_pages_taken_up_together_leave_what_pages_one_by_one_do():
    rng, at, want, found, waits = random.Random(7), None, [], [], None
    for size in (1, 40, 3, 200):
        low = at[0] if at else 0
        rows = [(low + 1 + i, 10**15, rng.choice(["a", "b", None]), rng.choice(["a", "b", None]), rng.random() < 0.1, rng.randrange(3), rng.randrange(3)) for i in range(size)]
        pages = pd.DataFrame(rows, columns=[*running.WAITS])
        after, marks = running._taken("j", pages, at)
        _, expected, alive, least = at or (None, None, None, 0)
        for seq, _, cursor, previous, bootstrap, born, died in rows:
            if expected is not None and previous != expected:
                want.append((seq, "gap", None, expected, previous))
            now, before = (born - died if bootstrap or alive is None else alive + born - died), alive
            least = now if bootstrap or alive is None else min(least, now)
            if not bootstrap and before is not None and now == 0 and before > 0 and least >= 0:
                want.append((seq, "death", before, None, None))
            alive, expected = now, cursor
        assert after == (rows[-1][0], expected, alive, least)
        found += [(r.seq, r.mark, None if pd.isna(r.before) else int(r.before), r.expected, r.prev_cursor) for r in marks.itertuples()]
        at, waits = after, pages
    assert sorted(map(str, found)) == sorted(map(str, want)) and {"gap", "death"} == {w[1] for w in want}
    packed = running._packed(pd.concat([waits] * 200))
    assert len(packed) == 2  # 40,000 pages in two rows of state
    back = running.pa.ipc.open_stream(packed[0][0]).read_pandas()
    assert [tuple(None if pd.isna(x) else x for x in r) for r in back[:200].itertuples(index=False)] == rows


def test_a_page_that_never_comes_holds_up_the_rest_no_longer_than_lateness(spark, tmp_path):
    files = [[page("a", 1, 2, 0, "x", None, True)], [page("a", 3, 0, 2, "z", "y")], [page("b", 1, 1, 0, "x", None, True, minute=50)], [page("b", 2, 1, 0, "y", "x", minute=55)]]
    got = stream(spark, tmp_path, files, late="5 minutes")
    assert ("a", 3, "death", 2) in got and ("a", 3, "gap", None) in got


def test_running_windows_take_a_hundred_thousand_points_of_one_key(spark):
    points = spark.range(100_000).select(F.lit("u").alias("k"), F.col("id").alias("point_id"), (F.col("id") * 2 + 1).alias("t"))
    captures = spark.range(0, 200_000, 1_000).select(F.lit("u").alias("k"), F.col("id").alias("t"))
    found = journal.in_window(points, captures, "k", "t")
    assert found.count() == 99_500 and found.filter("high <> (2 * point_id + 1) DIV 1000 * 1000 + 1000").count() == 0
    since = journal.as_of(points.withColumnRenamed("point_id", "row"), captures, "k", "t")
    assert since.filter("since <> t - t % 1000").count() == 0 and since.count() == 100_000


# ---- containers, rebuilds and refreshes --------------------------------------------------------------------------------

ROSTER = ["a", "b", "c"]


def world(spark, drop=(), lanes=ROSTER):
    nodes = [(lane, i, f"{lane}://k/n{i}", False) for lane in lanes for i in range(4) if f"{lane}{i}" not in drop]
    edges = [(lane, f"{lane}://k/n{i}", f"{to}://k/n{i}", "calls") for lane, to in zip(lanes, [*lanes[1:], lanes[0]], strict=True) for i in range(4) if f"{lane}{i}" not in drop]
    return refresh.World(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame([(x, x) for x in lanes], "scheme string, lane string"))


def test_container_states_and_one_job_for_all_that_is_not_fresh(spark, tmp_path):
    home, (nodes, edges, _) = str(tmp_path), world(spark)
    inputs = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "lane string, digest string")
    state = lambda i=inputs: {r["lane"]: r["state"] for r in containers.states(spark, home, i).collect()}
    assert state() == dict.fromkeys("abc", "absent")
    with pytest.raises(Refused, match="'c' has no shard"):
        containers.emit(spark, home, inputs, nodes, edges, ["c"])
    containers.emit(spark, home, inputs, nodes, edges, ["a"])
    containers.defer(spark, home, ["b"])
    assert state() == {"a": "fresh", "b": "pending", "c": "absent"}
    with pytest.raises(Refused, match="isn't written"):
        containers.rows(spark, home, "b", "nodes")
    later = spark.createDataFrame([("a", "2"), ("b", "1"), ("c", None)], "lane string, digest string")
    assert state(later)["a"] == "stale"
    assert containers.emit_missing(spark, home, later, nodes, edges) == (["a", "b"], 0) and state(later) == {"a": "fresh", "b": "fresh", "c": "absent"}
    assert containers.emit_missing(spark, home, later, nodes, edges) == ([], 2)
    assert rows_of(containers.rows(spark, home, "b", "adjacency")) == rows_of(edges.filter("lane = 'b'"))
    containers.defer(spark, home, ["a"])
    assert state(later)["a"] == "pending"


def test_rebuilds_refuse_before_anything_is_staged(spark, tmp_path):
    base, w = str(tmp_path / "t"), world(spark)
    for lanes, why in (([], "no lanes"), ([refresh.Lane("a"), refresh.Lane("a")], "twice: a"), ([refresh.Lane("a", True)], "every lane is placed"), ([refresh.Lane("a"), refresh.Lane("zz", True)], "without a shard: zz")):
        with pytest.raises(Refused, match=why):
            refresh.rebuild(spark, base, lanes, w)
    assert not (tmp_path / "t").exists() and refresh.serving(spark, base) is None


def test_a_failing_stage_leaves_the_served_generation(spark, tmp_path):
    base, lanes = str(tmp_path / "t"), [refresh.Lane("a"), refresh.Lane("b", placed=True)]
    told = refresh.rebuild(spark, base, lanes, world(spark))
    assert told["added"] == ["c"] and told["lanes"] == ["a", "b", "c"] and told["placed"] == ["b"]
    served = refresh.serving(spark, base)
    red = lambda held: spark.createDataFrame([("endpoints", "a: 1", "RED"), ("x", "y", "NOTE")], "check string, subject string, level string")
    with pytest.raises(refresh.CheckFailed, match="endpoints: a: 1"):
        refresh.rebuild(spark, base, lanes, world(spark, {"a1"}), red)

    def fails(held):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        refresh.rebuild(spark, base, lanes, world(spark, {"a1"}), fails)
    assert refresh.serving(spark, base) == served and [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("stage")] == [served.rsplit("/", 1)[1]]
    assert laned.open_laned(spark, served).nodes.count() == 12
    again = refresh.rebuild(spark, base, lanes, world(spark, {"a1"}), lambda held: red(held).filter("level = 'NOTE'"))
    assert again["number"] == 2 and laned.open_laned(spark, refresh.serving(spark, base)).nodes.count() == 11


def test_refresh_verdicts(spark, tmp_path):
    base = str(tmp_path / "t")
    refresh.rebuild(spark, base, [refresh.Lane(x) for x in ROSTER], world(spark))
    served, build = refresh.serving(spark, base), lambda: (world(spark, {"b2"}), ROSTER)
    go = lambda release, **how: refresh.refresh(spark, base, "1.2", release, build, **how)
    assert [go(r)["verdict"] for r in ("1.2", "1.2.0", "1.1", "1.2rc1", "junk")] == ["CURRENT"] * 5
    assert go("1.10", check_only=True)["verdict"] == "NEWER" and not (tmp_path / "t.1.10").exists()
    told = go("1.10")
    assert told["verdict"] == "OK" and [(d["lane"], d["born"], d["died"], d["edied"]) for d in told["diff"]] == [("b", 0, 1, 1)]
    assert refresh.serving(spark, base) == served  # proved, and not served
    with pytest.raises(Refused, match="exists"):
        go("1.10")
    red = lambda held: spark.createDataFrame([("x", "y", "RED")], "check string, subject string, level string")
    with pytest.raises(refresh.CheckFailed):
        go("1.10", force=True, check=red)
    assert json.loads(claims.read(spark, f"{base}.1.10/refresh.json"))["verdict"] == "CHECK FAILED"
    with pytest.raises(Refused, match="isn't proved"):
        refresh.promote(spark, base, "1.10")
    assert go("1.10", force=True)["verdict"] == "OK" and refresh.promote(spark, base, "1.10")["number"] == 2
    assert refresh.serving(spark, base) == f"{base}.1.10"
    with pytest.raises(Refused, match="would be what is served"):
        go("1.10", force=True)


def test_newest_release(spark):
    releases = spark.createDataFrame([("1.9", False), ("1.10", None), ("1.11", True), ("2.0rc1", False), ("junk", False)], "version string, yanked boolean")
    assert refresh.newest(releases) == "1.10" and refresh.newest(releases.filter("version = 'junk'")) is None


# ---- bridges -----------------------------------------------------------------------------------------------------------


def test_bridges_cross_only_where_releases_agree_or_skew_is_allowed(spark):
    left = spark.createDataFrame([("a://k/x",), ("lib://k/f",), ("both://k/g",)], "id string"), spark.createDataFrame([("a://k/x", "lib://k/f", "calls"), ("a://k/x", "both://k/g", "calls")], "src string, dst string, edge_type string")
    right = spark.createDataFrame([("b://k/y",), ("lib://k/f",), ("both://k/g",)], "id string"), spark.createDataFrame([("lib://k/f", "b://k/y", "calls"), ("both://k/g", "b://k/z", "calls")], "src string, dst string, edge_type string")
    sides = {"l": left, "r": right}
    pins = spark.createDataFrame([("l", "lib", "1.0"), ("r", "lib", "1.1"), ("l", "both", "2"), ("r", "both", None)], "side string, scheme string, version string")
    seeds = spark.createDataFrame([("l|a://k/x",)], "seed string")
    with pytest.raises(Refused, match="lib is pinned to different releases: l 1.0, r 1.1"):
        bridges.cross(sides, pins, ["lib"], seeds)
    for schemes, why in (([], "no scheme"), (["lib://"], "is no scheme"), (["zz"], "no node of zz:// in l, r"), (["a"], "in r")):
        with pytest.raises(Refused, match=why):
            bridges.cross(sides, pins, schemes, seeds)
    found = {r["node"]: (r["hop"], r["skew"]) for r in bridges.cross(sides, pins, ["lib", "both"], seeds, allow_skew=True).collect()}
    assert found["r|b://k/y"] == (3, True) and found["r|b://k/z"] == (3, False) and found["l|lib://k/f"] == (1, False) and found["r|lib://k/f"] == (2, True)
    told = {(r["scheme"], r["side"]): (r["nodes"], r["release"], r["skew"]) for r in bridges.joins({"l": left[0], "r": right[0]}, pins, ["lib", "both"]).collect()}
    assert told == {("lib", "l"): (1, "1.0", True), ("lib", "r"): (1, "1.1", True), ("both", "l"): (1, "2", False), ("both", "r"): (1, bridges.UNPINNED, False)}


# ---- overlap -----------------------------------------------------------------------------------------------------------


def test_a_walk_toward_a_side_finds_all_of_it_and_leaves_neighbours_at_home_alone(spark):
    from graphloom.operators import traverse

    home = [(f"a://p/{i}", f"geo://n/{i % 2}", "in") for i in range(40)]
    far = [("geo://n/0", "geo://r/0", "within"), ("geo://n/1", "geo://r/0", "within"), ("geo://r/0", "geo://w/0", "within")]
    sides = {x: spark.createDataFrame(e, "src string, dst string, edge_type string") for x, e in (("home", home), ("far", far))}
    seeds = spark.createDataFrame([(f"home|a://p/{i}",) for i in range(0, 40, 3)], "seed string")
    for depth in (2, 3, 5):
        whole = traverse.bridge(sides, seeds, ["geo"], depth).collect()
        found = traverse.bridge(sides, seeds, ["geo"], depth, toward="far").collect()
        there = lambda rows: sorted((r for r in rows if r["node"].startswith("far|")), key=str)
        assert there(found) == there(whole) and there(found)
    assert len([r for r in traverse.bridge(sides, seeds, ["geo"], 3, toward="far").collect() if r["node"].startswith("home|")]) == 2 * seeds.count()


def test_overlap_of_many_terms_against_plain_sets(spark):
    import random

    rng = random.Random(6)
    boxes = {(f"s{i % 9}", i): {f"t{rng.randint(0, 30)}" for _ in range(rng.randint(0, 9))} for i in range(400)}
    for i in range(30):
        boxes["rare", i] = {"t0", "only"}
    index = spark.createDataFrame([(t, s, b, 1 + b % 3) for (s, b), held in boxes.items() for t in held], "term string, session string, box_id int, n int")
    key, wanted = ["session", "box_id"], [f"t{i}" for i in range(6)] + ["only", "nowhere"]
    holds = {t: {k for k, held in boxes.items() if t in held} for t in wanted}
    got = {(r["term"], r["other"]): (r["shared"], r["own"], r["contained"]) for r in overlap.overlap(index, key, wanted).collect()}
    assert got == {(a, b): (len(holds[a] & holds[b]), len(holds[a]), len(holds[a] & holds[b]) >= 0.999 * len(holds[a]) and len(holds[a] & holds[b]) < 0.999 * len(holds[b])) for a in wanted for b in wanted if a != b and holds[a] & holds[b]}
    assert got["only", "t0"][2] and not got["t0", "only"][2]
    numbers = overlap.numbered(index, key)
    assert sorted(r["box"] for r in numbers.collect()) == list(range(len([k for k, v in boxes.items() if v])))
    for asked in (["t1", "t2"], ["t0", "only"], ["t3"], ["t1", "nowhere"]):
        every, some = set.intersection(*(holds[t] for t in asked)), set.union(*(holds[t] for t in asked))
        want = (len(every), len(some))
        row = overlap.joint(index, key, asked).first()
        assert (row["joint"], row["any"], row["joint_sessions"], row["any_sessions"]) == (*want, len({s for s, _ in every}), len({s for s, _ in some}))
        assert tuple(overlap.joint_count(overlap.bitmaps(index, numbers, key, asked), asked).first()) == want
    fans = overlap.fan_out(index, key, ["t1", "t2"], 5).collect()
    both = holds["t1"] | holds["t2"]
    counts = Counter(t for k in both for t in boxes[k] if t not in ("t1", "t2"))
    assert [(r["overlap"], r["term"]) for r in fans] == sorted(((n, t) for t, n in counts.items()), reverse=True)[:5]
    first = {k for k in holds["t1"] if fans[0]["term"] in boxes[k]}
    assert fans[0]["percents"]["t1"] == pytest.approx(100 * len(first) / len(holds["t1"]), abs=1e-5)
    with pytest.raises(Refused):
        overlap.joint(index, key, [])


def test_footprints_are_grouped_by_file_and_block(spark):
    hits = spark.createDataFrame([("t", "f", "b", 7), ("t", "f", "b", 3), ("t", "f", None, 1), ("u", "f", "b", 9)], "term string, file string, block string, line int")
    assert {tuple(r) for r in overlap.footprint(hits).collect()} == {("t", "f", "b", 2, 3), ("t", "f", "<module>", 1, 1), ("u", "f", "b", 1, 9)}


# ---- freshness ---------------------------------------------------------------------------------------------------------


def test_a_byte_that_changes_at_the_same_size_and_time_turns_the_check_red(spark, tmp_path):
    import os

    folders = {}
    for lane in ("a", "b", "c"):
        (tmp_path / lane).mkdir()
        folders[lane] = str(tmp_path / lane)
        for name in ("nodes.json", "edges.json"):
            (tmp_path / lane / name).write_text(f"[{lane}]")
    (tmp_path / "c/edges.json").unlink()
    first = {r["lane"]: r["digest"] for r in freshness.lane_digests(spark, folders).collect()}
    assert len(first["a"]) == 16 and first["a"] != first["b"] and first["c"] is None
    served = spark.createDataFrame(list(first.items()), "lane string, digest string")
    assert freshness.moved(served, freshness.lane_digests(spark, folders)).filter("level = 'RED'").count() == 0
    path = tmp_path / "a/nodes.json"
    stamp = path.stat()
    path.write_text("[x]")
    os.utime(path, ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    (tmp_path / "b/wormholes.json").write_text("")
    got = {(r["subject"], r["level"]) for r in freshness.moved(served, freshness.lane_digests(spark, folders)).collect()}
    assert got == {("a: its shard moved", "RED"), ("b: its shard moved", "RED"), ("c: no shard", "COULD-NOT-TELL")}


def test_drift_staleness_and_bare_windows(spark):
    told = spark.createDataFrame([("j", 1, "a"), ("j", 2, "b"), ("k", 1, "c"), ("l", 1, "d")], "journal string, seq long, cursor string")
    heads = spark.createDataFrame([("j", "b"), ("k", "x"), ("m", "y")], "journal string, cursor string")
    assert {(r["subject"], r["level"]) for r in freshness.drifted(told, heads).collect()} == {("k: c is not x", "RED"), ("l: d is not none", "COULD-NOT-TELL"), ("m: none is not y", "COULD-NOT-TELL")}
    built = spark.createDataFrame([("a", 100), ("b", 100), ("c", 100)], "lane string, t long").select("lane", F.timestamp_seconds("t").alias("ts"))
    changed = spark.createDataFrame([("a", 90), ("b", 90), ("b", 130)], "lane string, t long").select("lane", F.timestamp_seconds("t").alias("ts"))
    assert {r["lane"]: (r["behind"], r["stale"]) for r in freshness.staleness(built, changed).collect()} == {"a": (0, False), "b": (30, True), "c": (None, False)}
    commits = spark.createDataFrame([("j", 1), ("j", 25)], "journal string, ts long")
    windows = spark.createDataFrame([("j", 1, 10), ("j", 2, 20), ("j", 3, 30)], "journal string, seq long, high long")
    assert [tuple(r) for r in freshness.history_gaps(commits, windows).collect()] == [("history", "j#2", "COULD-NOT-TELL")]


# ---- weak spots of earlier operators -----------------------------------------------------------------------------------


def test_routes_and_their_patterns(spark):
    import re

    from graphloom.functions import columns as C

    urls = ["/a/12/b?q=1", "/u/x%40y.z/1f0e2d3c-0000-1111-2222-333344445555", "https://h.x/me@there/", "https://h.x", "", "/a//b#c"]
    got = [r[0] for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(C.route(F.col("u"))).collect()]
    assert got == ["/a/{}/b", "/u/{}/{}", "/{}/", "/", "/", "/a//b"]
    pattern = re.compile(C.route_pattern("/a/{}/b"))
    assert pattern.search('GET "/a/77/b" 200') and not pattern.search("/a/77/bc") and not pattern.search("/a/7/7/b")


def test_access_lines_with_a_time_in_front(spark):
    from graphloom.sources import shards

    lines = ['2024-05-06 07:08:09,250 x "GET /a/1 HTTP/1.1" 200 3 12.5 ms', '"POST /b HTTP/1.1" 500', "noise"]
    rows = shards.access_log(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(str(r["timestamp"]), r["method"], r["route"], r["status"], r["latency_ms"]) for r in rows] == [("2024-05-06 07:08:09.250000", "GET", "/a/{}", 200, 12.5), ("None", "POST", "/b", 500, None)]


def test_residuals_say_why_and_edges_may_stand_in_an_object(spark):
    from graphloom.sources import shards

    text = spark.createDataFrame([(json.dumps({"k1": {"src": "a", "dst": "b", "edge_type": "t"}, "k2": {"src": "a", "edge_type": "t"}, "k3": {"from": "a", "to": "b"}, "k4": {"dst": "b", "relation": "t"}}),)], "value string")
    assert sorted(str(r["reason"]) for r in shards.edges_in(text).collect()) == ["None", "no source", "no target", "no type"]
    nodes = shards.nodes_in(spark.createDataFrame([(json.dumps([{"id": "a"}, {"node_type": "t"}, {"id": "a", "node_type": "t"}]),)], "value string"))
    assert sorted(str(r["reason"]) for r in nodes.collect()) == ["None", "no id", "no type"]
    log = spark.createDataFrame([("a", "b", "t", False), ("a", "c", "t", False), (None, "c", "t", True)], "from string, to string, relation string, malformed boolean")
    assert [r["to"] for r in shards.orphans(log, spark.createDataFrame([("a", "b", "t")], "src string, dst string, edge_type string")).collect()] == ["c"]


def test_moves_tell_kept_metrics_first_and_nothing_that_stood(spark):
    rows = [("s", d, m, v) for m, (a, b) in {"floor.seconds": (10.0, 10.1), "x.big": (1.0, 9.0), "x.zero": (0.0, 3.0), "x.same": (2.0, 2.0), "job.rc": (0.0, 1.0), "x.rss": (1.0, 5.0), "floor.rss_kb": (5.0, 6.0), "x.a": (4.0, 5.0), "x.b": (4.0, 4.5)}.items() for d, v in ((1, a), (2, b))]
    found = journal.moves(spark.createDataFrame(rows, "series string, at int, metric string, value double"), "series", "at")
    assert [r["metric"] for r in found.orderBy("rank").collect()] == ["floor.rss_kb", "floor.seconds", "x.big", "x.zero"]


def test_admission_stats_and_seams_of_lanes(spark):
    from graphloom.operators import mesh

    edges = spark.createDataFrame([("a", "a://k/x", "b://k/y", "t"), ("a", "a://k/x", "b://k/y", "t"), ("a", "a://k/x", None, "t"), ("a", "a://k/x", "b://k/gone", "t"), ("b", "b://k/y", "b://k/y2", "t"), ("b", "a://k/x", "a://k/x2", "u")], EDGES)
    held = spark.createDataFrame([("a://k/x", "a"), ("b://k/y", "b"), ("b://k/y2", "b"), ("a://k/x2", "a")], "id string, lane string")
    owners, schemes = held.withColumnRenamed("lane", "owner"), spark.createDataFrame([("a", "a"), ("b", "b")], "scheme string, lane string")
    whole, pairs = mesh.admission_stats(edges, held, schemes, owners)
    assert tuple(whole.first()) == (6, 1, 1, 2, 2) and [tuple(r) for r in pairs.collect()] == [("a", "b", 2)]
    assert {tuple(r[c] for c in ("lane", "owner", "edge_type", "hits", "targets")) for r in mesh.seams_by_lane(edges, owners).collect()} == {("a", "b", "t", 2, 1), ("b", "a", "u", 2, 2)}


def test_explain_has_the_first_page_and_notes(spark, tmp_path):
    from graphloom.operators import lookup

    pages.append(spark, str(tmp_path), "a", moved(spark, ["a://k/x"]), "c1", None, bootstrap=True)
    nodes = spark.createDataFrame([("a://k/x", "func", "code"), ("a://k/t", "func", "test"), ("a://k/z", "func", "code")], "id string, node_type string, role string")
    edges = spark.createDataFrame([("a://k/t", "a://k/x", "calls"), ("d://k/doc", "a://k/x", "mentions"), ("d://k/far", "a://k/t", "mentions")], "src string, dst string, edge_type string")
    found = lookup.explain(nodes, edges, "a://k/x", pages=pages.read(spark, str(tmp_path)))
    assert found["page"]["cursor"] == "c1" and found["note"] == "1 page(s)" and found["tests_note"] is None and [r["node"] for r in found["tests"].collect()] == ["a://k/t"]
    assert {r["node"] for r in found["docs"].collect()} == {"d://k/doc"}
    bare = lookup.explain(nodes, edges, "a://k/z")
    assert bare["page"] is None and bare["note"] == "no journal is declared" and bare["tests_note"].startswith("none reach it within depth 3 against")
