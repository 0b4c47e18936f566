import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import catalog, decontaminate, host_rules, html_text, line_dedup, mixing, near_dedup, quality, suffix_dedup, token_counts, toxicity
from graphloom.llm.common import Rolling
from graphloom.llm.components import components

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, source="s"):
    rows = [(i, t, "en", source, len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def same(got, want, duck_names):
    names = sorted(got.columns)
    assert names == sorted(duck_names)
    left = sorted(tuple(str(r[n]) for n in names) for r in got.collect())
    right = sorted(tuple(str(r[duck_names.index(n)]) for n in names) for r in want)
    assert left == right


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_oracle(spark, duck, name):
    want = duck.execute(catalog.ORACLES[name])
    same(catalog.QUERIES[name](spark, FOLDER), want.fetchall(), [d[0] for d in want.description])


AWKWARD = [(1, None), (2, ""), (3, "  \n\t "), (4, "word"), (5, "x" * 30_000), (6, "tie tie tie"), (7, "tie tie tie"), (7, "tie tie tie"), (8, "éß " * 4000), (None, "no id here"), (None, None)]


@pytest.mark.parametrize("name", ["documents", "none"])
def test_operators_take_awkward_and_empty_tables(spark, name):
    """Nulls, empty, long and repeated rows, and columns whose names clash with those that operators add."""
    docs = docs_of(spark, AWKWARD if name == "documents" else [])
    n = len(AWKWARD) if name == "documents" else 0
    for extra in ("size", "score", "spans", "n_words", "key", "salt", "end", "bucket"):
        docs = docs.withColumn(extra, F.lit("clash"))
    items = spark.createDataFrame([(1, "no id here"), (2, None), (3, "")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert host_rules.host_rules(docs).count() == n
    assert token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(docs))).count() == (6 if n else 0) or n
    assert mixing.mix(docs).count() == n
    assert near_dedup.classes(docs).count() == n
    assert line_dedup.line_dedup(docs).count() == n
    assert suffix_dedup.suffix_dedup(docs).count() == n
    found = decontaminate.judged(decontaminate.find(docs, items)).collect()
    assert len(found) == n and {r["doc_id"] for r in found if r["contaminated"]} == ({None} if n else set())
    assert decontaminate.decontaminate(docs, items).columns == docs.columns
    assert near_dedup.keep_one(docs).columns == docs.columns
    assert quality.score(docs, quality.train(docs, labels), ["doc_id"]).count() == n
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()} == ({0.0} if n else set())


def test_rolling_hash_tells_substrings_apart():
    data = np.frombuffer(b"abcabcabd" * 20, np.uint8)
    rolling = Rolling(3)
    prefix, starts = rolling.prefix(data), np.arange(len(data) - 3)
    hashed = Rolling(3).at(prefix, starts, starts + 3)
    by = defaultdict(set)
    for s, h in zip(starts, hashed, strict=True):
        by[bytes(data[s : s + 3])].add(int(h))
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)


# ---- 1 and 8 ---------------------------------------------------------------------------------------------------------


def auc(score, label):
    order = sorted(zip(score, label, strict=True))
    ranks = [i for i, (_, y) in enumerate(order) if y]
    good = len(ranks)
    return (sum(ranks) - good * (good - 1) / 2) / (good * (len(order) - good))


@pytest.mark.parametrize(("query", "column", "least"), [(toxicity.query, "toxic", 0.85), (quality.query, "quality", 0.95)])
def test_classifiers_on_held_out_rows(spark, query, column, least):
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = [r for r in query(spark, LARGER).collect() if r["held_out"] and r["doc_id"] in labels]
    modulus, fold = (4, 2) if column == "toxic" else (5, 0)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % modulus == fold for r in rows)
    assert auc([r["score"] for r in rows], [labels[r["doc_id"]] for r in rows]) >= least
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_chain_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    emissions, moves, lengths = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([4, 0, 5])
    got, pairs = toxicity.marginals(emissions, lengths, moves)
    want, seen, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        weight, total = np.zeros(n), 0.0
        for bits in range(2**n if n else 0):
            y = [bits >> k & 1 for k in range(n)]
            w = math.exp(sum(emissions[at + k] for k in range(n) if y[k]) + sum(moves[y[k], y[k + 1]] for k in range(n - 1)))
            total += w
            weight += w * np.array(y)
        want += list(weight / total) if n else []
        for k in range(n - 1):
            for bits in range(2**n):
                y = [bits >> j & 1 for j in range(n)]
                w = math.exp(sum(emissions[at + j] for j in range(n) if y[j]) + sum(moves[y[j], y[j + 1]] for j in range(n - 1)))
                seen[y[k], y[k + 1]] += w / total
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, seen)


def test_toxic_spans_are_offsets_of_the_words():
    bad = ["vile" if i % 3 else "foul" for i in range(60)]
    texts = [f"some {w} words{i} stand{i} here{i} {w} today" for i, w in enumerate(bad)] + [f"some kind words{i} stand{i} here{i} again today" for i in range(60)]
    chain = toxicity.fit(texts, [1] * 60 + [0] * 60)
    (score, spans), (clean, none) = toxicity.score_texts(["Here VILE stands", "here kind stands"], chain, {})
    assert spans == [(5, 9)] and not none and score > 0.5 > clean


def test_texts_that_share_common_words_are_no_copies():
    """The words of least crc32 are in all texts; the others tell them apart."""
    common = sorted((f"c{i}" for i in range(3000)), key=lambda w: zlib.crc32(w.encode()))[:3]
    bad, good = [" ".join([*common, "vile", f"x{i}"]) for i in range(40)], [" ".join([*common, "kind", f"y{i}"]) for i in range(40)]
    corpus = toxicity.Words(bad + good + bad[:1])
    tags = toxicity.label_tokens(corpus, np.array([True] * 40 + [False] * 40 + [True]))
    assert [int(t.sum()) for t in tags] == [1] * 40 + [0] * 40 + [1]


def test_long_texts_are_trained_on_in_segments(spark):
    docs = docs_of(spark, [(i, " ".join(f"W{k}" for k in range(20_000 if i % 2 else 10))) for i in range(80)])
    labels = spark.createDataFrame([(i, int(i >= 40)) for i in range(80)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels, most=8, segments=3).collect()
    assert Counter(r["label"] for r in rows) == {0: 8, 1: 8} and any(r["doc_id"] % 2 for r in rows)
    size, n = toxicity.SEGMENT, -(-20_000 // toxicity.SEGMENT)
    want = " ".join(f"w{k}" for i in range(3) for k in range(i * n // 3 * size, (i * n // 3 + 1) * size))
    assert {r["text"] for r in rows if r["doc_id"] % 2} == {want} and {r["text"] for r in rows if r["doc_id"] % 2 == 0} == {" ".join(f"w{k}" for k in range(10))}


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    flat, paired = quality.fit(x, y, 40, pairs=0), quality.fit(x, y, 40)
    assert auc(flat.score(x), y) < 0.65 < 0.95 < auc(paired.score(x), y)


# ---- 2 ---------------------------------------------------------------------------------------------------------------


def removed(rows, length=suffix_dedup.LENGTH):
    """Brute force: (doc_id, kept bytes) by strings that start earlier, in a smaller doc_id or in the same row."""
    order = lambda d: math.inf if d is None else d
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            first[b[k : k + length]] = min(first.get(b[k : k + length], math.inf), order(d))
    out = []
    for d, t in rows:
        b, own, gone = (t or "").encode(), set(), set()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if order(d) > first[w] or w in own:
                gone.update(range(k, k + length))
            own.add(w)
        out.append((d, len(gone), bytes(x for i, x in enumerate(b) if i not in gone)))
    return sorted(out, key=str)


def test_cover_covers():
    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))
    for size in (99, 100, 101, 157, 400):
        n = int(suffix_dedup.sample_count(np.array([size]))[0])
        want = [p for p in range(max(0, size - 43)) if p % 57 in suffix_dedup.COVER] if size >= 100 else []
        assert suffix_dedup.sample_positions(np.arange(n)).tolist() == want


def test_suffix_dedup_matches_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8)))
    passage = [" ".join(word() for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passage)[rng.randrange(20) : rng.randrange(90, 300)] if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randrange(5, 60))) for _ in range(rng.randrange(1, 5))]
        rows.append((rng.choice([i, i, i, None]), " ".join(parts)))
    rows += [(100, rows[0][1]), (101, rows[1][1]), (101, rows[1][1]), (3, rows[5][1]), (200, "ab" * 400), (201, None), (202, ""), (203, "z" * 99), (204, "z" * 100), (205, "z" * 101), (None, rows[2][1])]
    got = sorted(((r["doc_id"], r["n_removed"], bytes(r["kept"])) for r in suffix_dedup.suffix_dedup(docs_of(spark, rows).repartition(5)).collect()), key=str)
    assert got == removed(rows)


# ---- 3 ---------------------------------------------------------------------------------------------------------------


def test_decontamination_in_blocks_equals_one_pass(spark):
    docs, items = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    key = lambda df: sorted((r["doc_id"], r["n_words"], [tuple(s) for s in r["spans"]], r["items"]) for r in df.collect())
    assert key(decontaminate.find(docs, items)) == key(decontaminate.find(docs, items, most=800))


def test_short_items_repeats_and_proximity(spark):
    docs = docs_of(spark, [(1, "One two THREE, one-two three"), (2, "three two one"), (3, "two one")])
    items = spark.createDataFrame([(7, "one two three"), (8, "ONE TWO THREE"), (9, "one four")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate.judged(decontaminate.find(docs, items)).collect()}
    assert got == {1: (6, ["7", "8"]), 2: (0, []), 3: (0, [])}
    near = {(r["doc_id"], r["position"]) for r in decontaminate.proximity(docs, [("p", "three one")], 2).collect()}
    assert {d for d, _ in near} == {1, 2}


# ---- 4 and 5 ---------------------------------------------------------------------------------------------------------


def test_token_histogram_answers(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    lengths = [len(token_counts.encoding().encode_ordinary(r["text"] or "")) for r in docs.collect()]
    sums = token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(docs))).cache()
    rows = {r["n_tokens"]: r for r in sums.collect()}
    assert {k: r["n_docs"] for k, r in rows.items()} == Counter(lengths)
    for k, r in rows.items():
        assert (r["docs_at_least"], r["tokens_at_least"], r["truncated_total"]) == (sum(x >= k for x in lengths), sum(x for x in lengths if x >= k), sum(min(x, k) for x in lengths))
    for r in token_counts.totals_at(sums, [0, 100, 512, 10**9]).collect():
        assert (r["n_docs"], r["n_tokens"], r["docs_cut"]) == (len(lengths), sum(lengths), sum(x > r["context_limit"] for x in lengths))
        assert r["truncated_total"] == sum(min(x, r["context_limit"]) for x in lengths)
    ordered = sorted(lengths)
    assert {r["share"]: r["length"] for r in token_counts.quantiles(sums, [0.5, 0.9, 1.0]).collect()} == {s: ordered[math.ceil(s * len(ordered)) - 1] for s in (0.5, 0.9, 1.0)}


def test_targets_fill_up_to_the_cap(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 50), ("d", 0)], "source string, size long")
    got = {r["mix_source"]: r["target"] for r in mixing.targets(sized).collect()}
    weight, cap, left = {"a": 3, "b": 1, "c": 2, "d": 3, None: 1}, {"a": 20, "b": 2000, "c": 200, "d": 0, None: 100}, 1.5 * 1160
    done, open_ = {}, set(weight)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= cap[s]}
        if not full:
            break
        done |= {s: cap[s] for s in full}
        left, open_ = left - sum(cap[s] for s in full), open_ - full
    done |= {s: level * weight[s] for s in open_}
    assert got == pytest.approx(done)


def test_mix_comes_near_its_targets(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    mixed = mixing.mix(docs).cache()
    fraction = F.col("rate") - F.floor("rate")
    per = mixed.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.sqrt(F.sum(F.col("size") ** 2 * fraction * (1 - fraction))).alias("spread"))
    assert abs(per.agg(F.sum("taken") / F.sum("target")).first()[0] - 1) < 0.1
    assert all(abs(r["taken"] - r["target"]) <= 3.5 * r["spread"] + 1e-6 for r in per.collect())  # each source, by its own draws
    assert mixed.filter("copies > 2").isEmpty()
    assert mixing.emit(docs).count() == mixed.agg(F.sum("copies")).first()[0]


# ---- 6 ---------------------------------------------------------------------------------------------------------------


def test_near_dedup_matches_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()]
    texts = [near_dedup.words_joined(t) for _, t in rows]
    bags = []
    for t in texts:
        w = t.split()
        count = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
        bags.append({(s, k) for s, n in count.items() for k in range(n)})
    holders, shared = defaultdict(list), Counter()
    for i, b in enumerate(bags):
        for e in b:
            holders[e].append(i)
    for held in holders.values():
        shared.update((a, b) for k, b in enumerate(held) for a in held[:k])
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if n >= 0.8 * (len(bags[a]) + len(bags[b]) - n):
            parent[root(b)] = root(a)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[root(i)].append(d)
    want = {d: (min(g), len(g)) for g in groups.values() for d in g}
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in near_dedup.query(spark, LARGER).collect()}
    assert got == want


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(4)
    base = [b"w%d" % rng.randrange(300) for _ in range(400)]
    for share in (0.02, 0.1):
        other = [b"x%d" % rng.randrange(9999) if rng.random() < share else w for w in base]
        hashed, counts = near_dedup.elements([b" ".join(base), b" ".join(other)])
        a, b = set(hashed[: counts[0]].tolist()), set(hashed[counts[0] :].tolist())
        signature = near_dedup.signatures(hashed, counts, 2000)
        assert abs((signature[0] == signature[1]).mean() - len(a & b) / len(a | b)) < 0.05


def test_blocks_of_a_bucket_lose_no_link(spark, monkeypatch):
    base = [f"w{i}" for i in range(200)]
    texts = [(i, " ".join(base[:k] + [f"new{i}"] + base[k + 1 :])) for i, k in enumerate(range(10, 190, 6))]
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    assert {r["class_id"] for r in near_dedup.classes(docs_of(spark, texts)).collect()} == {0}


def test_elements_alike_in_32_bits_cost_no_link(spark):
    """a and b are each similar to c, but to one another only where elements are cut to their upper 32 bits."""
    ends = [b"p q r s w%d" % i for i in range(400_000)]
    top = near_dedup.elements(ends)[0] >> np.uint64(32)
    order = np.argsort(top, kind="stable")
    twins = [(int(order[i]), int(order[i + 1])) for i in np.flatnonzero(top[order][1:] == top[order][:-1])]
    assert len(twins) >= 6
    rows = []
    for x, y in twins[:6]:
        for seed in range(1000):  # words by which all three meet in the one band
            middle = " ".join(f"m{x}n{seed}n{k}" for k in range(8)) + " p q r s"
            texts = [f"u {middle} w{x}", f"v {middle} w{y}", f"u {middle} w{y}"]
            hashed, counts = near_dedup.elements([t.encode() for t in texts])
            if len(set(near_dedup.band_hashes(near_dedup.signatures(hashed, counts, 1), 1, 1).ravel().tolist())) == 1:
                break
        rows += [(len(rows) + k, t) for k, t in enumerate(texts)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs_of(spark, rows), bands=1, rows=1).collect()}
    assert got == {i: i - i % 3 for i in range(len(rows))}


def test_keep_one_with_shared_ids(spark):
    a, b = "one two three four five six seven eight", "other words that stand in a different document"
    kept = near_dedup.keep_one(docs_of(spark, [(1, a), (1, b), (1, a), (2, a), (3, b), (4, ""), (5, "")])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, a), (1, b), (4, ""), (5, "")]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["key"]: r["root"] for r in components(links).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# ---- 7, 9, 10 --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<script>x</script><style>y</style><!-- z -->", ""),
        ("plain words", "plain words"),
        ("<nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>a\n b<br>c<p>d&nbsp;&nbsp;e</article><footer>f</footer>", "T & U\na b c\nd e"),
        ("<article><p>keep <a href=x>this link</a></p><div class='comments'><p>no</p></div><aside>no</aside><form>no</form></article>", "keep this link"),
        ("<article><p>a<div class=\"ad-box\">no</div><p>b</p>", "a\nb"),
        ("<header>no</header><div class=cookie-notice>no</div><main><header><h1>yes</h1></header><p>yes</p></main>", "yes\nyes"),
        ("<body><div id=menu><a href=x>no</a></div><h2>Head</h2><p>" + "it is the one of the that was in it " * 8 + "</p><p>short</p><div class=sidebar>no</div>", "Head\n" + ("it is the one of the that was in it " * 8).strip() + "\nshort"),
        ("<article><p title=\"a > b\">x < y & z</p></article>", "x < y & z"),
    ],
)
def test_html_text(page, want):
    assert html_text.main_text(page) == want


def test_line_runs_by_brute_force(spark):
    rng = random.Random(6)
    rows = [(rng.choice([i, i, None]), "\n".join(rng.choice(["a", " b", "c ", "d", "", "e", "f"]) for _ in range(rng.randrange(0, 14)))) for i in range(40)] + [(50, None), (51, ""), (7, "a\nb\nc")]
    for gram, window in ((1, 2), (1, 3), (2, 2)):
        run, first = gram + window - 1, {}
        solid = [[x.strip(" ") for x in (t or "").split("\n") if x.strip(" ")] for _, t in rows]
        order = lambda d: math.inf if d is None else d
        for (d, _), x in zip(rows, solid, strict=True):
            for k in range(len(x) - run + 1):
                first[tuple(x[k : k + run])] = min(first.get(tuple(x[k : k + run]), math.inf), order(d))
        want = []
        for (d, t), x in zip(rows, solid, strict=True):
            own, gone = set(), set()
            for k in range(len(x) - run + 1):
                r = tuple(x[k : k + run])
                if order(d) > first[r] or r in own:
                    gone.update(range(k, k + run))
                own.add(r)
            want.append((d, len(x), len(gone)))
        got = [(r["doc_id"], r["n_lines"], r["n_removed"]) for r in line_dedup.line_dedup(docs_of(spark, rows), gram=gram, window=window).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_single_lines_as_long_as_a_passage_go(spark):
    """Between other neighbours, as a whole document, twice in one, and beside runs; 49 words stay."""
    import corpus_pipeline

    passage, other, short = " ".join(f"p{i}" for i in range(50)), "语" * 100, " ".join(f"s{i}" for i in range(49))
    texts = [f"a\n{passage}\nb", f"c\n {passage}\n\nd", passage, f"{short}\ne\n{other}", f"{other}\nf\n{other}", short, f"g\n{passage}\nb\nh", other, "语" * 99]
    docs = docs_of(spark, list(enumerate(texts)))
    want = [texts[0], "c\n\nd", "", texts[3], "f", short, "g\nh", "", texts[8]]
    got = {r["doc_id"]: (r["text"], r["n_removed"], r["n_runs"]) for r in line_dedup.line_dedup(docs).collect()}
    assert [got[i][0] for i in range(9)] == want
    assert [got[i][1:] for i in range(9)] == [(0, 0), (1, 1), (1, 1), (0, 0), (2, 2), (0, 0), (2, 1), (1, 1), (0, 0)]
    staged = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_stage(spark, docs, FOLDER).collect()}
    assert staged == {i: (t, len(t)) for i, t in enumerate(want)}


def test_no_passage_of_the_sample_tables_stays_twice(spark):
    for gram, window in ((1, 2), (2, 2)):
        kept = line_dedup.line_dedup(spark.read.parquet(f"{LARGER}/documents.parquet"), gram=gram, window=window)
        lines = Counter(x.strip(" ") for r in kept.select("text").collect() for x in (r["text"] or "").split("\n"))
        assert not [x for x, n in lines.items() if n > 1 and len(x.split()) >= 50]


def test_repeated_words_and_shrinking(spark):
    words = b"a b c d e f g h x a b c d e f g h".split()
    assert host_rules.repeated_words(words) == 16 and host_rules.repeated_words([b"w"] * 9) == 9 and host_rules.repeated_words(words[:9]) == 0
    failures = spark.createDataFrame([("big", i % 10 == 0) for i in range(500)] + [("bad", i % 10 != 0) for i in range(500)] + [("tiny", True)], "host string, base_failed boolean")
    rate = {r["host"]: r["host_rate"] for r in host_rules.host_rates(failures).collect()}
    assert rate["big"] < 0.12 and rate["bad"] > 0.88 and 0.5 < rate["tiny"] < 1


def test_pipeline_keeps_what_its_stages_keep(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    done = corpus_pipeline.run(spark, FOLDER)
    assert set(docs.columns) < set(done.columns)
    scored = {r["doc_id"]: r["predicted"] for r in quality.query(spark, FOLDER).collect()}
    ids = {r["doc_id"] for r in done.collect()}
    assert ids and all(scored[i] == 1 for i in ids)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns
    once = corpus_pipeline.near_stage(spark, docs, FOLDER)
    assert once.count() == len({r["class_id"] for r in near_dedup.query(spark, FOLDER).collect()})
    clean = {r["doc_id"] for r in corpus_pipeline.benchmark_stage(spark, docs, FOLDER).collect()}
    assert clean == {r["doc_id"] for r in decontaminate.query(spark, FOLDER).collect() if not r["contaminated"]}
    assert hashlib.sha256(b"").hexdigest() == next(r["items_sha256"] for r in decontaminate.query(spark, FOLDER).collect() if not r["n_items"])
