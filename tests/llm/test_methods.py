"""Each operator gets its rows through its method: tests that fail where the method is bypassed."""

import html as entities
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, host_rules, html_text, line_dedup, mixing, near_dedup, quality, suffix_dedup, token_counts, toxicity

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in texts], DOC)


# ---- 7 ---------------------------------------------------------------------------------------------------------------


def plain_article(page):
    """What stands in the article of a page of the sample tables, by plain cutting at its tags."""
    inner = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    blocks = re.split(r"</?(?:p|h1)\b[^>]*>", re.sub(r"<br\s*/?>", " ", inner))
    texts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in blocks]
    return [t for t in texts if t]


def test_pages_match_plain_cutting(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{LARGER}/pages.parquet").collect()}
    rows = html_text.query(spark, LARGER).collect()
    assert len(rows) == len(pages)
    for r in rows:
        want = "\n".join(plain_article(pages[r["page_id"]]))
        assert (r["text"], r["n_chars"]) == (want, len(want))


def test_measures_find_the_text_without_named_holders(spark):
    """Without class, id and role values, and with article and main made div, the planted text is still found."""
    planted = found = wrong = 0
    for r in spark.read.parquet(f"{LARGER}/pages.parquet").collect():
        bare = re.sub(r"(</?)(?:article|main)\b", r"\1div", re.sub(r"\s(?:class|id|role)=\"[^\"]*\"", "", r["html"]))
        assert not any(b.main or b.soft for b in html_text.blocks_of(bare))
        want, got = Counter(plain_article(r["html"])), Counter(html_text.main_text(bare).split("\n"))
        planted, found, wrong = planted + want.total(), found + (want & got).total(), wrong + (got - want).total()
    assert found >= 0.99 * planted and wrong <= 0.02 * planted


def test_first_pass_decides_by_measures_and_leaves_short_blocks_to_the_second():
    long, middling = "it is the one of the that was in it " * 8, "words of no list at all but of some seventy letters and no links here xyzzy"
    page = f"<body><article><h2>Head</h2><p>{long}</p><p>brief</p><p>{middling}</p><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></article></body>"
    blocks = html_text.blocks_of(page)
    html_text.decide(blocks)
    assert [b.label for b in blocks] == [None, True, None, True, False, False]
    html_text.inherit(blocks)
    assert [b.label for b in blocks] == [True, True, True, True, False, False]


LONG = ("it is the one of the that was in it " * 8).strip()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article><p>a <svg width="1"/> b</p><p>c</p></article>', "a b\nc"),
        ("<article><p>let <math><mi>x</mi></math> be</p><p>z <svg><title>t</title></svg> w <svg> q</p></article>", "let x be\nz w q"),
        ("<article><p>a<template>no</template>b <object>seen</object> <video>old browser</video></p></article>", "ab seen"),
        (f"<div><p>{LONG}</p><a href=x><div>Card one title</div><div>Text of the card</div></a><p>end</p></div>", f"{LONG}\nend"),
        ("<article><p><a href=x>one linked line</a></p></article>", "one linked line"),
        ("<article><p>open <a href=x>link<p>next block</p></article>", "open link\nnext block"),
        ("<p>a<script>never closed <p>b</p>", "a"),
    ],
)
def test_drawings_formulas_and_links_around_blocks(page, want):
    assert html_text.main_text(page) == want


def test_awkward_pages(spark):
    """No page, repeated rows, a very long page, and columns named like those that the operator adds."""
    word = "<p>" + "the of and to " * 40 + "</p>"
    rows = [(1, None, None), (2, "u", ""), (3, "u", word * 3000), (4, "u", "<p>x"), (4, "u", "<p>x"), (None, "u", "<" * 5000)]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, text string, n_chars string")
    got = html_text.extract(pages).collect()
    assert sorted(r["n_chars"] for r in got) == sorted(len(html_text.main_text(h)) for _, _, h in rows) and max(r["n_chars"] for r in got) > 1_500_000
    assert html_text.extract(pages.limit(0)).count() == 0


# ---- 3 ---------------------------------------------------------------------------------------------------------------


def test_stored_index_holds_every_posting_and_serves_later_queries(spark, tmp_path):
    texts = ["One two, three two", None, "", "two ÉÉ one", "x " * 70_000 + "two"]
    folder = str(tmp_path / "index")
    decontaminate.build_index(docs_of(spark, list(enumerate(texts))).coalesce(1), folder)
    index = decontaminate.Index(spark, folder)
    got = {}
    first = {r["shard"]: np.frombuffer(r["terms"], np.int64) for r in index.postings.filter("bucket = -1").collect()}
    number = {(r["shard"], r["number"]): r["graphloom_0"] for r in index.docs.collect()}
    for r in index.postings.filter("bucket >= 0").collect():
        terms, counts = decontaminate.unpack_terms(r["terms"])
        at = decontaminate.unpack_lists(counts, np.arange(len(counts)), r["places"])
        for term, p in zip(np.repeat(np.array(terms, object), counts), at.tolist(), strict=True):
            assert decontaminate.bucket_of(term) == r["bucket"]
            k = int(np.searchsorted(first[r["shard"]], p, side="right")) - 1
            got.setdefault((number[r["shard"], k], term), []).append(p - int(first[r["shard"]][k]))
    want = {}
    for d, t in enumerate(texts):
        for p, w in enumerate(decontaminate.words_of(t)):
            want.setdefault((d, w), []).append(p)
    assert got == want
    for phrase, docs in (("three one", []), ("three two", [0]), ("x two", [4])):
        items = spark.createDataFrame([(1, phrase)], "item_id long, text string")
        assert [r["doc_id"] for r in decontaminate.search(index, items).filter("size(spans) > 0").collect()] == docs
    assert sorted((r["doc_id"], r["position"]) for r in decontaminate.near(index, [("p", "one three")], 2).collect()) == [(0, 2)]


def test_rows_of_a_search_come_from_the_index(spark, tmp_path):
    """Postings taken out of the index are no longer found."""
    docs = docs_of(spark, [(i, " ".join(f"w{k}" for k in range(i, i + 20))) for i in range(30)])
    index = decontaminate.build_index(docs, str(tmp_path / "index"))
    items = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(15, 28)))], "item_id long, text string")
    held = lambda: sorted(r["doc_id"] for r in decontaminate.search(index, items).filter("size(spans) > 0").collect())
    assert held() == list(range(8, 16))
    index.postings = index.postings.filter(f"bucket <> {decontaminate.bucket_of(b'w20')}")
    assert held() == []


def test_windows_are_led_by_their_rarest_terms():
    block = decontaminate.Phrases([("a", "the rare the odd the"), ("b", "the gone")], 3)
    numbers = block.numbers
    held = np.array([{b"the": 90, b"rare": 2, b"odd": 5, b"gone": 0}[t] for t in numbers])
    block.rank(held)
    assert len(block.width) == 3  # the window of b can't occur
    assert {list(numbers)[i] for i in block.leading(1)} == {b"rare", b"odd"}


@pytest.mark.parametrize("most", [8, 60, 10**6])
def test_search_matches_plain_windows_on_random_texts(spark, most):
    rng = random.Random(most)
    word = lambda: rng.choice(["a", "b", "c", "d"])
    texts = [(i, " ".join(word() for _ in range(rng.randrange(0, 60)))) for i in range(80)] + [(200, None), (200, "a b c d"), (200, "a b c d")]
    items = [(i, " ".join(word() for _ in range(rng.randrange(0, 9)))) for i in range(12)] + [(12, None)]
    want = []
    for d, t in texts:
        words, hit, named = (t or "").split(), set(), set()
        for i, item in items:
            asked = (item or "").split()
            k = min(5, len(asked))
            windows = {tuple(asked[j : j + k]) for j in range(len(asked) - k + 1)} if k else set()
            for p in range(len(words) - k + 1 if k else 0):
                if tuple(words[p : p + k]) in windows:
                    hit.update(range(p, p + k))
                    named.add(str(i))
        want.append((d, len(words), len(hit), sorted(named)))
    items = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.judged(decontaminate.find(docs_of(spark, texts), items, window=5, most=most)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got) == sorted(want)


def test_decontaminate_takes_maps_and_clashing_names_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 3)
    docs = docs_of(spark, [(1, "alpha beta gamma"), (2, "kept text"), (3, None)])
    for extra in ("shard", "number", "key", "graphloom_key", "spans", "kind"):
        docs = docs.withColumn(extra, F.create_map(F.lit("a"), F.lit(1)) if extra == "kind" else F.lit("clash"))
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, "nothing like it here")], "item_id long, text string")
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]


# ---- 2 ---------------------------------------------------------------------------------------------------------------


def test_cover_ranks_are_in_byte_order():
    rng = random.Random(1)
    data = np.frombuffer(b"".join(rng.choice([b"ab", b"a", b"\xff\x00", b"ba" * 30, b"a" * 120]) for _ in range(300)), np.uint8)
    raw, ranks = data.tobytes(), suffix_dedup.cover_ranks(data)
    at = [p for p in range(len(raw)) if p % suffix_dedup.STEP in suffix_dedup.RANKED]
    strings = [raw[p : p + suffix_dedup.DEPTH] for p in at[: len(ranks)] if p + suffix_dedup.DEPTH <= len(raw)]
    order = sorted(set(strings))
    by_rank = {r: t for r, t in zip(ranks.tolist(), strings, strict=False)}
    assert len(by_rank) == len(order) and [by_rank[r] for r in sorted(by_rank)] == order


def test_ties_are_resolved_by_ranks_alone(monkeypatch):
    """Suffixes alike in their first and last eight bytes: without the ranks they would be taken for equal."""
    rng = random.Random(2)
    pieces = [b"h" * 8 + bytes(rng.choice(b"xy") for _ in range(84)) + b"t" * 8 for _ in range(40)]
    raw = b"".join(rng.choice(pieces) + b"-" * rng.randrange(9) for _ in range(300)) + b"." * 100
    data = np.frombuffer(raw, np.uint8)
    at = np.array([p for p in range(len(raw) - 99) if raw[p : p + 8] == b"h" * 8 and raw[p + 92 : p + 100] == b"t" * 8], np.int64)
    least = {}
    for p in at.tolist():
        least.setdefault(raw[p : p + 100], p)
    assert suffix_dedup.first_equal(data, at, at).tolist() == [least[raw[p : p + 100]] for p in at.tolist()]
    monkeypatch.setattr(suffix_dedup, "cover_ranks", lambda data: np.zeros(len(data), np.uint32))
    assert set(suffix_dedup.first_equal(data, at, at).tolist()) == {int(at[0])}


def test_suffix_dedup_refuses_ids_without_an_order(spark):
    with pytest.raises(TypeError, match="whole number"):
        suffix_dedup.suffix_dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


# ---- 1 and 8 ---------------------------------------------------------------------------------------------------------


def test_offsets_are_those_of_the_original_text():
    bad = [f"some {'vile' if i % 3 else 'foul'} words{i} stand{i} here{i} today" for i in range(60)]
    chain = toxicity.fit(bad + [b.replace("vile", "kind").replace("foul", "good") for b in bad], [1] * 60 + [0] * 60)
    text = "\u0130\u0130\u0130 vile \u0130 FOUL"
    (_, spans), = toxicity.score_texts([text], chain, {})
    assert [text[a:b] for a, b in spans] == ["vile", "FOUL"]


def test_token_labels_by_plain_counting():
    """A word is marked exactly if it, or one of its prefixes, is held often enough, and far more, by toxic texts."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["vileness", "vile", "cat", "dog", "house", "foulest", f"u{i}"]) if i % 2 else rng.choice(["cat", "dog", "house", "villa", f"u{i}"]) for _ in range(12)) for i in range(120)]
    toxic = np.array([i % 2 == 1 for i in range(120)])
    corpus = toxicity.Words(texts)
    sets = {}
    for t, bad in zip(texts, toxic.tolist(), strict=True):
        sets[(bad, frozenset(t.split()))] = bad
    held = {True: [w for (bad, w) in sets if bad], False: [w for (bad, w) in sets if not bad]}

    def marked(word):
        for feature in ["w" + word] + [f"p{word[:n]}" for n in (3, 4, 5, 6) if len(word) > n]:
            has = lambda words, f=feature: any(f in toxicity.token_features(w) for w in words)
            b, g = sum(map(has, held[True])), sum(map(has, held[False]))
            if b >= max(4, 0.01 * len(held[True])) and math.log((b + 0.5) / (len(held[True]) + 1)) - math.log((g + 0.5) / (len(held[False]) + 1)) >= 3:
                return 1
        return 0

    for t, bad, tags in zip(texts, toxic.tolist(), toxicity.label_tokens(corpus, toxic), strict=True):
        assert tags.tolist() == [marked(w) if bad else 0 for w in t.split()]


def test_document_scores_by_plain_steps():
    """A score is the logistic of what enumerated marginals add up to."""
    chain = toxicity.Chain(-1.0, {"wbad": 2.5, "pbad": 0.5}, np.array([[0.4, -0.3], [0.1, 0.6]]), np.array([-1.0, 0.7, 1.1, 0.2, 0.3]))
    text = "a bad badly day bad"
    words, n = text.split(), 5
    strength = [-1.0 + sum(chain.weights.get(f, 0.0) for f in toxicity.token_features(w)) for w in words]
    weight, total = np.zeros(n), 0.0
    for bits in range(2**n):
        y = [bits >> k & 1 for k in range(n)]
        w = math.exp(sum(strength[k] for k in range(n) if y[k]) + sum(chain.moves[y[k], y[k + 1]] for k in range(n - 1)))
        total, weight = total + w, weight + w * np.array(y)
    p = weight / total
    evidence = [1, math.log1p(p.sum()), p.max(), min(1, 10 * p.sum() / n), math.log1p((p > 0.5).sum())]
    (score, spans), = toxicity.score_texts([text], chain, {})
    assert score == pytest.approx(1 / (1 + math.exp(-np.dot(evidence, chain.scale))))
    starts = np.cumsum([0] + [len(w) + 1 for w in words])
    assert spans == [(starts[k], starts[k] + len(words[k])) for k in range(n) if p[k] >= 0.5]


def test_additive_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(3)
    x = rng.random((600, 4))
    model = quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(int), 10, pairs=3)
    for row, got in zip(x[:50], model.score(x[:50]), strict=True):
        total = model.base + sum(t[sum(v >= e for e in edges)] for v, edges, t in zip(row, model.edges, model.tables, strict=True))
        place = [sum(v >= e for e in edges) for v, edges in zip(row, model.pair_edges, strict=True)]
        total += sum(t[place[i], place[j]] for i, j, t in model.pairs)
        assert got == pytest.approx(1 / (1 + math.exp(-total)))


AWKWARD = [(1, None), (2, ""), (3, "  \n\t "), (4, "word"), (5, "x" * 30_000), (6, "tie tie tie"), (7, "tie tie tie"), (7, "tie tie tie"), (8, "\u00e9\u00df " * 4000), (None, "no id here"), (None, None)]


@pytest.mark.parametrize("module", [toxicity, quality])
def test_trained_classifiers_take_awkward_rows(spark, module):
    label = "toxic" if module is toxicity else "quality"
    rows = [(100 + i, f"some {'vile' if i % 2 else 'kind'} words{i} " * 9) for i in range(80)] + [(100, "again"), (100, "again")] + AWKWARD
    docs = docs_of(spark, rows)
    for extra in ("score", "spans", "label", "train_id", "turn", "x"):
        docs = docs.withColumn(extra, F.lit("clash"))
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(80)] + [(101, 0), (101, 1), (5, None), (None, 1), (7, 1), (999, 1)], f"doc_id long, {label} int")
    model = module.train(docs, labels)
    got = [sorted((str(r["doc_id"]), r["score"]) for r in module.score(docs, model, ["doc_id"]).collect()) for _ in range(2)]
    assert len(got[0]) == len(rows) and got[0] == got[1] and all(0 <= s <= 1 for _, s in got[0])
    assert module.score(docs.limit(0), model, ["doc_id"]).count() == 0


def test_repeated_ids_train_the_same_model_in_every_run(spark):
    rows = [(i % 7, f"{'vile' if i % 7 > 3 else 'kind'} text number {i} of many") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i > 3)) for i in range(7)], "doc_id long, toxic int").withColumn("quality", F.col("toxic"))
    for module in (toxicity, quality):
        models = [module.train(docs_of(spark, rows).repartition(n), labels, most=20) for n in (2, 5)]
        scores = [[r["score"] for r in module.score(docs_of(spark, rows[:40]), m, ["doc_id"]).orderBy("doc_id", "score").collect()] for m in models]
        assert scores[0] == scores[1]


# ---- 4, 5, 9, 10 -----------------------------------------------------------------------------------------------------


def test_a_vocabulary_folder_is_read_and_not_run(spark, tmp_path):
    import shutil

    shutil.copy(f"{token_counts.TOKENIZERS}/{token_counts.VOCABULARY}", tmp_path)
    (tmp_path / "__init__.py").write_text(f"PATTERN = {token_counts.splitting_pattern(token_counts.TOKENIZERS)!r}\nraise SystemExit(1)\n")
    docs = docs_of(spark, [(1, "a few words"), (2, "n" * 1_000_000)])
    want = [len(token_counts.encoding().encode_ordinary(t)) for t in ("a few words", "n" * 1_000_000)]
    assert [r["n_tokens"] for r in token_counts.lengths(docs.orderBy("doc_id"), folder=str(tmp_path)).collect()] == want


def test_targets_do_not_depend_on_how_sources_are_parted(spark):
    rng = random.Random(4)
    sized = spark.createDataFrame([(f"h{rng.randrange(400)}" if i % 50 else None, rng.randrange(900)) for i in range(5000)], "source string, size long")
    got = [{r["mix_source"]: r["target"] for r in mixing.targets(sized.repartition(n)).collect()} for n in (1, 7)]
    assert got[0] == got[1] and len(got[0]) > 300


def test_a_bad_host_takes_its_clean_documents_along(spark):
    """On the sample texts, dealt to hosts by their base failures: one host fails often, the others as all do."""
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    failed = {r["doc_id"] for r in host_rules.query(spark, LARGER).filter("base_failed").collect()}
    assert len(failed) >= 20
    bad = spark.createDataFrame([(i,) for i in sorted(failed)], "bad_id long")
    host = F.when(F.col("bad_id").isNotNull() & (F.col("doc_id") % 2 == 0) | (F.col("doc_id") % 100 == 1), "bad").otherwise(F.concat(F.lit("h"), F.col("doc_id") % 9))
    dealt = docs.join(bad, docs["doc_id"] == bad["bad_id"], "left").withColumn("source", host)
    rows = host_rules.host_rules(dealt).join(dealt.select("doc_id", "source"), "doc_id").collect()
    assert {r["source"] for r in rows if r["host_rejected"]} == {"bad"}
    assert [r for r in rows if not r["kept"] and not r["base_failed"]] and all(r["kept"] == (not r["base_failed"] and r["source"] != "bad") for r in rows)


def clashing(docs):
    for extra in ("line_doc", "line_row", "line_list", "line_hit", "line_found", "line_numbers", "line_starts", "n_removed", "n_lines", "n_runs", "mix_source", "size", "rate", "target", "copies", "copy", "touched_id", "near_key", "near_id", "key", "graphloom_0x", "root", "m", "u", "n"):
        docs = docs.withColumn(extra, F.lit("clash"))
    return docs


@pytest.mark.parametrize("rows", [AWKWARD + [(9, "a b c d e f g\nh i j\nk l"), (10, "a b c d e f g\nh i j\nk l"), (10, "a b c d e f g\nh i j\nk l")], []])
def test_columns_of_any_name_keep_their_values(spark, rows):
    docs = clashing(docs_of(spark, rows))
    taken = mixing.emit(docs)
    assert taken.columns == [*docs.columns, "copy_2"]
    held = line_dedup.line_dedup(docs)
    assert held.columns == [c for c in docs.columns if c not in ("n_lines", "n_removed", "n_runs")] + ["n_lines", "n_removed", "n_runs"]
    kept = near_dedup.keep_one(docs)
    for frame in (taken, held.drop("n_lines", "n_removed", "n_runs"), kept):
        names = [c for c in frame.columns if c not in ("doc_id", "text", "lang", "source", "n_chars", "copy_2")]
        assert all(set(r) == {"clash"} for r in frame.select(*names).collect())
    assert held.count() == len(rows) and (kept.count() > 0) == bool(rows)


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_awkward_tables(spark, tmp_path, empty):
    import corpus_pipeline

    good = [(200 + i, " ".join(f"Some word{i % 60} of the {k} kind, and more." for k in range(12))) for i in range(60)]
    docs = clashing(docs_of(spark, [] if empty else AWKWARD + good))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([] if empty else [(200 + i, 1) for i in range(0, 60, 2)] + [(i, 0) for i in range(1, 9)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([] if empty else [(1, "no id here"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, run in corpus_pipeline.STAGES[:-1]:
        stage = run(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns
    done = corpus_pipeline.run(spark, str(tmp_path))
    assert done.columns == [*docs.columns, "copy_2"] and (done.count() == 0) == empty
    assert all(r["n_removed"] == "clash" == r["size"] for r in done.collect())


def test_pipeline_by_plain_steps(spark, tmp_path):
    """The stages but the first, which is learned, by brute force: each on all rows that the one before kept."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    lined = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_stage(spark, docs, LARGER).collect()}
    first, passage = {}, lambda x: len(x.split()) >= 50 or len(x.encode()) >= 300
    solid = {d: [(i, x.strip(" ")) for i, x in enumerate((t or "").split("\n")) if x.strip(" ")] for d, t in rows.items()}
    runs = {d: [((x[k][1],), (k,)) for k in range(len(x)) if passage(x[k][1])] + [((x[k][1], x[k + 1][1]), (k, k + 1)) for k in range(len(x) - 1)] for d, x in solid.items()}
    for d, found in runs.items():
        for lines, _ in found:
            first[lines] = min(first.get(lines, d), d)
    for d, text in rows.items():
        own, gone = set(), set()
        for lines, at in sorted(runs[d], key=lambda r: r[1]):
            if first[lines] < d or lines in own:
                gone.update(solid[d][k][0] for k in at)
            own.add(lines)
        assert lined[d] == (text if not gone else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone))


# ---- 6 ---------------------------------------------------------------------------------------------------------------


def groups_of(found):
    out = {}
    for r in found.collect():
        out.setdefault(r["class_id"], set()).add(r["doc_id"])
    return {frozenset(g) for g in out.values()}


def test_large_buckets_are_compared_by_leaders_then_by_what_they_leave(spark, monkeypatch):
    """Chains of texts of which only neighbours are similar, all in one bucket of many blocks, beside other chains."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "band_hashes", lambda signature, bands, rows: np.full((len(signature), bands), 7, np.uint64))
    texts, want = [], set()
    for chain in range(6):
        first = len(texts)
        for step in range(12):
            texts.append((len(texts), " ".join(f"c{chain}w{k}" for k in range(3 * step, 3 * step + 40))))
        want.add(frozenset(range(first, len(texts))))
    texts += [(len(texts) + i, f"alone {i} " + " ".join(f"x{i}y{k}" for k in range(20))) for i in range(5)]
    want |= {frozenset([i]) for i in range(72, 77)}
    assert groups_of(near_dedup.classes(docs_of(spark, texts), bands=2, rows=1)) == want


def test_members_of_a_near_copy_group_are_sent_once_a_band(spark, monkeypatch):
    base = [f"w{i}" for i in range(400)]
    texts = [(i, " ".join(base[:k] + [f"new{i}"] + base[k + 1 :])) for i, k in enumerate(range(0, 400, 2))]
    monkeypatch.setattr(near_dedup, "BLOCK", 10)
    sent = []
    real = near_dedup._compared
    monkeypatch.setattr(near_dedup, "_compared", lambda dealt, sets, t: (sent.append(dealt.select(F.sum(F.size("places"))).first()[0]), real(dealt, sets, t))[1])
    assert groups_of(near_dedup.classes(docs_of(spark, texts))) == {frozenset(range(200))}
    assert sum(sent) <= 20 * (200 + 2 * 20)


def test_buckets_of_the_same_members_are_compared_once(spark, monkeypatch):
    pair = [f"w{i}" for i in range(400)]
    sent = []
    real = near_dedup._compared
    monkeypatch.setattr(near_dedup, "_compared", lambda dealt, sets, t: (sent.append(dealt.select(F.sum(F.size("places"))).first()[0]), real(dealt, sets, t))[1])
    texts = [(1, " ".join(pair)), (2, " ".join(["new", *pair])), (3, "other words of no copy at all here")]
    assert groups_of(near_dedup.classes(docs_of(spark, texts))) == {frozenset([1, 2]), frozenset([3])} and sent == [2]
