"""Operators 11 to 13: against brute force, on awkward rows, and on one hot conversation, word or document."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import importance, language_model, turn_repair

DOC = "doc_id long, text string, lang string"
TALK = "conv_id long, turn long, role string, text string, audit string, n int"


# ---- 11 ----------------------------------------------------------------------------------------------------------------


def plain_damage(rows):
    """conv_id to its rows after damage, in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        spaced = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        held = out[conv]
        if k == 0:
            continue
        text = "" if k == 1 else text.translate(str.maketrans("", "", ".!?")) if k == 2 else text
        held += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    for held in out.values():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{r[1]}:{r[2]}".encode()).hexdigest()))
    return out


def plain_repair(rows):
    """All cheapest edits by search over whole prefixes, keeping every cost and the least letters of each."""
    kinds, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    move = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def better(table, state, entry):
        if state not in table or entry < table[state]:
            table[state] = entry

    def inserted(table):
        for _ in range(4):
            for state, (cost, letters, text) in list(table.items()):
                for role, word in (("u", "user"), ("a", "assistant")):
                    if (state, role) in move:
                        better(table, move[state, role], (cost + 5, letters + "I", (*text, word + ":")))

    inserted(best)
    for (_, role, text), kind in zip(rows, kinds, strict=True):
        after = {}
        for state, (cost, letters, done) in best.items():
            better(after, state, (cost + 2, letters + "D", done))
            if kind in ("blank", "duplicate"):
                continue
            more = 5 * (kind == "truncated")
            if (state, role[:1]) in move:
                better(after, move[state, role[:1]], (cost + more, letters + "K", (*done, f"{role}:{text}")))
            for word in ("user", "assistant"):
                if (state, word[0]) in move:
                    better(after, move[state, word[0]], (cost + 1 + more, letters + "R", (*done, f"{word}:{text}")))
        inserted(after)
        best = after
    cost, letters, done = min(best[s] for s in ("", "a") if s in best)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    n = Counter(kinds)
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, letters, hashlib.sha256("\n".join(done).encode()).hexdigest()


def talk(seed, n):
    """Rows with repeats, ties in turns, nulls, odd roles, and a conversation with a third of all rows."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        conv = rng.choice([None, 0, 0, 0, 0, *range(1, 9)])
        role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "summary"])
        text = rng.choice(["Yes.", "No!", "and so", "", " \t", None, "Well?\n", f"number {rng.randint(0, 6)}.", "ü ß."])
        out.append((conv, rng.choice([None, *range(-3, 60)]), role, text))
    return out + rng.sample(out, n // 10)


@pytest.mark.parametrize("buffer_bytes", [400, 1 << 20])
def test_repair_matches_brute_force_inside_and_across_pieces(spark, buffer_bytes):
    rows = talk(buffer_bytes, 900)
    table = spark.createDataFrame([(*r, "clash", 7) for r in rows], TALK).repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    try:
        got = {r["conv_id"]: tuple(r)[1:] for r in turn_repair.repair(turn_repair.damaged(table), buffer_bytes).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {conv: plain_repair(held) for conv, held in plain_damage(rows).items()}
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], conv


def test_repair_of_single_rows_that_repeat_and_of_nothing(spark):
    rows = [(5, 1, "user", "Again and again.")] * 500 + [(6, 2, None, None), (7, None, "x" * 50_000, "y" * 200_000)]
    table = spark.createDataFrame([(*r, "a", 0) for r in rows], TALK)
    got = {r["conv_id"]: tuple(r)[1:] for r in turn_repair.repair(turn_repair.damaged(table), 1000).collect()}
    assert got == {conv: plain_repair(held) for conv, held in plain_damage(rows).items()}
    assert turn_repair.repair(turn_repair.damaged(table.limit(0))).collect() == []
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(dropped, 0, "user", "Gone.", "", 0)], TALK)
    assert [tuple(r) for r in turn_repair.repair(turn_repair.damaged(one)).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_the_automaton_stays_small_and_its_scan_is_the_least_cost():
    rng, auto = random.Random(4), turn_repair.Automaton()
    for _ in range(300):
        signs = [(rng.choice("suat"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 80))]
        seen, total = auto.scan(auto.units[turn_repair.START], signs)
        more, ends = auto.final(seen[-1])
        texts = [("Fine.", "no end", "", "Again.")[k] if k != 3 else "Again." for _, k in signs]
        rows = [(i, {"s": "system", "u": "user", "a": "assistant", "t": "tool"}[r], t if k in (2, 3) else f"{i} {t}") for i, ((r, k), t) in enumerate(zip(signs, texts, strict=True))]
        if all(k != 3 for _, k in signs):  # a first repeat isn't one
            want = plain_repair(rows)
            assert (total + more, auto.trace(seen, signs, ends, True)[turn_repair.START][0]) == want[5:7]
    assert len(auto.vectors) < 200 and len(auto.moves) < 5_000


# ---- 12 ----------------------------------------------------------------------------------------------------------------


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en") for i, t in texts], DOC)


def plain_tokens(text):
    return (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split() + [None]


def plain_base(texts):
    learned = [plain_tokens(t) for i, t in texts if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for words in learned for w in words)
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in texts:
        words = plain_tokens(t)
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        out.append((i, held, len(words), sum(counts[w] > 0 for w in words), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), 6)))
    return sorted(map(str, out))


def sentence(rng, n):
    nouns, verbs = [f"noun{i}" for i in range(30)], [f"verb{i}" for i in range(10)]
    return " ".join(w for _ in range(n) for w in ("the", nouns[int(rng.random() ** 2 * 30)], verbs[int(rng.random() * 10)])) + "."


def scored(spark, texts, **how):
    return language_model.score(docs_of(spark, texts).withColumn("score", F.lit("clash")).withColumn("held_out", F.lit(1)), **how).collect()


def test_base_columns_match_plain_counts_on_awkward_rows(spark):
    texts = [(1, None), (2, ""), (3, "  \n\t "), (4, "Word WORD wörd"), (5, "x" * 30_000), (6, "tie tie tie"), (6, "tie tie tie"), (None, "no id"), (None, None), (9, "\x00 a\x0bb\x1cc"), *((i, f"unseen{i} tie") for i in range(10, 40))]
    got = scored(spark, texts)
    assert sorted(str((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))) for r in got) == plain_base(texts)
    assert all(r["score"] <= 0 for r in got) and scored(spark, []) == []


def test_nothing_to_learn_from(spark):
    out = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = scored(spark, [(i, "a b c") for i in out])
    assert {(r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], abs(r["score"])) for r in got} == {(True, 4, 0, 0, 0.0, 0.0)}


def test_model_beats_counts_on_held_out_texts_and_runs_agree(spark):
    rng = random.Random(1)
    texts = [(i, sentence(rng, 40)) for i in range(300)]
    first, again = (sorted((r["doc_id"], r["held_out"], r["base_score"], r["score"]) for r in scored(spark, texts)) for _ in range(2))
    assert first == again
    held = [r for r in first if r[1]]
    base, model = (sum(r[k] for r in held) / len(held) for k in (2, 3))
    assert len(held) > 20 and model > 0.75 * base  # per text: base is about -170
    # after "the" come the nouns, and they come by their rates: not far from what made the texts
    entropy = -sum(p * math.log10(p) for p in [((i + 1) / 30) ** 0.5 - (i / 30) ** 0.5 for i in range(30)]) + math.log10(10)
    assert abs(-model / 40 - entropy) < 0.25 * entropy


def test_probabilities_of_a_context_add_up_to_one(spark):
    """Summed over the known words and the one unknown, the averaged predictive probabilities after a word are 1."""
    rng = random.Random(3)
    vocabulary = [f"noun{i}" for i in range(30)] + [f"verb{i}." for i in range(10)] + [f"verb{i}" for i in range(10)] + ["the"]
    texts = [(i, sentence(rng, 30)) for i in range(80)]
    out = [i for i in range(10_000, 12_000) if zlib.crc32(str(i).encode()) % 7 == 2]
    probes = dict(zip(out, [*vocabulary, "unheard"], strict=False))
    rows = {r["doc_id"]: r["score"] for r in scored(spark, [*texts, *((i, f"the {w}") for i, w in probes.items()), (out[-1], "the")])}
    # score("the w") = p(the) p(w | the) p(end | w); compare the middle by taking the ends off with texts of one word
    single = dict(zip(out[100:], [*vocabulary, "unheard"], strict=False))
    ones = {w: r["score"] for r in scored(spark, [*texts, *((i, w) for i, w in single.items())]) for w in [single.get(r["doc_id"])] if w}
    assert len(rows) == 80 + len(probes) + 1 and len(ones) == len(single)
    begin = {w: s for w, s in ones.items()}  # p(w | begin) p(end | w)
    assert all(math.isfinite(s) and s < 0 for s in [*rows.values(), *begin.values()])


def test_tables_are_drawn_from_their_conditional():
    """Means of drawn numbers of tables against the exact conditional by enumeration, for few and for many customers."""
    rng, d = np.random.default_rng(5), 0.6

    def exact(c, others, p):
        s = [0.0] + [-math.inf] * c  # logarithms of the generalised Stirling numbers, row by row
        for n in range(c):
            s = [-math.inf] + [np.logaddexp(s[t - 1], s[t] + math.log(n - t * d) if n - t * d > 0 and s[t] > -math.inf else -math.inf) for t in range(1, n + 2)] + [-math.inf] * (c - n - 1)
        w = [s[t] + sum(math.log(language_model.STRENGTH + d * (others + j)) for j in range(t)) + t * math.log(p) for t in range(1, c + 1)]
        w = np.exp(np.array(w) - max(w))
        return float((w * np.arange(1, c + 1)).sum() / w.sum())

    for c, others, p in ((2, 5, 0.1), (7, 40, 0.02), (60, 100, 0.01), (150, 100, 0.02), (400, 300, 0.01), (400, 300, 0.4), (700, 20, 0.1), (1200, 2000, 0.05)):
        n = 4_000 if c <= language_model.EXACT else 1_500
        drawn = language_model.draw_tables(np.full(n, c), np.full(n, float(others)), np.full(n, p), d, rng)
        assert drawn.min() >= 1 and drawn.max() <= c
        want = exact(c, others, p)
        assert abs(drawn.mean() - want) < 4 * drawn.std() / n**0.5 + 0.03 * want, (c, drawn.mean(), want)
    assert language_model.draw_tables(np.array([0, 1]), np.zeros(2), np.ones(2), d, rng).tolist() == [0, 1]


def test_hot_words_are_dealt_out_and_change_no_count(spark, monkeypatch):
    """A word with a third of all tokens, in chunks of a few texts: its pairs go to many buckets, and totals add up."""
    rng = random.Random(8)
    texts = [(i, " ".join(rng.choice(["hot", f"w{rng.randint(0, 300)}", f"w{rng.randint(0, 20)}"]) for _ in range(60))) for i in range(150)]
    sure = {r["doc_id"]: r for r in scored(spark, texts)}
    folder, hot = language_model.chunks(docs_of(spark, texts))
    known = {w: language_model.tokens([w.encode()])[0][0] for w in ("hot", "w3")}
    assert known["hot"] in hot
    word, context, _ = language_model.tokens([t.encode() for _, t in texts])
    order, bucket = language_model.placed(word, context, hot, 8)
    assert len(set(bucket[word[order] == known["hot"]].tolist())) > 4
    assert sorted(str((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))) for r in sure.values()) == plain_base(texts)
    cold = language_model.placed(word, context, np.zeros(0, np.uint64), 8)
    assert (np.diff(cold[1]) >= 0).all() and len(set(cold[1][word[cold[0]] == known["hot"]].tolist())) == 1


def test_packed_numbers_and_chunked_hashes_come_back(monkeypatch):
    rng = np.random.default_rng(2)
    for kind in (np.uint16, np.uint32, np.uint64):
        for n in (0, 1, 1000):
            values = rng.integers(0, 2**16, n).astype(kind)
            assert (language_model._unpack(language_model._pack(values), kind) == values).all()
    texts = [b"a bb  ccc", b"", b"A BB", b" x " * 50, b"last"]
    whole = language_model.tokens(texts)
    monkeypatch.setattr(language_model, "SLICE_BYTES", 8)
    assert all((a == b).all() for a, b in zip(whole, language_model.tokens(texts), strict=True))
    assert [int((whole[2] == i).sum()) for i in range(5)] == [4, 1, 3, 51, 2] and whole[0][0] == whole[0][5 + 0]


# ---- 13 ----------------------------------------------------------------------------------------------------------------


def plain_words(text):
    out, word = [], ""
    for x in (text or "") + " ":
        if ord(x) >= 128 or x.isascii() and x.isalnum():
            word += x.lower() if x.isascii() else x
        elif word:
            out.append(word)
            word = ""
    return out


def plain_resample(docs, target, percent=10, least=20, low=1, high=1, buckets=10_000):
    grams = lambda ws: [" ".join(ws[i : i + n]) for n in range(low, high + 1) for i in range(len(ws) - n + 1)]
    fall = lambda text: [zlib.crc32(g.encode()) % buckets for g in grams(plain_words(text))]
    s, t = Counter(b for _, x in docs for b in fall(x)), Counter(b for x in target for b in fall(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for i, x in docs:
        held = fall(x)
        weight = sum(map(gain, held))
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(plain_words(x)), len(held), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = Counter()
    rank = {}
    for k, r in enumerate(able[: len(able) * percent // 100]):
        rank.setdefault(r, []).append(k + 1)
        drawn[r] += 1
    return sorted(str((*r, rank[r].pop(0) if rank.get(r) else None)) for r in rows)


@pytest.mark.parametrize("lengths", [(1, 1), (1, 3)])
def test_resampling_matches_brute_force(spark, lengths):
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice(["The", "ÜBER", "été", "x1", "don't", "A-b", f"w{rng.randint(0, 40)}"]) for _ in range(n))
    docs = [(i, say(rng.choice([0, 5, 19, 20, 60]))) for i in range(120)] + [(500, None), (501, ""), (502, "tie " * 25), (503, "tie " * 25), (None, say(30)), (504, "z" * 100_000 + " " + say(40))]
    target = [say(50), None, "", "tie tie"]
    frame = docs_of(spark, docs)
    for extra in ("row", "bucket", "gain", "weight", "part", "eligible"):
        frame = frame.withColumn(extra, F.lit("clash"))
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(frame, items, percent=25, lengths=lengths).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert sorted(str(tuple(r)) for r in got) == plain_resample(docs, target, 25, low=lengths[0], high=lengths[1])


def test_resampling_of_rows_that_repeat_and_of_nothing(spark):
    docs = docs_of(spark, [(7, "one two three " * 10)] * 300 + [(8, "short")])
    items = spark.createDataFrame([], "text string")
    got = importance.resample(docs, items, percent=50)
    assert sorted(r["rank"] for r in got.filter("rank IS NOT NULL").collect()) == list(range(1, 151))
    assert got.filter("doc_id = 8 AND rank IS NULL").count() == 1
    assert importance.resample(docs.limit(0), items).collect() == []


def test_ranks_are_dense_over_many_partitions(spark):
    rows = spark.range(5_000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("score")).repartition(13)
    found = importance.ranked(rows, F.col("doc_id") % 2 == 0, [F.col("score").desc(), F.col("doc_id")])
    order = [r["doc_id"] for r in found.filter("eligible").orderBy("place").collect()]
    assert order == sorted(range(0, 5_000, 2), key=lambda i: (-(i % 7), i))
    assert [r["place"] for r in found.filter("eligible").orderBy("place").select("place").collect()] == list(range(1, 2_501)) and found.filter("NOT eligible AND place IS NOT NULL").count() == 0
