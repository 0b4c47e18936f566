"""Toxicity (operator 1): a linear-chain conditional random field tags toxic spans.

Labels are per document, so tokens are labelled first: a token of a toxic training document is toxic if its word or one
of its prefixes occurs far more often in toxic than in other training documents. A two-state chain is then fitted to
the labelled tokens, with words, prefixes and suffixes as features. Forward and backward passes over a whole text give
each token's marginal; the marginals add up to a document score by a logistic fit to the document labels, and tokens at
0.5 or more give the offending offsets.

The model is fitted on the driver on at most ``SAMPLE`` ids of either label, those with the smallest hashes, whatever
the length of their texts; of a text of more than ``SEGMENTS`` segments (of ``SEGMENT`` tokens) so many are taken, evenly
spaced over all of it. Both bounds are parameters. Every text is scored whole. Offsets count the characters of the text.

Defined results: null and empty texts have no tokens and get the score of no evidence; a null doc_id is not held out and
not trained on; rows labelled twice count once, as the larger label; without both labels among the training rows every
score is 0; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import crc_mod, give_back, table

SAMPLE = 2_000
SEGMENTS = 64
FOLDS = 4
HELD_OUT = 2
THRESHOLD = 0.3
#: A feature marks tokens as toxic if it is in so many toxic training documents (and such a share of them), texts
#: of the same words counted once, and so many times likelier there.
MIN_TOXIC_DOCS = 4
MIN_TOXIC_SHARE = 0.01
MIN_LOG_RATIO = 3.0
SEGMENT = 64
#: Features of fewer training tokens get no weight.
MIN_SUPPORT = 4
STEPS = 50
RIDGE = 0.5
SLICE_CHARS = 2 << 20
CACHE_WORDS = 500_000

_TOKEN = re.compile(r"\w+")


def tokens_of(text: str | None) -> list[str]:
    """The words of a text, lower-cased one by one, so that they are those at the text's own offsets."""
    found = _TOKEN.findall(text) if text else []
    return " ".join(found).lower().split(" ") if found else []


def spaced_segments(text: str | None, most: int = SEGMENTS) -> str:
    """The words of a text with a space between them; of a longer one ``most`` segments, evenly spaced."""
    words = tokens_of(text)
    n = -(-len(words) // SEGMENT)
    if n > most:
        words = [w for i in range(most) for w in words[i * n // most * SEGMENT : (i * n // most + 1) * SEGMENT]]
    return " ".join(words)


def token_features(word: str) -> list[str]:
    out = ["w" + word]
    out += [f"p{word[:n]}" for n in (3, 4, 5, 6) if len(word) > n]
    if len(word) > 4:
        out.append("s" + word[-4:])
    return out


@dataclass
class Chain:
    """Weights of state 1 against state 0; ``moves[a, b]`` scores going from state a to b."""

    bias: float = -20.0
    weights: dict[str, float] = field(default_factory=dict)
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(5))

    def emissions(self, words: Sequence[str], cache: dict[str, float]) -> np.ndarray:
        get, weights = cache.get, self.weights

        def one(word: str) -> float:
            found = get(word)
            if found is None:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                found = cache[word] = self.bias + sum(weights.get(f, 0.0) for f in token_features(word))
            return found

        return np.fromiter(map(one, words), float, len(words))


def marginals(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(state 1) of every token of several chains that stand one after the other, and the summed pair marginals.

    Chains advance together, longest first, so that a step costs one vector operation over those still running. Ratios
    of the two states' messages are kept instead of the messages: they neither under- nor overflow.
    """
    order = np.argsort(-lengths, kind="stable")
    lengths_sorted, first = lengths[order], (np.cumsum(lengths) - lengths)[order]
    t, x = np.exp(np.clip(moves, -30, 30)), np.exp(np.clip(emissions, -30, 30))
    longest = int(lengths_sorted[0]) if len(lengths) else 0
    running = np.searchsorted(-lengths_sorted, -np.arange(longest), side="left")  # chains longer than each step
    forward, backward = np.empty(len(x)), np.ones(len(x))
    for step in range(longest):
        at = first[: running[step]] + step
        if step == 0:
            forward[at] = x[at]
        else:
            r = forward[at - 1]
            forward[at] = x[at] * (t[0, 1] + t[1, 1] * r) / (t[0, 0] + t[1, 0] * r)
    for step in range(longest - 2, -1, -1):
        at = first[: running[step + 1]] + step
        y = x[at + 1] * backward[at + 1]
        backward[at] = (t[1, 0] + t[1, 1] * y) / (t[0, 0] + t[0, 1] * y)
    odds = forward * backward
    pairs = np.zeros((2, 2))
    inner = np.ones(len(x), bool)
    inner[(np.cumsum(lengths) - 1)[lengths > 0]] = False
    at = np.flatnonzero(inner)
    r, y = forward[at], x[at + 1] * backward[at + 1]
    cells = np.stack([np.full(len(at), t[0, 0]), t[0, 1] * y, t[1, 0] * r, t[1, 1] * r * y])
    pairs[:] = (cells / cells.sum(0)).sum(1).reshape(2, 2)
    return odds / (1 + odds), pairs


class Words:
    """Tokenised texts as numbers of distinct words, to keep the driver's share small."""

    def __init__(self, texts: Sequence[str | None]):
        index: dict[str, int] = {}
        self.texts = [np.fromiter((index.setdefault(w, len(index)) for w in tokens_of(t)), np.int32) for t in texts]
        self.words = list(index)


def label_tokens(corpus: Words, toxic: np.ndarray) -> list[np.ndarray]:
    """0/1 per token: in toxic documents, tokens with a word or prefix that those have far more often."""
    groups, distinct = set(), {True: [], False: []}
    for text, bad in zip(corpus.texts, toxic.tolist(), strict=True):
        words = np.unique(text)
        copy = (bad, hashlib.blake2b(words.tobytes(), digest_size=16).digest())
        if copy not in groups:
            groups.add(copy)
            distinct[bad].append(words)
    n_bad, n_good = len(distinct[True]), len(distinct[False])
    held = Counter(f for words in distinct[True] for f in {f for w in words.tolist() for f in token_features(corpus.words[w]) if f[0] != "s"})
    least = max(MIN_TOXIC_DOCS, MIN_TOXIC_SHARE * n_bad)
    held = {f: c for f, c in held.items() if c >= least}
    clean: Counter[str] = Counter()
    for words in distinct[False]:
        clean.update({f for w in words.tolist() for f in token_features(corpus.words[w]) if f in held})
    marks = {f for f, c in held.items() if np.log((c + 0.5) / (n_bad + 1)) - np.log((clean[f] + 0.5) / (n_good + 1)) >= MIN_LOG_RATIO}
    marked = np.array([any(f in marks for f in token_features(w)) for w in corpus.words], np.int64)
    return [marked[t] if bad else np.zeros(len(t), np.int64) for t, bad in zip(corpus.texts, toxic, strict=True)]


def fit_chain(corpus: Words, tags: Sequence[np.ndarray], steps: int = STEPS) -> Chain:
    """Maximum likelihood with a ridge, by Adam over segments: all that hold a toxic token, and four others for each."""
    hot, cold = [], []
    for text, tag in zip(corpus.texts, tags, strict=True):
        for a in range(0, len(text), SEGMENT):
            (hot if tag[a : a + SEGMENT].any() else cold).append((text[a : a + SEGMENT], tag[a : a + SEGMENT]))
    parts = hot + cold[:: max(1, len(cold) // max(1, 4 * len(hot)))]
    word, y = np.concatenate([p for p, _ in parts]), np.concatenate([t for _, t in parts])
    lengths = np.array([len(p) for p, _ in parts])
    often = np.bincount(word, minlength=len(corpus.words))
    support: Counter[str] = Counter()
    for w in np.flatnonzero(often).tolist():
        for f in token_features(corpus.words[w]):
            support[f] += int(often[w])
    index = {f: i for i, f in enumerate(f for f, c in support.items() if c >= MIN_SUPPORT)}
    del support
    of_word, feature = [], []
    for w in np.flatnonzero(often).tolist():
        for f in token_features(corpus.words[w]):
            if f in index:
                of_word.append(w)
                feature.append(index[f])
    of_word, feature = np.array(of_word, np.int64), np.array(feature, np.int64)
    inner = np.ones(len(y), bool)
    inner[np.cumsum(lengths) - 1] = False
    at = np.flatnonzero(inner)
    pair_seen = np.bincount(2 * y[at] + y[at + 1], minlength=4).astype(float)
    theta = np.zeros(len(index) + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        strength = np.bincount(of_word, theta[feature], len(often)) + theta[len(index)]
        p, pairs = marginals(strength[word], lengths, theta[-4:].reshape(2, 2))
        error = np.bincount(word, y - p, len(often))
        grad = np.concatenate([np.bincount(feature, error[of_word], len(index)), [error.sum()], pair_seen - pairs.ravel()]) - RIDGE * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    weights = {f: float(theta[i]) for f, i in index.items() if abs(theta[i]) > 1e-3}
    return Chain(float(theta[len(index)]), weights, theta[-4:].reshape(2, 2).copy())


def evidence(p: np.ndarray) -> list[float]:
    """What a document's marginals add up to: 1, log of their sum, the largest, their share, the sum of the confident."""
    if not len(p):
        return [1.0, 0.0, 0.0, 0.0, 0.0]
    total = float(p.sum())
    return [1.0, float(np.log1p(total)), float(p.max()), min(1.0, 10 * total / len(p)), float(np.log1p((p > 0.5).sum()))]


def fit(texts: Sequence[str | None], toxic: Sequence[int]) -> Chain:
    toxic = np.array(toxic, bool)
    if not len(toxic) or toxic.all() or not toxic.any():
        return Chain()
    corpus = Words(texts)
    tags = label_tokens(corpus, toxic)
    if not any(t.any() for t in tags):
        return Chain()
    chain = fit_chain(corpus, tags)
    strength, x = chain.emissions(corpus.words, {}), []
    for start in range(0, len(corpus.texts), 200):
        part = corpus.texts[start : start + 200]
        lengths = np.array([len(t) for t in part])
        p, _ = marginals(strength[np.concatenate(part)], lengths, chain.moves)
        x += [evidence(q) for q in np.split(p, np.cumsum(lengths)[:-1])]
    x = np.array(x)
    y, beta = toxic.astype(float), np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps of a ridge logistic fit
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta += np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + 0.1 * np.eye(len(beta)), x.T @ (y - q) - 0.1 * beta)
    chain.scale = beta
    return chain


def score_texts(texts: Sequence[str | None], chain: Chain, cache: dict[str, float]) -> list[tuple[float, list[tuple[int, int]]]]:
    """(score, character spans of toxic tokens) of each whole text."""
    words = [tokens_of(t) for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    if not len(chain.weights):
        return [(0.0, []) for _ in texts]
    p, _ = marginals(chain.emissions([w for ws in words for w in ws], cache), lengths, chain.moves) if lengths.sum() else (np.zeros(0), None)
    out = []
    for text, q in zip(texts, np.split(p, np.cumsum(lengths)[:-1]), strict=True):
        score = 1 / (1 + np.exp(-np.clip(float(np.dot(evidence(q), chain.scale)), -30, 30)))
        spans: list[tuple[int, int]] = []
        if len(q) and q.max() >= 0.5:
            hot = q >= 0.5
            for k, match in enumerate(_TOKEN.finditer(text)):
                if hot[k]:
                    spans.append(match.span())
        out.append((float(score), spans))
    return out


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE, segments: int = SEGMENTS) -> DataFrame:
    """doc_id, text and label of at most ``most`` ids of either label outside the held-out fold; long texts in segments."""
    rows = labels.filter(F.col(label).isNotNull() & (crc_mod("doc_id", FOLDS) != HELD_OUT)).groupBy(F.col("doc_id").alias("train_id")).agg(F.max(label).cast("int").alias("label"))
    texts = docs.select("doc_id", "text")
    rows = rows.join(texts.select("doc_id"), F.col("train_id") == F.col("doc_id"), "left_semi")
    chosen = None
    for value in (0, 1):
        part = rows.filter(F.col("label") == value).orderBy(F.xxhash64("train_id"), "train_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    found = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("train_id")).select("doc_id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([spaced_segments(t.as_py(), segments) for t in batch.column(2)], pa.string())], ["doc_id", "label", "text"])

    return found.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, text string")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE, segments: int = SEGMENTS) -> Chain:
    """The model; at most ``2 * most`` rows of ``segments`` segments reach the driver, the same ones in every run."""
    rows = training_rows(docs, labels, label, most, segments).dropDuplicates(["doc_id", "label", "text"])
    rows = rows.orderBy(F.xxhash64("text"), "text", "doc_id").limit(2 * most).toArrow()  # more only if ids repeat
    data = sorted(zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist(), rows["label"].to_pylist(), strict=True))
    return fit([r[1] for r in data], [r[2] for r in data])


def score(docs: DataFrame, chain: Chain, carry: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``carry`` with the score of each whole text and the character spans of its toxic tokens."""
    shipped, carry = docs.sparkSession.sparkContext.broadcast(chain), list(carry)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            texts, start = batch.column(batch.num_columns - 1).to_pylist(), 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and (end == start or size + len(texts[end] or "") <= SLICE_CHARS):
                    size += len(texts[end] or "")
                    end += 1
                rows = score_texts(texts[start:end], shipped.value, cache)
                spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in rows], kind)
                yield pa.RecordBatch.from_arrays([*batch.slice(start, end - start).columns[:-1], pa.array([r[0] for r in rows], pa.float64()), spans], [*carry, "score", "spans"])
                start = end
            give_back()

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*carry, F.col(text).alias("graphloom_text")).mapInArrow(run, ", ".join(x for x in (schema, "score double, spans array<struct<start:long,end:long>>") if x))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
