"""Quality classifier (operator 8): a generalised additive model with pairwise interactions.

Features of a whole text are cut into bins; shallow trees, boosted in turn over the features, learn one lookup table a
feature; then small trees over pairs of features learn a table for each of the pairs that explain most of what is left.
A score is the logistic of an intercept plus one table entry per feature and pair: vectorised bin additions.

The model is fitted on the driver, on the features of at most ``SAMPLE`` labelled rows with the smallest hashes of their
id (the bound is documented and a parameter). Every text is scored.

Defined results: null and empty texts have all features 0 and get a score like any other; a null doc_id is not held
out and not trained on; rows labelled twice count once, as the larger label; without both labels among the training
rows the score is their share of label 1, or 0.5 without any; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import BROADCAST_ROWS, crc_mod, give_back, numbered, table

SAMPLE = 20_000
THRESHOLD = 0.3
FOLDS = 5
BINS = 32
PAIR_BINS = 8
PAIRS = 8
ROUNDS = 120
PAIR_ROUNDS = 40
RATE = 0.15
LEAVES = 4
RIDGE = 2.0

#: Common function words of the languages in the corpus; fixed values.
STOP_WORDS = frozenset(
    "the of and to in is that it for was on are as with be by this from at or an not "
    "der die das und ist nicht mit ein eine den dem von zu sich auf für als auch im des "
    "le la les de des et un une est que qui dans pour sur pas par avec au du elle il "
    "el los las y en que del por con para una un es se no su al lo".split()
)

_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LOWER = np.array([97 <= b <= 122 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_END = np.isin(np.arange(256), np.frombuffer(b".,;:?", np.uint8))
_MARK = np.isin(np.arange(256), np.frombuffer(b"#*$%&<>=@^~_{}[]\\/+", np.uint8))
_HIGH = np.array([b >= 128 for b in range(256)])

FEATURES = (
    "words", "chars", "word_length", "word_length_spread", "distinct_words", "adjacent_repeats", "top_word", "stop_words", "capitalised", "upper", "digits",
    "sentence_marks", "odd_marks", "bars", "shouts", "lines", "line_words", "repeated_lines", "repeated_grams", "compressed", "non_ascii", "long_words", "marked_words", "bar_words",
)


def features(text: str | None) -> list[float]:
    """Features of a whole text, in the order of ``FEATURES``."""
    if not text or text.isspace():
        return [0.0] * len(FEATURES)
    data = text.encode("utf-8", "surrogatepass")
    raw = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = text.split()
    n, size = len(words), len(data)
    sizes = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lowered = [w.strip(".,;:!?").lower() for w in counts]
    stops = sum(c for w, c in zip(lowered, counts.values(), strict=True) if w in STOP_WORDS)
    capital = sum(c for w, c in counts.items() if w[0].isupper())
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    names = {w: i for i, w in enumerate(counts)}
    ids = np.fromiter(map(names.__getitem__, words), np.int64, n)
    grams = ids[:-2] * len(names) ** 2 + ids[1:-1] * len(names) + ids[2:] if n > 2 else ids[:0]
    upper, lower = raw[_UPPER].sum(), raw[_LOWER].sum()
    marked = sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:?\"')")
    return [
        float(np.log1p(n)),
        float(np.log1p(size)),
        float(sizes.mean()),
        float(sizes.std()),
        len(counts) / n,
        float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0,
        max(counts.values()) / n,
        stops / n,
        capital / n,
        float(upper / max(1, upper + lower)),
        float(raw[_DIGIT].sum() / size),
        float(raw[_END].sum() / n),
        float(raw[_MARK].sum() / size),
        float(raw[124] / n),
        float(raw[33] / n),
        float(np.log1p(len(lines))),
        float(np.log1p(n / len(lines))),
        1 - len(set(lines)) / len(lines),
        1 - len(np.unique(grams)) / len(grams) if len(grams) else 0.0,
        len(zlib.compress(data, 1)) / size,
        float(raw[_HIGH].sum() / size),
        float((sizes > 20).mean()),
        marked / n,
        counts.get("|", 0) / n,
    ]


@dataclass
class Model:
    """Bin edges and tables; ``pairs`` holds (i, j, table)."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, values in enumerate(self.tables):
            total += values[np.searchsorted(self.edges[j], x[:, j], side="right")]
        if self.pairs:
            coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.pair_edges)]
            for i, j, values in self.pairs:
                total += values[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _quantile_edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(gradient: np.ndarray, hessian: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf value of each bin of a tree with up to ``leaves`` leaves over ordered bins, grown by best gain."""
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(hessian)])
    value = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + RIDGE)

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        cuts = np.arange(a + 1, b)
        gains = value(a, cuts) + value(cuts, b) - value(a, b)
        k = int(gains.argmax())
        return float(gains[k]), int(cuts[k])

    parts = [(*best(0, len(gradient)), 0, len(gradient))]
    while len(parts) < leaves:
        gain, at, a, b = max(parts)
        if gain <= 1e-9:
            break
        parts.remove((gain, at, a, b))
        parts += [(*best(a, at), a, at), (*best(at, b), at, b)]
    out = np.zeros(len(gradient))
    for _, _, a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree that cuts both axes of a two-way table once."""
    cg, ch = np.zeros((g.shape[0] + 1, g.shape[1] + 1)), np.zeros((g.shape[0] + 1, g.shape[1] + 1))
    cg[1:, 1:], ch[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = cg[1:-1, 1:-1], ch[1:-1, 1:-1]
    if not a.size:
        return 0.0, np.zeros_like(g)
    row_g, row_h, col_g, col_h, all_g, all_h = cg[1:-1, -1:], ch[1:-1, -1:], cg[-1:, 1:-1], ch[-1:, 1:-1], cg[-1, -1], ch[-1, -1]
    parts = [(a, b), (row_g - a, row_h - b), (col_g - a, col_h - b), (all_g - row_g - col_g + a, all_h - row_h - col_h + b)]
    gain = sum(x**2 / (y + RIDGE) for x, y in parts) - all_g**2 / (all_h + RIDGE)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    values = [x[i, j] / (y[i, j] + RIDGE) for x, y in parts]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS) -> Model:
    """The tables of every feature, then of the ``pairs`` pairs whose best tree gains most on the residuals."""
    model = Model()
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        model.base = float(np.log(share / (1 - share)))
        return model
    y = y.astype(float)
    model.base = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(len(y), model.base)
    model.edges = [_quantile_edges(c, BINS) for c in x.T]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    binned = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T, strict=True)]
    for _ in range(rounds):
        for j, bins in enumerate(binned):
            p = 1 / (1 + np.exp(-total))
            step = RATE * _tree(np.bincount(bins, y - p, len(model.tables[j])), np.bincount(bins, p * (1 - p), len(model.tables[j])), LEAVES)
            model.tables[j] += step
            total += step[bins]
    model.pair_edges = [_quantile_edges(c, PAIR_BINS) for c in x.T]
    coarse = [np.searchsorted(e, c, side="right") for e, c in zip(model.pair_edges, x.T, strict=True)]

    def two_way(i: int, j: int) -> tuple[float, np.ndarray]:
        p, shape = 1 / (1 + np.exp(-total)), (len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)
        cell = coarse[i] * shape[1] + coarse[j]
        return _quadrants(np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape))

    ranked = sorted(((two_way(i, j)[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)[:pairs]
    tables = {(i, j): np.zeros((len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)) for gain, i, j in ranked if gain > 0}
    for _ in range(PAIR_ROUNDS):
        for (i, j), values in tables.items():
            step = RATE * two_way(i, j)[1]
            values += step
            total += step[coarse[i], coarse[j]]
    model.pairs = [(i, j, values) for (i, j), values in tables.items()]
    return model


def training_ids(labels: DataFrame, label: str, held_out_mod: int, held_out: int, most: int, doc_id: str = "doc_id") -> DataFrame:
    """At most ``most`` labelled ids outside the held-out fold, those with the smallest hashes; one row per id."""
    rows = labels.filter(F.col(label).isNotNull() & (crc_mod(doc_id, held_out_mod) != held_out))
    rows = rows.groupBy(F.col(doc_id).alias("train_id")).agg(F.max(label).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("train_id"), "train_id").limit(most)


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, fold: int, most: int) -> DataFrame:
    """Whole texts of the training rows with their labels; the broadcast side is at most ``most`` ids."""
    chosen = training_ids(labels, label, modulus, fold, most)
    side = F.broadcast(chosen) if most <= BROADCAST_ROWS else chosen
    return docs.select("doc_id", "text").join(side, F.col("doc_id") == F.col("train_id")).select("text", "label", F.xxhash64("text").alias("turn"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Model:
    """Features are made by the tasks; at most ``most`` rows of numbers reach the driver, the same ones in every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), *batch.columns[1:]], ["x", "label", "turn"])
            give_back()

    rows = labelled_rows(docs, labels, label, FOLDS, 0, most).mapInArrow(run, "x array<double>, label int, turn long")
    rows = rows.orderBy("turn", "label", "x").limit(most).toArrow()  # more than that only if ids repeat
    x = np.array(rows["x"].to_pylist(), float).reshape(rows.num_rows, len(FEATURES))
    order = np.lexsort((*x.T, rows["label"].to_numpy()))  # the fit doesn't depend on the order in which tasks end
    return fit(x[order], rows["label"].to_numpy()[order])


def score(docs: DataFrame, model: Model, carry: list[str], text: str = "text") -> DataFrame:
    """The columns ``carry`` with the score of each whole text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(batch.num_columns - 1)], float).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shipped.value.score(x), pa.float64())], [*carry, "score"])
            give_back()

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*carry, F.col(text).alias("graphloom_text")).mapInArrow(run, ", ".join(x for x in (schema, "score double") if x))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` that score the threshold or more, all columns kept."""
    rows, names = numbered(docs)
    scored = score(rows, train(docs, labels), names, names[docs.columns.index("text")])
    return scored.filter(F.col("score") >= threshold).select(*names).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    held = F.coalesce(crc_mod("doc_id", FOLDS) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
