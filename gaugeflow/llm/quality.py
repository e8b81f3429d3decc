"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in a cycle; each step fits a tree of at most three leaves on one
binned feature to the current gradients and adds it, shrunken, to that feature's lookup table. Then the
pairs of features whose grids explain most of what is left are boosted in the same way with trees
of four leaves. A score is the logistic of the sum of one table entry a feature and a pair: two lookups
and an addition, for all rows at once.

Features come from one pass over each whole text: shares of character classes from its bytes, and
counts of words, pairs of words and lines. Fitting takes a bounded sample of labelled rows
(``sample_rows``, the lowest hashes of the id); scoring happens in the rows' own partitions, without a shuffle.

Behaviour: null text counts as empty; its features are zeros. A very long text is read whole. Without labelled rows of both
classes the score is the share of label 1 (0 without rows). An empty table gives an empty result. Repeated rows get equal scores; other
columns are not read. Equal gains go to the first feature and the lowest cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import chunks, ids_and_texts
from gaugeflow.session import ship

SAMPLE_ROWS = 8000
FEATURES = (
    "log_words", "word_length", "longest_word", "upper", "digit", "space", "line_ends", "stops", "commas", "symbols", "bars", "wide",
    "distinct_words", "distinct_pairs", "distinct_lines", "words_per_line", "short_words",
)


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for i, letters in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\v\f\r", b"\n", b".!?", b",;:", b"#*$%&<>@^~=+_/\\{}[]", b"|"), 1):
        table[list(letters)] = i
    table[128:192] = 9
    return table


CLASSES = _classes()


def features(text: str) -> list[float]:
    raw = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(CLASSES[raw], minlength=10) / max(1, len(raw))
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    lines = [x for x in text.split("\n") if x]
    sizes = np.fromiter(map(len, words), np.int64, n)
    return [
        float(np.log1p(n)), float(sizes.mean()), float(sizes.max()), *(float(counts[i]) for i in range(1, 10)),
        len(set(words)) / n, len(set(zip(words, words[1:], strict=False))) / max(1, n - 1), len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), float((sizes <= 3).mean()),
    ]


@dataclass
class Model:
    """Cuts of each feature, its table, and tables of pairs on coarser cuts."""

    constant: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.constant)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, j], side="right")]
        if self.pairs:
            coarse = [np.searchsorted(cuts, x[:, j], side="right") for j, cuts in enumerate(self.pair_cuts)]
            for a, b, table in self.pairs:
                total += table[coarse[a], coarse[b]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def cuts_of(x: np.ndarray, bins: int) -> np.ndarray:
    """Borders between bins of about equal counts."""
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def gain(g: np.ndarray, h: np.ndarray, penalty: float) -> np.ndarray:
    return g * g / (h + penalty)


def best_cut(g: np.ndarray, h: np.ndarray, penalty: float, least: float) -> tuple[float, int]:
    """Gain of the best cut of a run of bins, and the first bin right of it; 0 if no cut leaves ``least`` curvature on both sides."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    found = gain(left_g, left_h, penalty) + gain(all_g - left_g, all_h - left_h, penalty) - gain(all_g, all_h, penalty)
    found = np.where((left_h >= least) & (all_h - left_h >= least), found, 0)
    i = int(np.argmax(found))
    return float(found[i]), i + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, penalty: float, least: float) -> np.ndarray:
    """Values by bin of a tree with three leaves at most."""
    edges = [0, len(g)]
    for _ in range(2):
        options = [(*best_cut(g[a:b], h[a:b], penalty, least), a) for a, b in zip(edges, edges[1:], strict=False)]
        value, cut, a = max(options, key=lambda o: o[0])
        if value <= 0:
            break
        edges = sorted([*edges, a + cut])
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + penalty)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, penalty: float, least: float) -> tuple[float, np.ndarray]:
    """Gain and values by cell of the best tree that cuts one axis and then each side on the other."""
    best, values = 0.0, np.zeros_like(g)
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(gg)):
            total, out = 0.0, np.zeros_like(gg)
            for part in (slice(0, cut), slice(cut, None)):
                pg, ph = gg[part].sum(0), hh[part].sum(0)
                value, at = best_cut(pg, ph, penalty, least)
                total += value + gain(pg.sum(), ph.sum(), penalty)
                for side in (slice(0, at), slice(at, None)) if value > 0 else (slice(None),):
                    out[part, side] = -pg[side].sum() / (ph[side].sum() + penalty)
            total -= gain(gg.sum(), hh.sum(), penalty)
            if total > best:
                best, values = total, out.T if turned else out
    return best, values


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 40, pairs: int = 6, bins: int = 32, pair_bins: int = 8, rate: float = 0.1, penalty: float = 1.0, least: float = 2.0) -> Model:
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(constant=float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    mean = float(y.mean())
    m = Model(constant=float(np.log(mean / (1 - mean))))
    m.cuts = [cuts_of(x[:, j], bins) for j in range(x.shape[1])]
    at = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(m.cuts)]
    m.tables = [np.zeros(len(c) + 1) for c in m.cuts]
    total = np.full(len(y), m.constant)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, table in enumerate(m.tables):
            g, h = slopes()
            step = rate * shallow_tree(np.bincount(at[j], g, len(table)), np.bincount(at[j], h, len(table)), penalty, least)
            table += step
            total += step[at[j]]
    m.pair_cuts = [cuts_of(x[:, j], pair_bins) for j in range(x.shape[1])]
    coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(m.pair_cuts)]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        shape = len(m.pair_cuts[a]) + 1, len(m.pair_cuts[b]) + 1
        return np.bincount(coarse[a] * shape[1] + coarse[b], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(((-pair_tree(grid(a, b, g), grid(a, b, h), penalty, least)[0], a, b) for a in range(x.shape[1]) for b in range(a)))
    m.pairs = [(a, b, np.zeros((len(m.pair_cuts[a]) + 1, len(m.pair_cuts[b]) + 1))) for value, a, b in ranked[:pairs] if value < 0]
    for _ in range(pair_rounds):
        for a, b, table in m.pairs:
            g, h = slopes()
            step = rate * pair_tree(grid(a, b, g), grid(a, b, h), penalty, least)[1]
            table += step
            total += step[coarse[a], coarse[b]]
    # Tables are centred; their means go to the constant.
    for table, rows in zip(m.tables, at, strict=True):
        shift = float(table[rows].mean())
        table -= shift
        m.constant += shift
    return m


def feature_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and x, the array of features, of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([features(t) for t in texts], pa.list_(pa.float64()))], ["doc_id", "x"])

    return ids_and_texts(docs, id_column, text_column).mapInArrow(run, "doc_id long, x array<double>")


def training_sample(docs: DataFrame, labels: DataFrame, label: str, where: Column, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``rows`` labelled rows. Several labels of one id count as the highest."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("double").alias("y"))
    known = known.where(where).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    d = ids_and_texts(docs).join(F.broadcast(known), "doc_id").select("doc_id", "text")  # ``rows`` ids at most
    pairs = feature_rows(d).join(F.broadcast(known), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(rows).select("x", "y").collect()
    return np.array([r["x"] for r in pairs]).reshape(len(pairs), len(FEATURES)), np.array([r["y"] for r in pairs])


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            x = np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sent.value.score(x), pa.float64())], ["doc_id", "score"])

    return ids_and_texts(docs, id_column, text_column).mapInArrow(run, "doc_id long, score double")
