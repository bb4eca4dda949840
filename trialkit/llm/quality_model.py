"""Text quality by a generalised additive model with pairwise interactions.

Every feature has a lookup table over its bins, learned by boosting one small tree on one feature at a time, round after round, with a
small step. Then the pairs of features that explain most of what is left get tables over two coarse bins each, in the same way. A
score is a sum of table entries.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialkit.llm import textstats, words
from trialkit.llm.frames import map_texts

FIT_ROWS = 16_000
FEATURES = (
    "log_words", "word_length", "symbols", "shout", "punct", "digits", "capitals", "capital_words", "distinct", "repeated_lines", "words_a_line", "bare_words", "long_words",
    "beyond_ascii", "one_byte_words", "repeated_threes",
)


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of dense features for each document; a text without words has zeros."""
    found = textstats.blank_words(data, at)
    p = textstats.profile(data, at, found)
    n, chars, letters, lines = (np.maximum(p[k], 1) for k in ("words", "chars", "letters", "lines"))
    h, begin = words.windows(found, 3)
    doc = found.doc[begin]
    key = words.mix(h + words.mix(doc.astype(np.uint64) + np.uint64(0xB492B66FBE98F273)))
    new = np.unique(key, return_index=True)[1]
    threes, distinct = np.bincount(doc, minlength=len(n)), np.bincount(doc[new], minlength=len(n))
    return np.stack([
        np.log1p(p["words"]), p["word_bytes"] / n, p["symbols"] / n, p["shout"] / n, p["punct"] / n, p["digits"] / chars, p["upper"] / letters, p["capital_words"] / n,
        p["distinct"] / n, (p["lines"] - p["new_lines"]) / lines, p["words"] / lines, p["bare_words"] / n, p["long_words"] / n, p["beyond"] / chars, p["one_byte"] / n,
        (threes - distinct) / np.maximum(threes, 1),
    ], axis=1).astype(np.float32)


class Additive:
    """Lookup tables per feature and per chosen pair of features, for the logistic loss."""

    def __init__(self, bins: int = 48, coarse: int = 10, rounds: int = 150, pairs: int = 6, pair_rounds: int = 60, rate: float = 0.1, ridge: float = 2.0, leaves: int = 4):
        self.bins, self.coarse, self.rounds, self.pairs, self.pair_rounds, self.rate, self.ridge, self.leaves = bins, coarse, rounds, pairs, pair_rounds, rate, ridge, leaves
        self.base = 0.0
        self.edges: list[np.ndarray] = []
        self.coarse_edges: list[np.ndarray] = []
        self.tables: np.ndarray = np.zeros((0, bins))
        self.chosen: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []

    def _bins(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Additive:
        share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
        self.base = math.log(share / (1 - share))
        if len(y) < 20 or y.min() == y.max():
            return self
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(x.shape[1])]
        self.coarse_edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.coarse)[1:-1])) for j in range(x.shape[1])]
        b, c = self._bins(x, self.edges), self._bins(x, self.coarse_edges)
        self.tables = np.zeros((x.shape[1], self.bins))
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            for j in range(x.shape[1]):  # one small tree on one feature, in turn
                p = 1 / (1 + np.exp(-f))
                step = self._tree(np.bincount(b[:, j], y - p, self.bins), np.bincount(b[:, j], p * (1 - p), self.bins))
                self.tables[j] += step
                f += step[b[:, j]]
        p = 1 / (1 + np.exp(-f))
        cell = lambda i, j: c[:, i] * self.coarse + c[:, j]
        size = self.coarse * self.coarse

        def gain(i: int, j: int) -> float:
            g, h = np.bincount(cell(i, j), y - p, size), np.bincount(cell(i, j), p * (1 - p), size)
            return float((g**2 / (h + self.ridge)).sum())

        ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda ij: -gain(*ij))
        self.chosen = ranked[: self.pairs]
        self.pair_tables = [np.zeros(size) for _ in self.chosen]
        for _ in range(self.pair_rounds):
            for k, (i, j) in enumerate(self.chosen):
                p = 1 / (1 + np.exp(-f))
                g, h = np.bincount(cell(i, j), y - p, size).reshape(self.coarse, -1), np.bincount(cell(i, j), p * (1 - p), size).reshape(self.coarse, -1)
                step = self._square_tree(g, h).reshape(-1)
                self.pair_tables[k] += step
                f += step[cell(i, j)]
        return self

    def _best_cut(self, g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
        gl, hl, gs, hs = np.cumsum(g)[:-1], np.cumsum(h)[:-1], g.sum(), h.sum()
        gains = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
        k = int(np.argmax(gains)) if len(gains) else 0
        return (float(gains[k]), k + 1) if len(gains) else (0.0, 0)

    def _tree(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Step for each bin from a tree of a few leaves that splits where it gains most."""
        leaves = [(0, len(g))]
        while len(leaves) < self.leaves:
            gains = [(*self._best_cut(g[lo:hi], h[lo:hi]), k) for k, (lo, hi) in enumerate(leaves)]
            best, at, k = max(gains)
            if best <= 1e-9:
                break
            lo, hi = leaves[k]
            leaves[k : k + 1] = [(lo, lo + at), (lo + at, hi)]
        out = np.zeros(len(g))
        for lo, hi in leaves:
            out[lo:hi] = self.rate * g[lo:hi].sum() / (h[lo:hi].sum() + self.ridge)
        return out

    def _square_tree(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Step for each cell: one cut of the first feature, then one of the second on either side."""
        out = np.zeros_like(g)
        _, at = self._best_cut(g.sum(1), h.sum(1))
        for rows in (slice(0, at), slice(at, None)):
            _, across = self._best_cut(g[rows].sum(0), h[rows].sum(0))
            for columns in (slice(0, across), slice(across, None)):
                out[rows, columns] = self.rate * g[rows, columns].sum() / (h[rows, columns].sum() + self.ridge)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        if self.edges:
            b, c = self._bins(x, self.edges), self._bins(x, self.coarse_edges)
            for j in range(x.shape[1]):
                f += self.tables[j][b[:, j]]
            for (i, j), t in zip(self.chosen, self.pair_tables, strict=True):
                f += t[c[:, i] * self.coarse + c[:, j]]
        return 1 / (1 + np.exp(-f))

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.probability(features(data, at))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS) -> Additive:
    """Learn from about `fit_rows` labelled rows drawn by a hash of the key (all, if there are fewer). With that bound the drawn labels are
    sent to all tasks, and the features of the drawn rows (64 bytes each) come to the driver. A key on several rows teaches once, by its least text; null keys and labels teach
    nothing."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("double").alias("y"))
    labelled = known.count()
    draw = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit("fit")), 11) / F.lit(float(1 << 53))
    drawn = known.filter(draw < min(1.0, fit_rows / max(1, labelled))).select(F.col(key).alias("__key"), "y")
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("body")).join(F.broadcast(drawn), "__key")
    rows = rows.groupBy("__key", "y").agg(F.min("body").alias("body")).drop("__key")

    def make():
        return lambda data, at: {"x": [r.tobytes() for r in features(data, at)]}

    made = map_texts(rows, T.StructType([T.StructField("x", T.BinaryType())]), make, "f", "body", keep_text=False).select("y", "f.x").toPandas().sort_values(["y", "x"])
    x = np.stack([np.frombuffer(b, np.float32) for b in made["x"]]) if len(made) else np.zeros((0, len(FEATURES)), np.float32)
    return Additive().fit(x, made["y"].to_numpy(float))


def score(docs: DataFrame, model: Additive, out: str = "quality", text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add the struct `out` with score, 0 to 1: higher, the likelier the label.

    A null text scores like an empty one, on features of zero. Equal texts have equal scores, so do repeated rows. Whole texts are read in slices of
    about 1 MB. A model fitted on too few rows, or on one label only, gives every text the share of that label.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value
        return lambda data, at: {"score": m.score(data, at)}

    return map_texts(docs, T.StructType([T.StructField("score", T.DoubleType())]), make, out, text, keep_text)
