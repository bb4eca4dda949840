"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of a lexicon learned from labelled texts (words and word beginnings that toxic texts have far more
often), how near its hits are to words of the second person, capitals, punctuation and spellings that hide words. Labelled rows
of a hash sample are parted by hash: one part finds the lexicon, one fits the trees, one calibrates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialkit.llm import textstats, words
from trialkit.llm.frames import map_texts, small_batches
from trialkit.session import cut

#: fixed values: words of the second person in the languages of the texts
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine euch ihr euer tu te toi ton ta tes vous votre vos tú ti tu tus usted ustedes vosotros".split()
PREFIXES = (5, 6, 7, 8)
FIT_ROWS = 16_000
LEXICON_SIZE = 400
LEAST_TOXIC = 5
LEAST_ODDS = 2.5
NEAR = 4
FEATURES = ("log_words", "hits_log", "hit_density", "weight_density", "best_weight", "kinds", "near_second", "second_density", "capitals", "capital_words", "shout", "punct", "symbols", "obfuscated", "runs")


def second_person() -> np.ndarray:
    text = " ".join(SECOND_PERSON).encode()
    return np.unique(words.split(np.frombuffer(text, np.uint8), np.array([0, len(text)]), words.ALNUM_LOWER).hash)


def _units(found: words.Words) -> list[np.ndarray]:
    """Hashes of whole words and of their beginnings; 0 where there is none."""
    return [found.hash, *(found.prefixes[p] for p in PREFIXES)]


class Lexicon:
    """Learned units with their weights (log odds)."""

    def __init__(self, units: np.ndarray, weights: np.ndarray):
        order = np.argsort(units)
        self.units, self.weights, self.second = units[order], weights[order], second_person()

    def weight_of_words(self, found: words.Words) -> np.ndarray:
        """The largest weight among a word's units, 0 for none."""
        out = np.zeros(len(found.hash))
        if len(self.units):
            for u in _units(found):
                at = np.minimum(np.searchsorted(self.units, u), len(self.units) - 1)
                out = np.maximum(out, np.where(self.units[at] == u, self.weights[at], 0.0))
        return out

    def features(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        found = words.split(data, at, words.ALNUM_LOWER, PREFIXES)
        p = textstats.profile(data, at)
        weight, n = self.weight_of_words(found), np.maximum(found.counts, 1)
        hit, doc = weight > 0, found.doc
        second = np.isin(found.hash, self.second)
        around = np.zeros(len(hit) + 1, np.int64)
        spots = np.flatnonzero(second)
        np.add.at(around, np.maximum(spots - NEAR, found.first[doc[spots]]), 1)
        np.add.at(around, np.minimum(spots + NEAR + 1, found.first[doc[spots] + 1]), -1)
        near = hit & (np.cumsum(around[:-1]) > 0)
        best = np.zeros(len(n))
        full = found.counts > 0
        if full.any():
            best[full] = np.maximum.reduceat(weight, found.first[:-1][full])
        key = words.mix(found.hash[hit] + words.mix(doc[hit].astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))
        _, once = np.unique(key, return_index=True)
        kinds = np.bincount(doc[hit][once], minlength=len(n))
        hits, letters, chars = words.per_document(hit, found.first), np.maximum(p["letters"], 1), np.maximum(p["chars"], 1)
        total = np.bincount(doc, weights=weight, minlength=len(n))
        columns = [
            np.log1p(found.counts), np.log1p(hits), hits / n, total / n, best, kinds, words.per_document(near, found.first) / n, words.per_document(second, found.first) / n,
            p["upper"] / letters, p["capital_words"] / np.maximum(p["words"], 1), p["shout"] / chars, p["punct"] / chars, p["symbols"] / chars, p["mixed_words"] / np.maximum(p["words"], 1), p["runs"] / chars,
        ]
        return np.stack(columns, axis=1).astype(np.float32)


class Trees:
    """Boosted regression trees on binned features, for the logistic loss."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 10):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if len(self.edges) else np.zeros((len(x), 0), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
        self.base = math.log(share / (1 - share))
        if len(y) < 2 * self.least or y.min() == y.max():
            return self
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(x.shape[1])]
        binned, f = self._binned(x), np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            f += self._walk(tree, binned)
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nodes = (1 << self.depth + 1) - 1
        feature, cutoff, value = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes)
        at = np.zeros(len(g), np.int64)
        for level in range(self.depth + 1):
            for node in range((1 << level) - 1, (2 << level) - 1):
                own = at == node
                if not own.any():
                    continue
                gs, hs = g[own].sum(), h[own].sum()
                value[node] = self.rate * gs / (hs + self.ridge)
                if level == self.depth or own.sum() < 2 * self.least:
                    continue
                best = (1e-6, -1, 0)
                for j in range(b.shape[1]):
                    gl = np.cumsum(np.bincount(b[own, j], g[own], self.bins))[:-1]
                    hl = np.cumsum(np.bincount(b[own, j], h[own], self.bins))[:-1]
                    nl = np.cumsum(np.bincount(b[own, j], minlength=self.bins))[:-1]
                    gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                    gain[(nl < self.least) | (own.sum() - nl < self.least)] = 0
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
                if best[1] >= 0:
                    feature[node], cutoff[node] = best[1], best[2]
                    at[own] = np.where(b[own, best[1]] <= best[2], 2 * node + 1, 2 * node + 2)
        return feature, cutoff, value

    def _walk(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feature, cutoff, value = tree
        at = np.zeros(len(b), np.int64)
        for _ in range(self.depth):
            j = feature[at]
            inner = j >= 0
            right = b[np.arange(len(b)), np.maximum(j, 0)] > cutoff[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return value[at]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        return self.base + sum((self._walk(t, b) for t in self.trees), np.zeros(len(x)))


class Isotonic:
    """Monotone calibration by pooling adjacent violators; interpolates between the pools."""

    def __init__(self, margin: np.ndarray, y: np.ndarray):
        order = np.argsort(margin, kind="stable")
        pools: list[list[float]] = []  # sum of labels, rows, lowest and highest margin
        for m, label in zip(margin[order].tolist(), y[order].tolist(), strict=True):
            if pools and pools[-1][3] == m:
                pools[-1][0] += label
                pools[-1][1] += 1
            else:
                pools.append([label, 1.0, m, m])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
        self.x = np.array([v for p in pools for v in (p[2], p[3])])
        self.y = np.array([(p[0] + 0.05) / (p[1] + 0.1) for p in pools for _ in range(2)])

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.x, self.y) if len(self.x) else 1 / (1 + np.exp(-margin))


class Model:
    def __init__(self, lexicon: Lexicon, trees: Trees, calibration: Isotonic):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    @property
    def learned(self) -> bool:
        """Whether scores depend on the text at all; without labels of both kinds they do not."""
        return any((feature >= 0).any() for feature, _, _ in self.trees.trees)

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.clip(self.calibration(self.trees.margin(self.lexicon.features(data, at))), 0, 1)


def _learn_lexicon(rows: DataFrame) -> Lexicon:
    """Units that toxic texts have far more often, from rows of (body, y). Counted by Spark; the best few hundred are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = words.buffers(batch.column(0))
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j in words.slices(at):
                found = words.split(data, at[i : j + 1], words.ALNUM_LOWER, PREFIXES)
                doc = found.doc
                unit, doc = np.concatenate(_units(found)), np.tile(doc, 1 + len(PREFIXES))
                _, once = np.unique(words.mix(unit + words.mix(doc.astype(np.uint64) + np.uint64(0x8CB92BA72F3D8DD7))), return_index=True)
                once = once[unit[once] != 0]
                once = once[np.argsort(unit[once], kind="stable")]
                unit, own = unit[once].view(np.int64), y[i:j][doc[once]]
                begin = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]])) if len(unit) else np.zeros(0, np.int64)
                toxic = np.add.reduceat(own, begin, dtype=np.int64) if len(begin) else np.zeros(0, np.int64)
                size = np.diff(np.concatenate([begin, [len(unit)]]))
                yield pa.RecordBatch.from_arrays([pa.array(unit[begin]), pa.array(toxic), pa.array(size - toxic)], names=["unit", "toxic", "clean"])

    totals = rows.agg(F.sum("y"), F.count(F.lit(1))).first()
    n1, n = int(totals[0] or 0), int(totals[1])
    counts = rows.select("body", "y").mapInArrow(run, "unit long, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / F.lit(n1 - 0.0 + 1)) - F.log((F.col("clean") + 0.5) / F.lit(n - n1 + 1.0))
    best = counts.filter(F.col("toxic") >= LEAST_TOXIC).select("unit", "toxic", odds.alias("w")).filter(F.col("w") >= LEAST_ODDS)
    top = best.orderBy((F.col("w") * F.sqrt("toxic")).desc(), "unit").limit(LEXICON_SIZE).collect()
    return Lexicon(np.array([r["unit"] for r in top], np.int64).view(np.uint64), np.array([r["w"] for r in top], float))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """Learn from about `fit_rows` labelled rows drawn by a hash of the key (all, if there are fewer). The documented bound makes it safe to send
    the drawn labels to all tasks and the features of part of them to the driver. A key on several rows teaches once, by its least text; null texts, keys
    and labels teach nothing."""
    small_batches(docs.sparkSession)
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("double").alias("y"))
    labelled = known.count()
    draw = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit("fit")), 11) / F.lit(float(1 << 53))
    part = F.pmod(F.xxhash64(F.col(key), F.lit("part")), F.lit(20)).alias("part")
    drawn = known.filter(draw < min(1.0, fit_rows / max(1, labelled))).select(F.col(key).alias("__key"), "y", part)
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("body")).join(F.broadcast(drawn), "__key").filter(F.col("body").isNotNull())
    rows = cut(rows.groupBy("__key", "y", "part").agg(F.min("body").alias("body")).drop("__key"))
    lexicon = _learn_lexicon(rows.filter("part < 9"))

    def make():
        def run(data: np.ndarray, at: np.ndarray) -> dict:
            return {"x": [r.tobytes() for r in lexicon.features(data, at)]}

        return run

    made = map_texts(rows.filter("part >= 9"), T.StructType([T.StructField("x", T.BinaryType())]), make, "f", "body", keep_text=False).select("y", "part", "f.x").toPandas()
    made = made.sort_values(["part", "y", "x"])
    x = np.stack([np.frombuffer(b, np.float32) for b in made["x"]]) if len(made) else np.zeros((0, len(FEATURES)), np.float32)
    y, held = made["y"].to_numpy(float), made["part"].to_numpy() >= 16
    trees = Trees().fit(x[~held], y[~held])
    return Model(lexicon, trees, calibrated(trees, x[held], y[held]))


def calibrated(trees: Trees, x: np.ndarray, y: np.ndarray) -> Isotonic:
    """Labels of one kind would give every text the same score, so margins count as they are then."""
    if not trees.trees or not len(y) or y.min() == y.max():
        return Isotonic(np.zeros(0), np.zeros(0))
    return Isotonic(trees.margin(x), y)


def score(docs: DataFrame, model, out: str = "toxicity", text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add the struct `out` with score, 0 to 1: higher, the likelier the label.

    A null text scores like an empty one. Equal texts have equal scores, so do repeated rows. Whole texts are read in slices of about 1 MB. A model
    fitted on no rows, or on one label only, gives every text the same score.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value
        return lambda data, at: {"score": m.score(data, at)}

    return map_texts(docs, T.StructType([T.StructField("score", T.DoubleType())]), make, out, text, keep_text)
