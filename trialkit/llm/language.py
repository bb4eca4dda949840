"""Language identification by the nearest of several centroids per language.

A text becomes a vector of hashed three-byte grams of its lower-cased letters: damped counts times inverse document frequency, scaled to
length one. Each language has a few centroids from spherical k-means. The nearest centroid by cosine names the language; a text
farther from it than anything learned, by a margin, is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialkit.llm import words
from trialkit.llm.frames import map_texts, small_batches
from trialkit.session import cut

DIMENSIONS = 2048
FIT_ROWS = 800
CENTROIDS = 3
#: a floor is this part of that quantile of the length-adjusted cosines of a language's sample
REJECT_MARGIN = 0.85
REJECT_QUANTILE = 0.01
FULL_GRAMS = 200
_DOCS = 1_000
_BYTES = 1 << 20
#: bytes of a letter (A-Z lower-cased, everything beyond ASCII) or 0 for what stands between words
LETTERS = words.table(lambda b: 0x61 <= b <= 0x7A or b >= 0x80, lower=True)


def gram_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts of hashed grams, one row per document. A gram has a letter in its middle; the ends of a text count as spaces."""
    n = len(at) - 1
    out = np.zeros(n * DIMENSIONS, np.int64)
    for lo in range(int(at[0]), int(at[-1]), _BYTES):
        hi = min(lo + _BYTES, int(at[-1]))
        spot = np.arange(lo, hi)
        doc = np.searchsorted(at, spot, side="right") - 1
        c = LETTERS[data[max(lo - 1, 0) : hi + 1]].astype(np.uint64)
        c = np.concatenate([np.zeros(int(lo == 0), np.uint64), c, np.zeros(hi - lo + 2, np.uint64)])
        before, middle, after = c[: hi - lo].copy(), c[1 : hi - lo + 1], c[2 : hi - lo + 2].copy()
        before[spot == at[doc]] = 0
        after[spot + 1 == at[doc + 1]] = 0
        ok = middle > 0
        h = before[ok] + middle[ok] * np.uint64(257) + after[ok] * np.uint64(66049)
        bucket = (words.mix(h) >> np.uint64(53)).astype(np.int64)
        out += np.bincount(doc[ok] * DIMENSIONS + bucket, minlength=len(out))
    return out.reshape(n, DIMENSIONS)


def _blocks(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    for i in range(0, len(at) - 1, _DOCS):
        j = min(i + _DOCS, len(at) - 1)
        yield i, j, gram_counts(data, at[i : j + 1])


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts).astype(np.float32) * idf
    length = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(length > 0, length, 1)


def patience(counts: np.ndarray) -> np.ndarray:
    """Texts of fewer than 200 grams are farther from any centroid by their size alone; their floor is lower."""
    return np.sqrt(np.minimum(1, counts.sum(1) / FULL_GRAMS))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and of texts with each gram, over all of them: one small table of sums for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            data, at = words.buffers(batch.column(0))
            for i, j in words.slices(at):
                for _, _, counts in _blocks(data, at[i : j + 1]):
                    total += (counts > 0).sum(0)
                    seen += len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS)), pa.array(np.concatenate([[seen], total]))], names=["gram", "texts"])

    out = np.zeros(DIMENSIONS + 1, np.int64)
    for gram, n in texts.mapInArrow(run, "gram long, texts long").groupBy("gram").agg(F.sum("texts")).collect():  # 2,049 rows
        out[gram + 1] = n
    return int(out[0]), out[1:]


def _cluster(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; it starts from equal runs of the texts along their main direction, so a few odd texts make no centroid of their own."""
    off = v - v.mean(0)
    axis = off[int(np.argmax((off * off).sum(1)))]
    for _ in range(20):
        axis = off.T @ (off @ axis)
        axis = axis / max(float(np.linalg.norm(axis)), 1e-12)
    runs = np.array_split(np.argsort(off @ axis, kind="stable"), min(k, len(v)))
    c = np.stack([v[r].sum(0) for r in runs])
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    for _ in range(12):
        near = np.argmax(v @ c.T, axis=1)
        new = np.stack([v[near == i].sum(0) if (near == i).any() else c[i] for i in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c, atol=1e-5):
            break
        c = new
    return c.astype(np.float32)


MODEL = "lang string, centroid binary, floor double"


class Model:
    """Centroids with their languages and rejection floors, and the weights of the grams."""

    def __init__(self, rows: list, idf: np.ndarray):
        self.idf = idf
        rows = sorted(rows, key=lambda r: (r[0], r[1]))
        self.langs = [r[0] for r in rows]
        self.centroids = np.stack([np.frombuffer(r[1], np.float32) for r in rows]) if rows else np.zeros((0, DIMENSIONS), np.float32)
        self.floors = np.array([r[2] for r in rows])


def fit(docs: DataFrame, key: str, text: str, lang: str, fit_rows: int = FIT_ROWS, centroids: int = CENTROIDS) -> Model:
    """Learn from all rows with text, letters and language. Gram frequencies cover all of them; the centroids of each language come from
    a hash sample of about `fit_rows` rows of it, clustered in a task per language. The floor of its centroids is a low quantile of what all texts of
    that sample, short ones too, reach after the adjustment to their length. Rows without text, letters or language teach nothing; no such rows give a
    model without languages. Repeated rows count as often as they stand there.
    """
    small_batches(docs.sparkSession)
    known = docs.filter(F.col(lang).isNotNull() & has_letter(F.col(text))).select(key, F.col(text).alias("body"), F.col(lang).alias("lang"))
    counted = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counted:
        return Model([], np.ones(DIMENSIONS, np.float32))
    n, df = _document_frequencies(known.select("body"))
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(1)
    share = F.create_map(*[F.lit(x) for name, c in counted.items() for x in (name, min(1.0, fit_rows / c))])[F.col("lang")]
    draw = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit("fit")), 11) / F.lit(float(1 << 53))

    def make():
        def run(data: np.ndarray, at: np.ndarray) -> dict:
            counts = [c for _, _, c in _blocks(data, at)]
            return {"v": [row.tobytes() for c in counts for row in vectors(c, idf)], "patience": np.concatenate([patience(c) for c in counts])}

        return run

    sample = map_texts(known.filter(draw < share).drop(key), T.StructType([T.StructField("v", T.BinaryType()), T.StructField("patience", T.DoubleType())]), make, "g", "body", keep_text=False).select("lang", "g.*")

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        v = np.stack([np.frombuffer(x, np.float32) for x in pdf["v"]])
        c = _cluster(v, centroids)
        adjusted = (v @ c.T).max(1) / np.maximum(pdf["patience"].to_numpy(), 1e-6)
        floors = [float(np.quantile(adjusted, REJECT_QUANTILE)) * REJECT_MARGIN] * len(c)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": [x.tobytes() for x in c], "floor": floors})

    return Model([tuple(r) for r in sample.groupBy("lang").applyInPandas(cluster, MODEL).collect()], idf)


RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def predict(docs: DataFrame, model: Model, out: str = "language", text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add the struct `out`: lang (a learned language, or `und` for null texts and texts without a letter), score (cosine to the
    nearest centroid, 0 to 1) and rejected (`und`, or a cosine below the floor of that centroid, which is lower for texts of fewer than 200 grams).

    Equal cosines go to the first language by name. Repeated rows get equal results. Whole texts are read, in blocks of 1 MB. A model that
    learned nothing gives `und` for all. An empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value

        def run(data: np.ndarray, at: np.ndarray) -> dict:
            got: dict[str, list] = {"lang": [], "score": [], "rejected": []}
            for _, _, counts in _blocks(data, at):
                if not m.langs:
                    got["lang"] += ["und"] * len(counts)
                    got["score"] += [0.0] * len(counts)
                    got["rejected"] += [True] * len(counts)
                    continue
                near = vectors(counts, m.idf) @ m.centroids.T
                best = np.argmax(near, axis=1)
                score = np.clip(near[np.arange(len(near)), best], 0, 1).astype(float)
                got["lang"] += [m.langs[b] for b in best.tolist()]
                got["score"] += score.tolist()
                got["rejected"] += (score < m.floors[best] * patience(counts)).tolist()
            return got

        return run

    made = map_texts(docs.withColumn("__letter", has_letter(F.col(text))), RESULT, make, out, text, keep_text)
    r, letter = F.col(out), F.col("__letter")
    fixed = F.struct(
        F.when(letter, r["lang"]).otherwise("und").alias("lang"), F.when(letter, r["score"]).otherwise(0.0).alias("score"), (~letter | r["rejected"]).alias("rejected"),
    )
    return made.withColumn(out, fixed).drop("__letter")
