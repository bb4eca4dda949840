"""Refits over many resamples at once.

Every row is kept once, with the number of copies it has in each resample. One pass over the rows adds up the cross products of all
resamples as matrix products, so a Newton step of a thousand refits is one job, and nothing is copied or shuffled but sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialkit.functions.hashing import hash32, hash32_many
from trialkit.operators.joins import spread
from trialkit.session import cut

# Cumulative Poisson(1) probabilities of 0..12 copies; the rest is less than the smallest step of a 32-bit draw.
_POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(13)]
_SENT_BYTES = 64 * 1024 * 1024
_ROWS = 1_000
_DRAWN = 200_000
_SALTS = 16


def copies_of(boot, ident: Sequence[str], seed: int = 0):
    """Poisson(1) copies of a row in a resample, by hash of both: no shuffle, and any retry draws the same."""
    u = (hash32(F.lit(seed), F.lit("boot"), boot, *ident) + 0.5) / F.lit(float(2**32))
    return sum((u > F.lit(p)).cast("int") for p in _POISSON)


def _with_copies(rows: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """Add `_copies`, one byte per resample, which equal `copies_of`; `_ident` is the text of a row's ids, each after a '|'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boots, limits = np.arange(n_boot), np.array(_POISSON)
        for batch in batches:
            step = max(1, _DRAWN // max(1, n_boot))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                texts = [t.encode() for t in part.column(part.num_columns - 1).to_pylist()]
                codes, boot = np.repeat(np.arange(len(texts)), n_boot), np.tile(boots, len(texts))
                u = (hash32_many(f"{seed}|boot|".encode(), boot, (texts, codes)) + 0.5) / 2.0**32
                copies = np.searchsorted(limits, u).astype(np.uint8).tobytes()
                packed = pa.array([copies[i * n_boot : (i + 1) * n_boot] for i in range(len(texts))], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], packed], names=[*part.schema.names[:-1], "_copies"])

    kept = [f for f in rows.schema if f.name != "_ident"]
    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("_copies", T.BinaryType())]))


Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _summed(rows: DataFrame, k: int, span: slice, betas: dict[str, np.ndarray], kernel: Kernel, finish: Callable[[str, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """Add up kernel(x, treated, outcome, copies, betas) over all rows of a trial and hand the sums to `finish`."""
    sent = rows.sparkSession.sparkContext.broadcast(betas)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        salt = TaskContext.get().partitionId() % _SALTS
        for batch in batches:
            names = np.array(batch.column(0).to_pylist())
            numbers = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, k + 2)])
            packed = batch.column(k + 2)
            for g in set(names.tolist()):
                own = np.flatnonzero(names == g)
                for lo in range(0, len(own), _ROWS):
                    at = own[lo : lo + _ROWS]
                    w = np.frombuffer(b"".join(packed.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)[:, span].astype(float)
                    x = np.column_stack([np.ones(len(at)), numbers[at, : k - 1]])
                    part = kernel(x, numbers[at, k - 1], numbers[at, k], w, sent.value[g])
                    held[g] = held[g] + part if g in held else part
            if sum(a.nbytes for a in held.values()) > _SENT_BYTES:
                yield _sums(held, salt)
                held = {}
        if held:
            yield _sums(held, salt)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b) for b in pdf["_sums"])
        return pd.DataFrame({"_g": [pdf["_g"].iloc[0]], "_sums": [total.tobytes()]})

    def end(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf["_g"].iloc[0]
        total = sum(np.frombuffer(b) for b in pdf["_sums"])
        return finish(g, total.reshape(-1, span.stop - span.start))

    parts = rows.mapInArrow(run, "_g string, _salt int, _sums binary").groupBy("_g", "_salt").applyInPandas(add, "_g string, _sums binary")
    return parts.groupBy("_g").applyInPandas(end, schema)


def _sums(held: dict[str, np.ndarray], salt: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(held)), pa.array([salt] * len(held), pa.int32()), pa.array([a.tobytes() for a in held.values()], pa.binary())], names=["_g", "_salt", "_sums"]
    )


def _solved(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Solutions of many small symmetric systems; singular ones get the shortest solution."""
    try:
        return np.linalg.solve(h, g[..., None])[..., 0]
    except np.linalg.LinAlgError:
        return (np.linalg.pinv(h) @ g[..., None])[..., 0]


def _matrices(flat: np.ndarray, n: int) -> np.ndarray:
    upper = np.triu_indices(n)
    out = np.zeros((flat.shape[1], n, n))
    out[:, upper[0], upper[1]] = flat.T
    out[:, upper[1], upper[0]] = flat.T
    return out


def _probability(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ beta.T, -35, 35)))


def _newton(x, treated, outcome, w, beta) -> np.ndarray:
    p = _probability(x, beta)
    h, upper = w * p * (1 - p), np.triu_indices(x.shape[1])
    return np.concatenate([x.T @ (w * (treated[:, None] - p)), (x[:, upper[0]] * x[:, upper[1]]).T @ h])


def _outcome(x, treated, outcome, w, beta) -> np.ndarray:
    """Normal equations of the outcome on (x, arm, weight of the arm), then the sums that the two means need."""
    p = _probability(x, beta)
    if_treated, if_control = 1 / np.maximum(p, 1e-6), 1 / np.maximum(1 - p, 1e-6)
    ipw = np.where(treated[:, None] == 1, if_treated, if_control)
    known = ~np.isnan(outcome)
    y, z, wk = np.where(known, outcome, 0.0), np.column_stack([x, treated]), w * known[:, None]
    n = z.shape[1]
    moments = []
    for i in range(n + 1):
        for j in range(i, n + 1):
            left = wk if i == n else z[:, [i]] * wk
            moments.append((left * ipw * (ipw if i == n else 1)).sum(0) if j == n else (left * z[:, [j]]).sum(0))
    right = [(z[:, [i]] * wk * y[:, None]).sum(0) for i in range(n)] + [(ipw * wk * y[:, None]).sum(0)]
    return np.stack([*moments, *right, *(x.T @ w), (w * if_treated).sum(0), (w * if_control).sum(0)])


def bootstrap_effect(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], outcome: str, ident: Sequence[str] = ("id",), n_boot: int = 1000,
    seed: int = 0, treat: str = "treatment", l2: float = 1.0, steps: int = 25, tolerance: float = 1e-8, sent_bytes: int = _SENT_BYTES,
) -> DataFrame:
    """Mean and 2.5 / 97.5 percentiles of the standardized effect over resamples; both models are refitted in each.

    Rows need all covariates and the arm; rows without an outcome take no part in the outcome model. The coefficients of as many resamples
    as fit into `sent_bytes` go out together. `n_settled` counts the refits whose last step moved nothing by more than 1e-4.
    """
    keys, k = list(keys), len(features) + 1
    group = F.to_json(F.struct(*keys)) if keys else F.lit("all")
    complete = F.col(treat).isNotNull()
    for f in features:
        complete = complete & F.col(f).isNotNull()
    text = F.concat(*[F.coalesce(F.concat(F.lit("|"), F.col(c).cast("string")), F.lit("")) for c in ident])
    numbers = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate([*features, treat, outcome])]
    plain = cut(df.where(complete).select(group.alias("_g"), *numbers, text.alias("_ident")))  # few bytes, many draws: spread before they are drawn
    rows = cut(_with_copies(spread(plain, plain.count() * n_boot, task_rows=10_000_000), n_boot, seed))
    names = [r["_g"] for r in rows.select("_g").distinct().collect()]
    size = k + k * (k + 1) // 2
    together = max(1, min(n_boot, sent_bytes // (8 * size * max(1, len(names)))))
    penalty, spark, effects = np.array([0.0] + [l2] * (k - 1)), df.sparkSession, None
    for lo in range(0, n_boot, together):
        span = slice(lo, min(lo + together, n_boot))
        betas = {g: np.zeros((span.stop - lo, k)) for g in names}
        shift = {g: np.full(span.stop - lo, np.inf) for g in names}
        for _ in range(steps):
            now = betas

            def step(g: str, sums: np.ndarray, now=now) -> pd.DataFrame:
                beta = now[g]
                moved = _solved(_matrices(sums[k:], k) + np.diag(penalty), sums[:k].T - penalty * beta)
                return pd.DataFrame({"_g": [g], "_beta": [(beta + moved).tobytes()], "_shift": [np.abs(moved).max(1).tobytes()]})

            found = _summed(rows, k, span, now, _newton, step, "_g string, _beta binary, _shift binary").collect()  # at most sent_bytes
            betas = {r["_g"]: np.frombuffer(r["_beta"]).reshape(-1, k) for r in found}
            shift = {r["_g"]: np.frombuffer(r["_shift"]) for r in found}
            if max((s.max() for s in shift.values()), default=0.0) < tolerance:
                break
        settled = {g: s < 1e-4 for g, s in shift.items()}

        def effect(g: str, sums: np.ndarray, settled=settled, lo=lo) -> pd.DataFrame:
            n = k + 2
            m = n * (n + 1) // 2
            c = _solved(_matrices(sums[:m], n), sums[m : m + n].T)
            over = sums[m + n : m + n + k].T
            base, total = (c[:, :k] * over).sum(1), over[:, 0]
            treated, control = base + c[:, k] * total + c[:, k + 1] * sums[-2], base + c[:, k + 1] * sums[-1]
            return pd.DataFrame({"_g": g, "boot": np.arange(lo, lo + len(c)), "ate": (treated - control) / total, "settled": settled[g]})

        some = cut(_summed(rows, k, span, betas, _outcome, effect, "_g string, boot int, ate double, settled boolean"))
        effects = some if effects is None else effects.unionByName(some)
    if effects is None:
        effects = spark.createDataFrame([], "_g string, boot int, ate double, settled boolean")
    ends = F.percentile("ate", F.array(F.lit(0.025), F.lit(0.975)))  # n_boot values
    summary = effects.groupBy("_g").agg(
        F.avg("ate").alias("ate_mean"), ends[0].alias("ci_low"), ends[1].alias("ci_high"), F.count("ate").alias("n_resamples"),
        F.count_if("settled").alias("n_settled"),
    )
    if not keys:
        return summary.drop("_g")
    return df.select(*keys, group.alias("_g")).distinct().join(summary, "_g").drop("_g")
