"""Regression fits for many trials at once.

A fit is a few Newton steps. Each step is one distributed pass: batches turn their rows into moment sums
per trial, Spark adds the sums, and a small per-trial solve gives the next coefficients. No trial's rows
meet in one task, and one job serves every trial.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialkit.functions.normal import logit
from trialkit.session import broadcast_if_small, cut, settle
from trialkit.sources.tables import reuse


_HELD_BYTES = 64 * 1024 * 1024


def _design(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, weight: str | None) -> DataFrame:
    """Complete rows as plain number columns: _g, x1..xk, _y, _w."""
    x = [F.col(f).cast("double").alias(f"x{i + 1}") for i, f in enumerate(features)]
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    group = F.to_json(F.struct(*keys)) if keys else F.lit("all")
    complete = F.col(label).isNotNull()
    for f in features:
        complete = complete & F.col(f).isNotNull()
    return df.where(complete).select(group.alias("_g"), *x, F.col(label).cast("double").alias("_y"), w.alias("_w"))


_SALTS = 16


def _added(parts: DataFrame) -> DataFrame:
    """Add packed arrays of equal length per group: (_g, _sums). A group's parts meet in `_SALTS` tasks first, one packed row per task and trial."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(b) for b in pdf["_sums"]], axis=0)
        return pd.DataFrame({"_g": [pdf["_g"].iloc[0]], "_sums": [total.tobytes()]})

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        done = add(pdf)
        return done.assign(_sums=[np.frombuffer(done["_sums"].iloc[0])])

    salted = parts.groupBy("_g", "_salt").applyInPandas(add, "_g string, _sums binary")
    return salted.groupBy("_g").applyInPandas(finish, "_g string, _sums array<double>")


def _cross_products(rows: DataFrame, width: int) -> DataFrame:
    """Per trial: sums of x * _r, then of x x' * _h (upper triangle), with x = (1, x1, ..).

    A task adds up its own rows and hands over one array per trial, or several when the arrays it holds
    reach a fixed amount of memory.
    """
    names = [f"x{i}" for i in range(1, width)]
    upper = np.triu_indices(width)
    held_at_most = max(1, _HELD_BYTES // (8 * (width + len(upper[0]))))

    def packed(held: dict[str, np.ndarray]) -> pd.DataFrame:
        salt = TaskContext.get().partitionId() % _SALTS
        return pd.DataFrame({"_g": list(held), "_salt": salt, "_sums": [a.tobytes() for a in held.values()]})

    def task_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            code, groups = pd.factorize(pdf["_g"])
            order = np.argsort(code, kind="stable")
            starts = np.searchsorted(code[order], np.arange(len(groups) + 1))
            x = np.column_stack((np.ones(len(pdf)), pdf[names].to_numpy(float)))[order]
            r, h = pdf["_r"].to_numpy(float)[order], pdf["_h"].to_numpy(float)[order]
            for g, lo, hi in zip(groups, starts[:-1], starts[1:]):
                part = x[lo:hi]
                square = (part * h[lo:hi, None]).T @ part
                sums = np.concatenate((part.T @ r[lo:hi], square[upper]))
                held[g] = held[g] + sums if g in held else sums
            if len(held) > held_at_most:
                yield packed(held)
                held = {}
        if held:
            yield packed(held)

    parts = rows.select("_g", *names, "_r", "_h").mapInPandas(task_sums, "_g string, _salt int, _sums binary")
    return _added(parts)


def _solver(penalty: np.ndarray):
    @F.pandas_udf("array<double>")
    def step(beta: pd.Series, sums: pd.Series) -> pd.Series:
        out = []
        for b, s in zip(beta, sums):
            n = len(b)
            gradient = s[:n] - penalty * b
            hessian = np.zeros((n, n))
            hessian[np.triu_indices(n)] = s[n:]
            hessian = np.triu(hessian) + np.triu(hessian, 1).T + np.diag(penalty)
            out.append(b + np.linalg.lstsq(hessian, gradient, rcond=None)[0])
        return pd.Series(out)

    return step


def logistic_coefficients(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, weight: str | None = None,
    l2: float = 1.0, steps: int = 25, tolerance: float = 1e-8,
) -> DataFrame:
    """(_g, _beta, _converged): ridge logistic fit per trial, intercept first and not penalised. `_converged` says whether the
    last step moved no coefficient by more than 1e-4."""
    rows = reuse(_design(df, keys, features, label, weight))
    width = len(features) + 1
    step = _solver(np.array([0.0] + [l2] * len(features)))
    betas = cut(rows.select("_g").distinct().withColumn("_beta", F.array_repeat(F.lit(0.0), width)))
    groups = betas.count()
    for _ in range(steps):
        near = rows.join(broadcast_if_small(betas.select("_g", "_beta"), groups, 200 + 8 * width), "_g")
        p = 1 / (1 + F.exp(-_linear([f"x{i}" for i in range(1, width)], bounded=True)))
        moments = near.withColumn("_p", p).withColumns(
            {"_r": F.col("_w") * (F.col("_y") - F.col("_p")), "_h": F.col("_w") * F.col("_p") * (1 - F.col("_p"))}
        )
        moved = betas.select("_g", "_beta").join(_cross_products(moments, width), "_g").withColumn("_next", step("_beta", "_sums"))
        shift = F.array_max(F.zip_with("_beta", "_next", lambda a, b: F.abs(a - b)))
        moved = settle(moved.select("_g", F.col("_next").alias("_beta"), shift.alias("_shift")))
        betas = moved.select("_g", "_beta", (F.col("_shift") < 1e-4).alias("_converged"))
        if (moved.agg(F.max("_shift")).first()[0] or 0.0) < tolerance:
            break
    rows.unpersist()
    return betas


def _linear(features: Sequence[str], beta: str = "_beta", bounded: bool = False) -> Column:
    terms = [f"{beta}[0]", *[f"{beta}[{i + 1}] * double(`{f}`)" for i, f in enumerate(features)]]
    total = F.expr(" + ".join(terms))
    return F.least(F.greatest(total, F.lit(-35.0)), F.lit(35.0)) if bounded else total


def propensity_scores(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], treat: str = "treatment", weight: str | None = None,
    l2: float = 1.0,
) -> DataFrame:
    """Add `ps` and `ps_logit` from a logistic fit per trial."""
    betas = logistic_coefficients(df, keys, features, treat, weight, l2)
    group = F.to_json(F.struct(*keys)) if keys else F.lit("all")
    near = broadcast_if_small(betas.select("_g", "_beta"), betas.count(), 200 + 8 * len(features))
    scored = df.withColumn("_g", group).join(near, "_g")
    p = 1 / (1 + F.exp(-_linear(features, bounded=True)))
    return scored.withColumn("ps", p).withColumn("ps_logit", logit(F.col("ps"))).drop("_g", "_beta")


def linear_coefficients(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, weight: str | None = None) -> DataFrame:
    """(_g, _beta): least squares per trial from the normal equations, one pass."""
    rows = _design(df, keys, features, label, weight).withColumns({"_r": F.col("_w") * F.col("_y"), "_h": F.col("_w")})
    width = len(features) + 1
    start = F.array_repeat(F.lit(0.0), width)
    return _cross_products(rows, width).select("_g", _solver(np.zeros(width))(start, "_sums").alias("_beta"))


def standardized_effect(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], outcome: str, treat: str = "treatment", weight: str | None = None
) -> DataFrame:
    """Average outcome with everybody treated minus with nobody treated (keys, mean_treated, mean_control, ate).

    The outcome model is linear in the covariates, the treatment and the inverse probability weight of
    the assumed arm, so the weight feature changes with the arm.
    """
    keys = list(keys)
    scored = cut(propensity_scores(df, keys, features, treat, weight))  # feeds the fit and the prediction
    if_treated = 1 / F.greatest("ps", F.lit(1e-6))
    if_control = 1 / F.greatest(1 - F.col("ps"), F.lit(1e-6))
    modelled = scored.withColumn("_ipw", F.when(F.col(treat) == 1, if_treated).otherwise(if_control))
    inputs = [*features, treat, "_ipw"]
    betas = cut(linear_coefficients(modelled, keys, inputs, outcome, weight))
    group = F.to_json(F.struct(*keys)) if keys else F.lit("all")
    fitted = modelled.withColumn("_g", group).join(broadcast_if_small(betas, betas.count(), 200 + 8 * len(inputs)), "_g")
    beta, n = F.col("_beta"), len(features)
    base = _linear(features)
    w = F.lit(1.0) if weight is None else F.col(weight)
    y1 = base + beta[n + 1] + beta[n + 2] * if_treated
    y0 = base + beta[n + 2] * if_control
    return (
        fitted.groupBy(*keys)
        .agg((F.sum(w * y1) / F.sum(w)).alias("mean_treated"), (F.sum(w * y0) / F.sum(w)).alias("mean_control"))
        .withColumn("ate", F.col("mean_treated") - F.col("mean_control"))
    )
