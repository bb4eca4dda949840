"""Parametric survival models on counts per (trial, arm, day, event).

Weibull, log-normal and log-logistic are location-scale families of log time, so one Newton loop serves
all three. Patients collapse to day counts first; a trial brings at most four rows per day to its task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from trialkit.functions.normal import normal_quantile

FAMILIES = ("weibull", "lognormal", "loglogistic")


def _erfc(x: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(v) for v in x.ravel()]).reshape(x.shape)


def _log_normal_tail(z: np.ndarray) -> np.ndarray:
    small = np.minimum(z, 25.0)
    far = -0.5 * z * z - np.log(np.maximum(z, 1.0)) - 0.5 * math.log(2 * math.pi)
    return np.where(z > 25.0, far, np.log(0.5 * _erfc(small / math.sqrt(2.0))))


def _density(family: str, z):
    """Log density of log time's standard error term, with first and second derivative."""
    if family == "weibull":
        e = np.exp(z)
        return z - e, 1 - e, -e
    if family == "lognormal":
        return -0.5 * z * z - 0.5 * math.log(2 * math.pi), -z, -np.ones_like(z)
    p = 1 / (1 + np.exp(-z))
    return z - 2 * np.logaddexp(0, z), 1 - 2 * p, -2 * p * (1 - p)


def _tail(family: str, z):
    """Log survival of the standard error term, with first and second derivative."""
    if family == "weibull":
        e = np.exp(z)
        return -e, -e, -e
    if family == "lognormal":
        log_s = _log_normal_tail(z)
        hazard = np.exp(-0.5 * z * z - 0.5 * math.log(2 * math.pi) - log_s)
        return log_s, -hazard, -hazard * (hazard - z)
    p = 1 / (1 + np.exp(-z))
    return -np.logaddexp(0, z), -p, -p * (1 - p)


def _likelihood(family: str, theta, x, log_t, event, count):
    beta, log_s = theta[:-1], theta[-1]
    s = math.exp(log_s)
    z = (log_t - x @ beta) / s
    f, f1, f2 = _density(family, z)
    c, c1, c2 = _tail(family, z)
    value = np.where(event, f - log_s - log_t, c)
    g, h = np.where(event, f1, c1), np.where(event, f2, c2)
    d_beta = -(x * (count * g)[:, None]).sum(0) / s
    d_s = (count * (-g * z - event)).sum()
    hbb = (x * (count * h)[:, None]).T @ x / (s * s)
    hbs = (x * (count * (h * z + g))[:, None]).sum(0) / s
    hss = (count * (h * z * z + g * z)).sum()
    n = len(theta)
    hessian = np.zeros((n, n))
    hessian[:-1, :-1], hessian[:-1, -1], hessian[-1, :-1], hessian[-1, -1] = hbb, hbs, hbs, hss
    return (count * value).sum(), np.append(d_beta, d_s), hessian


def _fit(family: str, x, t, event, count, steps: int = 100):
    """(theta, covariance, log likelihood) by Newton with step halving; None when it cannot be fitted."""
    log_t = np.log(t)
    if not (count * event).sum() > 0:
        return None
    theta = np.zeros(x.shape[1] + 1)
    theta[0] = np.average(log_t, weights=count)
    spread = math.sqrt(max(np.average((log_t - theta[0]) ** 2, weights=count), 1e-4))
    theta[-1] = math.log(spread)
    with np.errstate(all="ignore"):
        value, gradient, hessian = _likelihood(family, theta, x, log_t, event, count)
    if not np.isfinite(hessian).all():
        return None
    for _ in range(steps):
        ridge = 0.0
        top = np.linalg.eigvalsh(hessian).max()
        if top >= 0:
            ridge = top + 1e-3 * count.sum()
        move = np.linalg.lstsq(ridge * np.eye(len(theta)) - hessian, gradient, rcond=None)[0]
        scale = 1.0
        while scale > 1e-8:
            trial = theta + scale * move
            with np.errstate(all="ignore"):  # a step too far is seen below and halved
                new = _likelihood(family, trial, x, log_t, event, count)
            if np.isfinite(new[0]) and np.isfinite(new[2]).all() and new[0] >= value - 1e-12:
                break
            scale /= 2
        else:
            break
        theta, (value, gradient, hessian) = trial, new
        if np.abs(scale * move).max() < 1e-9:
            break
    return theta, np.linalg.pinv(-hessian), value


def _collapse(df: DataFrame, keys: Sequence[str], time: str, event: str, treat: str, weight: str | None) -> DataFrame:
    w = F.lit(1.0) if weight is None else F.col(weight)
    return (
        df.where(F.col(time) > 0)
        .groupBy(*keys, F.col(treat).cast("int").alias("_arm"), F.col(time).cast("double").alias("_t"), (F.col(event) == 1).alias("_d"))
        .agg(F.sum(w).alias("_n"))
    )


def _arrays(pdf: pd.DataFrame):
    return pdf["_t"].to_numpy(float), pdf["_d"].to_numpy(bool), pdf["_n"].to_numpy(float)


def family_aic(df: DataFrame, keys: Sequence[str], time: str, event: str, treat: str = "treatment") -> DataFrame:
    """AIC of the three two-parameter models per trial, arms pooled, and the best one. Times of 0 are left out."""
    keys = list(keys)
    counts = _collapse(df, keys, time, event, treat, None)
    pooled = counts.groupBy(*keys, "_t", "_d").agg(F.sum("_n").alias("_n"))
    schema = StructType(
        [counts.schema[k] for k in keys] + [StructField(f"aic_{f}", DoubleType()) for f in FAMILIES] + [StructField("best", StringType())]
    )

    def per_trial(pdf: pd.DataFrame) -> pd.DataFrame:
        t, event_, n = _arrays(pdf)
        fits = [_fit(f, np.ones((len(t), 1)), t, event_, n) for f in FAMILIES]
        aic = [None if r is None else 2 * 2 - 2 * r[2] for r in fits]
        best = None if None in aic else FAMILIES[int(np.argmin(aic))]
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], *aic, best]], columns=schema.names)

    return pooled.groupBy(*keys).applyInPandas(per_trial, schema)


def time_ratio(
    df: DataFrame, keys: Sequence[str], time: str, event: str, treat: str = "treatment", family: str = "lognormal",
    weight: str | None = None, alpha: float = 0.05,
) -> DataFrame:
    """Accelerated failure time effect of treatment: exp(coefficient) of log time, interval and p."""
    if family not in FAMILIES:
        raise ValueError(f"family must be one of {FAMILIES}")
    keys = list(keys)
    counts = _collapse(df, keys, time, event, treat, weight)
    numbers = ["time_ratio", "ratio_low", "ratio_high", "p", "scale"]
    schema = StructType(
        [counts.schema[k] for k in keys] + [StructField("family", StringType()), StructField("n_events", LongType())]
        + [StructField(n, DoubleType()) for n in numbers]
    )
    q = normal_quantile(1 - alpha / 2)

    def per_trial(pdf: pd.DataFrame) -> pd.DataFrame:
        t, event_, n = _arrays(pdf)
        head = [*[pdf[k].iloc[0] for k in keys], family, int(round((n * event_).sum()))]
        arm = pdf["_arm"].to_numpy(float)
        fit = _fit(family, np.column_stack((np.ones(len(t)), arm)), t, event_, n) if len(set(arm)) == 2 else None
        if fit is None:
            return pd.DataFrame([[*head, *[None] * 5]], columns=schema.names)
        theta, cov, _ = fit
        b, se = theta[1], math.sqrt(max(cov[1, 1], 0.0))
        p = math.erfc(abs(b / se) / math.sqrt(2.0)) if se > 0 else None
        row = [math.exp(b), math.exp(b - q * se), math.exp(b + q * se), p, math.exp(theta[-1])]
        return pd.DataFrame([[*head, *row]], columns=schema.names)

    return counts.groupBy(*keys).applyInPandas(per_trial, schema)
