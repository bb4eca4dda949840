"""A whole trial in one task: imputation, propensity, matching, balance and hazard ratios for all its strata.

For trials of a bounded number of rows. A stratum is a bit of a mask and its training rows are found when they are needed. Covariates are taken column by
column and steps go by column or by a block of rows, so a trial takes little more than the numbers of the stratum at hand. Each step gives what the steps
over whole tables give (`plans.study` uses these for larger trials).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from trialkit.functions.normal import normal_quantile
from trialkit.plans.balance import NO_SPREAD
from trialkit.plans.matching import match_sorted
from trialkit.plans.survival import fit_arm

NEWTON_STEPS, TOLERANCE, RIDGE, BOUND, CLIP = 25, 1e-8, 1.0, 35.0, 1e-9
COX_STEPS = 10
BLOCK = 4096
#: days are counted in an array while they span at most this many
DAY_SPAN = 1 << 20


@dataclass
class TrialRows:
    """Rows of a trial in the order that settles equal scores (hash of the id, id).

    `strata` holds a bit per stratum. `fill(j, here, out)` puts covariate `j` of the rows `here` into `out`, NaN for a gap, and says whether there may be
    gaps; `train(k, here)` whether these rows are training rows of stratum `k`. `repeated` says that ids may repeat.
    """

    ids: np.ndarray
    treated: np.ndarray
    days: np.ndarray
    died: np.ndarray
    strata: np.ndarray
    width: int
    fill: Callable[[int, np.ndarray, np.ndarray], bool]
    train: Callable[[int, np.ndarray], np.ndarray]
    repeated: bool = True


def filled_with_medians(rows: TrialRows, k: int, here: np.ndarray) -> np.ndarray:
    """The covariates of the rows `here`, one row of the array each, with the median of the known training values in the gaps of each, 0 in those of one without any."""
    x, train = np.empty((rows.width, len(here))), None
    for j, values in enumerate(x):
        if rows.fill(j, here, values) and (gaps := np.isnan(values)).any():
            train = rows.train(k, here) if train is None else train
            part = values[train & ~gaps]
            m = len(part)
            if m:
                part.partition(sorted({(m - 1) // 2, m // 2}))
            low, high = (part[(m - 1) // 2], part[m // 2]) if m else (0.0, 0.0)
            values[gaps] = low + (high - low) * 0.5
    return x


def propensity(x: np.ndarray, treated: np.ndarray) -> np.ndarray:
    """Log odds of treatment from a ridge logistic fit on the columns `x` (one row of the array each); the intercept is not penalised."""
    width, n = len(x) + 1, x.shape[1]
    penalty = np.full(width, RIDGE)
    penalty[0] = 0.0
    beta = np.zeros(width)
    blocks = [slice(lo, lo + BLOCK) for lo in range(0, n, BLOCK)]
    chance = lambda part: 1 / (1 + np.exp(-np.clip(beta[0] + beta[1:] @ part, -BOUND, BOUND)))
    for _ in range(NEWTON_STEPS):
        gradient, hessian = np.zeros(width), np.zeros((width, width))
        for at in blocks:
            part = x[:, at]
            p = chance(part)
            off, weight = treated[at] - p, p * (1 - p)
            gradient[0] += off.sum()
            gradient[1:] += part @ off
            hessian[0, 0] += weight.sum()
            hessian[0, 1:] += part @ weight
            part = part * np.sqrt(weight)
            hessian[1:, 1:] += part @ part.T
        hessian[1:, 0] = hessian[0, 1:]
        step = np.linalg.lstsq(hessian + np.diag(penalty), gradient - penalty * beta, rcond=None)[0]
        beta = beta + step
        if np.abs(step).max() < TOLERANCE:
            break
    score = np.full(n, beta[0])
    for b, values in zip(beta[1:], x, strict=True):  # term by term, so that rows with the same covariates have the same score wherever they stand
        score += b * values
    p = np.clip(1 / (1 + np.exp(-np.clip(score, -BOUND, BOUND))), CLIP, 1 - CLIP)
    return np.log(p / (1 - p))


def unbalanced(x: np.ndarray, treated: np.ndarray, threshold: float) -> int:
    """Columns whose standardized difference is above the threshold; arms of one row or columns without spread have none."""
    n1 = np.count_nonzero(treated)
    n0 = len(treated) - n1
    if min(n1, n0) < 2:
        return 0
    n, arm = 0, treated.astype(float)
    for values in x:
        shifted = values - values[0]  # exactly 0 for a column of one value
        square = shifted * shifted
        s, q, s1, q1 = shifted.sum(), square.sum(), shifted @ arm, square @ arm
        m1, m0 = s1 / n1, (s - s1) / n0
        v1, v0 = (max(0.0, (sq - m * m * k) / (k - 1)) for sq, m, k in ((q1, m1, n1), (q - q1, m0, n0)))
        gap, spread = abs(m1 - m0), np.sqrt((v1 + v0) / 2)
        n += int(spread > NO_SPREAD * max(abs(values[0] + m1), abs(values[0] + m0)) and gap / spread > threshold)
    return n


def arm_hazard(days: np.ndarray, event: np.ndarray, treated: np.ndarray) -> tuple[float | None, float | None, float | None] | None:
    """(hazard ratio, lower, upper); nulls where it has none, None where no row has follow-up."""
    known = ~np.isnan(days)
    if not known.any():
        return None
    if not known.all():
        days, event, treated = days[known], event[known], treated[known]
    low, high = days.min(), days.max()
    at, n = days - low, high - low + 1
    if n <= DAY_SPAN and (at == np.floor(at)).all():
        at, n = at.astype(np.int64), int(n)
    else:
        time, at = np.unique(days, return_inverse=True)
        n = len(time)
    counts = np.bincount(4 * at + 2 * treated + (event == 1), minlength=4 * n).reshape(-1, 4).astype(float)
    d0, d1 = counts[:, 1], counts[:, 3]
    n0, n1 = (np.cumsum(c[::-1])[::-1] for c in (counts[:, 0] + d0, counts[:, 2] + d1))
    hit = d0 + d1 > 0
    beta, se, _ = fit_arm(n0[hit], n1[hit], d0[hit], d1[hit], COX_STEPS)
    if beta is None:
        return None, None, None
    z = normal_quantile(0.975)
    with np.errstate(over="ignore"):  # a separated trial has an infinite bound
        return tuple(float(np.exp(v)) for v in (beta, beta - z * se, beta + z * se))


def in_order(score: np.ndarray, treated: np.ndarray) -> np.ndarray:
    """Places of the rows by score; among equal scores treated rows come first, then rows as they stand."""
    order = np.argsort(score)
    same = np.diff(score[order]) == 0
    if same.any():
        group = np.concatenate(([0], np.cumsum(~same)))
        tied = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
        part = order[tied]
        order[tied] = part[np.lexsort((part, ~treated[part], group[tied]))]
    return order


def estimates_in(rows: TrialRows, strata: int, threshold: float) -> list[dict]:
    """One entry per stratum with its number (`stratum`), estimates and the places of matched rows (`matched`); strata without rows or follow-up have none."""
    out = []
    for k in range(strata):
        here = np.flatnonzero(rows.strata >> k & 1)
        arm, days, died = rows.treated[here], rows.days[here], rows.died[here]
        if not len(here) or (raw := arm_hazard(days, died, arm)) is None:
            continue
        x = filled_with_medians(rows, k, here)
        score = propensity(x, arm)
        order = in_order(score, arm)
        found = match_sorted(order, score[order], arm[order], np.inf, 1)
        taken = np.concatenate([np.concatenate((f["t_id"], f["c_id"])) for f in found]) if found else np.zeros(0, np.int64)
        if rows.repeated:
            chosen = np.flatnonzero(np.isin(rows.ids[here], rows.ids[here[taken]]))
        else:
            chosen = np.sort(taken)
        after = arm_hazard(days[chosen], died[chosen], arm[chosen])
        out.append({
            "stratum": k, **dict(zip(("hr_ori", "hr_ori_low", "hr_ori_high"), raw)), **dict(zip(("hr", "hr_low", "hr_high"), after or (None,) * 3)),
            "ori_unbalanced_covariates": unbalanced(x, arm, threshold),
            "unbalanced_covariates": unbalanced(x[:, chosen], arm[chosen], threshold) if len(taken) else None, "matched": here[taken],
        })
    return out


def estimates_of(trial: pa.Table, covariates: Sequence[str], time: str, event: str, strata: int, threshold: float) -> list[dict]:
    """`estimates_in` for the rows of a table, with the ids of matched rows.

    `trial` holds the rows of a trial: id, treatment, time, event, covariates, `_tie` (hash of the id), `_strata` and `_train` (bit masks).
    """
    numbers = lambda name, kind: trial.column(name).to_numpy().astype(kind, copy=False)
    order = np.lexsort((numbers("id", np.int64), numbers("_tie", np.int64)))  # stable; settles equal scores as the tables do
    ids, masks, trains = (numbers(c, np.int64)[order] for c in ("id", "_strata", "_train"))
    treated, days, died = numbers("treatment", float)[order] == 1, numbers(time, float)[order], numbers(event, float)[order] == 1

    def fill(j: int, here: np.ndarray, out: np.ndarray) -> bool:
        out[:] = numbers(covariates[j], float)[order[here]]
        return True

    rows = TrialRows(ids, treated, days, died, masks, len(covariates), fill, lambda k, here: (trains[here] >> k & 1) == 1)
    return [e | {"matched": ids[e["matched"]]} for e in estimates_in(rows, strata, threshold)]
