"""Survival estimates from life tables.

Patients collapse to one row per (trial, day, arm): what follows works on days, of which a trial has a
few thousand at most, however many patients it holds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialkit.functions.normal import normal_quantile, two_sided_p
from trialkit.session import broadcast_if_small, cut


def life_table(
    df: DataFrame, keys: Sequence[str], time: str, event: str, treat: str = "treatment", weight: str | None = None
) -> DataFrame:
    """Per (keys, time): events d0, d1 and numbers at risk n0, n1 by arm (weighted when asked)."""
    keys = list(keys)
    w = F.lit(1.0) if weight is None else F.col(weight)

    def total(arm: int, only_events: bool) -> Column:
        here = (F.col(treat) == arm) & ((F.col(event) == 1) if only_events else F.lit(True))
        return F.sum(F.when(here, w).otherwise(F.lit(0.0)))

    daily = df.where(F.col(time).isNotNull()).groupBy(*keys, F.col(time).alias("time")).agg(
        total(0, True).alias("d0"), total(1, True).alias("d1"), total(0, False).alias("m0"), total(1, False).alias("m1")
    )
    from_here = Window.partitionBy(*keys).orderBy(F.col("time").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("n0", F.sum("m0").over(from_here)).withColumn("n1", F.sum("m1").over(from_here)).drop("m0", "m1")


# ---- hazard ratio of the arm -----------------------------------------------------------------------

_FEW = 16


def _digamma(x: np.ndarray) -> np.ndarray:
    shift = sum(1 / (x + k) for k in range(10))
    y = 1 / (x + 10) ** 2
    return np.log(x + 10) - 0.5 / (x + 10) - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240))) - shift


def _trigamma(x: np.ndarray) -> np.ndarray:
    shift = sum(1 / (x + k) ** 2 for k in range(10))
    v = 1 / (x + 10)
    y = v * v
    return v + y / 2 + v * y * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30))) + shift


def _reciprocals(c: np.ndarray, d: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over l < n of 1 / (c - l d / n) and of its square, for every day; closed forms for days with many deaths."""
    first, second = np.zeros(len(c)), np.zeros(len(c))
    few = n <= _FEW
    for k in range(_FEW):
        at = few & (n > k)
        term = 1 / (c[at] - k * d[at] / n[at])
        first[at] += term
        second[at] += term * term
    many, step = ~few, n[~few] / d[~few]
    z = c[many] * step
    first[many] = step * (_digamma(z + 1) - _digamma(z - n[many] + 1))
    second[many] = step**2 * (_trigamma(z - n[many] + 1) - _trigamma(z + 1))
    return first, second


def _efron_terms(beta: float, n0, n1, d0, d1) -> tuple[float, float]:
    """Score and information of the arm coefficient; tied deaths enter one after the other. The work grows with the days, not with the deaths."""
    e = np.exp(beta)
    risk, dying, deaths = n1 * e + n0, d1 * e + d0, np.rint(d0 + d1)
    # share of the treated arm after l of the deaths: (n1 e - s d1 e) / (risk - s dying) = r + q / (risk - s dying), s = l / deaths
    r = d1 * e / dying
    q = n1 * e - r * risk
    first, second = _reciprocals(risk, dying, deaths)
    share = deaths * r + q * first
    square = deaths * r * r + 2 * r * q * first + q * q * second
    return float((d1 - share).sum()), float((share - square).sum())


def fit_arm(n0: np.ndarray, n1: np.ndarray, d0: np.ndarray, d1: np.ndarray, steps: int) -> tuple[float | None, float | None, bool]:
    """(coefficient, standard error, converged) from numbers at risk and deaths by arm on the days with deaths."""
    beta, moved = 0.0, np.inf
    for _ in range(steps):
        score, information = _efron_terms(beta, n0, n1, d0, d1)
        if not information > 0:
            return None, None, False
        moved = score / information
        before, beta = beta, beta + moved
        if not np.isfinite(beta) or abs(beta) > 30:
            return None, None, False
        if beta == before:  # as every later step
            break
    _, information = _efron_terms(beta, n0, n1, d0, d1)
    return (beta, 1 / np.sqrt(information), bool(abs(moved) < 1e-6)) if information > 0 else (None, None, False)


def hazard_ratio(
    df: DataFrame, keys: Sequence[str], time: str, event: str, treat: str = "treatment", alpha: float = 0.05, steps: int = 10
) -> DataFrame:
    """Hazard ratio of treatment per trial with its interval: Efron ties, Newton steps from 0.

    A trial without events, with one arm, or whose estimate runs away gives nulls. `converged` says whether the last step was
    below 1e-6.
    """
    keys = list(keys)

    @F.pandas_udf("beta double, se double, converged boolean")
    def fit(tables: pd.Series) -> pd.DataFrame:
        counts = [np.array([(r["n0"], r["n1"], r["d0"], r["d1"]) for r in days], dtype=float).reshape(-1, 4).T for days in tables]
        found = pd.DataFrame([fit_arm(*c, steps) for c in counts], columns=["beta", "se", "converged"])
        return found.astype({"beta": "float64", "se": "float64", "converged": "bool"})

    deaths = life_table(df, keys, time, event, treat)
    row = F.struct("time", "n0", "n1", "d0", "d1")
    tables = deaths.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("d0") + F.col("d1") > 0, row))).alias("_days"),  # one entry per day
        F.sum(F.col("d0") + F.col("d1")).cast("long").alias("n_events"),
    )
    z = normal_quantile(1 - alpha / 2)
    b, s = F.col("_f.beta"), F.col("_f.se")
    return tables.withColumn("_f", fit("_days")).select(
        *keys, "n_events", F.exp(b).alias("hr"), F.exp(b - z * s).alias("hr_low"), F.exp(b + z * s).alias("hr_high"),
        b.alias("log_hr"), s.alias("se"), F.col("_f.converged").alias("converged"),
    )


def proportionality(
    df: DataFrame, keys: Sequence[str], time: str, event: str, treat: str = "treatment", critical: float = 3.841458820694124
) -> DataFrame:
    """Correlation of the arm's Schoenfeld residuals with the rank of time, and its chi-square test.

    `critical` is the 95% point of chi-square with one degree of freedom.
    """
    keys = list(keys)
    deaths = life_table(df, keys, time, event, treat).where("d0 + d1 > 0")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("time")).cast("double")
    fits = hazard_ratio(df, keys, time, event, treat).select(*keys, "log_hr")
    rows = deaths.withColumn("g", rank).join(fits.where("log_hr is not null"), keys)
    p = F.col("n1") * F.exp("log_hr") / (F.col("n1") * F.exp("log_hr") + F.col("n0"))
    d, residual_sum = F.col("d0") + F.col("d1"), F.col("d1") - (F.col("d0") + F.col("d1")) * F.col("p")
    sums = rows.withColumn("p", p).groupBy(*keys).agg(
        F.sum(d).alias("n"), F.sum(d * F.col("g")).alias("g1"), F.sum(d * F.col("g") * F.col("g")).alias("g2"),
        F.sum(residual_sum).alias("r1"),
        F.sum(F.col("d1") * (1 - F.col("p")) * (1 - F.col("p")) + F.col("d0") * F.col("p") * F.col("p")).alias("r2"),
        F.sum(residual_sum * F.col("g")).alias("rg"), F.sum(d * F.col("p") * (1 - F.col("p"))).alias("v"),
    )
    cov = F.col("rg") - F.col("g1") * F.col("r1") / F.col("n")
    var_g = F.col("g2") - F.col("g1") * F.col("g1") / F.col("n")
    var_r = F.col("r2") - F.col("r1") * F.col("r1") / F.col("n")
    chi = F.try_divide(cov * cov * F.col("n"), F.col("v") * var_g)
    return sums.select(
        *keys, F.col("n").cast("long").alias("n_events"), F.try_divide(cov, F.sqrt(var_g * var_r)).alias("correlation"),
        chi.alias("chi_square"), (chi > critical).cast("int").alias("violated"),
    )


def kaplan_meier(
    df: DataFrame, keys: Sequence[str], time: str, event: str, treat: str = "treatment", weight: str | None = None
) -> DataFrame:
    """Survival after each day with an event or a censoring, per arm."""
    keys = list(keys)
    table = life_table(df, keys, time, event, treat, weight)
    arms = F.explode(
        F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f"d{a}").alias("d"), F.col(f"n{a}").alias("n")) for a in (0, 1)])
    )
    long = table.select(*keys, "time", arms.alias("_a")).select(*keys, "time", "_a.*").where("n > 0")
    upto = Window.partitionBy(*keys, "arm").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    over = F.max((F.col("d") >= F.col("n")).cast("int")).over(upto)
    logs = F.sum(F.when(F.col("d") < F.col("n"), F.log1p(-F.col("d") / F.col("n"))).otherwise(F.lit(0.0))).over(upto)
    survival = F.when(over == 1, F.lit(0.0)).otherwise(F.exp(logs))
    return long.select(*keys, "arm", "time", F.col("n").alias("at_risk"), F.col("d").alias("events"), survival.alias("survival"))


# ---- adjusted hazard ratios ------------------------------------------------------------------------


def adjusted_hazard_ratios(
    df: DataFrame, keys: Sequence[str], time: str, event: str, covariates: Sequence[str], weight: str | None = None,
    penalizer: float = 0.1, alpha: float = 0.05, steps: int = 12, tolerance: float = 1e-7,
) -> DataFrame:
    """Cox model with covariates per trial: (keys, covariate, coef, hr, robust_se, hr_low, hr_high, p, converged).

    Covariates are standardized inside the fit, the ridge term is n * penalizer / 2 * |coef|^2, ties are
    Efron's, standard errors are the sandwich of score residuals. Each Newton step sums moments per
    (trial, day) and accumulates them over days, so patients are touched once per step.
    """
    keys, covs, k = list(keys), list(covariates), len(covariates)
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    w = F.lit(1.0) if weight is None else F.col(weight)
    group = F.to_json(F.struct(*keys))
    spread = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(covs)],
        *[F.stddev_samp(c).alias(f"_s{i}") for i, c in enumerate(covs)],
    )
    complete = F.col(time).isNotNull() & F.col(event).isNotNull()
    rows = cut(
        df.join(spread, keys).where(complete).select(
            group.alias("_g"), "_rows", F.col(time).alias("_t"), F.col(event).cast("double").alias("_d"), w.cast("double").alias("_w"),
            *[F.coalesce(F.try_divide(F.col(c) - F.col(f"_m{i}"), F.col(f"_s{i}")), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(covs)],
            *[F.coalesce(F.col(f"_s{i}"), F.lit(1.0)).alias(f"_s{i}") for i in range(k)],
        )
    )
    betas = cut(
        rows.groupBy("_g").agg(F.first("_rows").alias("_rows"), F.array(*[F.first(f"_s{i}") for i in range(k)]).alias("_sd"))
        .withColumns({"_beta": F.array_repeat(F.lit(0.0), k), "_shift": F.lit(float("inf"))})
    )
    groups = betas.count()

    def with_betas() -> DataFrame:
        return rows.join(broadcast_if_small(betas.select("_g", "_beta"), groups, 200 + 8 * k), "_g")

    def risk_of(frame: DataFrame) -> DataFrame:
        eta = sum((F.col("_beta")[i] * F.col(f"x{i}") for i in range(1, k)), F.col("_beta")[0] * F.col("x0"))
        return frame.withColumn("_r", F.col("_w") * F.exp(eta))

    def day_moments(frame: DataFrame) -> DataFrame:
        """Per (trial, day): risk-set sums S over later days too, death sums D, and Efron's thinned terms."""
        r, dead = F.col("_r"), F.col("_d") == 1

        def moments(base: Column, tag: str) -> list[Column]:
            return [
                F.sum(base).alias(f"{tag}"),
                *[F.sum(base * F.col(f"x{i}")).alias(f"{tag}_{i}") for i in range(k)],
                *[F.sum(base * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"{tag}_{i}_{j}") for i, j in cells],
            ]

        dead_r = F.when(dead, r).otherwise(F.lit(0.0))
        dead_w = F.when(dead, F.col("_w")).otherwise(F.lit(0.0))
        daily = frame.groupBy("_g", "_t").agg(
            *moments(r, "s"), *moments(dead_r, "q"), F.sum(F.col("_d")).alias("deaths"), F.sum(dead_w).alias("dw"),
            *[F.sum(dead_w * F.col(f"x{i}")).alias(f"dx_{i}") for i in range(k)],
        )
        later = Window.partitionBy("_g").orderBy(F.col("_t").desc()).rowsBetween(Window.unboundedPreceding, 0)
        tags = ["s", *[f"s_{i}" for i in range(k)], *[f"s_{i}_{j}" for i, j in cells]]
        return daily.withColumns({t: F.sum(t).over(later) for t in tags})

    def score_and_information(days: DataFrame) -> DataFrame:
        ties = (
            days.where("deaths > 0")
            .withColumn("_l", F.explode(F.sequence(F.lit(0), F.col("deaths").cast("int") - 1)))
            .withColumns({"_l": F.col("_l") / F.col("deaths"), "_a": F.col("dw") / F.col("deaths")})
        )

        def thinned(tag: str) -> Column:
            return F.col(f"s{tag}") - F.col("_l") * F.col(f"q{tag}")

        mean = [thinned(f"_{i}") / thinned("") for i in range(k)]
        grad = [F.sum(F.col(f"dx_{i}") / F.col("deaths") - F.col("_a") * mean[i]) for i in range(k)]
        info = [
            F.sum(F.col("_a") * (thinned(f"_{i}_{j}") / thinned("") - mean[i] * mean[j])) for i, j in cells
        ]
        return ties.groupBy("_g").agg(F.array(*grad).alias("_grad"), F.array(*info).alias("_info"))

    def full(info, rows_n) -> np.ndarray:
        h = np.zeros((k, k))
        for value, (i, j) in zip(info, cells):
            h[i, j] = h[j, i] = value
        return h + np.eye(k) * penalizer * rows_n

    @F.pandas_udf("array<double>")
    def newton(beta: pd.Series, grad: pd.Series, info: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for b, g, h, m in zip(beta, grad, info, n):
            out.append(b + np.linalg.lstsq(full(h, m), g - penalizer * m * b, rcond=None)[0])
        return pd.Series(out)

    for _ in range(steps):
        parts = score_and_information(day_moments(risk_of(with_betas())))
        moved = betas.join(parts, "_g").withColumn("_next", newton("_beta", "_grad", "_info", "_rows"))
        moved = cut(
            moved.select(
                "_g", "_rows", "_sd", F.col("_next").alias("_beta"),
                F.array_max(F.zip_with("_beta", "_next", lambda a, b: F.abs(a - b))).alias("_shift"), "_info",
            )
        )
        betas = moved.drop("_info")
        if (moved.agg(F.max("_shift")).first()[0] or 0.0) < tolerance:
            break

    # score residual of a row: own death term minus its share of all earlier risk sets
    risky = risk_of(with_betas())
    days = day_moments(risky)
    upto = Window.partitionBy("_g").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    hazard = days.select(
        "_g", "_t", *[(F.col(f"s_{i}") / F.col("s")).alias(f"_e{i}") for i in range(k)],
        F.sum(F.col("dw") / F.col("s")).over(upto).alias("_a"),
        *[F.sum(F.col("dw") * F.col(f"s_{i}") / (F.col("s") * F.col("s"))).over(upto).alias(f"_b{i}") for i in range(k)],
    )
    hazard = cut(hazard)
    resid = risky.join(broadcast_if_small(hazard, hazard.count(), 64 + 16 * (2 * k + 2)), ["_g", "_t"])
    u = [
        F.col("_d") * F.col("_w") * (F.col(f"x{i}") - F.col(f"_e{i}")) - F.col("_r") * (F.col(f"x{i}") * F.col("_a") - F.col(f"_b{i}"))
        for i in range(k)
    ]
    meat = resid.groupBy("_g").agg(F.array(*[F.sum(u[i] * u[j]) for i, j in cells]).alias("_meat"))
    bread = score_and_information(days).select("_g", "_info")

    @F.pandas_udf("array<double>")
    def sandwich(info: pd.Series, meat: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for h, m, rows_n in zip(info, meat, n):
            inverse = np.linalg.pinv(full(h, rows_n))
            out.append(np.sqrt(np.diag(inverse @ (full(m, 0.0)) @ inverse)))
        return pd.Series(out)

    fitted = betas.join(bread, "_g").join(meat, "_g").withColumn("_se", sandwich("_info", "_meat", "_rows"))
    named = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("covariate"), (F.col("_beta")[i] / F.col("_sd")[i]).alias("coef"),
                    (F.col("_se")[i] / F.col("_sd")[i]).alias("robust_se"),
                )
                for i, c in enumerate(covs)
            ]
        )
    )
    z = normal_quantile(1 - alpha / 2)
    names = df.select(*keys, group.alias("_g")).distinct()
    return names.join(fitted.select("_g", (F.col("_shift") < 1e-4).alias("converged"), named.alias("_c")), "_g").select(
        *keys, "_c.covariate", "_c.coef", F.exp("_c.coef").alias("hr"), "_c.robust_se",
        F.exp(F.col("_c.coef") - z * F.col("_c.robust_se")).alias("hr_low"),
        F.exp(F.col("_c.coef") + z * F.col("_c.robust_se")).alias("hr_high"),
        two_sided_p(F.col("_c.coef") / F.col("_c.robust_se")).alias("p"), "converged",
    )


# ---- effects by counts -----------------------------------------------------------------------------


def odds_ratio(df: DataFrame, keys: Sequence[str], time: str, event: str, treat: str = "treatment", horizon: int | None = None) -> DataFrame:
    """Odds ratio of the event by arm, over all follow-up or within `horizon` days; null with an empty cell."""
    hit = F.col(event) == 1
    if horizon is not None:
        hit = hit & (F.col(time) <= horizon)
    hit = F.coalesce(hit, F.lit(False))

    def cell(arm: int, events: bool) -> Column:
        return F.sum(((F.col(treat) == arm) & (hit if events else ~hit)).cast("long"))

    counts = df.groupBy(*keys).agg(
        cell(1, True).alias("a"), cell(1, False).alias("b"), cell(0, True).alias("c"), cell(0, False).alias("d")
    )
    return counts.withColumn("odds_ratio", odds_of_cells(*"abcd"))


def odds_of_cells(*cells: str) -> Column:
    a, b, c, d = (F.col(x).cast("double") for x in cells)
    return F.when(a * b * c * d > 0, (a * d) / (b * c))


def rate_of(events: Column, days: Column) -> Column:
    """Events per person-year; null without time at risk."""
    return F.try_divide(events, days / 365.25)


def event_sums(treated: np.ndarray, event: np.ndarray, days: np.ndarray, horizon: int | None) -> tuple[float, ...]:
    """Rows of a task in the cells of `odds_ratio` (a, b, c, d) and the days of `incidence_rate_difference` by arm; NaN days are none."""
    hit = event if horizon is None else event & (days <= horizon)
    time = days if horizon is None else np.minimum(days, horizon)
    n, arm, a = len(treated), np.count_nonzero(treated), np.count_nonzero(hit & treated)
    c = np.count_nonzero(hit) - a
    return tuple(map(float, (a, arm - a, c, n - arm - c, np.nansum(time[treated]), np.nansum(time[~treated]))))


def incidence_rate_difference(
    df: DataFrame, keys: Sequence[str], time: str, event: str, treat: str = "treatment", horizon: int | None = None
) -> DataFrame:
    """Events per person-year, treated minus control, over all follow-up or the first `horizon` days."""
    days, hit = F.col(time), F.col(event) == 1
    if horizon is not None:
        hit, days = hit & (days <= horizon), F.when(days.isNotNull(), F.least(days, F.lit(horizon)))  # least() passes over null

    def rate(arm: int) -> Column:
        here = F.col(treat) == arm
        return rate_of(F.sum(F.when(here & hit, 1.0).otherwise(0.0)), F.sum(F.when(here, days).otherwise(0)))

    return (
        df.groupBy(*keys).agg(rate(1).alias("rate_treated"), rate(0).alias("rate_control"))
        .withColumn("rate_difference", F.col("rate_treated") - F.col("rate_control"))
    )
