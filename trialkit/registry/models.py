"""Propensity, matching, weighting, balance, survival and synthesis."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from trialkit.functions.hashing import hash32
from trialkit.functions.normal import logit, normal_quantile
from trialkit.functions.text import count_percent
from trialkit.functions.hashing import hash32
from trialkit.plans import balance, bootstrap, matching, models, outcomes, parametric, propensity, reports, survival, synthesis
from trialkit.plans.features import demographics
from trialkit.registry import sqlmath
from trialkit.registry import views as v
from trialkit.registry.base import query
from trialkit.registry.patients import _SV, USERS_SQL
from trialkit.registry.relational import LIFE_SQL
from trialkit.session import cut

COVARIATES = ["bal", "n_orders", "spend", "building"]
N_RESAMPLES = 1000


def _r(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _trial(spark, d):
    return v.cust_trial(spark, d)


# ---- propensity and matching -----------------------------------------------------------------------


_ETA = " + ".join(["b0", *[f"b{i + 1} * {c}" for i, c in enumerate(COVARIATES)]])
_PS = f"""{sqlmath.logistic("cust_trial", ["trial"], COVARIATES, "treatment")},
    ps AS (SELECT r.*, 1 / (1 + exp(-({_ETA}))) AS ps FROM cust_trial r JOIN lb ON r.trial = lb.trial)"""


@query("ps_logistic", f"WITH {_PS} SELECT trial, id, treatment, round(ps, 6) AS ps, round(ln(ps / (1 - ps)), 6) AS ps_logit FROM ps", ["cust_trial"])
def ps_logistic(spark, d):
    return _r(models.propensity_scores(_trial(spark, d), ["trial"], COVARIATES).select("trial", "id", "treatment", "ps", "ps_logit"), "ps", "ps_logit")


@query("ps_logit", "SELECT trial, id, round(ln(score / (1 - score)), 6) AS ps_logit FROM cust_trial", ["cust_trial"])
def ps_logit(spark, d):
    return _trial(spark, d).select("trial", "id", F.round(logit(F.col("score")), 6).alias("ps_logit"))


_LONG = " UNION ALL ".join(f"SELECT trial, treatment, '{c}' AS covariate, CAST({c} AS DOUBLE) AS x FROM cust_trial" for c in COVARIATES)
_SMD = f"""
    long AS ({_LONG}),
    smd AS (SELECT trial, covariate, abs(avg(x) FILTER (WHERE treatment = 1) - avg(x) FILTER (WHERE treatment = 0)) /
        sqrt((var_samp(x) FILTER (WHERE treatment = 1) + var_samp(x) FILTER (WHERE treatment = 0)) / 2) AS smd FROM long GROUP BY 1, 2)"""


@query("balance_smd", f"WITH {_SMD} SELECT trial, covariate, round(smd, 6) AS smd FROM smd", ["cust_trial"])
def balance_smd(spark, d):
    return _r(balance.standardized_differences(_trial(spark, d), ["trial"], COVARIATES), "smd")


@query("balance_unbalanced_count", f"""
    WITH {_SMD} SELECT trial, count(CASE WHEN smd > 0.2 AND covariate <> 'spend' THEN 1 END) AS unbalanced FROM smd GROUP BY 1""", ["cust_trial"])
def balance_unbalanced_count(spark, d):
    smd = balance.standardized_differences(_trial(spark, d), ["trial"], COVARIATES)
    return balance.unbalanced_counts(smd, ["trial"], 0.2, ["spend"])


def _scored(spark, d):
    return cut(models.propensity_scores(_trial(spark, d), ["trial"], COVARIATES))


# a score without ties, so that the order of closest pairs is the same everywhere
SHARE = "spend / 600000"
SHARE_SQL = f"scored AS (SELECT trial, id, treatment, {SHARE} AS share, ln(({SHARE}) / (1 - {SHARE})) AS share_logit FROM cust_trial)"


def shared(spark, d):
    share = F.expr(SHARE)
    return cut(_trial(spark, d).select("trial", "id", "treatment", share.alias("ps"), logit(share).alias("ps_logit"), "days", "flag"))


@query("match_nearest_1to1", f"""
    WITH RECURSIVE {SHARE_SQL}, {v.closest_first("scored", "share_logit")}
    SELECT trial, t_id, c_id, round(distance, 6) AS distance FROM taken WHERE t_id IS NOT NULL""", ["cust_trial"])
def match_nearest_1to1(spark, d):
    rows = shared(spark, d).select("trial", "id", "treatment", F.col("ps_logit").alias("score"))
    return _r(matching.match_nearest(rows, ["trial"]).select("trial", "t_id", "c_id", "distance"), "distance")


@query("join_inner_id", f"""
    WITH RECURSIVE {SHARE_SQL}, {v.closest_first("scored", "share_logit")}
    SELECT x.trial, x.id, x.treatment, x.days, x.flag FROM cust_trial x JOIN (
        SELECT trial, t_id AS id FROM taken WHERE t_id IS NOT NULL UNION ALL SELECT trial, c_id FROM taken WHERE t_id IS NOT NULL) m
    ON x.trial = m.trial AND x.id = m.id""", ["cust_trial"])
def join_inner_id(spark, d):
    rows = shared(spark, d)
    pairs = matching.match_nearest(rows.withColumn("score", F.col("ps_logit")), ["trial"])
    return matching.matched_rows(rows, pairs, ["trial"]).select("trial", "id", "treatment", "days", "flag")


@query("match_caliper_1toN", f"""
    WITH RECURSIVE {SHARE_SQL},
    gaps AS (SELECT t.trial, abs(t.share - c.share) AS gap
             FROM scored t JOIN scored c ON t.trial = c.trial AND t.treatment = 1 AND c.treatment = 0),
    mid AS (SELECT trial, median(gap) AS med FROM gaps GROUP BY 1),
    cal AS (SELECT g.trial, median(abs(g.gap - m.med)) AS caliper FROM gaps g JOIN mid m ON g.trial = m.trial GROUP BY 1),
    {v.closest_first("scored", "share", 3, "cal")}
    SELECT trial, t_id, c_id, round(distance, 6) AS distance, turn FROM taken WHERE t_id IS NOT NULL""", ["cust_trial"])
def match_caliper_1to_n(spark, d):
    return _r(propensity.caliper_match(shared(spark, d), ["trial"], ratio=3), "distance")


@query("match_caliper_mad", """
    WITH x AS (SELECT t.trial, abs(t.score - c.score) AS dist
               FROM cust_trial t JOIN cust_trial c ON t.trial = c.trial AND t.treatment = 1 AND c.treatment = 0),
    m AS (SELECT trial, median(dist) AS med FROM x GROUP BY 1)
    SELECT x.trial, round(any_value(m.med), 5) AS median_distance, round(median(abs(x.dist - m.med)), 5) AS caliper
    FROM x JOIN m ON x.trial = m.trial GROUP BY 1""", ["cust_trial"])
def match_caliper_mad(spark, d):
    return _r(matching.distance_mad(_trial(spark, d), ["trial"]), "median_distance", "caliper", digits=5)


_SCALED = ", ".join(f"({c} - min({c}) OVER t) / (max({c}) OVER t - min({c}) OVER t) AS {c}" for c in COVARIATES)


def _escalation_sql(shares: bool = False) -> str:
    """Closest pairs at ratios 1 to 4 on the fitted score; the first ratio with at most one covariate beyond 0.1 counts."""
    parts = [
        f"scaled AS (SELECT trial, id, treatment, {_SCALED} FROM cust_trial WINDOW t AS (PARTITION BY trial))",
        sqlmath.logistic("scaled", ["trial"], COVARIATES, "treatment"),
        f"scored AS MATERIALIZED (SELECT r.*, 1 / (1 + exp(-({_ETA}))) AS ps FROM scaled r JOIN lb ON r.trial = lb.trial)",
        "gaps AS (SELECT t.trial, abs(t.ps - c.ps) AS gap FROM scored t JOIN scored c ON t.trial = c.trial AND t.treatment = 1 AND c.treatment = 0)",
        "mid AS (SELECT trial, median(gap) AS med FROM gaps GROUP BY 1)",
        "cal AS MATERIALIZED (SELECT g.trial, median(abs(g.gap - m.med)) AS caliper FROM gaps g JOIN mid m ON g.trial = m.trial GROUP BY 1)",
    ]
    for r in (1, 2, 3, 4):
        parts.append(re.sub(r"\b(pairs|taken)\b", rf"\g<1>{r}", v.closest_first("scored", "ps", r, "cal")))
        kept = f"SELECT trial, t_id AS id FROM taken{r} WHERE t_id IS NOT NULL UNION SELECT trial, c_id FROM taken{r} WHERE t_id IS NOT NULL"
        parts.append(f"rows{r} AS (SELECT s.* FROM scored s JOIN ({kept}) k ON s.trial = k.trial AND s.id = k.id)")
        long = " UNION ALL ".join(f"SELECT trial, treatment, '{c}' AS covariate, CAST({c} AS DOUBLE) AS x FROM rows{r}" for c in COVARIATES)
        parts.append(
            f"smd{r} AS (SELECT trial, covariate, abs(avg(x) FILTER (WHERE treatment = 1) - avg(x) FILTER (WHERE treatment = 0)) / "
            f"nullif(sqrt((var_samp(x) FILTER (WHERE treatment = 1) + var_samp(x) FILTER (WHERE treatment = 0)) / 2), 0) AS smd FROM ({long}) GROUP BY 1, 2)"
        )
        parts.append(
            f"tried{r} AS (SELECT s.trial, {r} AS ratio, s.unbalanced, p.n_pairs, p.n_treated FROM "
            f"(SELECT trial, count(CASE WHEN smd > 0.1 THEN 1 END) AS unbalanced FROM smd{r} GROUP BY 1) s JOIN "
            f"(SELECT trial, count(*) AS n_pairs, count(DISTINCT t_id) AS n_treated FROM taken{r} WHERE t_id IS NOT NULL GROUP BY 1) p ON s.trial = p.trial)"
        )
    union = " UNION ALL ".join(f"SELECT * FROM tried{r}" for r in (1, 2, 3, 4))
    if shares:
        arms = "avg(flag) FILTER (WHERE treatment = 1) AS t, avg(flag) FILTER (WHERE treatment = 0) AS c, avg(flag) AS o"
        chosen = " UNION ALL ".join(f"SELECT trial, id, {r} AS ratio FROM rows{r}" for r in (1, 2, 3, 4))
        parts.append(f"report AS (SELECT trial, ratio, unbalanced FROM ({union}) WHERE unbalanced <= 1 OR ratio = 4 QUALIFY row_number() OVER (PARTITION BY trial ORDER BY ratio) = 1)")
        parts.append(f"whole AS (SELECT trial, {arms} FROM cust_trial GROUP BY 1)")
        parts.append(f"inside AS (SELECT trial, ratio, {arms} FROM (SELECT x.trial, k.ratio, x.treatment, x.flag FROM cust_trial x JOIN ({chosen}) k ON x.trial = k.trial AND x.id = k.id) GROUP BY 1, 2)")
        cells = {f"{p}_{n}": f"{a}.{e}" for a, p in (("w", "incidence"), ("i", "matched")) for n, e in (("treated", "t"), ("control", "c"), ("overall", "o"))}
        cells |= {"ate": "w.t - w.c", "matched_ate": "i.t - i.c"}
        return f"""WITH RECURSIVE {", ".join(parts)}
        SELECT w.trial, p.ratio, unbalanced, coalesce(CAST(unbalanced <= 1 AS INTEGER), 0) AS balanced, {", ".join(f"CASE WHEN unbalanced <= 1 THEN round({e}, 6) END AS {n}" for n, e in cells.items())}
        FROM whole w LEFT JOIN report p ON p.trial = w.trial LEFT JOIN inside i ON p.trial = i.trial AND p.ratio = i.ratio"""
    return f"""WITH RECURSIVE {", ".join(parts)}
        SELECT trial, ratio, unbalanced, CAST(unbalanced <= 1 AS INTEGER) AS balanced, n_pairs, n_treated FROM ({union}) WHERE unbalanced <= 1 OR ratio = 4
        QUALIFY row_number() OVER (PARTITION BY trial ORDER BY ratio) = 1"""


@query("match_ratio_escalation", _escalation_sql(), ["cust_trial"])
def match_ratio_escalation(spark, d):
    pairs, report = propensity.matched_with_escalation(_trial(spark, d), ["trial"], COVARIATES)
    sizes = pairs.groupBy("trial").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("t_id").alias("n_treated"))
    return report.join(sizes, "trial", "left")


@query("match_escalation_incidence", _escalation_sql(shares=True), ["cust_trial"])
def match_escalation_incidence(spark, d):
    """Outcome shares by arm of the trials that a ratio balanced, over all rows and over the matched ones."""
    _, report = propensity.incidence_after_matching(_trial(spark, d), ["trial"], COVARIATES, "flag")
    return _r(report, *[c for c in report.columns if c not in ("trial", "ratio", "unbalanced", "balanced")])


_WEIGHTS = """
    ps AS (SELECT *, avg(treatment) OVER (PARTITION BY trial, bal > 4500) AS p FROM cust_trial),
    w AS (SELECT *, CASE WHEN treatment = 1 THEN 1 / greatest(least(p, 1 - 1e-6), 1e-6) ELSE 1 / (1 - greatest(least(p, 1 - 1e-6), 1e-6)) END AS iptw_weight FROM ps)"""


def _weighted(spark, d):
    rows = _trial(spark, d).withColumn("stratum", F.col("bal") > 4500)
    shares = rows.groupBy("trial", "stratum").agg(F.avg("treatment").alias("p"))
    return rows.join(shares, ["trial", "stratum"]).withColumn("iptw_weight", balance.inverse_probability_weight(F.col("treatment"), F.col("p")))


@query("iptw_weights", f"WITH {_WEIGHTS} SELECT trial, id, treatment, round(iptw_weight, 6) AS iptw_weight FROM w", ["cust_trial"])
def iptw_weights(spark, d):
    return _r(_weighted(spark, d).select("trial", "id", "treatment", "iptw_weight"), "iptw_weight")


_WLONG = " UNION ALL ".join(f"SELECT trial, treatment, iptw_weight AS w, '{c}' AS covariate, CAST({c} AS DOUBLE) AS x FROM w" for c in COVARIATES)


@query("iptw_balance", f"""
    WITH {_WEIGHTS}, long AS ({_WLONG}),
    m AS (SELECT trial, covariate, treatment, sum(w * x) / sum(w) AS mean, sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ** 2 AS var FROM long GROUP BY 1, 2, 3)
    SELECT a.trial, a.covariate, round(abs(a.mean - b.mean) / sqrt((a.var + b.var) / 2), 6) AS smd
    FROM m a JOIN m b ON a.trial = b.trial AND a.covariate = b.covariate AND a.treatment = 1 AND b.treatment = 0""", ["cust_trial"])
def iptw_balance(spark, d):
    return _r(balance.standardized_differences(_weighted(spark, d), ["trial"], COVARIATES, weight="iptw_weight"), "smd")


_ALONG = " UNION ALL ".join(f"SELECT trial, treatment, iptw_weight AS w, '{c}' AS covariate, CAST({c} AS DOUBLE) AS x FROM w" for c in COVARIATES)


@query("iptw_analysis", f"""
    WITH {_PS}, w AS (SELECT *, CASE WHEN treatment = 1 THEN 1 / ps ELSE 1 / (1 - ps) END AS iptw_weight FROM ps), long AS ({_ALONG}),
    m AS (SELECT trial, covariate, treatment, sum(w * x) / sum(w) AS mean, sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ** 2 AS var FROM long GROUP BY 1, 2, 3),
    c AS (SELECT a.trial, count(CASE WHEN abs(a.mean - b.mean) / sqrt((a.var + b.var) / 2) > 0.1 THEN 1 END) AS unbalanced
          FROM m a JOIN m b ON a.trial = b.trial AND a.covariate = b.covariate AND a.treatment = 1 AND b.treatment = 0 GROUP BY 1),
    i AS (SELECT trial, sum(iptw_weight * flag) FILTER (WHERE treatment = 1) / sum(iptw_weight) FILTER (WHERE treatment = 1) AS wt,
        sum(iptw_weight * flag) FILTER (WHERE treatment = 0) / sum(iptw_weight) FILTER (WHERE treatment = 0) AS wc FROM w GROUP BY 1)
    SELECT c.trial, c.unbalanced, round(wt, 6) AS incidence_treated, round(wc, 6) AS incidence_control, round(wt - wc, 6) AS ate
    FROM c JOIN i ON c.trial = i.trial""", ["cust_trial"])
def iptw_analysis(spark, d):
    _, counts, effect = propensity.weighted_analysis(_trial(spark, d), ["trial"], COVARIATES, "flag")
    return _r(counts.join(effect.drop("incidence_overall"), "trial"), "incidence_treated", "incidence_control", "ate")


@query("ate_incidence_difference", f"""
    WITH {_WEIGHTS}, s AS (SELECT trial, avg(flag) FILTER (WHERE treatment = 1) AS it, avg(flag) FILTER (WHERE treatment = 0) AS ic, avg(flag) AS io,
        sum(iptw_weight * flag) FILTER (WHERE treatment = 1) / sum(iptw_weight) FILTER (WHERE treatment = 1) AS wt,
        sum(iptw_weight * flag) FILTER (WHERE treatment = 0) / sum(iptw_weight) FILTER (WHERE treatment = 0) AS wc FROM w GROUP BY 1)
    SELECT trial, round(it, 6) AS incidence_treated, round(ic, 6) AS incidence_control, round(io, 6) AS incidence_overall,
           round(it - ic, 6) AS ate, round(wt - wc, 6) AS weighted_ate FROM s""", ["cust_trial"])
def ate_incidence_difference(spark, d):
    rows = _weighted(spark, d)
    plain = balance.incidence_difference(rows, ["trial"], "flag")
    weighted = balance.incidence_difference(rows, ["trial"], "flag", weight="iptw_weight").select("trial", F.col("ate").alias("weighted_ate"))
    return _r(plain.join(weighted, "trial"), "incidence_treated", "incidence_control", "incidence_overall", "ate", "weighted_ate")


def _standardized_sql(rows: str, keys: list[str], features: list[str], weight: str = "1") -> str:
    """CTEs from `ps` scored rows to `effect`."""
    n = len(features)
    by, on = ", ".join(keys), " AND ".join(f"m.{k} = ls.{k}" for k in keys)
    fit = sqlmath.least_squares("modelled", keys, [*features, "treatment", "ipw"], "flag", weight)
    base = " + ".join(["c0", *[f"c{i + 1} * {f}" for i, f in enumerate(features)]])
    return f"""
    modelled AS (SELECT *, CASE WHEN treatment = 1 THEN 1 / ps ELSE 1 / (1 - ps) END AS ipw FROM {rows}), {fit},
    effect AS (SELECT {by}, sum({weight} * ({base} + c{n + 1} + c{n + 2} / ps)) / sum({weight}) AS mean_treated,
        sum({weight} * ({base} + c{n + 2} / (1 - ps))) / sum({weight}) AS mean_control
        FROM (SELECT m.*, ls.* EXCLUDE ({by}) FROM modelled m JOIN ls ON {on}) GROUP BY {by})"""


@query("ate_standardization", f"""
    WITH {_PS}, {_standardized_sql("ps", ["trial"], COVARIATES)}
    SELECT trial, round(mean_treated, 6) AS mean_treated, round(mean_control, 6) AS mean_control, round(mean_treated - mean_control, 6) AS ate FROM effect""",
    ["cust_trial"])
def ate_standardization(spark, d):
    return _r(models.standardized_effect(_trial(spark, d), ["trial"], COVARIATES, "flag"), "mean_treated", "mean_control", "ate")


_N_REFITS = 1000
# fixed values: cumulative Poisson(1) probabilities of 0..12
_POISSON_SQL = " + ".join(f"CAST(u > {p} AS INTEGER)" for p in (
    "0.36787944117144233", "0.7357588823428847", "0.9196986029286058", "0.9810118431238463", "0.9963401531726563", "0.9994058151824183",
    "0.999916758850712", "0.9999897508033254", "0.999998874797402", "0.9999998885745217", "0.9999999899522337", "0.9999999991683893", "0.9999999999364023",
))


@query("ate_bootstrap_ci", f"""
    WITH drawn AS (SELECT c.*, b.boot FROM cust_trial c, (SELECT unnest(range({_N_REFITS})) AS boot) b),
    hashed AS (SELECT *, ({v.h32("'0'", "'boot'", "boot", "id")} + 0.5) / 4294967296.0::DOUBLE AS u FROM drawn),
    copied AS (SELECT * FROM (SELECT *, {_POISSON_SQL} AS copies FROM hashed) WHERE copies > 0),
    {sqlmath.logistic("copied", ["trial", "boot"], COVARIATES, "treatment", "r.copies")},
    ps AS (SELECT r.*, 1 / (1 + exp(-({" + ".join(["b0", *[f"b{i + 1} * {c}" for i, c in enumerate(COVARIATES)]])}))) AS ps FROM copied r JOIN lb ON r.trial = lb.trial AND r.boot = lb.boot),
    {_standardized_sql("ps", ["trial", "boot"], COVARIATES, "copies")}
    SELECT trial, round(avg(mean_treated - mean_control), 6) AS ate_mean, round(quantile_cont(mean_treated - mean_control, 0.025), 6) AS ci_low,
           round(quantile_cont(mean_treated - mean_control, 0.975), 6) AS ci_high, count(*) AS n_resamples FROM effect GROUP BY 1""", ["cust_trial"])
def ate_bootstrap_ci(spark, d):
    found = bootstrap.bootstrap_effect(_trial(spark, d), ["trial"], COVARIATES, "flag", n_boot=_N_REFITS).drop("n_settled")
    return _r(found, "ate_mean", "ci_low", "ci_high")


# ---- survival --------------------------------------------------------------------------------------


def _cox_sql(steps: int) -> str:
    p = "((n1 - s * d1) * exp(b.beta) / ((n1 - s * d1) * exp(b.beta) + (n0 - s * d0)))"
    parts = [
        LIFE_SQL,
        "ties AS (SELECT trial, time, d0, d1, n0, n1, unnest(range(CAST(d0 + d1 AS BIGINT))) / (d0 + d1) AS s FROM life WHERE d0 + d1 > 0)",
        "b0 AS (SELECT DISTINCT trial, CAST(0 AS DOUBLE) AS beta FROM ties)",
    ]
    for i in range(steps):
        parts.append(
            f"b{i + 1} AS (SELECT b.trial, any_value(b.beta) + sum(d1 / (d0 + d1) - {p}) / sum({p} * (1 - {p})) AS beta "
            f"FROM ties t JOIN b{i} b ON t.trial = b.trial GROUP BY b.trial)"
        )
    parts.append(
        f"cox AS (SELECT b.trial, any_value(b.beta) AS beta, 1 / sqrt(sum({p} * (1 - {p}))) AS se, count(*) AS n_events "
        f"FROM ties t JOIN b{steps} b ON t.trial = b.trial GROUP BY b.trial)"
    )
    return ", ".join(parts)


_Z = normal_quantile(0.975)


@query("cox_hr_binary", f"""
    WITH {_cox_sql(10)} SELECT trial, n_events, round(exp(beta), 6) AS hr, round(exp(beta - {_Z} * se), 6) AS hr_low,
           round(exp(beta + {_Z} * se), 6) AS hr_high FROM cox""", ["cust_trial"])
def cox_hr_binary(spark, d):
    return _r(survival.hazard_ratio(_trial(spark, d), ["trial"], "days", "flag").drop("log_hr", "se", "converged"), "hr", "hr_low", "hr_high")


_COX_COVARIATES = ["treatment", "bal", "n_orders"]
_COX_ROWS = " UNION ALL ".join(
    f"SELECT trial, '{c}' AS covariate, b{i} / sd{i} AS coef, se{i} / sd{i} AS robust_se, b{i} / se{i} AS w FROM fitted" for i, c in enumerate(_COX_COVARIATES)
)


@query("cox_adjusted_weighted", f"""
    WITH {_WEIGHTS}, {sqlmath.adjusted_cox("w", "trial", _COX_COVARIATES, "iptw_weight")}
    SELECT trial, covariate, round(coef, 6) AS coef, round(exp(coef), 6) AS hr, round(robust_se, 6) AS robust_se,
           round(exp(coef - {_Z} * robust_se), 6) AS hr_low, round(exp(coef + {_Z} * robust_se), 6) AS hr_high, round(1 - 2 * {sqlmath.half_normal("w")}, 6) AS p
    FROM ({_COX_ROWS})""", ["cust_trial"])
def cox_adjusted_weighted(spark, d):
    found = survival.adjusted_hazard_ratios(_weighted(spark, d), ["trial"], "days", "flag", _COX_COVARIATES, weight="iptw_weight").drop("converged")
    return _r(found, "coef", "hr", "robust_se", "hr_low", "hr_high", "p")


@query("cox_ph_check", f"""
    WITH {_cox_sql(10)}, e AS (SELECT l.*, CAST(row_number() OVER (PARTITION BY l.trial ORDER BY time) AS DOUBLE) AS g,
        n1 * exp(c.beta) / (n1 * exp(c.beta) + n0) AS p FROM life l JOIN cox c ON l.trial = c.trial WHERE d0 + d1 > 0),
    x AS (SELECT trial, g, 1 - p AS r, p * (1 - p) AS v, unnest(range(CAST(d1 AS BIGINT))) AS i FROM e
          UNION ALL SELECT trial, g, -p, p * (1 - p), unnest(range(CAST(d0 AS BIGINT))) FROM e),
    s AS (SELECT trial, count(*) AS n, corr(g, r) AS c, covar_pop(g, r) * count(*) AS cov, var_pop(g) * count(*) AS vg, sum(v) AS vr FROM x GROUP BY 1)
    SELECT trial, n AS n_events, round(c, 6) AS correlation, round(cov * cov * n / (vr * vg), 6) AS chi_square,
           CAST(cov * cov * n / (vr * vg) > 3.841458820694124 AS INTEGER) AS violated FROM s""", ["cust_trial"])
def cox_ph_check(spark, d):
    return _r(survival.proportionality(_trial(spark, d), ["trial"], "days", "flag"), "correlation", "chi_square")


@query("km_curve", f"""
    WITH {LIFE_SQL}, a AS (SELECT trial, 0 AS arm, time, d0 AS d, n0 AS n FROM life WHERE n0 > 0 UNION ALL SELECT trial, 1, time, d1, n1 FROM life WHERE n1 > 0)
    SELECT trial, arm, time, n AS at_risk, d AS events, round(CASE WHEN max(CASE WHEN d >= n THEN 1 ELSE 0 END) OVER w = 1 THEN 0
           ELSE exp(sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE 0 END) OVER w) END, 6) AS survival
    FROM a WINDOW w AS (PARTITION BY trial, arm ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", ["cust_trial"])
def km_curve(spark, d):
    return _r(survival.kaplan_meier(_trial(spark, d), ["trial"], "days", "flag"), "survival")


@query("km_curve_weighted", f"""
    WITH {_WEIGHTS}, daily AS (SELECT trial, days AS time, {", ".join(
        f"sum(CASE WHEN treatment = {a} {e} THEN iptw_weight ELSE 0 END) AS {n}{a}" for a in (0, 1) for n, e in (("d", "AND flag = 1"), ("m", "")))}
        FROM w WHERE days IS NOT NULL GROUP BY 1, 2),
    life AS (SELECT trial, time, d0, d1, sum(m0) OVER r AS n0, sum(m1) OVER r AS n1 FROM daily WINDOW r AS (PARTITION BY trial ORDER BY time DESC)),
    a AS (SELECT trial, 0 AS arm, time, d0 AS d, n0 AS n FROM life WHERE n0 > 0 UNION ALL SELECT trial, 1, time, d1, n1 FROM life WHERE n1 > 0)
    SELECT trial, arm, time, round(n, 6) AS at_risk, round(d, 6) AS events, round(CASE WHEN max(CASE WHEN d >= n - 1e-9 THEN 1 ELSE 0 END) OVER w = 1 THEN 0
           ELSE exp(sum(CASE WHEN d < n - 1e-9 THEN ln(1 - d / n) ELSE 0 END) OVER w) END, 6) AS survival
    FROM a WINDOW w AS (PARTITION BY trial, arm ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", ["cust_trial"])
def km_curve_weighted(spark, d):
    return _r(survival.kaplan_meier(_weighted(spark, d), ["trial"], "days", "flag", weight="iptw_weight"), "at_risk", "events", "survival")


_MORE_THAN = 20


@query("sae_hazard_ratio", f"""
    WITH last AS (SELECT ptid, max(date) AS last_act_dt FROM history GROUP BY ptid),
    cls AS (SELECT name AS class FROM history GROUP BY name HAVING count(DISTINCT ptid) > {_MORE_THAN}),
    f AS (SELECT i.ptid, i.index_date, c.class, min(h.date) AS event_date FROM index_rows i CROSS JOIN cls c
          LEFT JOIN history h ON h.ptid = i.ptid AND h.date > i.index_date AND c.class = h.name GROUP BY 1, 2, 3),
    sae_trial AS (SELECT f.class AS trial, CAST({v.h32("f.ptid", "'sae'")} % 2 AS INTEGER) AS treatment, CAST(event_date IS NOT NULL AS INTEGER) AS flag,
          datediff('day', f.index_date, coalesce(event_date, last_act_dt)) AS days FROM f JOIN last l ON f.ptid = l.ptid),
    {_cox_sql(10).replace("cust_trial", "sae_trial")}
    SELECT trial AS class, n_events, round(exp(beta), 6) AS hr, round(exp(beta - {_Z} * se), 6) AS hr_low, round(exp(beta + {_Z} * se), 6) AS hr_high FROM cox""",
    ["history", "index_rows"])
def sae_hazard_ratio(spark, d):
    """Hazard ratio of the first adverse event of every class that more than a few patients have."""
    h = v.history(spark, d)
    last = h.groupBy("ptid").agg(F.max("date").alias("last_act_dt"))
    classes = outcomes.event_classes(h, _MORE_THAN)
    flags = outcomes.first_event_after(v.index_rows(spark, d), h, classes, last).where("class <> 'any'")
    rows = flags.withColumn("treatment", (hash32("ptid", F.lit("sae")) % 2).cast("int"))
    return _r(survival.hazard_ratio(rows, ["class"], "sae_delta_days", "sae_flag").drop("log_hr", "se", "converged"), "hr", "hr_low", "hr_high")


def _aft_sql(rows: str = "cust_trial", families=parametric.FAMILIES, weight: str | None = None, ahead: str = "") -> str:
    parts, out = [ahead] if ahead else [], []
    for f in families:
        unit = ", ".join(f"CAST({1 if i == 1 else 0} AS DOUBLE) AS e_{i}" for i in range(3))
        inverse = sqlmath.solve(f"(SELECT *, {unit} FROM {f}_at)", 3, ["trial", "n_events", "t1", "t2"], right="e")
        parts.append(sqlmath.location_scale(rows, ["trial"], f, True, name=f, weight=weight))
        parts.append(f"{f}_fit AS (SELECT *, sqrt(x1) AS se, t1 / sqrt(x1) AS w FROM ({inverse}))")
        out.append(f"""
    SELECT trial, '{f}' AS family, n_events, round(exp(t1), 6) AS time_ratio, round(exp(t1 - {_Z} * se), 6) AS ratio_low,
           round(exp(t1 + {_Z} * se), 6) AS ratio_high, round(1 - 2 * {sqlmath.half_normal('w')}, 6) AS p, round(exp(t2), 6) AS scale FROM {f}_fit""")
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(out)}"


@query("aft_effect", _aft_sql(), ["cust_trial"])
def aft_effect(spark, d):
    rows, out = _trial(spark, d), None
    for family in parametric.FAMILIES:
        one = parametric.time_ratio(rows, ["trial"], "days", "flag", family=family)
        out = one if out is None else out.unionByName(one)
    return _r(out, "time_ratio", "ratio_low", "ratio_high", "p", "scale")


@query("aft_effect_weighted", _aft_sql("w", ("lognormal",), "iptw_weight", _WEIGHTS), ["cust_trial"])
def aft_effect_weighted(spark, d):
    """Log-normal time ratio with inverse probability weights."""
    found = parametric.time_ratio(_weighted(spark, d), ["trial"], "days", "flag", family="lognormal", weight="iptw_weight")
    return _r(found, "time_ratio", "ratio_low", "ratio_high", "p", "scale")


_AIC_SQL = f"""
    WITH {", ".join(sqlmath.location_scale("cust_trial", ["trial"], f, False, name=f) for f in parametric.FAMILIES)},
    aic AS (SELECT w.trial, 4 - 2 * w.ll AS a, 4 - 2 * n.ll AS b, 4 - 2 * l.ll AS c FROM weibull_at w JOIN lognormal_at n ON w.trial = n.trial
            JOIN loglogistic_at l ON w.trial = l.trial)
    SELECT trial, round(a, 4) AS aic_weibull, round(b, 4) AS aic_lognormal, round(c, 4) AS aic_loglogistic,
           CASE WHEN a <= b AND a <= c THEN 'weibull' WHEN b <= c THEN 'lognormal' ELSE 'loglogistic' END AS best FROM aic"""


@query("parametric_aic", _AIC_SQL, ["cust_trial"])
def parametric_aic(spark, d):
    return _r(parametric.family_aic(_trial(spark, d), ["trial"], "days", "flag"), *[f"aic_{f}" for f in parametric.FAMILIES], digits=4)


def _or_sql(hits: dict[str, str]) -> str:
    cells, odds = [], []
    for name, hit in hits.items():
        for cell, arm, no in (("a", 1, ""), ("b", 1, "NOT "), ("c", 0, ""), ("d", 0, "NOT ")):
            cells.append(f"CAST(sum(CASE WHEN treatment = {arm} AND {no}({hit}) THEN 1 ELSE 0 END) AS BIGINT) AS {cell}{name}")
        a, b, c, d = (f"{x}{name}" for x in "abcd")
        odds.append(f"{a}, {b}, {c}, {d}, CASE WHEN {a} * {b} * {c} * {d} > 0 THEN round(({a} * {d})::DOUBLE / ({b} * {c}), 6) END AS odds_ratio{name}")
    return f"WITH c AS (SELECT trial, {', '.join(cells)} FROM cust_trial GROUP BY 1) SELECT trial, {', '.join(odds)} FROM c"


@query("odds_ratio_allday", _or_sql({"": "flag = 1"}), ["cust_trial"])
def odds_ratio_allday(spark, d):
    return _r(survival.odds_ratio(_trial(spark, d), ["trial"], "days", "flag"), "odds_ratio")


# order histories span years, so a longer horizon stands beside the 180 days, where cells are empty
_HORIZONS = (180, 1800)


@query("odds_ratio_180day", _or_sql({f"_{h}": f"flag = 1 AND days <= {h}" for h in _HORIZONS}), ["cust_trial"])
def odds_ratio_180day(spark, d):
    out = None
    for h in _HORIZONS:
        one = _r(survival.odds_ratio(_trial(spark, d), ["trial"], "days", "flag", horizon=h), "odds_ratio")
        one = one.withColumnsRenamed({c: f"{c}_{h}" for c in one.columns if c != "trial"})
        out = one if out is None else out.join(one, "trial")
    return out


def _rate(arm: int, horizon: int | None) -> str:
    hit = "flag = 1" if horizon is None else f"flag = 1 AND days <= {horizon}"
    days = "days" if horizon is None else f"least(days, {horizon})"
    return f"sum(CASE WHEN treatment = {arm} AND {hit} THEN 1.0 ELSE 0 END)::DOUBLE / (sum(CASE WHEN treatment = {arm} THEN {days} ELSE 0 END) / 365.25)"


@query("incidence_rate_difference", f"""
    SELECT trial, round({_rate(1, None)}, 6) AS rate_treated, round({_rate(0, None)}, 6) AS rate_control,
           round({_rate(1, None)} - {_rate(0, None)}, 6) AS rate_difference, round({_rate(1, 180)} - {_rate(0, 180)}, 6) AS rate_difference_180
    FROM cust_trial GROUP BY 1""", ["cust_trial"])
def incidence_rate_difference(spark, d):
    rows = _trial(spark, d)
    whole = survival.incidence_rate_difference(rows, ["trial"], "days", "flag")
    short = survival.incidence_rate_difference(rows, ["trial"], "days", "flag", horizon=180).select("trial", F.col("rate_difference").alias("rate_difference_180"))
    return _r(whole.join(short, "trial"), "rate_treated", "rate_control", "rate_difference", "rate_difference_180")


# ---- synthesis -------------------------------------------------------------------------------------

_KEPT = """
    passing AS (SELECT * FROM estimates WHERE unbalanced_covariates < 20),
    kept AS (SELECT * FROM passing WHERE drug IN (SELECT drug FROM passing GROUP BY 1 HAVING count(*) >= 10))"""


@query("trial_balance_gate", f"WITH {_KEPT} SELECT drug, boot_id, hr, unbalanced_covariates FROM kept", ["estimates"])
def trial_balance_gate(spark, d):
    return synthesis.balanced_trials(v.estimates(spark, d), ["drug"]).select("drug", "boot_id", "hr", "unbalanced_covariates")


def _boot_sql(source: str, keys: str = "drug") -> str:
    on = " AND ".join(f"p.{k} = x.{k}" for k in keys.split(", "))
    own = ", ".join(f"s.{k}" for k in keys.split(", "))
    return f"""
    base AS (SELECT {keys}, hr AS v, row_number() OVER (PARTITION BY {keys} ORDER BY boot_id) - 1 AS pos, count(*) OVER (PARTITION BY {keys}) AS n,
        avg(hr) OVER (PARTITION BY {keys}) AS mean0, stddev_samp(hr) OVER (PARTITION BY {keys}) AS sd0 FROM {source}),
    sizes AS (SELECT {keys}, any_value(n) AS n, any_value(mean0) AS mean0, any_value(sd0) AS sd0 FROM base GROUP BY {keys}),
    picks AS (SELECT {own}, s.n, b.b, {v.h32("'0'", "b.b", "i.i", own)} % s.n AS pos
        FROM sizes s JOIN (SELECT unnest(range(1, 101)) AS i) i ON i.i <= s.n, (SELECT unnest(range({N_RESAMPLES})) AS b) b),
    means AS (SELECT {", ".join(f"p.{k}" for k in keys.split(", "))}, p.b, avg(x.v) AS m, stddev_samp(x.v) AS s
        FROM picks p JOIN base x ON {on} AND p.pos = x.pos GROUP BY ALL),
    tests AS (SELECT {own}, s.n, (s.mean0 - 1) / (s.sd0 / sqrt(s.n)) AS t, avg(CASE WHEN (p.m - s.mean0) / (p.s / sqrt(s.n)) >=
        (s.mean0 - 1) / (s.sd0 / sqrt(s.n)) THEN 1.0 ELSE 0.0 END) AS share FROM means p JOIN sizes s ON {on.replace("x.", "s.")} GROUP BY ALL)"""


@query("boot_mean_ci", f"""
    WITH {_boot_sql("estimates")} SELECT drug, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high, round(stddev_pop(m), 6) AS se
    FROM means GROUP BY 1""", ["estimates"])
def boot_mean_ci(spark, d):
    return _r(synthesis.bootstrap_mean_interval(v.estimates(spark, d), ["drug"], "hr", n_resamples=N_RESAMPLES), "ci_low", "ci_high", "se")


@query("boot_mean_pvalue", f"""
    WITH {_boot_sql("estimates")}
    SELECT drug, n AS n_trials, round(t, 6) AS t, round(2 * least(share, 1 - share), 6) AS p FROM tests""", ["estimates"])
def boot_mean_pvalue(spark, d):
    return _r(synthesis.bootstrap_mean_p(v.estimates(spark, d), ["drug"], "hr", 1.0, n_resamples=N_RESAMPLES), "t", "p")


_P = f"SELECT p_brand, ({v.h32('p_brand')} % 1000) / 10000.0 AS p, count(*) AS n FROM part GROUP BY 1"


@query("multiple_testing", f"""
    WITH x AS ({_P}), r AS (SELECT p_brand, p::DOUBLE AS p, n, row_number() OVER (ORDER BY p, p_brand) AS i, count(*) OVER () AS m FROM x),
    h AS (SELECT *, sum(1.0 / i) OVER () AS harmonic FROM r),
    a AS (SELECT p_brand, p, n, least(1, p * m) AS p_bonf, least(1, min(p * m / i) OVER w) AS p_bh, least(1, min(p * m / i * harmonic) OVER w) AS p_by
          FROM h WINDOW w AS (ORDER BY p, p_brand ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT p_brand, p, n, round(p_bonf, 6) AS p_bonf, round(p_bh, 6) AS p_bh, round(p_by, 6) AS p_by, CAST(p_bonf <= 0.05 AS INTEGER) AS sig_bonf,
           CAST(p_bh <= 0.05 AS INTEGER) AS sig_bh, CAST(p_by <= 0.05 AS INTEGER) AS sig_by FROM a""")
def multiple_testing(spark, d):
    brands = v.table(spark, d, "part", "p_brand").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    tested = brands.withColumn("p", (hash32("p_brand") % 1000) / 10000.0)
    return _r(synthesis.adjust_p(tested, ["p_brand"], "p"), "p_bonf", "p_bh", "p_by")


@query("pooled_hr", f"""
    WITH x AS (SELECT drug, ln(hr) AS y, 1 / (((ln(hr_high) - ln(hr_low)) / (2 * {_Z})) ** 2) AS w FROM estimates),
    s AS (SELECT drug, count(*) AS n_pooled, sum(w * y) / sum(w) AS m, 1 / sqrt(sum(w)) AS se FROM x GROUP BY 1)
    SELECT drug, n_pooled, round(exp(m), 6) AS pooled_hr, round(exp(m - {_Z} * se), 6) AS pooled_low, round(exp(m + {_Z} * se), 6) AS pooled_high,
           round(m / se, 6) AS pooled_z FROM s""", ["estimates"])
def pooled_hr(spark, d):
    return _r(synthesis.pool_inverse_variance(v.estimates(spark, d), ["drug"]), "pooled_hr", "pooled_low", "pooled_high", "pooled_z")


def _pooled_sql(tail: str) -> str:
    return f"""
    WITH x AS (SELECT drug, ln(hr) AS y, 1 / (((ln(hr_high) - ln(hr_low)) / (2 * {_Z})) ** 2) AS w FROM estimates),
    s AS (SELECT drug, exp(sum(w * y) / sum(w)) AS pooled_hr, sum(w * y) / sum(w) * sqrt(sum(w)) AS z FROM x GROUP BY 1) {tail}"""


@query("pooled_hr_pvalue", _pooled_sql(f"SELECT drug, round(pooled_hr, 6) AS pooled_hr, round(1 - 2 * {sqlmath.half_normal('z')}, 6) AS pooled_p FROM s"), ["estimates"])
def pooled_hr_pvalue(spark, d):
    pooled = synthesis.with_pooled_p(synthesis.pool_inverse_variance(v.estimates(spark, d), ["drug"]))
    return _r(pooled.select("drug", "pooled_hr", "pooled_p"), "pooled_hr", "pooled_p")


@query("drug_effect_report", f"""
    WITH {_KEPT}, {_boot_sql("kept")},
    ci AS (SELECT drug, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM means GROUP BY 1),
    pooled AS (SELECT drug, sum(w * y) / sum(w) AS m, 1 / sqrt(sum(w)) AS se, sum(w * y) / sum(w) * sqrt(sum(w)) AS z FROM (
        SELECT drug, ln(hr) AS y, 1 / (((ln(hr_high) - ln(hr_low)) / (2 * {_Z})) ** 2) AS w FROM kept) GROUP BY 1),
    n AS (SELECT p_type AS drug, count(*) AS num_treated FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
    p AS (SELECT drug, CAST(2 * least(share, 1 - share) AS DOUBLE) AS p, row_number() OVER (ORDER BY 2 * least(share, 1 - share), drug) AS i, count(*) OVER () AS m FROM tests),
    h AS (SELECT *, sum(1.0 / i) OVER () AS harmonic FROM p),
    adj AS (SELECT drug, p, least(1, p * m) AS bonf, least(1, min(p * m / i) OVER w) AS bh, least(1, min(p * m / i * harmonic) OVER w) AS by_ FROM h
        WINDOW w AS (ORDER BY p, drug ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    est AS (SELECT drug, avg(hr) AS hr, quantile_cont(hr, 0.025) AS p025, quantile_cont(hr, 0.975) AS p975 FROM kept GROUP BY 1)
    SELECT e.drug, n.num_treated, round(e.hr, 3) AS hr, printf('[%.3f, %.3f]', ci.lo, ci.hi) AS ci_mean, printf('[%.3f, %.3f]', p025, p975) AS ci_trials,
           round(exp(q.m), 3) AS pooled_hr, printf('[%.3f, %.3f]', exp(q.m - {_Z} * q.se), exp(q.m + {_Z} * q.se)) AS ci_pooled,
           round(1 - 2 * {sqlmath.half_normal('q.z')}, 3) AS pooled_p, round(a.p, 6) AS p, round(bonf, 6) AS p_bonf, round(bh, 6) AS p_bh, round(by_, 6) AS p_by,
           CAST(bonf <= 0.05 AS INTEGER) AS sig_bonf, CAST(bh <= 0.05 AS INTEGER) AS sig_bh, CAST(by_ <= 0.05 AS INTEGER) AS sig_by,
           CASE WHEN bonf < 0.0001 THEN '<0.0001' ELSE printf('%.4f', bonf) END AS p_bonf_text
    FROM est e JOIN n ON e.drug = n.drug JOIN ci ON e.drug = ci.drug JOIN pooled q ON e.drug = q.drug JOIN adj a ON e.drug = a.drug""", ["estimates"])
def drug_effect_report(spark, d):
    lines = v.table(spark, d, "lineitem", "l_partkey").join(v.table(spark, d, "part", "p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    counts = lines.groupBy(F.col("p_type").alias("drug")).agg(F.count(F.lit(1)).alias("num_treated"))
    return _r(synthesis.drug_summary(v.estimates(spark, d), counts, N_RESAMPLES), "p", "p_bonf", "p_bh", "p_by")


_GROUPS = ["a", "b", "c"]


@query("effect_matrix_report", f"""
    WITH grouped AS (SELECT *, ['a', 'b', 'c'][boot_id % 3 + 1] AS class FROM estimates),
    passing AS (SELECT * FROM grouped WHERE unbalanced_covariates < 20),
    kept AS (SELECT p.* FROM passing p JOIN (SELECT drug, class FROM passing GROUP BY 1, 2 HAVING count(*) >= 10) k ON p.drug = k.drug AND p.class = k.class),
    {_boot_sql("kept", "drug, class")},
    cells AS (SELECT t.drug, t.class, CASE WHEN 2 * least(t.share, 1 - t.share) < 0.05 THEN round(s.mean0, 3) END AS cell
              FROM tests t JOIN sizes s ON t.drug = s.drug AND t.class = s.class)
    SELECT drug, max(CASE WHEN class = 'a' THEN cell END) AS a, max(CASE WHEN class = 'b' THEN cell END) AS b, max(CASE WHEN class = 'c' THEN cell END) AS c
    FROM cells GROUP BY 1""", ["estimates"])
def effect_matrix_report(spark, d):
    classes = F.array(*[F.lit(g) for g in _GROUPS])
    rows = v.estimates(spark, d).withColumn("class", F.get(classes, F.col("boot_id") % 3))
    cells = synthesis.significant_means(rows, ["drug", "class"], "hr", 1.0, N_RESAMPLES)
    return synthesis.effect_matrix(cells, ["drug"], "class", _GROUPS)


@query("effect_direction_label", """
    SELECT drug, boot_id, hr, p, CASE WHEN p < 0.05 AND hr > 1 THEN 'harm' WHEN p < 0.05 AND hr < 1 THEN 'benefit' ELSE 'none' END AS direction,
           round(abs(hr - 1) * 400 + 50, 4) AS size, round(CASE WHEN hr > 1 THEN least(1, (hr - 1) / 1.5) ELSE least(1, 1 - hr) END, 6) AS intensity,
           round(CASE WHEN hr > 1 THEN hr ELSE 1 / hr END, 6) AS magnitude
    FROM (SELECT drug, boot_id, hr, CAST((boot_id % 10) / 100.0 AS DOUBLE) AS p FROM estimates)""", ["estimates"])
def effect_direction_label(spark, d):
    rows = v.estimates(spark, d).select("drug", "boot_id", "hr", ((F.col("boot_id") % 10) / 100.0).alias("p"))
    labelled = synthesis.effect_labels(rows)
    return _r(_r(labelled, "size", digits=4), "intensity", "magnitude")


@query("trial_success_report", """
    SELECT drug, round(avg(ori_unbalanced_covariates), 6) AS mean_before, round(avg(unbalanced_covariates), 6) AS mean_after,
           round(avg(CASE WHEN unbalanced_covariates < 15 THEN 1.0 ELSE 0.0 END), 6) AS share_passing,
           round(quantile_cont(CASE WHEN unbalanced_covariates < 15 THEN hr END, 0.05), 4) AS p05,
           round(quantile_cont(CASE WHEN unbalanced_covariates < 15 THEN hr END, 0.5), 4) AS p50,
           round(quantile_cont(CASE WHEN unbalanced_covariates < 15 THEN hr END, 0.95), 4) AS p95 FROM estimates GROUP BY 1""", ["estimates"])
def trial_success_report(spark, d):
    report = synthesis.success_report(v.estimates(spark, d), ["drug"], below=15)
    return _r(_r(report, "mean_before", "mean_after", "share_passing"), "p05", "p50", "p95", digits=4)


@query("table_one", """
    WITH a AS (SELECT t.ptid, year(t.dx_date) - CASE WHEN c.birth_yr = '1935 and Earlier' THEN 1935 ELSE CAST(c.birth_yr AS INTEGER) END AS age_at_index,
                      c.gender, c.race, c.region, c.ecog, CAST(b.c_acctbal AS DOUBLE) AS bal
               FROM cohort t JOIN clinical c ON t.ptid = c.ptid JOIN customer b ON b.c_custkey = t.ptid),
    u AS (SELECT 'gender' AS variable, gender AS category FROM a UNION ALL SELECT 'race', race FROM a UNION ALL SELECT 'region', region FROM a
          UNION ALL SELECT 'ecog', CAST(ecog AS VARCHAR) FROM a)
    SELECT 'age_at_index' AS variable, CAST(NULL AS VARCHAR) AS category, 'median, IQR' AS metric,
           printf('%.2f(%.2f, %.2f)', median(age_at_index), quantile_cont(age_at_index, 0.25), quantile_cont(age_at_index, 0.75)) AS value FROM a
    UNION ALL SELECT 'bal', NULL, 'median, IQR', printf('%.2f(%.2f, %.2f)', round(median(bal), 2), round(quantile_cont(bal, 0.25), 2), round(quantile_cont(bal, 0.75), 2)) FROM a
    UNION ALL SELECT variable, category, 'count (percentage)',
           CAST(count(*) AS VARCHAR) || ' (' || CAST(round(count(*) / sum(count(*)) OVER (PARTITION BY variable) * 100, 2) AS VARCHAR) || '%)' FROM u GROUP BY 1, 2""",
    ["cohort", "clinical"])
def table_one(spark, d):
    clinical = v.clinical(spark, d)
    base = v.cohort(spark, d).select("ptid", F.col("dx_date").alias("index_date"))
    ages = demographics(clinical, base).select("ptid", "age_at_index")
    bal = v.table(spark, d, "customer", "c_custkey", "c_acctbal").select(F.col("c_custkey").alias("ptid"), F.col("c_acctbal").alias("bal"))
    rows = ages.join(clinical, "ptid").join(bal, "ptid")
    return reports.table_one(rows, ["age_at_index", "bal"], ["gender", "race", "region", "ecog"])


# fixed values of the collapsed table: levels, their common name, the name of all others; levels that stay, the name of the rest
_TWO_LEVELS = {"race": (["Caucasian"], "White", "Non White"), "smoking_status": (["current", "former"], "History of smoking", "No history of smoking")}
_KEPT_LEVELS = {
    "gender": (["Male", "Female", "Unknown"], "Female"), "ethnicity": (["Not Hispanic", "Hispanic"], "Not Hispanic"),
    "region": (["AMERICA", "EUROPE", "ASIA"], "Other/Unknown"),
}


def _collapsed_sql() -> str:
    listed = lambda levels: ", ".join(f"'{lv}'" for lv in levels)
    cases = [f"CASE WHEN {c} IN ({listed(ones)}) THEN '{name}' ELSE '{rest}' END AS {c}" for c, (ones, name, rest) in _TWO_LEVELS.items()]
    cases += [f"CASE WHEN {c} IN ({listed(keep)}) THEN {c} ELSE '{rest}' END AS {c}" for c, (keep, rest) in _KEPT_LEVELS.items()]
    long = " UNION ALL ".join(f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS category FROM a" for c in [*_TWO_LEVELS, *_KEPT_LEVELS, "ecog"])
    ages = " UNION ALL ".join(
        f"SELECT '{n}' AS variable, CAST(NULL AS VARCHAR) AS category, 'median, IQR' AS metric, printf('%.2f(%.2f, %.2f)', median({n}), quantile_cont({n}, 0.25), quantile_cont({n}, 0.75)) AS value FROM a"
        for n in ("age_at_dx", "age_at_prior")
    )
    return f"""
    WITH a AS (SELECT year(t.dx_date) - born AS age_at_dx, year(t.prior_date) - born AS age_at_prior, {", ".join(cases)},
               CASE WHEN ecog >= 2 THEN 2 WHEN ecog >= 0 THEN ecog ELSE 0 END AS ecog
        FROM cohort t JOIN (SELECT c.*, CASE WHEN birth_yr = '1935 and Earlier' THEN 1935 ELSE CAST(birth_yr AS INTEGER) END AS born,
            CASE WHEN b.c_mktsegment = 'AUTOMOBILE' THEN 'current' WHEN b.c_mktsegment = 'MACHINERY' THEN 'former' ELSE 'never' END AS smoking_status,
            CASE WHEN b.c_custkey % 5 = 0 THEN 'Hispanic' WHEN b.c_custkey % 3 = 0 THEN 'Unknown' ELSE 'Not Hispanic' END AS ethnicity
            FROM clinical c JOIN customer b ON c.ptid = b.c_custkey) x ON t.ptid = x.ptid),
    u AS ({long})
    {ages} UNION ALL SELECT variable, category, 'count (percentage)',
           CAST(count(*) AS VARCHAR) || ' (' || CAST(round(count(*) / sum(count(*)) OVER (PARTITION BY variable) * 100, 2) AS VARCHAR) || '%)' FROM u GROUP BY 1, 2"""


@query("table_one_collapsed", _collapsed_sql(), ["cohort", "clinical"])
def table_one_collapsed(spark, d):
    """Table one with ages at diagnosis and at the prior event and with the levels of a publication."""
    segment, k = F.col("c_mktsegment"), F.col("c_custkey")
    habits = v.table(spark, d, "customer", "c_custkey", "c_mktsegment").select(
        k.alias("ptid"), F.when(segment == "AUTOMOBILE", "current").when(segment == "MACHINERY", "former").otherwise("never").alias("smoking_status"),
        F.when(k % 5 == 0, "Hispanic").when(k % 3 == 0, "Unknown").otherwise("Not Hispanic").alias("ethnicity"),
    )
    dates = {"age_at_dx": "dx_date", "age_at_prior": "prior_date"}
    return reports.characteristics(v.cohort(spark, d), v.clinical(spark, d).join(habits, "ptid"), dates, _TWO_LEVELS, _KEPT_LEVELS, {"ecog": 2})


@query("treated_share", f"""
    WITH {USERS_SQL} SELECT drug, count(*) AS num_treated, CAST(count(*) AS VARCHAR) || ' (' ||
        CAST(round(count(*) / (SELECT count(*) FROM therapy) * 100, 2) AS VARCHAR) || '%)' AS num_treated_percentage FROM arm GROUP BY 1""", _SV)
def treated_share(spark, d):
    from trialkit.plans.cohort import new_users

    therapy = cut(v.therapy(spark, d))
    total = therapy.agg(F.count(F.lit(1))).scalar()
    counts = new_users(therapy, v.records(spark, d)).groupBy("drug").agg(F.count(F.lit(1)).alias("num_treated"))
    return counts.withColumn("num_treated_percentage", count_percent(F.col("num_treated"), total))
