import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trialkit.plans import bootstrap, models, parametric, survival


def rows(seed=0, n=400, beta=0.7, groups=2):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        x = rng.normal(0, 1, n)
        z = rng.normal(2, 3, n)
        t = (rng.random(n) < 1 / (1 + np.exp(-(0.8 * x - 0.3)))).astype(int)
        life = np.ceil(rng.exponential(120 * np.exp(-beta * t - 0.4 * x))).clip(1)
        stop = rng.integers(30, 400, n)
        out.append(pd.DataFrame({"trial": g, "id": np.arange(n), "treatment": t, "x": x, "z": z, "days": np.minimum(life, stop).astype(int), "flag": (life <= stop).astype(int)}))
    return pd.concat(out)


def ridge_logistic(x, y, l2=1.0):
    x = np.column_stack((np.ones(len(x)), x))
    pen = np.array([0.0] + [l2] * (x.shape[1] - 1))
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen), x.T @ (y - p) - pen * b)
    return b


def test_logistic_matches_direct_newton(spark):
    pdf = rows()
    betas = models.logistic_coefficients(spark.createDataFrame(pdf), ["trial"], ["x", "z"], "treatment").toPandas()
    for g, p in pdf.groupby("trial"):
        got = betas[betas._g == f'{{"trial":{g}}}']["_beta"].iloc[0]
        assert np.allclose(got, ridge_logistic(p[["x", "z"]].to_numpy(), p.treatment.to_numpy()), atol=1e-6)


def test_weights_count_as_copies(spark):
    pdf = rows(groups=1)
    pdf["w"] = 1 + pdf["id"] % 3
    once = models.logistic_coefficients(spark.createDataFrame(pdf), ["trial"], ["x"], "treatment", "w").first()["_beta"]
    twice = pdf.loc[pdf.index.repeat(pdf["w"])]
    assert np.allclose(once, ridge_logistic(twice[["x"]].to_numpy(), twice.treatment.to_numpy()), atol=1e-6)


def test_linear_fit_and_standardization(spark):
    pdf = rows(groups=1)
    pdf["y"] = 1.0 + 2.0 * pdf["treatment"] + 0.5 * pdf["x"]
    df = spark.createDataFrame(pdf)
    assert np.allclose(models.linear_coefficients(df, ["trial"], ["treatment", "x"], "y").first()["_beta"], [1.0, 2.0, 0.5])
    assert np.isclose(models.standardized_effect(df, ["trial"], ["x"], "y").first()["ate"], 2.0)
    for sent in (64 << 20, 200):  # all resamples together, or a few at a time
        wide = bootstrap.bootstrap_effect(df, ["trial"], ["x"], "y", n_boot=10, sent_bytes=sent).first()
        assert np.isclose(wide["ate_mean"], 2.0) and wide["n_resamples"] == wide["n_settled"] == 10


def test_bootstrap_refits_match_single_fits(spark):
    pdf = rows(groups=2)
    pdf["y"] = (pdf["x"] + pdf["treatment"] + pdf["id"] % 7 > 4).astype(int)
    df = spark.createDataFrame(pdf)
    got = {r["trial"]: r["ate_mean"] for r in bootstrap.bootstrap_effect(df, ["trial"], ["x", "z"], "y", n_boot=3).collect()}
    one = []
    for b in range(3):
        copied = df.withColumn("w", bootstrap.copies_of(F.lit(b), ["id"])).where("w > 0")
        one += models.standardized_effect(copied, ["trial"], ["x", "z"], "y", weight="w").collect()
    for t, mean in got.items():
        assert np.isclose(mean, np.mean([r["ate"] for r in one if r["trial"] == t]), atol=1e-6)


def test_resample_counts_look_like_poisson(spark):
    df = spark.range(2000)
    drawn = df.withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(19))))
    copies = drawn.groupBy("boot").agg(F.sum(bootstrap.copies_of(F.col("boot"), ["id"])).alias("n")).toPandas()
    assert abs(copies["n"].mean() - 2000) < 40 and copies["n"].nunique() > 10


# ---- survival --------------------------------------------------------------------------------------


def efron(p, beta, cols, penalizer=0.0):
    """Gradient and Hessian of the Efron partial likelihood, patient by patient."""
    x = p[cols].to_numpy(float)
    x = (x - x.mean(0)) / x.std(0, ddof=1) if penalizer else x
    e = np.exp(x @ beta)
    t, d = p.days.to_numpy(), p.flag.to_numpy()
    g, h = np.zeros(len(cols)), np.zeros((len(cols), len(cols)))
    for day in np.unique(t[d == 1]):
        risk, dead = t >= day, (t == day) & (d == 1)
        m = dead.sum()
        for j in range(m):
            w = np.where(risk, e, 0) - j / m * np.where(dead, e, 0)
            mean = (w[:, None] * x).sum(0) / w.sum()
            g += x[dead].sum(0) / m - mean
            h += (x * w[:, None]).T @ x / w.sum() - np.outer(mean, mean)
    n = len(p)
    return g - penalizer * n * beta, h + penalizer * n * np.eye(len(cols))


def solve(p, cols, penalizer=0.0):
    b = np.zeros(len(cols))
    for _ in range(15):
        g, h = efron(p, b, cols, penalizer)
        b = b + np.linalg.solve(h, g)
    return b, efron(p, b, cols, penalizer)[1]


def test_hazard_ratio_matches_partial_likelihood(spark):
    pdf = rows(seed=4)
    got = survival.hazard_ratio(spark.createDataFrame(pdf), ["trial"], "days", "flag").toPandas().set_index("trial")
    for g, p in pdf.groupby("trial"):
        b, h = solve(p, ["treatment"])
        assert np.isclose(got.loc[g, "log_hr"], b[0]) and np.isclose(got.loc[g, "se"], h[0, 0] ** -0.5)


def test_hazard_ratio_recovers_the_truth_and_inverts(spark):
    rng = np.random.default_rng(2)
    n = 6000
    t = rng.integers(0, 2, n)
    life = np.ceil(rng.exponential(200 * np.exp(-0.5 * t)))
    pdf = pd.DataFrame({"trial": 0, "treatment": t, "days": life.astype(int), "flag": 1})
    df = spark.createDataFrame(pdf)
    fit = survival.hazard_ratio(df, ["trial"], "days", "flag").first()
    assert abs(fit["log_hr"] - 0.5) < 0.1
    swapped = survival.hazard_ratio(df.withColumn("treatment", 1 - F.col("treatment")), ["trial"], "days", "flag").first()
    assert np.isclose(swapped["hr"] * fit["hr"], 1.0)


def test_trials_without_an_estimate_are_null(spark):
    df = spark.sql("select * from values ('censored', 1, 5, 0), ('censored', 0, 6, 0), ('one arm', 1, 5, 1), ('one arm', 1, 7, 1) t(trial, treatment, days, flag)")
    assert {r["hr"] for r in survival.hazard_ratio(df, ["trial"], "days", "flag").collect()} == {None}
    assert {r["time_ratio"] for r in parametric.time_ratio(df, ["trial"], "days", "flag").collect()} == {None}


def test_adjusted_cox_matches_direct_fit(spark):
    pdf = rows(seed=6, n=150)
    cols = ["treatment", "x"]
    got = survival.adjusted_hazard_ratios(spark.createDataFrame(pdf), ["trial"], "days", "flag", cols).toPandas()
    for g, p in pdf.groupby("trial"):
        b, _ = solve(p, cols, 0.1)
        mine = got[got.trial == g].set_index("covariate").loc[cols]
        assert np.allclose(mine["coef"], b / p[cols].std(ddof=1).to_numpy(), atol=1e-6)
        assert ((mine["hr_low"] < mine["hr"]) & (mine["hr"] < mine["hr_high"])).all() and mine["p"].between(0, 1).all()


def test_kaplan_meier_falls_and_unit_weights_change_nothing(spark):
    df = spark.createDataFrame(rows(seed=8, n=200)).withColumn("w", F.lit(1.0))
    plain = survival.kaplan_meier(df, ["trial"], "days", "flag").toPandas().sort_values(["trial", "arm", "time"])
    weighted = survival.kaplan_meier(df, ["trial"], "days", "flag", weight="w").toPandas().sort_values(["trial", "arm", "time"])
    assert np.allclose(plain["survival"], weighted["survival"])
    assert (plain.groupby(["trial", "arm"])["survival"].diff().dropna() <= 1e-12).all()


def test_lognormal_without_censoring_is_closed_form(spark):
    rng = np.random.default_rng(3)
    t = rng.integers(0, 2, 500)
    days = np.exp(rng.normal(4 + 0.3 * t, 0.5))
    pdf = pd.DataFrame({"trial": 0, "treatment": t, "days": days, "flag": 1})
    fit = parametric.time_ratio(spark.createDataFrame(pdf), ["trial"], "days", "flag").first()
    logs = np.log(days)
    gap = logs[t == 1].mean() - logs[t == 0].mean()
    resid = logs - np.where(t == 1, logs[t == 1].mean(), logs[t == 0].mean())
    assert np.isclose(np.log(fit["time_ratio"]), gap, atol=1e-6) and np.isclose(fit["scale"], np.sqrt((resid**2).mean()), atol=1e-6)


def test_likelihood_derivatives(spark):
    rng = np.random.default_rng(5)
    t, d = rng.exponential(50, 40) + 1, rng.random(40) < 0.6
    x, n = np.column_stack((np.ones(40), rng.integers(0, 2, 40))), rng.integers(1, 4, 40).astype(float)
    theta = np.array([3.0, 0.4, -0.2])
    for family in parametric.FAMILIES:
        value, grad, hess = parametric._likelihood(family, theta, x, np.log(t), d, n)
        for i in range(3):
            step = np.zeros(3)
            step[i] = 1e-5
            up, down = (parametric._likelihood(family, theta + s, x, np.log(t), d, n) for s in (step, -step))
            assert np.isclose((up[0] - down[0]) / 2e-5, grad[i], rtol=1e-4, atol=1e-4)
            assert np.allclose((up[1] - down[1]) / 2e-5, hess[i], rtol=1e-3, atol=1e-3)


def test_weibull_data_prefers_weibull(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"trial": 0, "treatment": rng.integers(0, 2, 2000), "days": 100 * rng.weibull(3.0, 2000) + 1e-3, "flag": 1})
    assert parametric.family_aic(spark.createDataFrame(pdf), ["trial"], "days", "flag").first()["best"] == "weibull"


def test_weibull_with_few_patients_stays_finite(spark):
    # late events far above the mean of log time once sent the fit off
    days = [1, 2, 3, 900, 1000, 1100, 1200, 1300]
    pdf = pd.DataFrame({"trial": 0, "treatment": [0, 1] * 4, "days": days, "flag": [0, 0, 0, 1, 1, 1, 1, 1]})
    fit = parametric.time_ratio(spark.createDataFrame(pdf), ["trial"], "days", "flag", family="weibull").first()
    assert 0.1 < fit["time_ratio"] < 10 and fit["ratio_low"] < fit["time_ratio"] < fit["ratio_high"]
