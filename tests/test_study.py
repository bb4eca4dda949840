"""The study on simulated trials: a known hazard comes back, text ids work, fits say when they did not converge."""

import datetime as dt
import math
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trialkit.plans import features, study, survival, trial_fit
from trialkit.plans.models import logistic_coefficients

START = dt.date(2020, 1, 1)


def simulated(effect, n=1500, seed=0):
    rng = np.random.default_rng(seed)
    x, z = rng.normal(size=n), rng.normal(size=n)
    treated = (rng.random(n) < 1 / (1 + np.exp(1.4 - 0.6 * x))).astype(int)
    days = np.ceil(rng.exponential(1 / (0.004 * np.exp(effect * treated + 0.4 * x)))).astype(int)
    censor = rng.integers(100, 600, n)
    return pd.DataFrame({"id": np.arange(n), "ptid": np.arange(n), "treatment": treated, "x": x, "z": z, "d_delta_days": np.minimum(days, censor), "d_flag": (days <= censor).astype(int)})


def test_known_log_hazard_comes_back_after_matching(spark):
    effects = {0: 0.7, 1: -0.5}
    rows = pd.concat([simulated(e, seed=5 + k).assign(drug="d", boot_id=k) for k, e in effects.items()])
    estimates, matched = study.estimate_trials(spark.createDataFrame(rows), ["x", "z"])
    got = {r["boot_id"]: r for r in estimates.collect()}
    for k, e in effects.items():
        assert abs(math.log(got[k]["hr"]) - e) < 0.3 and math.log(got[k]["hr_low"]) < e < math.log(got[k]["hr_high"])
        assert got[k]["unbalanced_covariates"] <= got[k]["ori_unbalanced_covariates"]
    counts = matched.groupBy("boot_id", "treatment").count().collect()
    assert len({(r["boot_id"], r["count"]) for r in counts}) == 2  # as many controls as treated


@pytest.mark.parametrize("text", [False, True])
def test_whole_study_with_number_and_text_ids(spark, text):
    rng = np.random.default_rng(3)
    name = (lambda i: f"PT{i}") if text else int
    day = lambda k: START + dt.timedelta(days=int(k))
    kind = "string" if text else "long"
    therapy = spark.createDataFrame([(name(i), day(i % 30)) for i in range(120)], f"ptid {kind}, therapy_date date")
    records = spark.createDataFrame([(name(i), "drug", day(i % 30 + k)) for i in range(40) for k in (5, 20)], f"ptid {kind}, drug string, rx_date date")
    died = rng.random(120) < 0.5
    last = rng.integers(60, 400, 120)
    outcome = spark.createDataFrame([(name(i), int(died[i]), day(last[i]) if died[i] else None, day(last[i])) for i in range(120)], f"ptid {kind}, d_flag int, available_date date, last_act_dt date")
    ages = spark.createDataFrame([(name(i), float(rng.normal())) for i in range(120)], f"ptid {kind}, x double")
    built = study.build_trials(therapy, records, outcome, lambda keys: keys.join(ages, "ptid").select(*features.KEY, "x"), n_boot=3, min_treated=10)
    assert built.rows.groupBy("boot_id").agg(F.count_distinct("id", "treatment").alias("n"), F.count(F.lit(1)).alias("m")).where("n <> m").count() == 0
    estimates, _ = study.estimate_trials(built.rows, built.covariates)
    assert sorted(r["boot_id"] for r in estimates.collect()) == [0, 1, 2]


def test_class_estimates_keep_rows_with_follow_up_below_zero_or_none(spark):
    day = lambda k: START + dt.timedelta(days=k)
    # patients 0 to 3 are treated, 4 to 7 controls; 1 and 4 have an index date after their last activity, 5 has no activity
    last = {0: 100, 1: -10, 2: 100, 3: 100, 4: -20, 5: None, 6: 100, 7: 100}
    hits = {0: 50, 2: 60, 6: 40}
    kinds = "drug string, boot_id int, ptid long, index_date date, treatment int"
    matched = spark.createDataFrame([("d", 0, i, START, int(i < 4)) for i in last], kinds)
    events = spark.createDataFrame([(i, "e", day(k)) for i, k in hits.items()], "ptid long, name string, date date")
    acted = spark.createDataFrame([(i, None if k is None else day(k)) for i, k in last.items()], "ptid long, last_act_dt date")
    balance = spark.createDataFrame([("d", 0, 1)], "drug string, boot_id int, unbalanced_covariates int")
    got = study.class_estimates(matched, events, balance, ["e"], acted).first()
    assert got["OR_all_day"] == got["OR_180day"] == pytest.approx((2 * 3) / (2 * 1))
    rate = 2 / ((50 + 60 + 100 - 10) / 365.25) - 1 / ((40 + 100 - 20) / 365.25)
    assert got["diff_ir_all_day"] == pytest.approx(rate) and got["diff_ir_180day"] == pytest.approx(rate)
    kept = study.class_estimates(matched, events, balance, ["e"], acted, min_days=0).first()
    assert kept["n_dropped"] == 3 and kept["OR_all_day"] == pytest.approx((2 * 1) / (1 * 1))


def test_fits_that_do_not_settle_say_so(spark):
    separable = spark.createDataFrame([("a", float(i), int(i >= 20)) for i in range(40)], "trial string, x double, y int")
    fit = lambda steps, l2: logistic_coefficients(separable, ["trial"], ["x"], "y", l2=l2, steps=steps).first()["_converged"]
    assert fit(1, 1.0) is False and fit(30, 1.0) is True
    rows = spark.createDataFrame(simulated(0.7, 200).assign(trial=1))
    assert survival.hazard_ratio(rows, ["trial"], "d_delta_days", "d_flag", steps=1).first()["converged"] is False
    assert survival.hazard_ratio(rows, ["trial"], "d_delta_days", "d_flag").first()["converged"] is True


def test_trials_in_tasks_and_by_steps_give_the_same_estimates(spark):
    rows = pd.concat([simulated(e, 400, seed=20 + k).assign(drug="d", boot_id=k) for k, e in enumerate((0.6, -0.4))])
    rows["x"] = rows["x"].where(np.arange(len(rows)) % 7 > 0).round(1)  # gaps and equal values
    rows["same"], rows["none"] = 0.1, np.nan
    rows.loc[rows.index % 50 == 0, "d_delta_days"] = -3
    frame = spark.createDataFrame(rows.astype({"none": float}))
    frame = frame.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("x", "none")})
    strata = {"low": F.col("z") < 0, "high": F.col("z") >= 0, "few": F.col("z") > 2.2, "all": F.lit(True), "nobody": F.lit(False)}
    for parts in (None, strata):
        keys = ["drug", "boot_id", *(["stratum"] if parts else [])]
        found = {}
        for size in (200_000, 0):
            estimates, matched = study.estimate_trials(frame, ["x", "z", "same", "none"], strata=parts, task_rows=size)
            found[size] = (estimates.toPandas().sort_values(keys).reset_index(drop=True), sorted(map(tuple, matched.select(*keys, "id").collect())))
        (a, ids), (b, others) = found.values()
        assert ids == others and len(ids) > 200
        assert a[keys].equals(b[keys]) and len(a) == (8 if parts else 2)
        for c in study._ESTIMATES:
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-6)
        for c in study._COUNTS:
            assert a[c].astype("Int64").equals(b[c].astype("Int64")), c


def large_trial(spark, n):
    noise = lambda what: (F.xxhash64("id", F.lit(what)) % 1000) / 1000.0
    return spark.range(n).select(
        F.lit("d").alias("drug"), F.lit(0).alias("boot_id"), "id", (F.col("id") % 6 == 0).cast("int").alias("treatment"),
        (F.pmod(F.xxhash64("id"), F.lit(900))).cast("int").alias("d_delta_days"), (F.col("id") % 11 < 4).cast("int").alias("d_flag"),
        *[F.when(F.col("id") % (k + 5) > 0, noise(k)).alias(f"x{k}") for k in range(3)],
    )


def test_a_trial_of_more_rows_than_one_matching_task_takes_is_estimated_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(study, "_estimate_by_steps", lambda *a: pytest.fail("went through whole tables"))
    estimates, matched = study.estimate_trials(large_trial(spark, 210_000), ["x0", "x1", "x2"])
    assert estimates.count() == 1 and matched.count() == 70_000


def test_a_trial_in_a_task_takes_little_more_than_its_numbers():
    n, names = 300_000, [f"x{k}" for k in range(20)]
    rng = np.random.default_rng(5)
    columns = {"id": np.arange(n), "_tie": rng.integers(0, 1 << 32, n), "_strata": np.ones(n, np.int64), "_train": (rng.random(n) < 0.7).astype(np.int64),
               "treatment": (rng.random(n) < 0.2).astype(np.int64), "t": rng.integers(0, 500, n), "e": rng.integers(0, 2, n)}
    trial = pa.table(columns | {c: np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, 9, n)) for c in names})
    tracemalloc.start()
    found = trial_fit.estimates_of(trial, names, "t", "e", 1, 0.2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 1 and len(found[0]["matched"]) == 2 * columns["treatment"].sum()
    assert peak < 3.5 * n * len(names) * 8
