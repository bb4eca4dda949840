"""Trials whose rows are made in the tasks that estimate them: the same estimates as from rows, without the rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialkit.plans import features, outcomes, study, trial_fit

START = dt.date(2020, 11, 1)  # index dates go past the turn of the year
NAMES = ["a", "b"]


def day(k):
    return START + dt.timedelta(days=int(k))


def made(spark, text=False, copies=1, twice=False):
    """A study of two drugs; `copies` repeats the clinical rows, `twice` gives patients a second therapy date."""
    rng = np.random.default_rng(11)
    name, kind = ((lambda i: f"PT{i}"), "string") if text else (int, "long")
    n = 240
    therapy = [(name(i), day(i % 40)) for i in range(n)] + ([(name(i), day(70)) for i in range(0, n, 3)] if twice else [])
    records = [(name(i), drug, day(i % 40 + k)) for drug, low, high in (("x", 0, 70), ("Y", 50, 130)) for i in range(low, high) for k in (i % 60, i % 60 + 9)]
    died, last = rng.random(n) < 0.5, rng.integers(90, 600, n)
    outcome = [(name(i), int(died[i]), day(last[i]) if died[i] else None, day(last[i])) for i in range(n) if i != 200]
    events = [(name(rng.integers(0, n)), str(rng.choice(NAMES)), day(rng.integers(-430, 300)), float(rng.integers(0, 9))) for _ in range(1500)]
    clinical = [(name(i), "Male" if i % 2 else "Female", "Caucasian" if i % 3 else "Other", str(1940 + i % 40)) for i in range(n) if i % 17] * copies
    therapy = spark.createDataFrame(therapy, f"ptid {kind}, therapy_date date")
    records = spark.createDataFrame(records, f"ptid {kind}, drug string, rx_date date")
    outcome = spark.createDataFrame(outcome, f"ptid {kind}, d_flag int, available_date date, last_act_dt date")
    events = spark.createDataFrame(events, f"ptid {kind}, name string, date date, value double").localCheckpoint()
    clinical = spark.createDataFrame(clinical, f"ptid {kind}, gender string, race string, birth_yr string")
    labs = events.select("ptid", "name", "date", F.col("value").cast("string").alias("result"))
    at = lambda keys: features.baseline(
        keys, clinical, events, events, labs, events, events, sites=NAMES, vitals=NAMES, labs=NAMES, drugs=NAMES, diagnoses=NAMES
    )
    return study.build_trials(therapy, records, outcome, at, n_boot=3, min_treated=20, changes=features.change_days(events)), events


def table(df, by):
    return df.toPandas().sort_values(by).reset_index(drop=True)


def assert_equal(got, want):
    assert list(got.columns) == list(want.columns) and len(got) == len(want) > 0
    for c in got.columns:
        if got[c].dtype.kind == "f":
            np.testing.assert_allclose(got[c], want[c], rtol=1e-9)
        else:
            assert got[c].astype(str).equals(want[c].astype(str)), c


@pytest.mark.parametrize("text,copies", [(True, 1), (False, 2)])
def test_trials_made_in_tasks_equal_those_of_rows(spark, monkeypatch, text, copies):
    built, events = made(spark, text, copies)
    assert built.pooled is not None
    last = built.outcome.select("ptid", "last_act_dt")
    strata = outcomes.study_strata(NAMES)
    with monkeypatch.context() as m:  # no row of a trial is stored
        m.setattr(study.outcomes, "assemble_trials", lambda *a: pytest.fail("stored the rows of the trials"))
        estimates, matched = study.estimate_trials(built, built.covariates, watched=study.Watched(events, NAMES, last))
        by_class = study.class_estimates(matched, events, estimates, NAMES, last)
        got = [table(estimates, study.TRIAL), table(by_class, [*study.TRIAL, "class"])]
        got.append(table(study.stratum_estimates(built, built.covariates, strata), [*study.TRIAL, "stratum"]))
    rows = built.rows
    assert rows.groupBy("drug").agg(F.count_distinct("boot_id").alias("n")).where("n = 3").count() == 2
    estimates, matched = study.estimate_trials(rows, built.covariates)
    assert_equal(got[0], table(estimates, study.TRIAL))
    assert_equal(got[1], table(study.class_estimates(matched, events, estimates, NAMES, last), [*study.TRIAL, "class"]))
    assert_equal(got[2], table(study.stratum_estimates(rows, built.covariates, strata), [*study.TRIAL, "stratum"]))


def test_trials_too_large_for_a_task_and_several_therapy_dates_go_by_rows(spark, monkeypatch):
    assert made(spark, twice=True)[0].pooled is None
    built, _ = made(spark)
    want = table(study.estimate_trials(built, built.covariates)[0], study.TRIAL)
    monkeypatch.setattr(study, "TASK_BYTES", 70 * 6 * 8 * (len(built.covariates) + 7) - 1)
    monkeypatch.setattr(study.trial_pool, "estimated", lambda *a: pytest.fail("made in tasks"))
    got = table(study.estimate_trials(built, built.covariates, task_rows=None)[0], study.TRIAL)
    np.testing.assert_allclose(got["hr_ori"], want["hr_ori"], rtol=1e-6)


def test_covariates_stay_the_same_between_change_days(spark):
    events = spark.createDataFrame([(1, "a", day(0), 1.0), (1, "b", day(30), 2.0), (1, "a", None, 1.0)], "ptid long, name string, date date, value double")
    turns = {r["day"] for r in features.change_days(events).collect()} | {dt.date(y, 1, 1) for y in range(2020, 2023)}
    assert day(366) in turns and day(0) in turns and None not in turns
    keys = spark.createDataFrame([(1, day(k)) for k in range(-3, 420)], "ptid long, index_date date")
    clinical = spark.createDataFrame([(1, "Male", "Other", "1950")], "ptid long, gender string, race string, birth_yr string")
    labs = events.withColumn("result", F.col("value").cast("string"))
    rows = features.baseline(keys, clinical, events, events, labs, events, events, sites=NAMES, vitals=NAMES, labs=NAMES, drugs=NAMES, diagnoses=NAMES)
    rows = [tuple(r) for r in rows.orderBy("index_date").collect()]
    changed = [b[1] for a, b in zip(rows, rows[1:]) if a[2:] != b[2:]]
    assert changed and set(changed) <= turns


def test_rows_with_the_same_covariates_have_the_same_score():
    rng = np.random.default_rng(2)
    kinds = rng.normal(size=(9, 40)) * 10.0 ** np.arange(-2, 7)[:, None]
    of = rng.integers(0, 40, 10_007)
    score = trial_fit.propensity(kinds[:, of], rng.random(10_007) < 0.2)
    assert all(len(np.unique(score[of == k])) == 1 for k in range(40))
