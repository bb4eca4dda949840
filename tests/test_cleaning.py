"""The cleaning chain, outcome shares after matching and the collapsed description of a cohort."""

import datetime as dt

import numpy as np
import pytest

from trialkit.operators import reshape
from trialkit.plans import propensity, reports

ROWS = "trial int, id int, treatment int, x double, t string, c string, b boolean, none double"


def _rows():
    rng = np.random.default_rng(3)
    out = []
    for trial in (0, 1):
        for i in range(120):
            x = None if i % 10 == 0 else float(rng.normal(trial * 5, 1))
            out.append((trial, i, i % 2, x, None if i % 9 == 0 else f"{rng.random():.3f}", [None, "u", "v", "v"][i % 4], [None, True, False][i % 3], None))
    out.append((0, 999, 1, 1e6, "word", "w", True, None))
    return out


def test_clean_covariates_by_hand(spark):
    data = _rows()
    cleaned = reshape.clean_covariates(spark.createDataFrame(data, ROWS), ["trial"], ["id"], ["x", "t", "c", "b", "none"], numbers=["treatment"])
    assert cleaned.continuous == ["x", "t", "b", "none"] and cleaned.categorical == ["c_u", "c_v", "c_w"] and cleaned.wide_levels is None
    got = {(r["trial"], r["id"]): r for r in cleaned.rows.collect()}
    assert len(got) == len(data) and dict(cleaned.rows.dtypes)["treatment"] == "double"
    for trial in (0, 1):
        own = [r for r in data if r[0] == trial]
        seen = np.array([r[3] for r in own if r[3] is not None])
        lo, hi = np.quantile(seen, [0.01, 0.99])
        mean = seen[(seen >= lo) & (seen <= hi)].mean()
        share = np.mean([r[6] for r in own if r[6] is not None])
        for r in own:
            row = got[r[0], r[1]]
            assert row["x"] == pytest.approx(r[3] if r[3] is not None and lo <= r[3] <= hi else mean)
            assert row["b"] == pytest.approx(share if r[6] is None else float(r[6]))
            assert (row["c_u"], row["c_v"], row["c_w"]) == {"u": (1, 0, 0), "v": (0, 1, 0), None: (0, 1, 0), "w": (0, 0, 1)}[r[5]]
            assert row["none"] is None and row["t"] is not None
    assert got[0, 999]["x"] < 100


def test_covariates_of_many_levels_go_to_the_long_form(spark):
    df = spark.createDataFrame([(0, i, 0, 1.0, "1.5", f"l{i % 30}", True, 1.0) for i in range(60)], ROWS)
    cleaned = reshape.clean_covariates(df, ["trial"], ["id"], ["c", "x"], at_most=20)
    assert cleaned.categorical == [] and "c" not in cleaned.rows.columns and cleaned.rows.count() == 60
    assert {(r["id"], r["covariate"], r["level"]) for r in cleaned.wide_levels.collect()} == {(i, "c", f"l{i % 30}") for i in range(60)}


def test_cleaning_an_empty_table(spark):
    cleaned = reshape.clean_covariates(spark.createDataFrame([], ROWS), ["trial"], ["id"], ["x", "c", "b"])
    assert cleaned.rows.count() == 0 and cleaned.categorical == []


def test_shares_after_matching_only_of_balanced_trials(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(160):
        arm = i % 4 == 0
        rows.append((0, i, int(arm), float(rng.normal()), float(rng.normal()), int(rng.random() < 0.3)))
        rows.append((1, i, int(arm), float(rng.normal(6 if arm else 0)), float(rng.normal(6 if arm else 0)), int(rng.random() < 0.3)))
    df = spark.createDataFrame(rows, "trial int, id int, treatment int, a double, b double, flag int")
    pairs, report = propensity.incidence_after_matching(df, ["trial"], ["a", "b"], "flag", threshold=0.6)
    got = {r["trial"]: r for r in report.collect()}
    flags = {(r[0], r[1]): r[5] for r in rows}
    assert got[0]["balanced"] == 1 and got[1]["balanced"] == 0
    assert got[0]["incidence_treated"] == pytest.approx(np.mean([r[5] for r in rows if r[0] == 0 and r[2] == 1]))
    found = [(r["t_id"], r["c_id"]) for r in pairs.where("trial = 0").collect()]
    treated, control = (np.mean([flags[0, i] for i in {p[k] for p in found}]) for k in (0, 1))
    assert got[0]["matched_treated"] == pytest.approx(treated) and got[0]["matched_ate"] == pytest.approx(treated - control)
    assert all(got[1][c] is None for c in ("incidence_treated", "ate", "matched_treated", "matched_ate"))


def test_characteristics_keep_patients_without_a_clinical_row(spark):
    day = dt.date(2020, 5, 1)
    cohort = spark.createDataFrame([(1, day, None), (2, day, dt.date(2010, 1, 1)), (3, day, None)], "ptid int, dx date, prior date")
    clinical = spark.createDataFrame([(1, "A", "West", 3, "1950"), (2, "B", "Moon", None, "1960")], "ptid int, race string, region string, ecog int, birth_yr string")
    found = reports.characteristics(cohort, clinical, {"age": "dx", "before": "prior"}, {"race": (["A"], "one", "rest")}, {"region": (["West"], "Other")}, {"ecog": 2})
    got = {(r["variable"], r["category"]): r["value"] for r in found.collect()}
    assert got["age", None] == "65.00(62.50, 67.50)" and got["before", None] == "50.00(50.00, 50.00)"
    assert got["race", "one"].startswith("1 (33.33") and got["race", "rest"].startswith("2 (66.67")
    assert got["region", "Other"].startswith("2 (") and got["ecog", "0"].startswith("2 (") and got["ecog", "2"].startswith("1 (")
