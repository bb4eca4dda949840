import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trialkit.plans import synthesis


def test_pooling_ratios(spark):
    rng = random.Random(11)
    hr = [math.exp(rng.gauss(-0.1, 0.2)) for _ in range(7)]
    spread = [rng.uniform(0.1, 0.4) for _ in hr]
    low, high = [h * math.exp(-s) for h, s in zip(hr, spread)], [h * math.exp(s) for h, s in zip(hr, spread)]
    df = spark.createDataFrame([("d", *r) for r in zip(hr, low, high)], "drug string, hr double, hr_low double, hr_high double")
    got = synthesis.with_pooled_p(synthesis.pool_inverse_variance(df, ["drug"])).first()
    z = 1.959963984540054
    w = [((math.log(h) - math.log(lo)) / (2 * z)) ** -2 for lo, h in zip(low, high)]
    mean = sum(a * math.log(b) for a, b in zip(w, hr)) / sum(w)
    assert math.isclose(got["pooled_hr"], math.exp(mean))
    assert got["pooled_high"] - got["pooled_low"] < min(h - lo for lo, h in zip(low, high))
    assert math.isclose(got["pooled_p"], math.erfc(abs(mean) * math.sqrt(sum(w)) / math.sqrt(2)))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0.0001, 1), min_size=1, max_size=12))
def test_adjusted_p_are_ordered(spark, ps):
    df = spark.createDataFrame(list(enumerate(ps)), "k int, p double")
    for r in synthesis.adjust_p(df, ["k"], "p").collect():
        assert r["p"] <= r["p_bh"] + 1e-12 and r["p_bh"] <= r["p_by"] + 1e-12 <= 1 + 2e-12 and r["p_bh"] <= r["p_bonf"] + 1e-12


def test_adjusted_p_by_hand(spark):
    ps = [0.001, 0.005, 0.012, 0.030, 0.045, 0.075, 0.200, 0.500]
    df = spark.createDataFrame(list(enumerate(ps)), "k int, p double")
    got = {r["k"]: r for r in synthesis.adjust_p(df, ["k"], "p").collect()}
    raw = [p * 8 / (i + 1) for i, p in enumerate(ps)]
    assert all(math.isclose(got[i]["p_bh"], min(raw[i:])) for i in range(8))
    assert math.isclose(got[0]["p_bonf"], 0.008)


def test_gate_needs_enough_balanced_trials(spark):
    rows = [("a", i, 5 if i < 10 else 25) for i in range(20)] + [("b", i, 5 if i < 9 else 25) for i in range(20)]
    df = spark.createDataFrame(rows, "drug string, boot_id int, unbalanced_covariates int")
    kept = synthesis.balanced_trials(df, ["drug"]).collect()
    assert {r["drug"] for r in kept} == {"a"} and len(kept) == 10


def test_bootstrap_finds_a_shifted_mean(spark):
    rng = random.Random(1)
    rows = [(k, i, 1 + shift + rng.gauss(0, 0.1)) for k, shift in (("null", 0.0), ("shifted", 0.2)) for i in range(60)]
    df = spark.createDataFrame(rows, "drug string, boot_id int, hr double")
    p = {r["drug"]: r["p"] for r in synthesis.bootstrap_mean_p(df, ["drug"], "hr", 1.0, n_resamples=400).collect()}
    assert p["shifted"] < 0.01 < p["null"]
    ci = {r["drug"]: r for r in synthesis.bootstrap_mean_interval(df, ["drug"], "hr", n_resamples=400).collect()}
    assert ci["shifted"]["ci_low"] > 1.1 and ci["null"]["ci_low"] < 1.0 < ci["null"]["ci_high"]


def test_infinite_and_missing_estimates_are_left_out(spark):
    df = spark.createDataFrame([("d", 0, 1.0), ("d", 1, float("inf")), ("d", 2, float("nan")), ("d", 3, None), ("d", 4, 2.0)], "drug string, boot_id int, hr double")
    assert synthesis.estimate_percentiles(df, ["drug"], "hr", {"p50": 0.5}).first()["p50"] == 1.5


@pytest.mark.parametrize("range_rows", [7, 50_000])
def test_adjusted_p_over_ranges_equal_the_sorted_walk(spark, range_rows):
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.random(300) ** 4, np.full(120, 0.01), np.zeros(3), np.ones(4)])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)] + [(9000, None), (9001, float("nan"))], "k int, p double")
    got = {r["k"]: r for r in synthesis.adjust_p(df, ["k"], "p", range_rows=range_rows).collect()}
    order, m = np.argsort(p, kind="stable"), len(p)
    step = np.minimum.accumulate((p[order] * m / np.arange(1, m + 1))[::-1])[::-1]
    harmonic = (1 / np.arange(1, m + 1)).sum()
    assert set(got) == set(range(m))
    for k, s in zip(order.tolist(), step):
        assert got[k]["p_bh"] == pytest.approx(min(1, s)) and got[k]["p_by"] == pytest.approx(min(1, s * harmonic))
        assert got[k]["p_bonf"] == pytest.approx(min(1, p[k] * m)) and got[k]["sig_bh"] == int(min(1, s) <= 0.05)


def test_adjusted_p_of_nothing(spark):
    found = synthesis.adjust_p(spark.createDataFrame([(1, None)], "k int, p double"), ["k"], "p")
    assert found.count() == 0 and found.columns == ["k", "p", "p_bonf", "p_bh", "p_by", "sig_bonf", "sig_bh", "sig_by"]


def test_adjusted_p_has_no_window_over_all_rows(spark):
    df = spark.range(50).select("id", (F.col("id") / 50).alias("p"))
    plan = synthesis.adjust_p(df, ["id"], "p")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_all#" in line.split("], [")[1] for line in windows)
