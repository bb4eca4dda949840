import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialkit.plans.matching import distance_mad, distance_profile, match_nearest, matched_rows, nearest_controls


def trials(seed, n=60, grid=None, groups=2):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        score = rng.normal(0, 1, n)
        if grid:
            score = np.round(score / grid) * grid
        treat = (rng.random(n) < 0.3 + 0.15 * (score > 0)).astype(int)
        out.append(pd.DataFrame({"trial": g, "id": np.arange(n) + 1000 * g, "treatment": treat, "score": score}))
    return pd.concat(out)


def closest_first(pdf, caliper=np.inf, ratio=1):
    """Brute force over all pairs of one trial."""
    pairs, used, open_t = [], set(), set(pdf[pdf.treatment == 1].id)
    score = dict(zip(pdf.id, pdf.score))
    for _ in range(ratio):
        left, got = set(open_t), set()
        while True:
            options = [(abs(score[t] - score[c]), t, c) for t in left for c in pdf[pdf.treatment == 0].id if c not in used]
            if not options or min(options)[0] > caliper:
                break
            _, t, c = min(options)
            pairs.append((t, c))
            left.discard(t)
            got.add(t)
            used.add(c)
        open_t = got
    return set(pairs)


def pairs_of(df):
    return {(r.t_id, r.c_id) for r in df.collect()}


@pytest.mark.parametrize("task_rows", [10_000, 0])
@pytest.mark.parametrize("caliper,ratio", [(None, 1), (0.3, 2)])
def test_pairs_equal_brute_force(spark, task_rows, caliper, ratio):
    pdf = trials(3, n=40)
    rows = spark.createDataFrame(pdf)
    cap = None if caliper is None else F.lit(caliper)
    got = pairs_of(match_nearest(rows, ["trial"], cap, ratio, task_rows))
    want = set().union(*[closest_first(p, caliper or np.inf, ratio) for _, p in pdf.groupby("trial")])
    assert got == want


def test_both_ways_agree_on_ties(spark):
    pdf = trials(5, n=300, grid=0.5, groups=1)  # about a dozen distinct scores
    rows = spark.createDataFrame(pdf)
    small = match_nearest(rows, ["trial"], F.lit(0.6), 2)
    large = match_nearest(rows, ["trial"], F.lit(0.6), 2, task_rows=0)
    mixed = match_nearest(rows, ["trial"], F.lit(0.6), 2, task_rows=250)  # starts in rounds, ends in tasks
    assert pairs_of(small) == pairs_of(large) == pairs_of(mixed)


def test_controls_are_used_once_and_nobody_is_left(spark):
    pdf = trials(7, n=500, grid=0.25)
    pairs = match_nearest(spark.createDataFrame(pdf), ["trial"]).toPandas()
    assert not pairs.duplicated(["trial", "c_id"]).any() and not pairs.duplicated(["trial", "t_id"]).any()
    sides = pdf.groupby(["trial", "treatment"]).size().unstack()
    assert (pairs.groupby("trial").size() == sides.min(axis=1)).all()


def test_long_runs_take_few_rounds(spark):
    # all treated below all controls: nested pairs, settled at one border
    n = 400
    pdf = pd.DataFrame({"trial": 0, "id": np.arange(2 * n), "treatment": [1] * n + [0] * n, "score": np.arange(2 * n, dtype=float)})
    pairs = match_nearest(spark.createDataFrame(pdf), ["trial"], task_rows=0).toPandas()
    assert ((pairs.t_id + pairs.c_id) == 2 * n - 1).all() and len(pairs) == n


def test_one_arm_gives_no_pairs(spark):
    pdf = trials(1, n=20).assign(treatment=1)
    rows = spark.createDataFrame(pdf)
    assert match_nearest(rows, ["trial"]).count() == 0
    assert match_nearest(rows, ["trial"], task_rows=0).count() == 0


def test_matched_rows_keep_columns(spark):
    pdf = trials(2).assign(extra=1.5)
    rows = spark.createDataFrame(pdf)
    pairs = match_nearest(rows, ["trial"])
    assert matched_rows(rows, pairs, ["trial"]).count() == 2 * pairs.count()


def test_distances_against_all_pairs(spark):
    pdf = trials(11, n=80, grid=0.01)
    rows = spark.createDataFrame(pdf)
    profile = distance_profile(rows, ["trial"]).toPandas().set_index(["trial", "t_id"])
    near = nearest_controls(rows, ["trial"], 3).toPandas()
    mads = distance_mad(rows, ["trial"], 0.01).toPandas().set_index("trial")
    for g, p in pdf.groupby("trial"):
        t, c = p[p.treatment == 1], p[p.treatment == 0]
        d = np.abs(t.score.to_numpy()[:, None] - c.score.to_numpy()[None, :])
        mine = profile.loc[g].loc[t.id]
        assert np.allclose(mine["mean_distance"], d.mean(1)) and np.allclose(mine["nearest"], d.min(1)) and np.allclose(mine["farthest"], d.max(1))
        top = near[near.trial == g].sort_values(["t_id", "nth"]).groupby("t_id")["distance"].apply(list)
        assert np.allclose(np.array(top.loc[t.id].tolist()), np.sort(d, axis=1)[:, :3])
        med = np.median(d)
        assert np.isclose(mads.loc[g, "median_distance"], med) and np.isclose(mads.loc[g, "caliper"], np.median(np.abs(d - med)))
