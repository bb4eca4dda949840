"""Pooling the estimates of a drug's trials, testing them, and the tables that report them.

An estimates frame has one row per trial: the keys, a trial id (`boot_id`), an estimate and its balance
count. A drug has as many trials as control draws (100), so an array of its estimates is small; the
resamples of all drugs are spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialkit.functions.hashing import hash32, hash_position
from trialkit.functions.normal import normal_quantile, two_sided_p
from trialkit.functions.text import interval_text, p_value_text
from trialkit.operators.ranks import ordered_chunks, running
from trialkit.operators.reshape import matrix
from trialkit.plans.survival import hazard_ratio
from trialkit.session import cut


def finite(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) < F.lit(float("inf")))


def balanced_trials(
    estimates: DataFrame, keys: Sequence[str], unbalanced: str = "unbalanced_covariates", below: int = 20, at_least: int = 10
) -> DataFrame:
    """Trials with few unbalanced covariates, of the keys that have enough of them."""
    passing = estimates.where(F.col(unbalanced) < below)
    enough = passing.groupBy(*keys).agg(F.count(F.lit(1)).alias("_passing")).where(F.col("_passing") >= at_least)
    return passing.join(enough.select(*keys), list(keys), "left_semi")


def _resamples(estimates: DataFrame, keys: Sequence[str], value: str, order: str, n_resamples: int, seed: int) -> DataFrame:
    """(keys, _b, _mean0, _sd0, _n, _x): every value of every resample, streamed and summed where it is made."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))))
    arrays = (
        estimates.where(finite(F.col(value)))
        .groupBy(*keys)
        .agg(items.alias("_items"), F.count(value).alias("_n"), F.avg(value).alias("_mean0"), F.stddev_samp(value).alias("_sd0"))
        .withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1))))
        .repartition(*keys, "_b")
        .withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    )
    at = hash_position(F.col("_n"), F.lit(seed), "_b", "_i", *keys)
    return arrays.select(*keys, "_b", "_n", "_mean0", "_sd0", F.get(F.col("_items"), at.cast("int"))["v"].alias("_x"))


def bootstrap_mean_interval(
    estimates: DataFrame, keys: Sequence[str], value: str, order: str = "boot_id", n_resamples: int = 1000,
    alpha: float = 0.05, seed: int = 0,
) -> DataFrame:
    """Percentile interval of the mean over resamples, and the spread of the resample means."""
    means = _resamples(estimates, keys, value, order, n_resamples, seed).groupBy(*keys, "_b").agg(F.avg("_x").alias("_m"))
    ends = F.percentile("_m", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return means.groupBy(*keys).agg(ends[0].alias("ci_low"), ends[1].alias("ci_high"), F.stddev_pop("_m").alias("se"))


def bootstrap_mean_p(
    estimates: DataFrame, keys: Sequence[str], value: str, expected: float, order: str = "boot_id",
    n_resamples: int = 1000, seed: int = 0,
) -> DataFrame:
    """Two-sided bootstrap t test of the mean against `expected`: p and the observed t."""
    root_n = F.sqrt(F.col("_n").cast("double"))
    per = _resamples(estimates, keys, value, order, n_resamples, seed).groupBy(*keys, "_b", "_n", "_mean0", "_sd0").agg(
        F.avg("_x").alias("_m"), F.stddev_samp("_x").alias("_s")
    )
    t_boot = F.try_divide(F.col("_m") - F.col("_mean0"), F.col("_s") / root_n)
    t_seen = F.try_divide(F.col("_mean0") - expected, F.col("_sd0") / root_n)
    shares = per.select(*keys, "_n", t_boot.alias("_t"), t_seen.alias("t")).groupBy(*keys, "t").agg(
        F.avg((F.col("_t") >= F.col("t")).cast("double")).alias("_p"), F.max("_n").alias("n_trials")
    )
    return shares.select(*keys, "n_trials", "t", (2 * F.least("_p", 1 - F.col("_p"))).alias("p"))


def adjust_p(df: DataFrame, ident: Sequence[str], p: str, alpha: float = 0.05, range_rows: int = 50_000) -> DataFrame:
    """Bonferroni, Benjamini-Hochberg and Benjamini-Yekutieli p-values and 0/1 decisions.

    Nulls and NaN are not hypotheses. Hypotheses are cut into ranges of p of about `range_rows` rows: ranks are the row numbers of a range plus the rows of
    all earlier ones, and the step-up minimum of a range is lowered by the minima of all later ones. Equal p-values get equal results, so their order
    does not matter.
    """
    tested = cut(df.where(F.col(p).isNotNull() & ~F.isnan(p)).withColumns({"_all": F.lit(1), "_hash": hash32(*ident)}))
    m = tested.count()
    harmonic = df.sparkSession.range(1, m + 1).agg(F.sum(1.0 / F.col("id"))).scalar() if m else F.lit(0.0)
    ranges = cut(ordered_chunks(tested, ["_all"], p, F.lit(0), F.col("_hash"), chunks=min(512, 2 + m // range_rows)))
    upward = [F.col(p), F.col("_hash"), *[F.col(c) for c in ident]]
    ranked = running(ranges, ["_all"], upward, sums={"_i": F.lit(1)})
    lowest = running(
        ranked.withColumn("_step", F.col(p) * F.lit(m) / F.col("_i")), ["_all"], [c.desc() for c in upward], maxes={"_least": -F.col("_step")}, backward=True
    )
    out = lowest.withColumns({
        "p_bonf": F.least(F.lit(1.0), F.col(p) * F.lit(m)), "p_bh": F.least(F.lit(1.0), -F.col("_least")),
        "p_by": F.least(F.lit(1.0), -F.col("_least") * harmonic),
    })
    flags = {f"sig_{k}": (F.col(f"p_{k}") <= alpha).cast("int") for k in ("bonf", "bh", "by")}
    return out.withColumns(flags).select(*df.columns, *[f"p_{k}" for k in ("bonf", "bh", "by")], *flags)


def pool_inverse_variance(
    estimates: DataFrame, keys: Sequence[str], hr: str = "hr", low: str = "hr_low", high: str = "hr_high", alpha: float = 0.05
) -> DataFrame:
    """Fixed-effect pooling of log hazard ratios; standard errors come from the intervals."""
    z = normal_quantile(1 - alpha / 2)
    usable = estimates.where((F.col(hr) > 0) & (F.col(low) > 0) & (F.col(high) > F.col(low)) & finite(F.col(high)))
    se = (F.log(high) - F.log(low)) / (2 * z)
    weighted = usable.withColumn("_y", F.log(hr)).withColumn("_w", 1 / (se * se))
    sums = weighted.groupBy(*keys).agg(F.sum(F.col("_w") * F.col("_y")).alias("_wy"), F.sum("_w").alias("_w"), F.count(F.lit(1)).alias("n_pooled"))
    mean, pooled_se = F.col("_wy") / F.col("_w"), 1 / F.sqrt("_w")
    return sums.select(
        *keys, "n_pooled", F.exp(mean).alias("pooled_hr"), F.exp(mean - z * pooled_se).alias("pooled_low"),
        F.exp(mean + z * pooled_se).alias("pooled_high"), (mean / pooled_se).alias("pooled_z"),
    )


def with_pooled_p(pooled: DataFrame) -> DataFrame:
    return pooled.withColumn("pooled_p", two_sided_p("pooled_z"))


def estimate_percentiles(estimates: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Percentiles over a drug's trials (as many values as draws)."""
    p = F.percentile(value, F.array(*[F.lit(float(q)) for q in probs.values()]))
    return estimates.where(finite(F.col(value))).groupBy(*keys).agg(*[p[i].alias(n) for i, n in enumerate(probs)])


def drug_summary(
    estimates: DataFrame, treated_counts: DataFrame, n_resamples: int = 1000, below: int = 20, at_least: int = 10, seed: int = 0
) -> DataFrame:
    """Per drug: treated count, mean HR, two intervals, pooled HR, and the adjusted p-values of the mean."""
    kept = balanced_trials(estimates, ["drug"], below=below, at_least=at_least)
    means = kept.where(finite(F.col("hr"))).groupBy("drug").agg(F.avg("hr").alias("hr"))
    ci = bootstrap_mean_interval(kept, ["drug"], "hr", n_resamples=n_resamples, seed=seed)
    spread = estimate_percentiles(kept, ["drug"], "hr", {"p025": 0.025, "p975": 0.975})
    tests = bootstrap_mean_p(kept, ["drug"], "hr", 1.0, n_resamples=n_resamples, seed=seed)
    pooled = with_pooled_p(pool_inverse_variance(kept, ["drug"]))
    joined = treated_counts.join(means, "drug")
    for part in (ci, spread, tests, pooled):
        joined = joined.join(part, "drug", "left")
    adjusted = adjust_p(joined, ["drug"], "p")
    return adjusted.select(
        "drug", "num_treated", F.round("hr", 3).alias("hr"), interval_text(F.col("ci_low"), F.col("ci_high")).alias("ci_mean"),
        interval_text(F.col("p025"), F.col("p975")).alias("ci_trials"), F.round("pooled_hr", 3).alias("pooled_hr"),
        interval_text(F.col("pooled_low"), F.col("pooled_high")).alias("ci_pooled"), F.round("pooled_p", 3).alias("pooled_p"),
        "p", "p_bonf", "p_bh", "p_by", "sig_bonf", "sig_bh", "sig_by", p_value_text(F.col("p_bonf")).alias("p_bonf_text"),
    )


def significant_means(
    estimates: DataFrame, keys: Sequence[str], value: str, expected: float, n_resamples: int = 1000, level: float = 0.05,
    below: int = 20, at_least: int = 10, seed: int = 0,
) -> DataFrame:
    """(keys, mean, p, cell): the mean over passing trials, shown in `cell` only when it is significant."""
    kept = balanced_trials(estimates, keys, below=below, at_least=at_least).where(finite(F.col(value)))
    means = kept.groupBy(*keys).agg(F.round(F.avg(value), 3).alias("mean"))
    tests = bootstrap_mean_p(kept, keys, value, expected, n_resamples=n_resamples, seed=seed).select(*keys, "p")
    return means.join(tests, list(keys), "left").withColumn("cell", F.when(F.col("p") < level, F.col("mean")))


def effect_matrix(cells: DataFrame, rows: Sequence[str], column: str, levels: Sequence[str], prefix: str = "") -> DataFrame:
    return matrix(cells, rows, column, levels, F.col("cell"), prefix)


# fixed values of the effect plots: size of a bubble without an estimate, size per unit of effect, effect of full colour
BUBBLE_BASE, BUBBLE_SCALE, FULL_COLOUR = 50, 400, 1.5


def effect_labels(df: DataFrame, hr: str = "hr", p: str = "p", level: float = 0.05) -> DataFrame:
    """Direction, bubble size and magnitude behind the effect plots."""
    h = F.col(hr)
    significant = F.coalesce(F.col(p) < level, F.lit(False))
    direction = F.when(significant & (h > 1), "harm").when(significant & (h < 1), "benefit").otherwise("none")
    size = F.when(h.isNull(), F.lit(float(BUBBLE_BASE))).otherwise(F.abs(h - 1) * BUBBLE_SCALE + BUBBLE_BASE)
    intensity = F.when(h > 1, F.least(F.lit(1.0), (h - 1) / FULL_COLOUR)).otherwise(F.least(F.lit(1.0), 1 - h))
    return df.withColumns({
        "direction": direction, "size": size, "intensity": intensity, "magnitude": F.when(h > 1, h).otherwise(1 / h),
    })


def success_report(
    estimates: DataFrame, keys: Sequence[str], before: str = "ori_unbalanced_covariates", after: str = "unbalanced_covariates",
    value: str = "hr", below: int = 3,
) -> DataFrame:
    """Mean unbalanced counts, share of passing trials, and percentiles of the passing estimates."""
    passing = F.when(F.col(after) < below, F.col(value))
    p = F.percentile(passing, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))  # one value per draw
    return estimates.groupBy(*keys).agg(
        F.avg(before).alias("mean_before"), F.avg(after).alias("mean_after"),
        F.avg((F.col(after) < below).cast("double")).alias("share_passing"),
        p[0].alias("p05"), p[1].alias("p50"), p[2].alias("p95"),
    )


def trial_estimates(trials: DataFrame, matched: DataFrame, keys: Sequence[str], time: str, event: str) -> DataFrame:
    """Hazard ratio per trial before (`hr_ori`) and after matching."""
    raw = hazard_ratio(trials, keys, time, event).select(
        *keys, F.col("hr").alias("hr_ori"), F.col("hr_low").alias("hr_ori_low"), F.col("hr_high").alias("hr_ori_high")
    )
    return raw.join(hazard_ratio(matched, keys, time, event).select(*keys, "hr", "hr_low", "hr_high"), list(keys), "left")
