"""Propensity analyses: matched tables, ratio escalation, weighting, effect intervals."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialkit.operators.reshape import scale_min_max
from trialkit.plans.balance import (
    incidence_difference,
    inverse_probability_weight,
    standardized_differences,
    unbalanced_counts,
)
from trialkit.plans.matching import distance_mad, match_nearest, matched_rows
from trialkit.plans.models import propensity_scores
from trialkit.session import cut
from trialkit.sources.tables import reuse


def caliper_match(
    scored: DataFrame, keys: Sequence[str], ratio: int = 1, score: str = "ps", resolution: float = 1e-6
) -> DataFrame:
    """1:N pairs on the score, with the MAD of all treated-control distances as the caliper."""
    keys = list(keys)
    rows = scored.select(*keys, "id", "treatment", F.col(score).alias("score"))
    calipers = distance_mad(rows, keys, resolution).select(*keys, "caliper")
    return match_nearest(rows.join(calipers, keys), keys, F.col("caliper"), ratio)


def matched_with_escalation(
    df: DataFrame, keys: Sequence[str], covariates: Sequence[str], ratios: Sequence[int] = (1, 2, 3, 4),
    threshold: float = 0.1, tolerated_share: float = 0.02, ignore: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Try 1:1 up to 1:4 until few enough covariates stay unbalanced; all trials go through together.

    Returns (pairs with the ratio used, report per trial with ratio, unbalanced, balanced).
    """
    keys = list(keys)
    allowed = math.ceil(len(covariates) * tolerated_share)
    scaled = scale_min_max(df, keys, covariates)
    scored = cut(propensity_scores(scaled, keys, covariates))
    todo, pairs, report = scored, None, None
    for i, ratio in enumerate(ratios):
        found = caliper_match(todo, keys, ratio)
        chosen = matched_rows(todo, found, keys)
        smd = standardized_differences(chosen, keys, covariates)
        counts = cut(unbalanced_counts(smd, keys, threshold, ignore))
        done = counts if i == len(ratios) - 1 else counts.where(F.col("unbalanced") <= allowed)
        now_pairs = found.join(done.select(*keys), keys, "left_semi").withColumn("ratio", F.lit(ratio))
        now_report = done.select(
            *keys, F.lit(ratio).alias("ratio"), "unbalanced", (F.col("unbalanced") <= allowed).cast("int").alias("balanced")
        )
        pairs = now_pairs if pairs is None else pairs.unionByName(now_pairs)
        report = now_report if report is None else report.unionByName(now_report)
        todo = cut(todo.join(done.select(*keys), keys, "left_anti"))
        if todo.isEmpty():
            break
    return pairs, report


def incidence_after_matching(
    df: DataFrame, keys: Sequence[str], covariates: Sequence[str], outcome: str, treat: str = "treatment", **escalation
) -> tuple[DataFrame, DataFrame]:
    """(pairs, report per trial): escalated matching with outcome shares by arm, over all rows and over the matched ones.

    Shares (`incidence_*`, `ate` of all rows, `matched_*` of the rows in pairs) are null where no ratio balanced the trial; a trial without any pair has
    no ratio and counts as not balanced.
    """
    keys = list(keys)
    pairs, report = matched_with_escalation(df, keys, covariates, **escalation)
    pairs = cut(pairs)
    chosen = matched_rows(df.select(*keys, "id", treat, outcome), pairs, keys)
    names = ["incidence_treated", "incidence_control", "incidence_overall", "ate"]
    whole = incidence_difference(df, keys, outcome, treat)
    inside = incidence_difference(chosen, keys, outcome, treat).withColumnsRenamed({n: f"matched_{n.removeprefix('incidence_')}" for n in names})
    shares = whole.join(report, keys, "left").join(inside, keys, "left").withColumn("balanced", F.coalesce("balanced", F.lit(0)))
    found = [c for c in shares.columns if c not in report.columns]
    return pairs, shares.select(*report.columns, *[F.when(F.col("balanced") == 1, F.col(c)).alias(c) for c in found])


def weighted_analysis(
    df: DataFrame, keys: Sequence[str], covariates: Sequence[str], outcome: str, threshold: float = 0.1
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with iptw_weight, unbalanced count per trial, weighted incidence difference per trial)."""
    scored = propensity_scores(df, keys, covariates)
    weighted = reuse(scored.withColumn("iptw_weight", inverse_probability_weight(F.col("treatment"), F.col("ps"))))
    smd = standardized_differences(weighted, keys, covariates, weight="iptw_weight")
    return (
        weighted,
        unbalanced_counts(smd, keys, threshold),
        incidence_difference(weighted, keys, outcome, weight="iptw_weight"),
    )
