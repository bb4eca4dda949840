"""The study end to end on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialkit.plans import features, outcomes, synthesis
from trialkit.plans.cohort import gap_or_null
from trialkit.plans.study import Watched, build_trials, class_estimates, estimate_trials, stratum_estimates
from trialkit.registry import views as v
from trialkit.registry.base import query
from trialkit.registry.patients import outcome_of
from trialkit.session import cut

N_BOOT = 100
N_RESAMPLES = 1000
MIN_TREATED = 100
PRIOR_DAYS = 60
#: every value of the tables, as in their specification; priorities stand for sites, measurements and drugs, statuses for diagnoses
PRIORITIES = ["1_URGENT", "2_HIGH", "3_MEDIUM", "4_NOT_SPECIFIED", "5_LOW"]
STATUSES = ["F", "O", "P"]


def _order_events(spark, d):
    name = F.translate("priority", "- ", "__").alias("name")
    return v.orders(spark, d).select("ptid", name, F.col("order_day").alias("date"), F.col("price").alias("value"))


def _covariates(spark, d):
    clinical, events = v.clinical(spark, d), _order_events(spark, d)
    statuses = v.orders(spark, d).select("ptid", F.col("status").alias("name"), F.col("order_day").alias("date"))
    labs = events.select("ptid", "name", "date", F.col("value").cast("string").alias("result"))

    def at(keys):
        return features.baseline(
            cut(keys), clinical, events, events, labs, events, statuses, sites=PRIORITIES, vitals=PRIORITIES, labs=PRIORITIES, drugs=PRIORITIES, diagnoses=STATUSES,
        )

    return at


def trials(spark, d, n_boot=N_BOOT, min_treated=MIN_TREATED):
    """All trials; patients with another event shortly before their diagnosis are left out first."""
    clear = v.cohort(spark, d).where(gap_or_null(F.col("prior_date"), F.col("dx_date"), PRIOR_DAYS)).select("ptid")
    therapy = cut(v.therapy(spark, d).join(clear, "ptid", "left_semi"))
    changes = features.change_days(v.orders(spark, d).select("ptid", F.col("order_day").alias("date")))
    return build_trials(
        therapy, v.records(spark, d), outcome_of(spark, d, therapy), _covariates(spark, d), n_boot=n_boot, min_treated=min_treated, changes=changes
    )


def summary(spark, d, n_boot=N_BOOT, min_treated=MIN_TREATED, n_resamples=N_RESAMPLES):
    built = trials(spark, d, n_boot, min_treated)
    estimates = cut(estimate_trials(built, built.covariates)[0])
    counts = built.treated.groupBy("drug").agg(F.count(F.lit(1)).alias("num_treated"))
    return synthesis.drug_summary(estimates, counts, n_resamples)


@query("drug_effect_summary")
def drug_effect_summary(spark, d):
    return summary(spark, d)


_MORE_THAN = 1000


@query("sae_effect_matrix")
def sae_effect_matrix(spark, d):
    built = trials(spark, d)
    events = _order_events(spark, d)
    classes = outcomes.event_classes(events, _MORE_THAN)
    last = built.outcome.select("ptid", "last_act_dt")
    estimates, matched = estimate_trials(built, built.covariates, watched=Watched(events, classes, last))
    estimates = cut(estimates)
    per_class = cut(class_estimates(matched, events, estimates, classes, last))
    out = None
    for measure, expected in (("OR_all_day", 1.0), ("OR_180day", 1.0), ("diff_ir_all_day", 0.0), ("diff_ir_180day", 0.0)):
        cells = synthesis.significant_means(per_class, ["drug", "class"], measure, expected, N_RESAMPLES)
        one = synthesis.effect_matrix(cells, ["drug"], "class", classes).withColumn("measure", F.lit(measure))
        out = one if out is None else out.unionByName(one)
    return out.select("measure", "drug", *classes)


@query("stratified_effect_matrix")
def stratified_effect_matrix(spark, d):
    built = trials(spark, d)
    strata = outcomes.study_strata(PRIORITIES)
    estimates = cut(stratum_estimates(built, built.covariates, strata))
    cells = synthesis.significant_means(estimates, ["drug", "stratum"], "hr", 1.0, N_RESAMPLES)
    return synthesis.effect_matrix(cells, ["drug"], "stratum", list(strata))
