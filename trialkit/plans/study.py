"""The whole emulation: arms, draws, covariates, matching and estimates for every drug and draw at once."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialkit.functions.hashing import hash32
from trialkit.operators.joins import spread
from trialkit.operators.reshape import impute_median_from_train, split_flag
from trialkit.plans import balance, cohort, features, matching, models, outcomes, survival, synthesis, trial_fit, trial_pool
from trialkit.session import broadcast_if_small, cut, settle

TRIAL = ["drug", "boot_id"]
_ESTIMATES, _COUNTS = trial_pool.ESTIMATES, trial_pool.COUNTS
#: numbers of a trial, or of the tables that trials are made of, that one task may hold: with 27 covariates a trial of up to about a million rows
TASK_BYTES = 256 * 1024 * 1024


@dataclass
class Pooled:
    """What tasks make trials of: draw tables, outcomes, and the covariates of the first day of every stretch of days in which a member's stay the same."""

    tables: cohort.DrawTables
    stretches: DataFrame
    ratio: int
    seed: int


@dataclass
class Trials:
    """Trials of drugs and draws. `rows` are their rows keyed (drug, boot_id, id) with follow-up, event flag and covariates, made when first asked for."""

    make_rows: Callable[[], DataFrame]
    treated: DataFrame
    outcome: DataFrame
    covariates: list[str]
    n_boot: int
    pooled: Pooled | None = None

    @cached_property
    def rows(self) -> DataFrame:
        return self.make_rows()


RATIO = 5


def _row_id() -> Column:
    """Number of a treated row in its trials, by patient (ids may be text); drawn controls have the number of their slot, from 0 on."""
    return -F.shiftrightunsigned(F.xxhash64(F.col("ptid").cast("string")), 1) - 1


def build_trials(
    therapy: DataFrame, records: DataFrame, outcome: DataFrame, covariates_at, *, n_boot: int, min_treated: int,
    excluded: Sequence[str] = (), seed: int = 0, changes: DataFrame | None = None,
) -> Trials:
    """Arms and draws of the drugs with enough new users, with outcomes and covariates.

    `covariates_at(keys)` gives one row per (ptid, index_date) for the distinct pairs in use. `therapy` is
    read several times, so pass a materialised table. With `changes` (ptid, day), the days on which the covariates of a patient, or the events that outcomes
    are counted from, can change besides the turn of the year (`features.change_days`), covariates are computed for the first day of every stretch only,
    and `estimate_trials` makes the rows of a trial in its task.
    """
    outcome = cut(outcome)
    users = cohort.new_users(therapy, records).where(~F.lower("drug").isin([e.lower() for e in excluded]))
    enough = users.groupBy("drug").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > min_treated).select("drug")
    treated = cut(users.join(enough, "drug", "left_semi"))

    def assembled() -> tuple[DataFrame, list[str]]:
        draws = cohort.control_draws(treated, therapy, n_boot, RATIO, seed)
        trials = cut(outcomes.assemble_trials(treated, draws, outcome, n_boot))
        wide = settle(covariates_at(features.index_keys(trials)))  # read once for the sizes of trials and once for each use of their rows
        ident = F.when(F.col("treatment") == 1, _row_id()).otherwise(F.col("rep"))
        return trials.join(wide, features.KEY, "left").withColumn("id", ident.cast("long")), [c for c in wide.columns if c not in features.KEY]

    pooled = None if changes is None else _pooled(treated, therapy, outcome, covariates_at, changes, seed)
    if pooled is not None:
        names = [c for c in pooled.stretches.columns if c not in (*features.KEY, "member")]
        return Trials(lambda: assembled()[0], treated, outcome, names, n_boot, pooled)
    rows, names = assembled()
    return Trials(lambda: rows, treated, outcome, names, n_boot)


def _pooled(treated: DataFrame, therapy: DataFrame, outcome: DataFrame, covariates_at, changes: DataFrame, seed: int) -> Pooled | None:
    """None without treated rows, or where a patient has several therapy dates or outcomes, or no date."""
    tables = cohort.draw_tables(treated, therapy)
    single = lambda df, c: F.count(F.lit(1)) == F.count_distinct(F.when(F.col(c).isNotNull(), F.col("ptid")))
    if not (tables.n_arm and tables.members.agg(single(tables.members, "therapy_date")).first()[0] and outcome.agg(single(outcome, "ptid")).first()[0]):
        return None
    low, high = treated.agg(F.min("delta_days"), F.max("delta_days")).first()
    spans = tables.members.select(
        "ptid", "member", F.date_add("therapy_date", low).alias("_first"), F.date_add("therapy_date", high).alias("_last")
    )
    spans = broadcast_if_small(spans, tables.n_members, 64)
    moved = changes.join(spans, "ptid").where("day > _first and day <= _last").select("ptid", F.col("day").alias("index_date"))
    years = F.explode(F.sequence(F.year("_first") + 1, F.year("_last")))
    turned = spans.where(F.year("_last") > F.year("_first")).select("ptid", years.alias("_y")).select("ptid", F.make_date("_y", F.lit(1), F.lit(1)).alias("index_date"))
    first = spans.select("ptid", F.col("_first").alias("index_date"))
    keys = cut(features.index_keys(first.unionByName(moved).unionByName(turned)))
    wide = covariates_at(keys)
    return Pooled(tables, settle(keys.join(spans.select("ptid", "member"), "ptid").join(wide, features.KEY, "left")), RATIO, seed)


def _pooled_estimates(
    built: Trials, threshold: float, seed: int, strata: Mapping[str, Column] | None, classes: Sequence[str] = (), firsts: Callable[[DataFrame], DataFrame] | None = None,
    horizons: Sequence[tuple[str, int | None]] = (),
) -> DataFrame | None:
    """Estimates, and sums by class, of trials made in the tasks; None where the tables, or a trial, are too large for a task."""
    if built.pooled is None:
        return None
    tables, stretches, names = built.pooled.tables, built.pooled.stretches, list(strata or {"": F.lit(True)})
    values = stretches.withColumn("_strata", _bits([F.coalesce(p, F.lit(False)) for p in (strata or {"": F.lit(True)}).values()]))
    if firsts is not None:
        flags = firsts(stretches.select(*features.KEY)).where(F.col("class") != "any")
        of = lambda i, col: F.max(F.when(F.col("class") == classes[i], F.col(col)))
        wide = flags.groupBy(*features.KEY).agg(
            *[of(i, "sae_flag").alias(f"flag{i}") for i in range(len(classes))], *[of(i, "sae_delta_days").alias(f"days{i}") for i in range(len(classes))]
        )
        values = values.join(wide, features.KEY, "left")
    whole = ("tinyint", "smallint", "int", "bigint")
    number = lambda c: F.col(f"`{c}`") if stretches.schema[c].dataType.simpleString() in whole else F.col(f"`{c}`").cast("double")
    marks = [f"{w}{i}" for i in range(len(classes)) for w in ("flag", "days")]
    values = settle(values.select(
        "member", F.unix_date("index_date").alias("start_day"), F.col("_strata").alias("strata"), *[number(c).alias(f"x{i}") for i, c in enumerate(built.covariates)], *marks
    ))
    values, row_bytes = trial_pool.narrowed(values, values.columns)
    n_rows, n_keys = values.agg(F.count(F.lit(1)), F.count_distinct("member", "start_day")).first()
    n_bytes = n_rows * (row_bytes + 24) + tables.n_members * 20 + tables.n_arm * 40
    sizes = tables.arm.groupBy("drug", "drug_no").agg(F.max("n_treated").alias("n_treated"), F.max("n_control").alias("n_control"))
    sizes = cut(sizes.withColumn("text", F.col("drug").cast("string")))
    n_drugs, largest = sizes.agg(F.count(F.lit(1)), F.max("n_treated")).first()
    trial_rows = largest * (1 + built.pooled.ratio) * -(-n_rows // n_keys)
    if n_bytes > TASK_BYTES or trial_rows * 8 * (len(built.covariates) + 7) > TASK_BYTES:
        return None
    known = tables.members.join(built.outcome.select("ptid", "d_flag", "available_date", "last_act_dt"), "ptid", "left")
    end = F.when(F.col("d_flag") == 1, F.col("available_date")).otherwise(F.col("last_act_dt"))
    members = known.select("member", F.unix_date("therapy_date").alias("therapy_day"), "d_flag", F.unix_date(end).alias("end_day"))
    arm = tables.arm.withColumn("id", _row_id()).join(tables.members.select("ptid", "member", "therapy_date"), "ptid").select(
        "drug_no", "t_pos", "member", "delta_days", F.unix_date(F.date_add("therapy_date", F.col("delta_days"))).alias("index_day"), "id"
    )
    job = trial_pool.Job(
        built.n_boot, built.pooled.ratio, tuple(built.covariates), tuple(names), bool(strata), tuple(classes), tuple(horizons), threshold, built.pooled.seed, seed
    )
    parts = {"drugs": sizes.select("drug_no", "text", "n_treated", "n_control"), "members": members, "arm": arm, "swaps": tables.swaps, "stretches": values}
    packed = cut(reduce(DataFrame.unionByName, [trial_pool.packed(df, kind) for kind, df in parts.items()]))
    done = trial_pool.estimated(packed, n_drugs * built.n_boot, n_bytes, job)
    return cut(done.join(broadcast_if_small(sizes.select("drug", "drug_no"), n_drugs, 96), "drug_no").drop("drug_no"))


@dataclass
class Watched:
    """Events whose first occurrence after the index is counted on matched rows, by class."""

    events: DataFrame
    classes: Sequence[str]
    last: DataFrame
    horizon: int = 180


@dataclass
class MatchedSums:
    """The matched rows of trials as `class_estimates` counts them: events and days at risk by arm, class and horizon."""

    sums: DataFrame


def _estimate_study(
    built: Trials, threshold: float, seed: int, strata: Mapping[str, Column] | None, watched: Watched | None
) -> tuple[DataFrame, DataFrame | MatchedSums | None]:
    if watched is None:
        done = _pooled_estimates(built, threshold, seed, strata)
    else:
        firsts = lambda index_rows: outcomes.first_event_after(index_rows, watched.events, watched.classes, watched.last)
        done = _pooled_estimates(built, threshold, seed, strata, watched.classes, firsts, _horizons(watched.horizon))
    if done is None:
        return estimate_trials(built.rows, built.covariates, threshold=threshold, seed=seed, strata=strata)
    by = [*TRIAL, *(["stratum"] if strata else [])]
    return done.select(*by, *_ESTIMATES, *_COUNTS), MatchedSums(done.select(*by, F.inline("sums"))) if watched else None


def _bits(flags: Sequence[Column]) -> Column:
    return sum((F.shiftleft(f.cast("long"), i) for i, f in enumerate(flags)), F.lit(0).cast("long"))


def estimate_trials(
    trials: DataFrame | Trials, covariates: Sequence[str], keys: Sequence[str] = TRIAL, time: str = "d_delta_days", event: str = "d_flag",
    threshold: float = 0.2, seed: int = 0, strata: Mapping[str, Column] | None = None, task_rows: int | None = None, watched: Watched | None = None,
) -> tuple[DataFrame, DataFrame | MatchedSums | None]:
    """(one estimate per trial, matched rows): impute, balance, propensity, 1:1 match, balance, hazard ratios.

    With `strata` (at most 62) every stratum of a trial is estimated and matched on its own, and both results have a column `stratum`. Rows are held once, with
    a bit mask of their strata. Trials of up to `task_rows` rows (as many as `TASK_BYTES` hold, unless given) are estimated in one task each, with all
    their strata; larger ones by steps over whole tables, in which no trial meets in one task. Both ways give the same estimates.

    Instead of rows, `trials` may be what `build_trials` gives. If the tables its trials are made of fit a task, their rows are made in the tasks that estimate
    them and never stored; the second result then is what `class_estimates` needs of the matched rows for the `watched` events, None without these.
    """
    if isinstance(trials, Trials):
        return _estimate_study(trials, threshold, seed, strata, watched)
    keys, covariates, names = list(keys), list(covariates), list(strata or {"": F.lit(True)})
    holds = [F.coalesce(p, F.lit(False)) for p in (strata or {"": F.lit(True)}).values()]
    label = [[F.lit(n)] if strata else [] for n in names]
    masks = {"_strata": _bits(holds), "_train": _bits([split_flag(seed, 70, *keys, *lb, "id") for lb in label]), "_tie": hash32("id")}
    if task_rows is None:
        task_rows = TASK_BYTES // (8 * (len(covariates) + 7))
    sizes = cut(trials.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")))
    n_rows = sizes.agg(F.sum("_rows")).first()[0] or 0
    large = cut(sizes.where(F.col("_rows") > task_rows).select(*keys))
    n_large = large.count()
    near = broadcast_if_small(large, n_large, 96)
    small = trials.join(near, keys, "left_anti") if n_large else trials
    estimates, ids = _estimate_in_tasks(small, n_rows, keys, covariates, time, event, threshold, names, masks)
    if not strata:
        estimates, ids = estimates.drop("stratum"), ids.drop("stratum")
    matched = trials.join(ids, [*keys, "id"]).select(*trials.columns, *(["stratum"] if strata else []))
    if n_large:
        rows = trials.join(near, keys, "left_semi")
        whole, taken = _estimate_by_steps(
            outcomes.explode_strata(rows, dict(strata)) if strata else rows, covariates, [*keys, "stratum"] if strata else keys, time, event, threshold, seed
        )
        estimates, matched = estimates.unionByName(whole.select(*estimates.columns)), matched.unionByName(taken.select(*matched.columns))
    return estimates, matched


def _estimate_in_tasks(
    trials: DataFrame, n_rows: int, keys: list[str], covariates: list[str], time: str, event: str, threshold: float, names: list[str], masks: Mapping[str, Column]
) -> tuple[DataFrame, DataFrame]:
    """Estimates and ids of matched rows of trials that fit a task, both by stratum."""
    needed = trials.withColumns(dict(masks)).select(
        *keys, "id", "treatment", time, event, *[F.col(c).cast("double").alias(c) for c in covariates], *masks
    )
    kept = T.StructType([trials.schema[k] for k in keys])
    doubles, longs = [T.StructField(c, T.DoubleType()) for c in _ESTIMATES], [T.StructField(c, T.LongType()) for c in _COUNTS]
    schema = T.StructType([*kept, T.StructField("stratum", T.StringType()), *doubles, *longs, T.StructField("matched", T.ArrayType(T.LongType()))])

    def per_trial(trial: pa.Table) -> pa.Table:
        found = trial_fit.estimates_of(trial, covariates, time, event, len(names), threshold)
        named = {k: pa.array([trial.column(k)[0].as_py()] * len(found), trial.schema.field(k).type) for k in keys}
        named["stratum"] = pa.array([names[f["stratum"]] for f in found], pa.string())
        named |= {c: pa.array([f[c] for f in found], pa.float64()) for c in _ESTIMATES} | {c: pa.array([f[c] for f in found], pa.int64()) for c in _COUNTS}
        return pa.table(named | {"matched": pa.array([f["matched"] for f in found], pa.list_(pa.int64()))})

    done = cut(spread(needed, n_rows, *keys).groupBy(*keys).applyInArrow(per_trial, schema))
    return done.drop("matched"), done.select(*keys, "stratum", F.explode("matched").alias("id"))


def _estimate_by_steps(
    trials: DataFrame, covariates: Sequence[str], keys: Sequence[str], time: str, event: str, threshold: float, seed: int
) -> tuple[DataFrame, DataFrame]:
    """The same for trials of any size, one step after another over all of them."""
    keys, covariates = list(keys), list(covariates)
    split = trials.withColumn("_train", split_flag(seed, 70, *keys, "id"))
    filled = impute_median_from_train(split, keys, covariates, "_train").drop("_train")
    # a covariate without a single training value in a trial carries no information there
    filled = cut(filled.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in covariates}))
    scored = cut(models.propensity_scores(filled, keys, covariates))
    pairs = matching.match_nearest(scored.select(*keys, "id", "treatment", F.col("ps_logit").alias("score")), keys)
    matched = cut(matching.matched_rows(scored, pairs, keys))
    estimates = synthesis.trial_estimates(scored, matched, keys, time, event)
    for rows, name in ((scored, "ori_unbalanced_covariates"), (matched, "unbalanced_covariates")):
        smd = balance.standardized_differences(rows, keys, covariates)
        counts = balance.unbalanced_counts(smd, keys, threshold).withColumnRenamed("unbalanced", name)
        estimates = estimates.join(counts, keys, "left")
    return estimates, matched


def _horizons(horizon: int) -> tuple[tuple[str, int | None], ...]:
    return ("all_day", None), ("180day", horizon)


def _class_estimates_of_sums(matched: MatchedSums, balance_counts: DataFrame, horizon: int) -> DataFrame:
    measures = {}
    for name, _ in _horizons(horizon):
        here = F.col("horizon") == name
        rates = [survival.rate_of(F.col(hits), F.col(days)) for hits, days in (("a", "treated_days"), ("c", "control_days"))]
        measures[f"OR_{name}"] = F.max(F.when(here, survival.odds_of_cells(*"abcd")))
        measures[f"diff_ir_{name}"] = F.max(F.when(here, rates[0] - rates[1]))
    out = matched.sums.groupBy(*TRIAL, "class").agg(*[m.alias(n) for n, m in measures.items()])
    return out.join(balance_counts.select(*TRIAL, "unbalanced_covariates"), TRIAL)


def class_estimates(
    matched: DataFrame | MatchedSums, events: DataFrame, balance_counts: DataFrame, classes: Sequence[str], last: DataFrame, horizon: int = 180, min_days: int | None = None
) -> DataFrame:
    """Per drug, draw and event class: odds ratios and incidence rate differences on the matched rows.

    Every row stays unless `min_days` is given; then `n_dropped` counts those with follow-up below it or without any. Rows without follow-up
    have no event and add no person-time. Sums of matched rows must be those of these events, classes and horizon.
    """
    if isinstance(matched, MatchedSums):
        if min_days is not None:
            raise ValueError("min_days needs the matched rows")
        return _class_estimates_of_sums(matched, balance_counts, horizon)
    flags = outcomes.first_event_after(matched.select("ptid", "index_date"), events, classes, last)
    rows = matched.select(*TRIAL, "ptid", "index_date", "treatment").join(flags.where("class <> 'any'"), ["ptid", "index_date"])
    keys = [*TRIAL, "class"]
    out = dropped = None
    if min_days is not None:
        short = F.coalesce(F.col("sae_delta_days") < min_days, F.lit(True))
        dropped = rows.groupBy(*keys).agg(F.count_if(short).alias("n_dropped"))
        rows = rows.where(~short)
    for name, days in _horizons(horizon):
        odds = survival.odds_ratio(rows, keys, "sae_delta_days", "sae_flag", horizon=days).select(*keys, F.col("odds_ratio").alias(f"OR_{name}"))
        rates = survival.incidence_rate_difference(rows, keys, "sae_delta_days", "sae_flag", horizon=days).select(
            *keys, F.col("rate_difference").alias(f"diff_ir_{name}")
        )
        both = odds.join(rates, keys)
        out = both if out is None else out.join(both, keys)
    if dropped is not None:
        out = out.join(dropped, keys, "right")
    return out.join(balance_counts.select(*TRIAL, "unbalanced_covariates"), TRIAL)


def stratum_estimates(trials: DataFrame | Trials, covariates: Sequence[str], strata: Mapping[str, Column], task_rows: int | None = None) -> DataFrame:
    """One estimate per (drug, draw, stratum); every stratum is matched on its own."""
    return estimate_trials(trials, covariates, strata=strata, task_rows=task_rows)[0]
