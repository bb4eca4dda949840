"""Outcomes: last activity, validated death, follow-up, adverse events, trial tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialkit.operators.joins import join_numbered, of_patients, spread
from trialkit.operators.ranks import dense_positions
from trialkit.session import broadcast_if_small, cut


def last_activity(patients: DataFrame, events: Sequence[DataFrame], anchors: Sequence[str]) -> DataFrame:
    """Latest of the patient's anchor dates and of any event on or after them.

    `patients` has ptid, last_act_dt and the anchor columns; each events frame is (ptid, date). An event
    ahead of an anchor cannot be the latest date, so each patient's latest event is enough.
    """
    dated = of_patients(reduce(DataFrame.unionByName, [e.select("ptid", "date") for e in events]), patients)
    latest = dated.groupBy("ptid").agg(F.max("date").alias("_latest"))
    last = F.greatest("last_act_dt", *anchors, "_latest")
    return patients.join(latest, "ptid", "left").withColumn("last_act_dt", last).drop("_latest")


def validated_death(patients: DataFrame, recorded: str = "unvalidated_dod", grace: int = 30) -> DataFrame:
    """A recorded death is void when activity goes on for `grace` days or more after it."""
    void = F.col("last_act_dt") >= F.date_add(recorded, grace)
    return patients.withColumn("available_date", F.when(F.coalesce(~void, F.lit(True)), F.col(recorded))).withColumn(
        "d_flag", F.col("available_date").isNotNull().cast("int")
    )


def follow_up_days(index_date: Column, flag: Column, event_date: Column, last_date: Column) -> Column:
    """Days from index to the event, or to the last activity when there is none."""
    return F.datediff(F.when(flag == 1, event_date).otherwise(last_date), index_date)


def event_classes(events: DataFrame, more_than: int) -> list[str]:
    """Names of the event classes that more than `more_than` patients have, in order; a short list that shapes the plan."""
    members = events.where(F.col("name").isNotNull()).groupBy("name").agg(F.count_distinct("ptid").alias("n"))
    return [r["name"] for r in members.where(F.col("n") > more_than).orderBy("name").collect()]


def first_event_after(
    index_rows: DataFrame, events: DataFrame, classes: Sequence[str], last: DataFrame, horizon: int | None = None
) -> DataFrame:
    """Per index row and class (and `any`): flag and days to the first event strictly after the index.

    Rows without an event are censored at the last activity; `horizon` caps follow-up at that many days.
    """
    named = events.where(F.col("name").isin(list(classes))).select("ptid", "name", "date")
    daily = of_patients(named, index_rows).distinct()
    # one pass over each patient's days from the latest back: an index row sees the first event of the days after it
    anchors = index_rows.select("ptid", "index_date").distinct().select("ptid", F.col("index_date").alias("date"), F.lit(None).cast("string").alias("name"))
    both = daily.select("ptid", "date", "name").unionByName(anchors).withColumn("_day", F.unix_date("date"))
    after = Window.partitionBy("ptid").orderBy(F.desc("_day")).rangeBetween(Window.unboundedPreceding, -1)
    firsts = both.select(
        "ptid", F.col("date").alias("index_date"), "name", F.min(F.when(F.col("name").isNotNull(), F.col("date"))).over(after).alias("any"),
        *[F.min(F.when(F.col("name") == c, F.col("date"))).over(after).alias(c) for c in classes],
    ).where("name is null").drop("name")
    long = firsts.unpivot(["ptid", "index_date"], ["any", *classes], "class", "event_date").join(last, "ptid", "left")
    flag = F.col("event_date").isNotNull()
    days = F.datediff(F.coalesce("event_date", "last_act_dt"), "index_date")
    if horizon is not None:
        flag, days = flag & (days <= horizon), F.least(days, F.lit(horizon))
    return long.select("ptid", "index_date", "class", flag.cast("int").alias("sae_flag"), days.alias("sae_delta_days"))


def _whole(df: DataFrame, col: str) -> bool:
    return df.schema[col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")


def _not_own(draws: DataFrame, treated: DataFrame, n_treated: int) -> DataFrame:
    """Draws without those that are treated patients of the same drug."""
    own = treated.select("drug", "ptid")
    if _whole(own, "ptid"):
        low, high = own.agg(F.min("ptid"), F.max("ptid")).first()
        numbers = dense_positions(own.select("drug").distinct(), [], "drug", "_no")
        if low is not None and low >= 0 and high < 1 << 40:
            numbers = cut(numbers)
            n, span = numbers.count(), high // 64 * 64 + 64
            if n < 1 << 20:
                known = F.when(F.col("ptid").between(0, span - 1), F.col("_no") * F.lit(span) + F.col("ptid"))
                numbered = broadcast_if_small(numbers, n, 96)
                listed = own.distinct().join(numbered, "drug").select("ptid", "_no")
                return join_numbered(draws.join(numbered, "drug", "left"), listed, ["_no", "ptid"], known, "left_anti").drop("_no")
    return draws.join(broadcast_if_small(own, n_treated, 96), ["drug", "ptid"], "left_anti")


def assemble_trials(
    treated: DataFrame, draws: DataFrame, outcome: DataFrame, n_boot: int = 100, min_days: int | None = None
) -> DataFrame:
    """All trials of all drugs: treated and drawn controls with follow-up and event flag.

    Keyed (drug, boot_id, treatment, ptid, index_date, rep). Draws that are treated patients of the same
    drug are removed. Every row stays unless `min_days` is given; `dropped_follow_up` counts what that would drop.
    """
    n_treated = treated.count()
    arms = spread(treated.select("drug", "ptid", "index_date"), n_treated * n_boot, "drug", "ptid").select(
        "drug", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("boot_id"), "ptid", "index_date",
        F.lit(0).cast("long").alias("rep"), F.lit(1).alias("treatment"),
    )
    controls = _not_own(draws, treated, n_treated).select(
        "drug", "boot_id", "ptid", "index_date", F.col("rep").cast("long").alias("rep"), F.lit(0).alias("treatment")
    )
    known, rows = outcome.select("ptid", "d_flag", "available_date", "last_act_dt"), arms.unionByName(controls)
    if _whole(known, "ptid"):
        rows = join_numbered(rows, known, ["ptid"], F.col("ptid"), "left", 64)
    else:
        rows = rows.join(broadcast_if_small(known, known.count(), 64), "ptid", "left")
    days = follow_up_days(F.col("index_date"), F.col("d_flag"), F.col("available_date"), F.col("last_act_dt"))
    rows = rows.withColumn("d_delta_days", days).drop("available_date", "last_act_dt")
    return rows if min_days is None else rows.where(F.col("d_delta_days") >= min_days)


def dropped_follow_up(rows: DataFrame, min_days: int = 0) -> DataFrame:
    """Per drug and draw: rows, and those with follow-up below `min_days` or without any."""
    short = F.coalesce(F.col("d_delta_days") < min_days, F.lit(True))
    return rows.groupBy("drug", "boot_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(short).alias("n_short"))


def explode_strata(rows: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """A row goes into every stratum whose predicate holds."""
    names = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in predicates.items()]))
    return rows.withColumn("stratum", F.explode(names))


def study_strata(sites: Sequence[str] = ("lung", "brain", "bone", "liver", "adrenal_gland")) -> dict[str, Column]:
    """Sex, age below / from 65, number of metastatic sites, and each site."""
    out = {
        "gender_0": F.col("gender") == 0,
        "gender_1": F.col("gender") == 1,
        "age_less_65": F.col("age_at_index") < 65,
        "age_large_65": F.col("age_at_index") >= 65,
        "meta_total_0": F.col("meta_total") == 0,
        "meta_total_1": F.col("meta_total") == 1,
        "meta_total_2": F.col("meta_total") >= 2,
    }
    out.update({f"meta_{s}_1": F.col(f"meta_{s}") == 1 for s in sites})
    return out
