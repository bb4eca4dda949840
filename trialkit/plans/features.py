"""Baseline covariates at (ptid, index_date).

Covariates depend on patient and index date only, so they are computed once per distinct pair and joined
to every trial that uses it. Histories are first reduced to one row per (patient, name, day), which bounds
what one patient can bring into the range join. `baseline` drops patients outside the keys first; callers of single
blocks do so with `of_patients`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialkit.functions.dates import age_at
from trialkit.functions.recode import binary_flag, is_value
from trialkit.functions.text import parse_number
from trialkit.operators.joins import patient_list

KEY = ["ptid", "index_date"]

# The measurements and sites the study extracts.
VITALS = ["SBP", "DBP", "WT", "HT", "TEMP", "PULSE", "RESP", "PAIN", "HR", "UROUT", "PACK_YEARS"]
LABS = [
    "hemoglobin", "platelets", "hematocrit", "serum_creatinine", "calcium", "albumin", "blood_glucose",
    "blood_urea_nitrogen", "blood_bilirubin_total", "blood_erythrocytes", "blood_wbc", "neutrophils_percent",
    "lymphocytes_percent", "monocytes_percent", "eosinophils_percent", "basophils_percent", "ast", "alt",
    "potassium", "chloride", "sodium", "alkaline_phosphatase", "carbon_dioxide", "protein",
]
SITES = ["brain", "bone", "liver", "lung", "adrenal gland"]


def index_keys(rows: DataFrame) -> DataFrame:
    return rows.select(*KEY).distinct()


def change_days(events: DataFrame, days: int = 365) -> DataFrame:
    """(ptid, day): the days on which covariates of `baseline` over `events` (ptid, date) can change, the turn of the year apart.

    An event counts from its day on and, where the window is bounded, leaves it `days` + 1 days later. Between two such days of one year all index dates of
    a patient have the same covariates, and the same first event after them.
    """
    seen = events.select("ptid", F.col("date").alias("day")).where("day is not null")
    return seen.unionByName(seen.withColumn("day", F.date_add("day", days + 1)))


def _lookback(daily: DataFrame, keys: DataFrame, days: int | None, unbounded: str | None = None) -> DataFrame:
    """Keys with their history up to the index day, of `days` at most; keys without any keep one row of nulls. Rows of the block `unbounded` count however old.

    The bounds are part of the join, so older days never leave it.
    """
    k, h = keys.alias("k"), daily.alias("h")
    hit = (F.col("k.ptid") == F.col("h.ptid")) & (F.col("h.date") <= F.col("k.index_date"))
    if days is not None:
        near = F.col("h.date") >= F.date_sub(F.col("k.index_date"), days)
        hit = hit & (near if unbounded is None else near | (F.col("h.block") == unbounded))
    rest = [F.col(f"h.{c}").alias(c) for c in daily.columns if c != "ptid"]
    return k.join(h, hit, "left").select("k.ptid", "k.index_date", *rest)


def _per_name(rows: DataFrame, names: Sequence[str], prefix: str, cell) -> DataFrame:
    return rows.groupBy(*KEY).agg(*[cell(F.col("name") == n).alias(f"{prefix}{n}") for n in names])


def _daily_totals(events: DataFrame, names: Sequence[str]) -> DataFrame:
    measured = events.where(F.col("name").isin(list(names)) & F.col("value").isNotNull())
    return measured.groupBy("ptid", "name", "date").agg(F.sum("value").alias("total"), F.count("value").alias("n"))


def _daily_numbers(events: DataFrame, names: Sequence[str]) -> DataFrame:
    numbers = events.where(F.col("name").isin(list(names))).select("ptid", "name", "date", parse_number(F.col("result")).alias("value"))
    return numbers.where("value is not null").groupBy("ptid", "name", "date").agg(F.max("value").alias("value"))


def _days(events: DataFrame, names: Sequence[str]) -> DataFrame:
    return events.where(F.col("name").isin(list(names))).select("ptid", "name", "date").distinct()


def _first_days(events: DataFrame) -> DataFrame:
    return events.groupBy("ptid", "name").agg(F.min("date").alias("date"))


def _mean(hit: Column) -> Column:
    return F.try_divide(F.sum(F.when(hit, F.col("total"))), F.sum(F.when(hit, F.col("n"))))


def _last(hit: Column) -> Column:
    return F.max_by("value", F.when(hit, F.col("date")))


def _seen(hit: Column) -> Column:
    return F.coalesce(F.max(F.when(hit, F.lit(1))), F.lit(0))


def window_mean(events: DataFrame, keys: DataFrame, names: Sequence[str], prefix: str, days: int = 365) -> DataFrame:
    """Mean of each named measurement in [index - days, index]."""
    return _per_name(_lookback(_daily_totals(events, names), keys, days), names, prefix, _mean)


def window_last_number(events: DataFrame, keys: DataFrame, names: Sequence[str], prefix: str, days: int = 365) -> DataFrame:
    """Last numeric result of each name in the window; same-day results: the greatest value."""
    return _per_name(_lookback(_daily_numbers(events, names), keys, days), names, prefix, _last)


def window_any(events: DataFrame, keys: DataFrame, names: Sequence[str], prefix: str, days: int = 365) -> DataFrame:
    """1 if the name occurs in the window, else 0."""
    return _per_name(_lookback(_days(events, names), keys, days), names, prefix, _seen)


def sites_before(events: DataFrame, keys: DataFrame, sites: Sequence[str], prefix: str) -> DataFrame:
    """Distinct sites ever seen up to the index day, and a flag per named site."""
    rows = _lookback(_first_days(events), keys, None)
    flags = [_seen(F.col("name") == s).alias(f"{prefix}{s.replace(' ', '_')}") for s in sites]
    return rows.groupBy(*KEY).agg(F.count("name").cast("int").alias(f"{prefix}total"), *flags)


def demographics(clinical: DataFrame, keys: DataFrame, race_one: str = "Caucasian") -> DataFrame:
    return keys.join(clinical, "ptid", "left").select(
        *KEY,
        binary_flag(F.col("gender"), "Male", "Female").alias("gender"),
        is_value(F.col("race"), race_one).alias("race"),
        age_at(F.col("index_date"), F.col("birth_yr")).alias("age_at_index"),
    )


def baseline(
    keys: DataFrame, clinical: DataFrame, site_events: DataFrame, vital_events: DataFrame, lab_events: DataFrame,
    drug_events: DataFrame, diagnosis_events: DataFrame, *, sites: Sequence[str] = SITES,
    vitals: Sequence[str] = VITALS, labs: Sequence[str] = LABS, drugs: Sequence[str] = (),
    diagnoses: Sequence[str] = (), days: int = 365, race_one: str = "Caucasian",
) -> DataFrame:
    """The six covariate blocks side by side, one row per (ptid, index_date)."""
    listed = patient_list(keys)
    per_block = {
        "meta": _first_days(site_events.join(listed, "ptid", "left_semi")),
        "vital": _daily_totals(vital_events.join(listed, "ptid", "left_semi"), vitals),
        "lab": _daily_numbers(lab_events.join(listed, "ptid", "left_semi"), labs),
        "med": _days(drug_events.join(listed, "ptid", "left_semi"), drugs),
        "com": _days(diagnosis_events.join(listed, "ptid", "left_semi"), diagnoses),
    }
    # one table of patient days, so keys meet the history once
    tagged = [rows.withColumn("block", F.lit(b)) for b, rows in per_block.items()]
    history = tagged[0]
    for rows in tagged[1:]:
        history = history.unionByName(rows, allowMissingColumns=True)
    block, name = F.col("block"), F.col("name")
    wide = _lookback(history, keys, days, unbounded="meta").groupBy(*KEY).agg(
        F.count(F.when(block == "meta", name)).cast("int").alias("meta_total"),
        *[_seen((block == "meta") & (name == s)).alias(f"meta_{s.replace(' ', '_')}") for s in sites],
        *[_mean((block == "vital") & (name == n)).alias(f"vital_{n}") for n in vitals],
        *[_last((block == "lab") & (name == n)).alias(f"lab_{n}") for n in labs],
        *[_seen((block == "med") & (name == n)).alias(f"med_{n}") for n in drugs],
        *[_seen((block == "com") & (name == n)).alias(f"com_{n}") for n in diagnoses],
    )
    filled = demographics(clinical, keys, race_one).join(wide, KEY, "left")
    zero = ["meta_total", *[f"meta_{s.replace(' ', '_')}" for s in sites], *[f"med_{n}" for n in drugs], *[f"com_{n}" for n in diagnoses]]
    return filled.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in zero})
