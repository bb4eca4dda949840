"""Cohort description."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialkit.functions.dates import age_at
from trialkit.functions.recode import cap_ordinal, collapse_levels
from trialkit.functions.text import count_percent
from trialkit.operators.ranks import exact_percentiles
from trialkit.session import cut


def median_iqr(df: DataFrame, cols: Sequence[str], digits: int = 2) -> DataFrame:
    """(variable, median, q1, q3) of several columns in one pass over their long form."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "variable", "value")
    found = exact_percentiles(long, ["variable"], "value", [0.5, 0.25, 0.75], ["median", "q1", "q3"])
    return found.select("variable", *[F.round(c, digits).alias(c) for c in ("median", "q1", "q3")])


def category_shares(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(variable, category, n, total, percent) for several columns; null is a category."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "variable", "category")
    counts = long.groupBy("variable", "category").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("variable"))  # over the few rows of the counts
    return counts.withColumn("total", total).withColumn("percent", F.round(F.col("n") / F.col("total") * 100, 2))


def characteristics(
    cohort: DataFrame, clinical: DataFrame, dates: Mapping[str, str], binary: Mapping[str, tuple[Sequence[str], str, str]], kept: Mapping[str, tuple[Sequence[str], str]],
    capped: Mapping[str, int], birth: str = "birth_yr",
) -> DataFrame:
    """Table one of a cohort with an age at several dates and with collapsed levels.

    `dates` names an age for each date column, `binary` gives levels, their common name and the name of all others, `kept` the levels that stay and the name of the
    rest, `capped` the top of an ordinal. Patients without a clinical row stay, with the level of the rest; an age without its date is left out of the median.
    """
    rows = cohort.join(clinical, "ptid", "left")
    recoded = {name: age_at(F.col(date), F.col(birth)) for name, date in dates.items()}
    recoded |= {c: F.when(F.col(c).isin(list(ones)), F.lit(name)).otherwise(F.lit(rest)) for c, (ones, name, rest) in binary.items()}
    recoded |= {c: collapse_levels(F.col(c), keep, rest) for c, (keep, rest) in kept.items()}
    recoded |= {c: cap_ordinal(F.col(c), top) for c, top in capped.items()}
    return table_one(cut(rows.select("ptid", *[e.alias(n) for n, e in recoded.items()])), list(dates), [*binary, *kept, *capped])


def table_one(df: DataFrame, continuous: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """(variable, category, metric, value): median (Q1, Q3) and n (%) rows."""
    numbers = median_iqr(df, continuous).select(
        "variable", F.lit(None).cast("string").alias("category"), F.lit("median, IQR").alias("metric"),
        F.format_string("%.2f(%.2f, %.2f)", "median", "q1", "q3").alias("value"),
    )
    groups = category_shares(df, categorical).select(
        "variable", "category", F.lit("count (percentage)").alias("metric"), count_percent(F.col("n"), F.col("total")).alias("value")
    )
    return numbers.unionByName(groups)
