"""Covariate balance and outcome shares by arm."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: spread in units of the mean that counts as none
NO_SPREAD = 1e-9


def _pairs(cols: Sequence[str], value) -> Column:
    return F.array(*[F.struct(F.lit(c).alias("covariate"), value(c).alias("smd")) for c in cols])


def standardized_differences(df: DataFrame, keys: Sequence[str], cols: Sequence[str], treat: str = "treatment", weight: str | None = None) -> DataFrame:
    """|mean difference| / pooled standard deviation per (keys, covariate), plain or weighted.

    One wide conditional aggregate, then the small result is made long. Plain: sample variances.
    Weighted: variances over the weight total.
    """
    aggs = []
    for i, c in enumerate(cols):
        for arm in (0, 1):
            x = F.when(F.col(treat) == arm, F.col(c).cast("double"))
            if weight is None:
                aggs += [F.avg(x).alias(f"m{arm}_{i}"), F.var_samp(x).alias(f"v{arm}_{i}")]
            else:
                w = F.when(x.isNotNull(), F.col(weight))
                aggs += [F.sum(w).alias(f"w{arm}_{i}"), F.sum(w * x).alias(f"s{arm}_{i}"), F.sum(w * x * x).alias(f"q{arm}_{i}")]
    wide = df.groupBy(*keys).agg(*aggs)
    at = {c: i for i, c in enumerate(cols)}

    def moments(c: str, arm: int) -> tuple[Column, Column]:
        i = at[c]
        if weight is None:
            return F.col(f"m{arm}_{i}"), F.col(f"v{arm}_{i}")
        total = F.col(f"w{arm}_{i}")
        mean = F.try_divide(F.col(f"s{arm}_{i}"), total)
        return mean, F.greatest(F.try_divide(F.col(f"q{arm}_{i}"), total) - mean * mean, F.lit(0.0))

    def smd(c: str) -> Column:
        (m1, v1), (m0, v0) = moments(c, 1), moments(c, 0)
        spread = F.sqrt((v1 + v0) / 2)
        known = spread > NO_SPREAD * F.greatest(F.abs(m1), F.abs(m0))  # below that it is the rounding of a column of one value
        return F.when(known, F.abs(m1 - m0) / spread)

    return wide.select(*keys, F.explode(_pairs(cols, smd)).alias("_b")).select(*keys, "_b.covariate", "_b.smd")


def unbalanced_counts(balance: DataFrame, keys: Sequence[str], threshold: float = 0.2, ignore: Sequence[str] = ()) -> DataFrame:
    """Covariates over the threshold per trial, apart from the ignored ones; trials with none count 0."""
    over = (F.col("smd") > threshold) & ~F.col("covariate").isin(list(ignore)) if ignore else F.col("smd") > threshold
    return balance.groupBy(*keys).agg(F.count(F.when(over, 1)).alias("unbalanced"))


def incidence_difference(df: DataFrame, keys: Sequence[str], outcome: str, treat: str = "treatment", weight: str | None = None) -> DataFrame:
    """Outcome share by arm and their difference."""
    w = F.lit(1.0) if weight is None else F.col(weight)

    def share(arm: int) -> Column:
        here = F.col(treat) == arm
        return F.try_divide(F.sum(F.when(here, w * F.col(outcome))), F.sum(F.when(here, w)))

    overall = F.try_divide(F.sum(w * F.col(outcome)), F.sum(w))
    return (
        df.groupBy(*keys)
        .agg(share(1).alias("incidence_treated"), share(0).alias("incidence_control"), overall.alias("incidence_overall"))
        .withColumn("ate", F.col("incidence_treated") - F.col("incidence_control"))
    )


def inverse_probability_weight(treat: Column, p: Column, clip: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.when(treat == 1, 1 / q).otherwise(1 / (1 - q))
