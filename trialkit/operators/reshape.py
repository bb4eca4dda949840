"""Wide and long shapes, encoding, cleaning and imputation, per trial."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialkit.functions.hashing import hash_position
from trialkit.operators.ranks import exact_percentiles, keep_first
from trialkit.session import broadcast_if_small, cut


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), variable, value)


def matrix(df: DataFrame, rows: Sequence[str], column: str, levels: Sequence[str], cell: Column, prefix: str = "") -> DataFrame:
    """Rows x named levels with one conditional aggregate per level (one shuffle, no level scan)."""
    return df.groupBy(*rows).agg(
        *[F.max(F.when(F.col(column) == lv, cell)).alias(f"{prefix}{lv}") for lv in levels]
    )


def distinct_levels(df: DataFrame, col: str, at_most: int = 1000) -> list[str]:
    """Levels of a categorical column as plan constants; a wider one than `at_most` is refused, see `one_hot_long`."""
    found = _levels_up_to(df, col, at_most)
    if found is None:
        raise ValueError(f"{col} has more than {at_most} levels; use one_hot_long")
    return found


def _levels_up_to(df: DataFrame, col: str, at_most: int) -> list[str] | None:
    """The sorted levels, or None when there are more than `at_most`."""
    found = df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col).limit(at_most + 1).collect()
    return None if len(found) > at_most else [r[0] for r in found]


def one_hot(df: DataFrame, col: str, levels: Sequence[str]) -> DataFrame:
    flags = {f"{col}_{lv}": F.coalesce((F.col(col) == lv).cast("int"), F.lit(0)) for lv in levels}
    return df.withColumns(flags).drop(col)


def one_hot_long(df: DataFrame, ids: Sequence[str], col: str) -> DataFrame:
    """(ids, level, flag): the flags that are 1, one row each, for a categorical column of any number of levels."""
    return df.where(F.col(col).isNotNull()).select(*ids, F.col(col).cast("string").alias("level"), F.lit(1).alias("flag"))


def drop_all_null(df: DataFrame, candidates: Sequence[str] | None = None) -> DataFrame:
    """Drop columns without a single value, found in one pass."""
    cols = list(candidates or df.columns)
    counts = df.agg(*[F.count(c).alias(c) for c in cols]).first()
    return df.drop(*[c for c in cols if counts[c] == 0])


def drop_constant(df: DataFrame, candidates: Sequence[str] | None = None) -> DataFrame:
    """Drop columns with one value in every row, found in one pass."""
    cols = list(candidates or df.columns)
    checks = [
        ((F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1)))).alias(c) for c in cols
    ]
    same = df.agg(*checks).first()
    return df.drop(*[c for c in cols if same[c]])


def covariate_kinds(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(covariate, kind): text is categorical unless a value has a decimal point."""
    text = [c for c, t in df.dtypes if c in cols and t == "string"]
    found = df.agg(*[F.max(F.contains(F.col(c), F.lit(".")).cast("int")).alias(c) for c in text] or [F.lit(0).alias("_none")])
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("covariate"),
                (F.when(F.col(c) == 1, "continuous").otherwise("categorical") if c in text else F.lit("continuous")).alias("kind"),
            )
            for c in cols
        ]
    )
    return found.select(F.explode(pairs).alias("p")).select("p.*")


def _value_ranges(df: DataFrame, keys: Sequence[str], cols: Sequence[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Per (keys, variable): exact percentiles, all columns in one pass over the long form."""
    long = df.unpivot(list(keys), [F.col(c).cast("double").alias(c) for c in cols], "_var", "_val")
    return exact_percentiles(long, [*keys, "_var"], "_val", probs, names)


def _spread(long: DataFrame, keys: Sequence[str], cols: Sequence[str], names: Sequence[str]) -> DataFrame:
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_var") == c, F.col(n))).alias(f"_{n}_{c}") for c in cols for n in names]
    )


def _attach(df: DataFrame, keys: Sequence[str], per_group: DataFrame) -> DataFrame:
    """Join a summary per group back to the rows; while it is small the rows are not shuffled for it."""
    summary = cut(per_group)
    return df.join(broadcast_if_small(summary, summary.count(), 100 + 16 * len(summary.columns)), list(keys), "left")


def trim_outliers(df: DataFrame, keys: Sequence[str], cols: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values outside the group's low / high percentile become null."""
    ranges = _spread(_value_ranges(df, keys, cols, [low, high], ["lo", "hi"]), keys, cols, ["lo", "hi"])
    joined = _attach(df, keys, ranges)
    kept = {c: F.when(F.col(c).between(F.col(f"_lo_{c}"), F.col(f"_hi_{c}")), F.col(c)) for c in cols}
    return joined.withColumns(kept).select(*df.columns)


def impute_mean(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(f"_mean_{c}") for c in cols])
    joined = _attach(df, keys, means)
    return joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_mean_{c}")) for c in cols}).select(*df.columns)


def impute_mode(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Most frequent value; ties go to the smallest value."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    modes = keep_first(counts, keys, [-F.col("_n"), col]).select(*keys, F.col(col).alias("_mode"))
    return _attach(df, keys, modes).withColumn(col, F.coalesce(col, "_mode")).select(*df.columns)


def split_flag(seed: int, percent_train: int, *key: Column | str) -> Column:
    """1 for the training part; the same row always lands in the same part."""
    return (hash_position(F.lit(100), F.lit(seed), *key) < percent_train).cast("int")


def impute_median_from_train(df: DataFrame, keys: Sequence[str], cols: Sequence[str], train: str) -> DataFrame:
    """Medians of the rows with train = 1, applied to all rows. Columns without gaps cost one count."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in cols]).first()
    whole = [c for c in cols if counts[c] == counts["_rows"]]
    df = df.withColumns({c: F.col(c).cast("double") for c in whole}) if whole else df
    cols = [c for c in cols if c not in whole]
    if not cols:
        return df
    medians = _spread(_value_ranges(df.where(F.col(train) == 1), keys, cols, [0.5], ["med"]), keys, cols, ["med"])
    joined = _attach(df, keys, medians)
    return joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}")) for c in cols}).select(*df.columns)


def scale_min_max(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """To [0, 1] per group; a column with one value becomes 0."""
    ends = df.groupBy(*keys).agg(*[F.min(c).alias(f"_lo_{c}") for c in cols], *[F.max(c).alias(f"_hi_{c}") for c in cols])
    joined = _attach(df, keys, ends)

    def scaled(c: str) -> Column:
        width = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        return F.when(width == 0, F.lit(0.0)).otherwise(F.try_divide(F.col(c) - F.col(f"_lo_{c}"), width))

    return joined.withColumns({c: scaled(c) for c in cols}).select(*df.columns)


def median_abs_deviation(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    medians = exact_percentiles(df, keys, col, [0.5], ["median"])
    spread = _attach(df, keys, medians).withColumn("_dev", F.abs(F.col(col) - F.col("median")))
    return medians.join(exact_percentiles(spread, keys, "_dev", [0.5], ["mad"]), list(keys))


@dataclass
class Cleaned:
    """Rows ready for a model. `wide_levels` holds (row id, covariate, level, flag) of the categorical covariates with too many levels for columns."""

    rows: DataFrame
    categorical: list[str]
    continuous: list[str]
    wide_levels: DataFrame | None = None


def clean_covariates(
    df: DataFrame, keys: Sequence[str], ids: Sequence[str], covariates: Sequence[str], numbers: Sequence[str] = (), at_most: int = 1000,
    low: float = 0.01, high: float = 0.99,
) -> Cleaned:
    """Covariates made numeric per trial: kinds, outliers, gaps, flags.

    Text is categorical unless one of its values has a decimal point; then it is read as numbers, and what is no number becomes null. Values of continuous covariates outside the trial's
    percentiles become null, and nulls the mean of what is left. Categorical gaps take the trial's most frequent level (ties: the smallest), then every
    level of any trial becomes a 0/1 column `covariate_level`; covariates of more than `at_most` levels go to `wide_levels` instead, one row per flag that
    is 1. Boolean columns become 0/1 and stay whole. `numbers` (arm, outcome, follow-up) become doubles. A covariate without a value in a trial stays null there.
    """
    keys, covariates = list(keys), list(covariates)
    kind_of = dict(df.dtypes)
    flags = [c for c in df.columns if kind_of[c] == "boolean"]
    text = [c for c in covariates if kind_of[c] == "string"]
    kinds = {r["covariate"]: r["kind"] for r in covariate_kinds(df, text).collect()} if text else {}
    categorical = [c for c in text if kinds[c] == "categorical"]
    continuous = [c for c in covariates if c not in categorical]
    measured = [c for c in continuous if c not in flags]
    as_number = {c: F.col(c).cast("int") for c in flags} | {c: F.expr(f"try_cast(`{c}` AS double)") for c in [*measured, *numbers]}
    rows = cut(df.select(*dict.fromkeys([*keys, *ids, *numbers, *covariates])).withColumns({c: e for c, e in as_number.items() if c in {*numbers, *covariates}}))
    if measured:
        rows = impute_mean(trim_outliers(rows, keys, measured, low, high), keys, measured)
    if any(c in flags for c in continuous):
        rows = impute_mean(rows, keys, [c for c in continuous if c in flags])
    for c in categorical:
        rows = impute_mode(rows, keys, c)
    rows = cut(rows)
    columns, long = [], None
    for c in categorical:
        levels = _levels_up_to(rows, c, at_most)
        if levels is None:
            one = one_hot_long(rows, [*keys, *ids], c).withColumn("covariate", F.lit(c)).select(*keys, *ids, "covariate", "level", "flag")
            long = one if long is None else long.unionByName(one)
            rows = rows.drop(c)
            continue
        rows = one_hot(rows, c, levels)
        columns += [f"{c}_{lv}" for lv in levels]
    return Cleaned(rows, columns, continuous, long)
