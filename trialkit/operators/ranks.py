"""Order statistics and running totals that never sort a whole group in one task.

A group (a drug, a trial) may hold a large share of all rows, so a window over the group alone would
put it in one task. Here each group is cut into chunks that are contiguous in the wanted order; windows
run inside a chunk, and a small table with one row per chunk carries the totals across.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialkit.functions.hashing import hash32
from trialkit.session import broadcast_if_small, cut
from trialkit.sources.tables import reuse

CHUNKS = 64
_UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)
_BEFORE_HERE = (Window.unboundedPreceding, -1)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the smallest by `order`; a partial aggregate, so a hot key is no problem."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def dense_positions(df: DataFrame, group: Sequence[str], ident: str, name: str = "pos", bucket_rows: int = 20_000) -> DataFrame:
    """0-based position of each row in its group, ordered by (hash of ident, ident).

    Windows run inside ranges of the hash, as many as the counted rows need; the positions do not depend on their number.
    """
    group = list(group)
    rows = cut(df.withColumn("_hash", hash32(ident)))
    bits = min(32, int(rows.count() // bucket_rows).bit_length())
    rows = rows.withColumn("_bucket", F.shiftright("_hash", 32 - bits))
    inside = Window.partitionBy(*group, "_bucket").orderBy("_hash", ident)
    across = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(*_BEFORE_HERE)
    offsets = rows.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.withColumn("_offset", F.coalesce(F.sum("_n").over(across), F.lit(0))).drop("_n")
    ranked = rows.withColumn("_local", F.row_number().over(inside) - 1)
    return (
        ranked.join(offsets, [*group, "_bucket"])
        .withColumn(name, (F.col("_offset") + F.col("_local")).cast("long"))
        .drop("_bucket", "_hash", "_offset", "_local")
    )


def chunk_bounds(df: DataFrame, keys: Sequence[str], value: str, chunks: int = CHUNKS) -> DataFrame:
    """Per group: approximate cut points that split it into about `chunks` parts."""
    probs = F.array(*[F.lit(i / chunks) for i in range(1, chunks)])
    return df.groupBy(*keys).agg(F.percentile_approx(value, probs, F.lit(1000)).alias("_bounds"))


def chunk_of(bounds: Column, value: Column) -> Column:
    return F.size(F.filter(bounds, lambda b: b < value))


def ordered_chunks(
    df: DataFrame, keys: Sequence[str], score: str, arm_rank: Column, tie_hash: Column, chunks: int = CHUNKS
) -> DataFrame:
    """Add `_chunk`, contiguous in the order (score, arm_rank, tie_hash) inside each group.

    A score held by so many rows that two cut points fall on it is split further by arm and hash, so
    a mass of equal scores is spread as well.
    """
    bounds = cut(chunk_bounds(df, keys, score, chunks))
    bounded = df.join(broadcast_if_small(bounds, bounds.count(), 8 * chunks + 200), list(keys))
    bucket = chunk_of(F.col("_bounds"), F.col(score))
    repeats = F.size(F.filter("_bounds", lambda b: b == F.col(score)))
    inner = F.when(repeats >= 2, 1 + arm_rank.cast("long") * 256 + F.shiftright(tie_hash, 24)).otherwise(F.lit(0))
    return bounded.withColumn("_chunk", bucket.cast("long") * 1024 + inner).drop("_bounds")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    backward: bool = False,
) -> DataFrame:
    """Inclusive running sums and running maxima over each group, in two levels by `_chunk`.

    `order` must agree with the chunk order; with `backward` it must be the reversed order.
    """
    keys, sums, maxes = list(keys), dict(sums or {}), dict(maxes or {})
    chunk_order = F.col("_chunk").desc() if backward else F.col("_chunk").asc()
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(*_UP_TO_HERE)
    across = Window.partitionBy(*keys).orderBy(chunk_order).rowsBetween(*_BEFORE_HERE)
    rows = df.select(
        "*",
        *[F.sum(c).over(local).alias(n) for n, c in sums.items()],
        *[F.max(c).over(local).alias(n) for n, c in maxes.items()],
    )
    totals = df.groupBy(*keys, "_chunk").agg(
        *[F.sum(c).alias(f"_c_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"_c_{n}") for n, c in maxes.items()],
    )
    carry = totals.select(
        *keys,
        "_chunk",
        *[F.coalesce(F.sum(f"_c_{n}").over(across), F.lit(0)).alias(f"_p_{n}") for n in sums],
        *[F.max(f"_c_{n}").over(across).alias(f"_p_{n}") for n in maxes],
    )
    joined = rows.join(carry, [*keys, "_chunk"])
    for n in sums:
        joined = joined.withColumn(n, F.col(n) + F.col(f"_p_{n}"))
    for n in maxes:
        joined = joined.withColumn(n, F.greatest(n, f"_p_{n}"))
    return joined.drop(*[f"_p_{n}" for n in [*sums, *maxes]])


BINS = 4096


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """Exact percentiles with linear interpolation, per group, for groups of any size.

    Equal values collapse map-side. Each wanted rank has a range of values that holds it; a pass counts the range in a fixed
    number of bins and keeps the bin with the rank, until that is a single value. So no task sorts more than the bins of a rank.
    """
    keys = list(keys)
    key_cols = [F.lit(1).alias("_all")] if not keys else [F.col(k) for k in keys]
    by = keys or ["_all"]
    rows = df.select(*key_cols, F.col(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    counted = reuse(rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")))
    ranges = counted.groupBy(*by).agg(F.sum("_n").alias("_total"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    at = [F.lit(float(p)) * (F.col("_total") - 1) for p in probs]
    wanted = [F.struct(F.lit(2 * i + j).alias("i"), (F.floor(t) if j == 0 else F.least(F.floor(t) + 1, F.col("_total") - 1)).alias("rank")) for i, t in enumerate(at) for j in (0, 1)]
    state = cut(
        ranges.withColumn("_w", F.explode(F.array(*wanted)))
        .select(*by, "_total", "_low", "_high", F.col("_w.i").alias("_i"), F.col("_w.rank").alias("_rank"), F.lit(0).cast("long").alias("_below"))
    )
    groups = state.count()
    while not state.where("_low < _high").isEmpty():
        state = cut(_narrowed(counted, state, by, groups))
    counted.unpersist()
    picked = state.groupBy(*by, "_total").agg(*[F.max(F.when(F.col("_i") == i, F.col("_low"))).alias(f"_x{i}") for i in range(2 * len(probs))])
    low, high = [F.col(f"_x{2 * i}") for i in range(len(probs))], [F.col(f"_x{2 * i + 1}") for i in range(len(probs))]
    return picked.select(
        *keys, *[F.when((h == lo) | (t == F.floor(t)), lo).otherwise(lo + (h - lo) * (t - F.floor(t))).alias(n) for lo, h, t, n in zip(low, high, at, names)]
    )


def _narrowed(counted: DataFrame, state: DataFrame, by: list[str], groups: int) -> DataFrame:
    """The ranges that still hold several values, cut down to the bin with the wanted rank."""
    open_, v, low, high = state.where("_low < _high"), F.col("_v"), F.col("_low"), F.col("_high")
    wide = (high - low) == float("inf")  # differences beyond the largest double are taken of halves
    share = F.when(wide, (v / 2 - low / 2) / (high / 2 - low / 2)).otherwise((v - low) / (high - low))
    infinite = (F.abs(low) == float("inf")) | (F.abs(high) == float("inf"))
    bins = F.when(v == float("-inf"), F.lit(-1)).when(v == float("inf"), F.lit(BINS + 1)).when(
        infinite, F.floor(F.lit(BINS / 2) + F.signum(v) * F.log2(1 + F.abs(v)))
    ).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1)))
    inside = counted.join(broadcast_if_small(open_, groups, 96), by).where((v >= low) & (v <= high))
    binned = inside.groupBy(*by, "_i", "_rank", "_total", "_below", bins.alias("_bin")).agg(
        F.sum("_n").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )
    upto = Window.partitionBy(*by, "_i").orderBy("_bin").rowsBetween(*_UP_TO_HERE)  # at most BINS + 2 rows
    ended = binned.withColumn("_end", F.col("_below") + F.sum("_n").over(upto))
    hit = ended.where((F.col("_rank") >= F.col("_end") - F.col("_n")) & (F.col("_rank") < F.col("_end")))
    columns = [*by, "_total", "_low", "_high", "_i", "_rank", "_below"]
    found = hit.withColumn("_below", F.col("_end") - F.col("_n")).select(*columns)
    return state.where("_low >= _high").select(*columns).unionByName(found)
