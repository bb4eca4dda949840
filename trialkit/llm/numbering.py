"""Gapless numbers in a wanted order, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialkit.session import broadcast_if_small, cut

#: rows that one task sorts
ROWS_PER_TASK = 20_000
_INDEX_BITS = 33  # of the ids that Spark gives out: partition above, row of the partition below


def numbered(df: DataFrame, group: str, order: Sequence[str], rows: int, out: str, payload: Sequence[str] | None = None) -> DataFrame:
    """Add `out`: 0, 1, .. in each group by `order`, nulls first and strings bytewise. `group` has no nulls; `df` is a materialised table of `rows` rows.

    The table is dealt into ranges of (group, order, place in the table), so neither a large group nor equal rows meet in one task. A row's
    place in its range plus the rows of its group in earlier ranges is its number; the second comes from a table of one row per group
    and range.
    """
    kept = list(payload or df.columns)
    by = [group, *order, "__at"]
    tasks = max(1, -(-rows // ROWS_PER_TASK))
    at = F.monotonically_increasing_id()
    placed = cut(df.withColumn("__at", at).repartitionByRange(tasks, *by).sortWithinPartitions(*by).select(*dict.fromkeys([group, *kept]), at.alias("__id")))
    ranged = placed.withColumns({"__range": F.shiftright("__id", _INDEX_BITS), "__row": F.col("__id").bitwiseAND((1 << _INDEX_BITS) - 1)})
    runs = ranged.groupBy(group, "__range").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = cut(runs.select(group, "__range", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift")))
    near = broadcast_if_small(shifts, shifts.count(), 96)
    return ranged.join(near, [group, "__range"]).select(*kept, (F.col("__row") + F.col("__shift")).alias(out))
