"""Conditional recodes of patient attributes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(col: Column, rules: Sequence[tuple[str, object]], otherwise: object) -> Column:
    """First regex that matches the lowered text decides."""
    text = F.lower(col)
    out = None
    for pattern, value in rules:
        hit = text.rlike(pattern)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def replace_values(col: Column, mapping: Mapping[str, str]) -> Column:
    """Whole-value replacement of synonyms; other values pass."""
    out = col
    for old, new in mapping.items():
        out = F.when(col == old, F.lit(new)).otherwise(out)
    return out


def binary_flag(col: Column, one: str, zero: str) -> Column:
    """1 / 0 for the two named values, null for anything else."""
    return F.when(col == one, 1).when(col == zero, 0)


def is_value(col: Column, value: str) -> Column:
    """1 for the value, 0 for all else including null."""
    return F.coalesce(F.when(col == value, 1).otherwise(0), F.lit(0))


def collapse_levels(col: Column, keep: Sequence[str], other: str) -> Column:
    """Levels outside `keep` (and null) become `other`."""
    return F.when(col.isin(list(keep)), col).otherwise(F.lit(other))


def cap_ordinal(col: Column, top: int, missing: int = 0) -> Column:
    """Values above `top` become `top`; null and negative become `missing`."""
    return F.when(col >= top, F.lit(top)).when(col >= 0, col).otherwise(F.lit(missing))
