"""String functions: alternation patterns, safe keys, interval and number text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what counts as a number when it arrives as text.
NUMBER_TEXT = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def alternation_from_table(terms: DataFrame, term: str, end_anchored: Iterable[str] = ()) -> DataFrame:
    """One-row frame with the pattern of a term dictionary (a dictionary, not an event column)."""
    ends = list(end_anchored)
    t = F.col(term)
    piece = F.when(t.isin(ends), F.concat(t, F.lit("$"))).otherwise(t) if ends else t
    return terms.select(piece.alias("piece")).distinct().agg(
        F.concat(F.lit("("), F.array_join(F.sort_array(F.collect_list("piece")), "|"), F.lit(")")).alias("pattern")
    )


def path_safe(col: Column) -> Column:
    """A name usable as a folder: slashes become dashes."""
    return F.translate(col, "/", "-")


def parse_number(col: Column) -> Column:
    """Double for number text, null for everything else (units, `5d`, nan, inf)."""
    return F.when(col.rlike(NUMBER_TEXT), F.trim(col).try_cast("double"))


def interval_bounds(col: Column) -> Column:
    """`[lo hi]` or `[lo, hi]` to struct(lo, hi)."""
    parts = F.split(F.trim(F.regexp_replace(col, r"[\[\]]", "")), r"[ ,]+")
    return F.struct(
        F.try_element_at(parts, F.lit(1)).try_cast("double").alias("lo"),
        F.try_element_at(parts, F.lit(2)).try_cast("double").alias("hi"),
    )


def interval_text(lo: Column, hi: Column, digits: int = 3) -> Column:
    """`[lo, hi]` with fixed digits."""
    return F.format_string(f"[%.{digits}f, %.{digits}f]", lo, hi)


def count_percent(n: Column, total: Column, digits: int = 2) -> Column:
    """`n (p%)` with the percentage rounded to `digits`."""
    share = F.round(n.cast("double") / total.cast("double") * 100, digits)
    return F.concat(n.cast("string"), F.lit(" ("), share.cast("string"), F.lit("%)"))


def p_value_text(p: Column, floor: float = 0.0001) -> Column:
    """p-values under the floor shown as `<floor`, others with four digits."""
    return F.when(p < floor, F.lit(f"<{floor:.4f}")).otherwise(F.format_string("%.4f", p))
