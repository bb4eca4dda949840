"""Date functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The label used for the oldest birth years, and the year it stands for.
OLDEST_BIRTH_LABEL = "1935 and Earlier"
OLDEST_BIRTH_YEAR = 1935


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def within_days(event: Column, anchor: Column, before: int, after: int) -> Column:
    """event in [anchor - before, anchor + after], written so both ends are plain comparisons."""
    return event.between(F.date_sub(anchor, before), F.date_add(anchor, after))


def age_at(index_date: Column, birth_year: Column) -> Column:
    """Whole years by calendar year; birth year is text with a floor label."""
    year = F.when(birth_year == OLDEST_BIRTH_LABEL, F.lit(OLDEST_BIRTH_YEAR)).otherwise(
        birth_year.try_cast("int")
    )
    return F.year(index_date) - year


def parse_day(text: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """Text to date, null when it does not parse."""
    return F.to_date(F.try_to_timestamp(text, F.lit(pattern)))
