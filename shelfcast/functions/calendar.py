"""Calendar features of a date column (Monday = 0, ISO week)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of_week(d: Column) -> Column:
    """0 = Monday … 6 = Sunday (``weekday``, not ``dayofweek``)."""
    return F.weekday(d)


def week_of_year(d: Column) -> Column:
    """ISO-8601 week number (2024-12-30 is week 1)."""
    return F.weekofyear(d)


def is_weekend(d: Column) -> Column:
    return (F.weekday(d) >= 5).cast("int")


def date_text(d: Column) -> Column:
    """The date as ``yyyy-MM-dd``."""
    return F.date_format(d, "yyyy-MM-dd")


def calendar_columns(d: Column) -> list[Column]:
    return [
        day_of_week(d).alias("day_of_week"),
        week_of_year(d).alias("week_of_year"),
        F.month(d).alias("month"),
        is_weekend(d).alias("is_weekend"),
    ]
