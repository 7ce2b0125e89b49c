"""Date parsing and period labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_DATE = ("yyyy-MM-dd",)


def parse_date(c: Column, formats: Sequence[str] = ISO_DATE) -> Column:
    """First format that fits, else null."""
    return F.coalesce(*[F.try_to_date(c, f) for f in formats])


def is_bad_date(c: Column, formats: Sequence[str] = ISO_DATE) -> Column:
    """A text is there but fits none of the formats."""
    return c.isNotNull() & parse_date(c, formats).isNull()


def month_label(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def week_label(d: Column) -> Column:
    """``2025-W03``: weeks start on Monday, week 00 is what precedes the first Monday.

    This is not the ISO week.
    """
    week = F.floor((F.dayofyear(d) + 6 - F.weekday(d)) / 7).cast("int")
    return F.concat(F.date_format(d, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def day_text(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def period_label(d: Column, period: str = "week") -> Column:
    """Week labels for ``week``; every other period means month."""
    return week_label(d) if period == "week" else month_label(d)
