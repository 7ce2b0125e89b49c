"""Exact money sums, half-even rounding and guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(c: Column | str, where: Column | None = None) -> Column:
    """Exact sum as a double, 0 when nothing was summed."""
    c = F.col(c) if isinstance(c, str) else c
    if where is not None:
        c = F.when(where, c)
    return F.coalesce(F.sum(c).cast("double"), F.lit(0.0))


def round2(c: Column) -> Column:
    """Round to cents, ties to even on the scaled value."""
    return F.rint(c * 100) / 100


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as a double; null when the denominator is 0 or null."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(ratio(num, den), F.lit(0.0))


def percent(num: Column, den: Column) -> Column:
    return ratio(num, den) * 100


def grouped(c: Column, decimals: int = 2) -> Column:
    """``12,345.67`` style text: thousands commas, ties to even."""
    return F.format_number(c.cast("double"), decimals)


def plain(c: Column, decimals: int = 1) -> Column:
    """Like :func:`grouped` without the thousands commas."""
    return F.replace(grouped(c, decimals), F.lit(","), F.lit(""))


def count_text(c: Column) -> Column:
    """A count with thousands commas."""
    return F.format_number(c.cast("long"), 0)
