"""Order-dependent picks that survive a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_non_null(value: str, where: Column | None = None, order: str = "line_ord") -> Column:
    """First non-null ``value`` in line order, optionally among the rows of ``where``.

    ``min_by`` skips rows whose ordering is null and combines map-side, so a key
    that holds a large part of the table costs each task one row, and the answer
    does not depend on the partitioning as that of ``first`` would.
    """
    present = F.col(value).isNotNull()
    if where is not None:
        present = present & where
    return F.min_by(F.col(value), F.when(present, F.col(order)))
