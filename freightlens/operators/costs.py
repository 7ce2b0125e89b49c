"""Costs by charge category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.functions.numeric import percent, round2, total

_KEYS = ("charge_category", "charge_category_name")


def _by_category(lines: DataFrame, *more: Column) -> DataFrame:
    return (
        lines.filter(F.col("charge_category").isNotNull())
        .groupBy(*_KEYS)
        .agg(
            total("discount_amount").alias("discount_amount"),
            total("net_amount").alias("net_amount"),
            total("total_charge").alias("total_charge"),
            *more,
        )
    )


def category_totals(lines: DataFrame) -> DataFrame:
    return _by_category(lines)


def with_share(df: DataFrame, value: str, share: str = "percentage") -> DataFrame:
    """Add the share of ``value`` in its grand total, in percent to two decimals.

    The total is an aggregate of one row, joined back. It reads the same grouped
    rows, whose shuffle Spark reuses, so the lines are not read again.
    """
    exact = F.sum(F.col(value).cast("decimal(38,4)")).cast("double")
    whole = df.agg(exact.alias("_whole"))
    shared = df.crossJoin(whole).withColumn(share, round2(percent(F.col(value), F.col("_whole"))))
    return shared.drop("_whole")


def cost_breakdown(lines: DataFrame) -> DataFrame:
    """Sums by category with their share of the whole, largest first."""
    shares = with_share(category_totals(lines), "total_charge")
    return shares.orderBy(F.desc("total_charge"), *_KEYS)


def charge_breakdown(lines: DataFrame) -> DataFrame:
    """Sums by category with the number of parcels that have such a charge."""
    parcels = F.count_distinct("tracking_number").alias("package_count")
    return _by_category(lines, parcels).orderBy(F.desc("total_charge"), *_KEYS)
