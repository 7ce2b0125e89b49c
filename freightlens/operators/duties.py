"""Import duties and brokerage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.functions.numeric import ratio, ratio_or_zero, round2, total
from freightlens.functions.ordering import first_non_null
from freightlens.operators.countries import with_country_name
from freightlens.schema import AMOUNT, CATEGORY_NAMES


def import_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("shipment_subtype") == "IMP")


def duties_summary(lines: DataFrame) -> DataFrame:
    """One row, or none without imports. Lines without a number count as one shipment."""
    category, number = F.col("charge_category"), F.col("tracking_number")
    shipments = F.count_distinct(number) + F.max(number.isNull().cast("int"))
    return (
        import_lines(lines)
        .agg(
            F.count("*").alias("_n"),
            total("net_amount").alias("total_cost"),
            shipments.alias("shipment_count"),
            total("net_amount", category == "BRK").alias("brokerage_cost"),
            total("net_amount", category == "GOV").alias("customs_cost"),
            total("net_amount", ~F.coalesce(category.isin("BRK", "GOV"), F.lit(False))).alias(
                "other_cost"
            ),
        )
        .filter("_n > 0")
        .drop("_n")
        .withColumn(
            "avg_cost_per_shipment", ratio_or_zero(F.col("total_cost"), F.col("shipment_count"))
        )
    )


def duties_by_charge_type(lines: DataFrame) -> DataFrame:
    return (
        import_lines(lines)
        .filter(F.col("charge_category").isNotNull())
        .groupBy("charge_category", F.col("charge_category_name").alias("charge_name"))
        .agg(
            total("net_amount").alias("total_cost"),
            F.count_distinct("tracking_number").alias("shipment_count"),
        )
        .orderBy(F.desc("total_cost"), "charge_category", "charge_name")
    )


def duties_shipments(lines: DataFrame) -> DataFrame:
    """Per imported parcel: its first known attributes, its cost, and the BRK and GOV parts.

    The parts are conditional sums of the same aggregation, so no pivot and no
    join back are needed for them.
    """
    category = F.col("charge_category")
    first = ("recipient_country", "recipient_name", "recipient_city", "order_reference")
    zero = F.lit(0).cast(AMOUNT)

    def part(code: str) -> Column:
        return F.coalesce(F.sum(F.when(category == code, F.col("net_amount"))), zero)

    return (
        import_lines(lines)
        .filter(F.col("tracking_number").isNotNull())
        .groupBy("tracking_number")
        .agg(
            *[first_non_null(c).alias(c) for c in (*first, "shipment_date")],
            F.sum("net_amount").alias("net_amount"),
            part("BRK").alias("BRK"),
            part("GOV").alias("GOV"),
        )
    )


def duties_by_country(lines: DataFrame, countries: DataFrame) -> DataFrame:
    totals = (
        duties_shipments(lines)
        .filter(F.col("recipient_country").isNotNull())
        .groupBy(F.col("recipient_country").alias("country_code"))
        .agg(
            F.count("tracking_number").alias("shipment_count"),
            total("net_amount").alias("total_cost"),
        )
    )
    return (
        with_country_name(totals, countries)
        .withColumn(
            "avg_cost_per_shipment",
            round2(ratio(F.col("total_cost"), F.col("shipment_count"))),
        )
        .orderBy(F.desc("total_cost"), "country_code")
    )


def duties_pivot(
    lines: DataFrame, categories: Sequence[str] = tuple(sorted(CATEGORY_NAMES))
) -> DataFrame:
    """Parcel by charge category, 0 where a parcel has no such charge.

    The columns are fixed, so no job has to find out the categories first; what is
    in none of them goes to ``OTHER``.
    """
    category = F.col("charge_category")
    known = F.when(category.isin(*categories), category).otherwise("OTHER")
    return (
        import_lines(lines)
        .filter(F.col("tracking_number").isNotNull() & category.isNotNull())
        .withColumn("_category", known)
        .groupBy("tracking_number")
        .pivot("_category", [*categories, "OTHER"])
        .agg(F.sum("net_amount").cast("double"))
        .na.fill(0.0)
    )


def duties_detail(lines: DataFrame) -> DataFrame:
    """The imported parcels, costliest first."""
    return (
        duties_shipments(lines)
        .select(
            "tracking_number",
            F.col("recipient_country").alias("country"),
            F.col("recipient_name").alias("recipient"),
            F.col("recipient_city").alias("city"),
            "order_reference",
            "shipment_date",
            F.col("net_amount").cast("double").alias("total_cost"),
            F.col("BRK").cast("double").alias("BRK"),
            F.col("GOV").cast("double").alias("GOV"),
        )
        .orderBy(F.desc("total_cost"), "tracking_number")
    )
