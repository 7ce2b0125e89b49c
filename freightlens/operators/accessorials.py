"""Accessorial charges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightlens.functions.dates import month_label
from freightlens.functions.numeric import ratio, ratio_or_zero, round2, total
from freightlens.functions.ordering import first_non_null
from freightlens.operators.countries import with_country_name
from freightlens.schema import AREA_CODES, RESIDENTIAL_CODES, SURGE_CODES


def accessorial_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("charge_category") == "ACC")


def accessorials_summary(lines: DataFrame) -> DataFrame:
    """One row, or none without accessorial charges."""
    code = F.col("charge_code")
    return (
        accessorial_lines(lines)
        .agg(
            total("net_amount").alias("total_cost"),
            F.count("*").alias("charge_count"),
            F.count_distinct("tracking_number").alias("shipment_count"),
            total("net_amount", code.isin(*RESIDENTIAL_CODES)).alias("residential_cost"),
            total("net_amount", code.isin(*SURGE_CODES)).alias("surge_cost"),
            total("net_amount", code.isin(*AREA_CODES)).alias("area_surcharge_cost"),
        )
        .filter(F.col("charge_count") > 0)
        .withColumn("avg_per_shipment", ratio_or_zero(F.col("total_cost"), F.col("shipment_count")))
    )


def accessorials_by_code(lines: DataFrame) -> DataFrame:
    """By code and description; lines that lack one of them are left out."""
    code, text = F.col("charge_code"), F.col("charge_description")
    return (
        accessorial_lines(lines)
        .filter(code.isNotNull() & text.isNotNull())
        .groupBy(code, text.alias("description"))
        .agg(
            total("net_amount").alias("total_cost"),
            F.count_distinct("tracking_number").alias("shipment_count"),
        )
        .orderBy(F.desc("total_cost"), "charge_code", "description")
    )


def tracking_country(lines: DataFrame) -> DataFrame:
    """Per parcel, the first country on any of its lines."""
    return (
        lines.filter(F.col("recipient_country").isNotNull() & F.col("tracking_number").isNotNull())
        .groupBy("tracking_number")
        .agg(first_non_null("recipient_country").alias("recipient_country"))
    )


def accessorials_by_parcel(lines: DataFrame) -> DataFrame:
    return (
        accessorial_lines(lines)
        .filter(F.col("tracking_number").isNotNull())
        .groupBy("tracking_number")
        .agg(F.sum("net_amount").alias("acc_cost"))
    )


def accessorials_with_country(lines: DataFrame) -> DataFrame:
    """Accessorial cost and country per parcel, in one pass and one shuffle."""
    accessorial = F.col("charge_category") == "ACC"
    return (
        lines.filter(
            F.col("tracking_number").isNotNull()
            & (accessorial | F.col("recipient_country").isNotNull())
        )
        .groupBy("tracking_number")
        .agg(
            F.sum(F.when(accessorial, F.col("net_amount"))).alias("acc_cost"),
            first_non_null("recipient_country").alias("recipient_country"),
            F.count_if(accessorial).alias("_n"),
        )
        .filter("_n > 0")
        .drop("_n")
    )


def accessorials_by_country(lines: DataFrame, countries: DataFrame) -> DataFrame:
    totals = (
        accessorials_with_country(lines)
        .filter(F.col("recipient_country").isNotNull())
        .groupBy(F.col("recipient_country").alias("country_code"))
        .agg(
            F.count("tracking_number").alias("shipment_count"),
            total("acc_cost").alias("total_cost"),
        )
    )
    return (
        with_country_name(totals, countries)
        .withColumn(
            "avg_per_shipment", round2(ratio(F.col("total_cost"), F.col("shipment_count")))
        )
        .orderBy(F.desc("total_cost"), "country_code")
    )


def accessorial_trends(lines: DataFrame) -> DataFrame:
    """By month of the dated lines."""
    return (
        accessorial_lines(lines)
        .filter(F.col("shipment_date").isNotNull())
        .groupBy(month_label(F.col("shipment_date")).alias("period"))
        .agg(
            total("net_amount").alias("total_cost"),
            F.count_distinct("tracking_number").alias("shipment_count"),
        )
        .orderBy("period")
    )
