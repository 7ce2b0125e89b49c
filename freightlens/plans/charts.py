"""The datasets behind the dashboard's charts and key figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.functions.numeric import count_text, grouped, percent, plain
from freightlens.functions.text import shorten
from freightlens.operators.costs import with_share
from freightlens.operators.countries import with_alpha3


def _share_text(part: str) -> Column:
    cost = F.col("total_cost")
    share = F.concat(plain(percent(F.col(part), cost), 1), F.lit("%"))
    return F.when(cost > 0, share).otherwise("0%")


def kpi_cards(summary: DataFrame) -> DataFrame:
    """Key figures as display text."""
    unit = F.col("currency")
    return summary.select(
        F.concat_ws(" ", grouped(F.col("total_cost")), unit).alias("total_cost"),
        count_text(F.col("total_packages")).alias("total_packages"),
        F.concat_ws(" ", grouped(F.col("avg_cost_per_package")), unit).alias("avg_cost"),
        F.concat(grouped(F.col("total_weight_kg"), 1), F.lit(" kg")).alias("total_weight"),
        F.concat(plain(F.col("return_rate"), 1), F.lit("%")).alias("return_rate"),
        F.col("total_invoices").cast("string").alias("total_invoices"),
        _share_text("total_freight").alias("freight_pct"),
        _share_text("total_fuel_surcharge").alias("fuel_pct"),
    )


def cost_pie(breakdown: DataFrame) -> DataFrame:
    return breakdown.select("charge_category_name", "total_charge", "percentage")


def cost_bars(breakdown: DataFrame) -> DataFrame:
    return breakdown.select("charge_category_name", "total_charge")


def map_points(destinations: DataFrame, countries: DataFrame) -> DataFrame:
    """Destinations that can be placed on a map."""
    return with_alpha3(destinations, countries)


def top_destinations(destinations: DataFrame, n: int = 15) -> DataFrame:
    ranked = destinations.orderBy(F.desc("total_cost"), "country_code")
    return ranked.limit(n).select("country_name", "country_code", "total_cost", "package_count")


def trend_series(trends: DataFrame) -> DataFrame:
    return trends.select("period", "total_cost", "package_count")


def return_reasons_top(by_reason: DataFrame, n: int = 15) -> DataFrame:
    return (
        by_reason.orderBy(F.desc("count"), "reason")
        .limit(n)
        .withColumn("reason_short", shorten(F.col("reason"), 40, "..."))
    )


def weight_bars(distribution: DataFrame) -> DataFrame:
    return distribution.select("weight_range", "package_count", "total_cost")


def service_compare(by_service: DataFrame) -> DataFrame:
    return by_service.select("service_name", "total_cost", "avg_cost_per_package")


def duties_pie(by_charge_type: DataFrame) -> DataFrame:
    return with_share(by_charge_type.select("charge_name", "total_cost"), "total_cost")


def duties_top_countries(by_country: DataFrame, n: int = 15) -> DataFrame:
    ranked = by_country.orderBy(F.desc("total_cost"), "country_code")
    return ranked.limit(n).select("country_name", "country_code", "total_cost", "shipment_count")


def accessorial_bars(by_code: DataFrame, n: int = 15) -> DataFrame:
    """Top charges labelled ``code - description``."""
    label = F.concat_ws(" - ", "charge_code", shorten(F.col("description"), 30))
    ranked = by_code.orderBy(F.desc("total_cost"), "charge_code", "description")
    return ranked.limit(n).withColumn("label", label)


def accessorial_top_countries(by_country: DataFrame, n: int = 15) -> DataFrame:
    ranked = by_country.orderBy(F.desc("total_cost"), "country_code")
    return ranked.limit(n).select("country_name", "country_code", "total_cost", "shipment_count")


def accessorial_trend_series(trends: DataFrame) -> DataFrame:
    return trends.select("period", "total_cost", "shipment_count")
