"""The one-row summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightlens.functions.dates import day_text
from freightlens.functions.numeric import ratio_or_zero, total
from freightlens.functions.ordering import first_non_null
from freightlens.schema import DEFAULT_CURRENCY


def line_totals(lines: DataFrame) -> DataFrame:
    """Invoices, category totals and date range over all lines.

    Lines are summed by invoice first, those without one in a group of their own, so
    that counting invoices needs no second copy of each line.
    """
    category = F.col("charge_category")
    sums = {"freight": "FRT", "fuel_surcharge": "FSC", "tax": "TAX", "accessorial": "ACC"}
    by_invoice = lines.groupBy("invoice_number").agg(
        *[F.sum(F.when(category == code, F.col("total_charge"))).alias(n) for n, code in sums.items()],
        F.min("shipment_date").alias("first_date"),
        F.max("shipment_date").alias("last_date"),
    )
    return by_invoice.agg(
        F.count("invoice_number").alias("total_invoices"),
        *[total(n).alias(f"total_{n}") for n in sums],
        day_text(F.min("first_date")).alias("date_from"),
        day_text(F.max("last_date")).alias("date_to"),
    )


def currency(lines: DataFrame) -> DataFrame:
    """Currency of the first line that has one.

    Kept apart from the distinct count, whose hash aggregation a text result
    would turn into a sort of all lines.
    """
    return lines.agg(
        F.coalesce(first_non_null("currency"), F.lit(DEFAULT_CURRENCY)).alias("currency")
    )


def package_totals(pkgs: DataFrame) -> DataFrame:
    """Package figures and the top destination, through one rollup by country.

    The most frequent country wins; of equals, the one with the smallest
    tracking number.
    """
    country = F.col("recipient_country")
    by_country = pkgs.groupBy("recipient_country").agg(
        F.count("*").alias("n"),
        F.sum("total_charge").alias("cost"),
        F.sum("billed_weight").alias("weight"),
        F.count_if("is_return").alias("returns"),
        F.min("tracking_number").alias("first_number"),
    )
    n = F.coalesce(F.sum("n"), F.lit(0).cast("long"))
    rank = F.struct(-F.col("n"), F.col("first_number"))
    return by_country.agg(
        n.alias("total_packages"),
        total("cost").alias("total_cost"),
        ratio_or_zero(F.sum("cost"), n).alias("avg_cost_per_package"),
        total("weight").alias("total_weight_kg"),
        F.min_by(country, F.when(country.isNotNull(), rank)).alias("top_destination_country"),
        (ratio_or_zero(F.sum("returns"), n) * 100).alias("return_rate"),
    )


def summary(lines: DataFrame, pkgs: DataFrame) -> DataFrame:
    """All figures as one row; an empty table gives zeros, nulls and the default currency."""
    one_row = line_totals(lines).crossJoin(package_totals(pkgs)).crossJoin(currency(lines))
    return one_row.select(
        "total_invoices",
        "total_packages",
        "total_cost",
        "total_freight",
        "total_fuel_surcharge",
        "total_tax",
        "total_accessorial",
        "avg_cost_per_package",
        "total_weight_kg",
        "date_from",
        "date_to",
        "top_destination_country",
        "return_rate",
        "currency",
    )
