"""Derived columns of a billing line."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.functions.dates import month_label
from freightlens.functions.text import lookup, trim_to_null
from freightlens.schema import CATEGORY_NAMES, OTHER, SERVICE_NAMES


def service_name(names: Mapping[str, str] = SERVICE_NAMES) -> Column:
    """The freight row's own description, else the name of the service code."""
    described = F.when(
        F.col("charge_category") == "FRT",
        F.when(
            trim_to_null(F.col("charge_description")).isNotNull(), F.col("charge_description")
        ),
    )
    return F.coalesce(described, lookup(F.col("service_code"), names), F.lit(OTHER))


def category_name() -> Column:
    return F.coalesce(lookup(F.col("charge_category"), CATEGORY_NAMES), F.lit(OTHER))


def is_package_line() -> Column:
    return F.coalesce(F.col("package_indicator") == "1", F.lit(False))


def is_return() -> Column:
    return F.coalesce(F.col("shipment_type") == "RTN", F.lit(False))


def add_derived(lines: DataFrame, service_names: Mapping[str, str] = SERVICE_NAMES) -> DataFrame:
    """Add the nine derived columns."""
    shipped = F.col("shipment_date")
    return lines.withColumns(
        {
            "total_charge": F.col("net_amount"),
            "service_name": service_name(service_names),
            "charge_category_name": category_name(),
            "is_package_line": is_package_line(),
            "is_return": is_return(),
            "weight_difference": F.col("billed_weight") - F.col("actual_weight"),
            "shipment_week": F.weekofyear(shipped),
            "shipment_month": month_label(shipped),
            "shipment_year_month": month_label(shipped),
        }
    )
