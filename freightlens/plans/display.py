"""Display tables: the columns shown to a reader, renamed and formatted as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.functions.dates import day_text
from freightlens.functions.numeric import count_text, grouped, plain

Format = Callable[[Column], Column]


def money(c: Column) -> Column:
    return grouped(c, 2)


def tenths(c: Column) -> Column:
    return grouped(c, 1)


def plain_tenths(c: Column) -> Column:
    return plain(c, 1)


def percent_text(c: Column) -> Column:
    return F.concat(plain(c, 1), F.lit("%"))


def as_is(c: Column) -> Column:
    return c


def show(df: DataFrame, columns: dict[str, tuple[str, Format]]) -> DataFrame:
    """``heading -> (column, format)``."""
    return df.select([fmt(F.col(c)).alias(heading) for heading, (c, fmt) in columns.items()])


def cost_table(breakdown: DataFrame) -> DataFrame:
    return show(
        breakdown,
        {
            "Charge Type": ("charge_category_name", as_is),
            "Discount": ("discount_amount", money),
            "Net Amount": ("net_amount", money),
            "Total": ("total_charge", money),
            "% of Total": ("percentage", percent_text),
        },
    )


def destination_table(destinations: DataFrame) -> DataFrame:
    return show(
        destinations,
        {
            "Country": ("country_name", as_is),
            "Code": ("country_code", as_is),
            "Packages": ("package_count", count_text),
            "Total Cost": ("total_cost", money),
            "Avg Cost": ("avg_cost_per_package", money),
            "Weight (kg)": ("total_weight", tenths),
            "Return %": ("return_rate", percent_text),
        },
    )


def trend_table(trends: DataFrame) -> DataFrame:
    return show(
        trends,
        {
            "Period": ("period", as_is),
            "Packages": ("package_count", count_text),
            "Total Cost": ("total_cost", money),
            "Weight (kg)": ("total_weight", tenths),
            "Avg Cost/Pkg": ("avg_cost_per_package", money),
        },
    )


def returns_country_table(by_country: DataFrame) -> DataFrame:
    return show(
        by_country,
        {
            "country_code": ("country_code", as_is),
            "return_count": ("return_count", count_text),
            "return_cost": ("return_cost", money),
            "country_name": ("country_name", as_is),
        },
    )


def service_table(by_service: DataFrame) -> DataFrame:
    return show(
        by_service,
        {
            "Service": ("service_name", as_is),
            "Code": ("service_code", as_is),
            "Packages": ("package_count", count_text),
            "Total Cost": ("total_cost", money),
            "Avg Cost": ("avg_cost_per_package", money),
            "Weight (kg)": ("total_weight", tenths),
        },
    )


def duties_table(detail: DataFrame) -> DataFrame:
    return show(
        detail,
        {
            "Tracking #": ("tracking_number", as_is),
            "Country": ("country", as_is),
            "Recipient": ("recipient", as_is),
            "City": ("city", as_is),
            "Order Ref": ("order_reference", as_is),
            "Date": ("shipment_date", day_text),
            "Total": ("total_cost", money),
            "Brokerage": ("BRK", money),
            "Customs": ("GOV", money),
        },
    )


def accessorial_table(by_code: DataFrame) -> DataFrame:
    return show(
        by_code,
        {
            "Code": ("charge_code", as_is),
            "Description": ("description", as_is),
            "Total Cost": ("total_cost", money),
            "Shipments": ("shipment_count", count_text),
        },
    )


def top_expense_table(top: DataFrame, currency: DataFrame) -> DataFrame:
    """``currency`` is its table of one row; a heading cannot depend on the data without a job."""
    return show(
        top.crossJoin(currency),
        {
            "Tracking #": ("tracking_number", as_is),
            "Reference": ("order_reference", as_is),
            "Date": ("shipment_date", day_text),
            "Recipient": ("recipient_name", as_is),
            "City": ("recipient_city", as_is),
            "Country": ("recipient_country", as_is),
            "Service": ("service_name", as_is),
            "Weight (kg)": ("billed_weight", plain_tenths),
            "Cost": ("total_charge", money),
            "Currency": ("currency", as_is),
            "Return?": ("is_return", as_is),
        },
    )


# --- one-row metric strips -----------------------------------------------------


def returns_metrics(returns_summary: DataFrame) -> DataFrame:
    return show(
        returns_summary,
        {
            "Total Returns": ("total_returns", count_text),
            "Return Cost": ("total_return_cost", money),
            "Return Rate": ("return_rate", percent_text),
            "Avg Return Cost": ("avg_return_cost", money),
        },
    )


def _kg(c: Column) -> Column:
    return F.concat(tenths(c), F.lit(" kg"))


def weights_metrics(weights_summary: DataFrame) -> DataFrame:
    return show(
        weights_summary,
        {
            "Total Actual Weight": ("total_actual_weight", _kg),
            "Total Billed Weight": ("total_billed_weight", _kg),
            "Dim Weight Premium": ("weight_premium", percent_text),
            "Pkgs w/ Dim Weight": ("packages_with_dim_weight", count_text),
        },
    )


def _in_currency(c: Column) -> Column:
    return F.concat_ws(" ", money(c), F.col("currency"))


def duties_metrics(duties_summary: DataFrame, currency: DataFrame) -> DataFrame:
    return show(
        duties_summary.crossJoin(currency),
        {
            "Total Import Costs": ("total_cost", _in_currency),
            "Shipments": ("shipment_count", count_text),
            "Brokerage Fees": ("brokerage_cost", _in_currency),
            "Customs Duties": ("customs_cost", _in_currency),
            "Avg/Shipment": ("avg_cost_per_shipment", _in_currency),
        },
    )


def accessorials_metrics(accessorials_summary: DataFrame, currency: DataFrame) -> DataFrame:
    return show(
        accessorials_summary.crossJoin(currency),
        {
            "Total Accessorials": ("total_cost", _in_currency),
            "Shipments Affected": ("shipment_count", count_text),
            "Residential Fees": ("residential_cost", _in_currency),
            "Surge Fees": ("surge_cost", _in_currency),
            "Area Surcharges": ("area_surcharge_cost", _in_currency),
        },
    )
