"""Line filters, and the facets a filter form is filled with."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.functions.dates import month_label
from freightlens.functions.ordering import first_non_null
from freightlens.schema import MONTH_PARTITION

_SEPARATOR = " - "


def filter_lines(
    lines: DataFrame,
    start_date: str | date | None = None,
    end_date: str | date | None = None,
    countries: Sequence[str] | None = None,
    services: Sequence[str] | None = None,
    returns_only: bool = False,
) -> DataFrame:
    """Keep the lines that meet every given condition; a null never meets one.

    Packages are to be rolled up from what is left, so a charge line that does
    not carry the country or service itself falls out of its package's total. On
    a landed table, dates also name the months to read: those of the parsed dates,
    which Spark folds to constants before it lists the partitions.
    """
    by_month = MONTH_PARTITION in lines.columns
    if start_date:
        first = F.lit(str(start_date)).cast("date")
        lines = lines.filter(F.col("shipment_date") >= first)
        if by_month:
            lines = lines.filter(F.col(MONTH_PARTITION) >= month_label(first))
    if end_date:
        last = F.lit(str(end_date)).cast("date")
        lines = lines.filter(F.col("shipment_date") <= last)
        if by_month:
            lines = lines.filter(F.col(MONTH_PARTITION) <= month_label(last))
    if countries:
        lines = lines.filter(F.col("recipient_country").isin(*countries))
    if services:
        lines = lines.filter(F.col("service_code").isin(*services))
    if returns_only:
        lines = lines.filter(F.col("is_return"))
    return lines


def date_bounds(lines: DataFrame) -> DataFrame:
    return lines.agg(
        F.min("shipment_date").alias("min_date"), F.max("shipment_date").alias("max_date")
    )


def country_choices(lines: DataFrame) -> DataFrame:
    return (
        lines.filter(F.col("recipient_country").isNotNull())
        .select("recipient_country")
        .distinct()
        .orderBy("recipient_country")
    )


def service_choices(lines: DataFrame) -> DataFrame:
    """Codes with the service name of their first line, and a display label.

    For a first text Spark would sort all lines by code. Beside a collected set it keeps groups in
    a hash map instead, and sorts what comes after a task has met 128 codes.
    """
    named = (
        lines.filter(F.col("service_code").isNotNull())
        .groupBy("service_code")
        .agg(first_non_null("service_name").alias("service_name"), F.collect_set(F.lit(0)).alias("_hashed"))
    )
    return labelled(named.filter(F.size("_hashed") > 0).drop("_hashed"))


def labelled(services: DataFrame) -> DataFrame:
    """``service_code, service_name`` with a display label, in order of the codes."""
    name = F.coalesce("service_name", F.lit("Unknown"))
    return services.withColumn("label", F.concat_ws(_SEPARATOR, "service_code", name)).orderBy("service_code")


def code_of_label(label: Column) -> Column:
    """Back from a display label to the code."""
    return F.substring_index(label, _SEPARATOR, 1)
