"""Package rollup: one row per tracking number.

The shipment attributes come from the freight package rows only, about one line
in four, and the charges from all lines. So the wide, string-carrying aggregation
sees only the rows it needs, the charges go through a code-generated hash
aggregation, and the two meet on the tracking number by which both are already
partitioned. Columns that a later operator does not read drop out of both.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.functions.ordering import first_non_null
from freightlens.schema import PACKAGE_ATTRIBUTES

_ORDER = "line_ord"
CHARGES = ("discount_amount", "net_amount", "total_charge")


def _is_freight() -> Column:
    return F.coalesce(
        (F.col("package_indicator") == "1") & (F.col("charge_category") == "FRT"), F.lit(False)
    )


def freight_rows(lines: DataFrame) -> DataFrame:
    """The preferred base rows: freight lines of a package."""
    return lines.filter((F.col("package_indicator") == "1") & (F.col("charge_category") == "FRT"))


def has_freight(lines: DataFrame) -> Column:
    """True if the table has any freight package row, as an uncorrelated EXISTS.

    Spark runs it once as a LIMIT 1 probe, which ends at the first such row.
    """
    return freight_rows(lines).select("package_indicator").exists()


def _is_base(lines: DataFrame) -> Column:
    """Freight package rows; all package rows if the whole table has no freight one."""
    freight = F.col("charge_category") == "FRT"
    return (F.col("package_indicator") == "1") & (
        F.coalesce(freight, F.lit(False)) | ~has_freight(lines)
    )


def base_rows(lines: DataFrame) -> DataFrame:
    """The rows that packages take their attributes from."""
    return lines.filter(_is_base(lines))


def tracked(lines: DataFrame) -> DataFrame:
    """Service fees have no tracking number and belong to no package."""
    return lines.filter(F.col("tracking_number").isNotNull())


def _described(base: DataFrame) -> DataFrame:
    freight = _is_freight()
    return base.withColumns(
        {
            "service_name": F.when(freight, F.col("charge_description")).otherwise(
                F.col("service_name")
            ),
            "charge_description": F.when(freight, F.col("charge_description")),
        }
    )


def attributes(base: DataFrame, *known: str) -> DataFrame:
    """Per tracking number, the first non-null value of each attribute column.

    ``known`` names columns that are the same on all rows of a number, to be kept.

    ``service_name`` is the freight row's description, null where that is null.
    In a table without freight rows it is the name derived for the line, and
    ``charge_description`` is null.
    """
    names = (*PACKAGE_ATTRIBUTES, "charge_description", "service_name")
    return (
        tracked(_described(base))
        .groupBy("tracking_number", *known)
        .agg(*[first_non_null(n).alias(n) for n in names])
    )


# Attributes that a freight row mostly has, in two groups: those of nearly every row, and what some rows lack. Any
# other row is read right as well, only its attributes carry an order each.
_TOGETHER = (
    (
        "invoice_number",
        "invoice_date",
        "order_reference",
        "actual_weight",
        "billed_weight",
        "sender_name",
        "sender_country",
        "recipient_name",
        "recipient_country",
        "shipment_type",
        "shipment_subtype",
        "goods_description",
        "is_return",
        "source_file",
    ),
    ("shipment_date", "service_code", "charge_description", "service_name"),
)


def whole_attributes(base: DataFrame) -> DataFrame:
    """As ``attributes``, for what reads all of them.

    Rows that have all attributes of a group carry one order for them through the shuffle, not one for each
    attribute. An attribute's first value is the earlier one of those rows' and the other rows'.
    """
    described, ordered = tracked(_described(base)), F.col(_ORDER).isNotNull()
    aggregates = {}
    for i, group in enumerate(_TOGETHER):
        full = reduce(and_, (F.col(n).isNotNull() for n in group))
        aggregates[f"_group{i}"] = F.min(F.when(ordered & full, F.struct(_ORDER, *group)))
        for n in group:
            aggregates[f"_{n}"] = F.min(F.when(ordered & ~full & F.col(n).isNotNull(), F.struct(_ORDER, F.col(n))))
    grouped = {n: f"_group{i}" for i, group in enumerate(_TOGETHER) for n in group}
    names = (*PACKAGE_ATTRIBUTES, "charge_description", "service_name")
    alone = [n for n in names if n not in grouped]
    found = described.groupBy("tracking_number").agg(
        *[c.alias(n) for n, c in aggregates.items()], *[first_non_null(n).alias(n) for n in alone]
    )

    def first(n: str) -> Column:
        rest, group = F.col(f"_{n}"), F.col(grouped[n])
        earlier = rest.isNull() | (group[_ORDER] <= rest[_ORDER])
        return F.when(group.isNotNull() & earlier, group[n]).otherwise(rest[n])

    return found.select("tracking_number", *[F.col(n) if n in alone else first(n).alias(n) for n in names])


def charge_totals(lines: DataFrame) -> DataFrame:
    """Per tracking number, the charges summed over all its lines."""
    return (
        tracked(lines)
        .groupBy("tracking_number")
        .agg(*[F.sum(c).alias(c) for c in CHARGES])
    )


def packages(lines: DataFrame, whole: bool = False) -> DataFrame:
    """One row per tracking number that has a base row. Amounts stay exact decimals.

    ``whole`` is for readers of all attributes; without it those that are not read drop out.
    """
    made = whole_attributes if whole else attributes
    return made(base_rows(lines)).join(charge_totals(lines), "tracking_number", "left")


def package_sums(lines: DataFrame) -> DataFrame:
    """``tracking_number, total_charge`` of each package, without its attributes."""
    return (
        tracked(lines)
        .withColumn("_base", _is_base(lines))
        .groupBy("tracking_number")
        .agg(F.sum("total_charge").alias("total_charge"), F.bool_or("_base").alias("_base"))
        .filter("_base")
        .drop("_base")
    )


def as_doubles(df: DataFrame) -> DataFrame:
    """Decimal columns as doubles, for results."""
    return df.select(
        [
            F.col(n).cast("double").alias(n) if t.startswith("decimal") else F.col(n)
            for n, t in df.dtypes
        ]
    )
