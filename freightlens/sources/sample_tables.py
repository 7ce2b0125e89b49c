"""Billing lines made out of an order/lineitem star schema.

Every lineitem is a parcel row, every charge that applies to it becomes one
billing line. One shuffle join (lineitem with orders, after one with parts where
they are too many to broadcast) and dimension joins; the
charges come from an array that is made and exploded in place, so no row is
shuffled for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freightlens.operators.derive import add_derived
from freightlens.schema import AMOUNT, POSITIONS, TRIMMED_FIELDS
from freightlens.session import landed

# Ship rows of one order in a fixed order: it repeats (order, line number) pairs. A row's place among
# them is one number, as each first value of a package carries its order through the shuffle.
_ROW_ORDER = (
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_shipdate",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
)

# What the lines are made of, as they are shuffled and written: no column that no line reads, numbers and days
# as narrow as the lines have them.
_USED = (
    "l_orderkey",
    "l_linenumber",
    "place",
    "l_quantity",
    "price",
    "off",
    "tax",
    "l_returnflag",
    "shipped",
    "trade",
    "o_custkey",
    "ordered",
    "o_orderpriority",
    "c_name",
    "c_mktsegment",
    "customer_country",
    "s_name",
    "supplier_country",
    "p_type",
    "p_size",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(c: str, precision: int, scale: int) -> Column:
    return F.col(c).cast(f"decimal({precision},{scale})")


def _lit(value: str, precision: int, scale: int) -> Column:
    return F.lit(value).cast(f"decimal({precision},{scale})")


# Every item meets its supplier. Up to so many of them (some 100 MB) are sent to the executors whatever the session's
# broadcast threshold, as a shuffle of all items by supplier moves far more; beyond it Spark chooses.
SENT_SUPPLIERS = 1_000_000


def _sent(side: DataFrame) -> DataFrame | None:
    return F.broadcast(side) if side.count() <= SENT_SUPPLIERS else None


def parcels(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """The parcel rows that lines are made of; ``spread`` by the month of their lines.

    Names of nations and suppliers are then looked up behind that shuffle, which moves their keys only.
    """
    nation = table(spark, sf_dir, "nation")
    home = nation.select(
        F.col("n_nationkey").alias("c_nationkey"),
        F.col("n_name").alias("customer_country"),
        F.col("n_regionkey").alias("customer_region"),
    )
    away = nation.select(
        F.col("n_nationkey").alias("s_nationkey"),
        F.col("n_name").alias("supplier_country"),
        F.col("n_regionkey").alias("supplier_region"),
    )
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    few, near, far = _sent(supplier), _sent(home), _sent(away)
    late = spread and None not in (few, near, far)
    if late:
        home, away = near, far
    supplier = supplier if few is None else few
    part = table(spark, sf_dir, "part")
    # Customers meet the orders, not the four times as many items. Nations come last: Spark takes the
    # size of a join for the product of its sides, and would shuffle the items for a supplier with its nation.
    orders = (
        table(spark, sf_dir, "orders")
        .withColumn("ordered", F.col("o_orderdate").cast("date"))
        .drop("o_orderdate")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
    )
    if not late:
        orders = orders.join(home, "c_nationkey")
    # Parts come first, so that where they are too many to broadcast it is the bare items that are shuffled by part,
    # and what follows is by order: a later shuffle of the joined rows would move twice as much and part the lines of
    # a parcel and of an invoice. Items without a part count for the places of others, so they leave after those.
    parts = part.select("p_partkey", "p_type", "p_size", F.lit(True).alias("has_part"))
    item = table(spark, sf_dir, "lineitem").filter("l_orderkey is not null")
    item = item.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left").drop("p_partkey")
    # The join with orders needs this shuffle anyway; asked for here, the wide work
    # behind it is spread over all tasks, whatever the file's row groups are.
    item = item.repartition("l_orderkey")
    in_order = Window.partitionBy("l_orderkey").orderBy(*_ROW_ORDER[1:])
    rows = (
        item.withColumn("place", F.dense_rank().over(in_order))
        .filter("has_part")
        .withColumns(
            {
                "price": _money("l_extendedprice", 18, 2),
                "off": _money("l_discount", 4, 2),
                "tax": _money("l_tax", 4, 2),
                "shipped": _shipped(),
            }
        )
        .drop("l_extendedprice", "l_discount", "l_tax", "l_shipdate")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    )
    if late:
        rows = by_month(rows.select(*[c for c in _USED if c in rows.columns], "l_suppkey", "c_nationkey"))
        rows = rows.join(home, "c_nationkey")
    rows = rows.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(away, "s_nationkey")
    rows = rows.withColumn("trade", _trade()).select(*_USED)
    return by_month(rows) if spread and not late else rows


# The charge kinds in the order of a shipment's lines.
KINDS = ("FRT", "FSC", "TAX", "ACC", "BRK", "GOV", "MSC", "ZZZ")


def _kinds() -> Column:
    """The kinds of charge that a shipment has, with their place among all kinds, in that order.

    Short arrays put together, as a filter of one array would be interpreted for each of its kinds.
    """

    def of(*kinds: str) -> Column:
        return F.array(*[F.struct(F.lit(KINDS.index(k)).alias("kn"), F.lit(k).alias("kind")) for k in kinds])

    late = (F.col("l_linenumber") == 5) & (F.col("l_returnflag") == "N")
    charged = (
        (("TAX",), F.col("tax") > 0),
        (("ACC",), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "5-LOW")),
        (("BRK", "GOV"), F.col("trade") == "IMP"),
        (("MSC",), F.col("l_linenumber") == 7),
        (("ZZZ",), late),
    )
    none = F.slice(of("FRT"), 1, 0)
    return F.concat(of("FRT", "FSC"), *[F.when(applies, of(*kinds)).otherwise(none) for kinds, applies in charged])


def _trade() -> Column:
    """RTS for returns, else by border and part size."""
    return (
        F.when(F.col("l_returnflag") == "R", "RTS")
        .when(F.col("customer_region") == F.col("supplier_region"), "NSD")
        .when(F.col("p_size") % 2 == 0, "IMP")
        .otherwise("ISD")
    )


def _shipped() -> Column:
    return F.when(F.col("l_partkey") % 50 != 0, F.col("l_shipdate").cast("date"))


def _choose(key: Column, **values: str) -> Column:
    pairs = iter(values.items())
    name, value = next(pairs)
    chosen = F.when(key == name, value)
    for name, value in pairs:
        chosen = chosen.when(key == name, value)
    return chosen


def _columns() -> dict[str, Column]:
    kind, trade, size = F.col("kind"), F.col("trade"), F.col("p_size")
    freight, fee = kind == "FRT", kind == "MSC"
    returned = ~fee & (F.col("l_returnflag") == "R")
    price, quantity = F.col("price"), _money("l_quantity", 10, 2)
    off, tax = F.col("off"), F.col("tax")
    milli = _lit("0.001", 4, 3)
    note = (kind == "ACC") & (F.col("c_mktsegment") == "MACHINERY")
    zero = F.lit(0).cast(AMOUNT)

    def noted(label: str, kg: Column) -> Column:
        return F.when(note, F.concat(F.lit(label), kg.cast("string"), F.lit(".0 KGS")))

    net = (
        F.when(freight, F.round(price * (_lit("1", 3, 2) - off) * milli, 2).cast(AMOUNT))
        .when(kind == "FSC", F.round(price * _lit("0.0001", 5, 4), 2).cast(AMOUNT))
        .when(kind == "TAX", F.round(price * tax * milli, 2).cast(AMOUNT))
        .when(kind == "ACC", F.round(quantity * _lit("0.35", 3, 2), 2).cast(AMOUNT))
        .when(kind == "BRK", F.lit(45).cast(AMOUNT))
        .when(kind == "GOV", F.round(price * _lit("0.0005", 5, 4), 2).cast(AMOUNT))
        .when(fee, F.lit(5).cast(AMOUNT))
        .otherwise(zero)
    )
    weightless = (F.col("l_quantity") == 7) & (F.col("l_linenumber") == 7)
    weight = F.when(
        freight & ~weightless, (quantity * quantity * _lit("0.025", 4, 3)).cast(AMOUNT)
    ).otherwise(zero)
    oversize = F.when(size % 3 == 0, _lit("1.5", 2, 1)).otherwise(_lit("1", 2, 1))
    whole_kg = F.col("l_quantity").cast("int")
    order_year = F.year("ordered").cast("string")
    return {
        "tracking_number": F.when(
            ~fee,
            F.concat(
                F.lit("1Z"),
                F.lpad(F.col("l_orderkey").cast("string"), 12, "0"),
                F.col("l_linenumber").cast("string"),
            ),
        ),
        "charge_category": kind,
        "package_indicator": F.when(freight & (size == 50), "3")
        .when(freight, "1")
        .otherwise("0"),
        "invoice_number": F.concat(
            F.lit("INV"),
            F.lpad(F.col("o_custkey").cast("string"), 10, "0"),
            F.lit("-"),
            order_year,
        ),
        "invoice_date": F.col("ordered"),
        "shipment_date": F.col("shipped"),
        "order_reference": F.concat(F.lit("#"), F.col("l_orderkey").cast("string")),
        "currency": F.lit("EUR"),
        "service_code": F.when(
            size != 49, _choose(trade, NSD="003", ISD="704", IMP="007", RTS="353")
        ),
        "charge_description": F.when(
            freight,
            F.when(
                size != 48,
                _choose(
                    trade,
                    NSD="TB Standard",
                    ISD="WW Standard",
                    IMP="WW Express Saver",
                    RTS="TB Standard Undeliverable Return",
                ),
            ),
        ).otherwise(F.concat(F.lit("Charge "), kind)),
        "charge_code": F.when(
            kind == "ACC",
            _choose(
                F.col("c_mktsegment"),
                AUTOMOBILE="RES",
                BUILDING="PFR",
                FURNITURE="RDS",
                HOUSEHOLD="PFC",
                MACHINERY="SCF",
            ),
        ).otherwise(kind),
        "shipment_type": F.when(fee, "MIS").when(returned, "RTN").otherwise("SHP"),
        "shipment_subtype": F.when(fee, "SVCH").otherwise(trade),
        "discount_amount": F.when(
            freight, F.round(price * off * milli, 2).cast(AMOUNT)
        ).otherwise(zero),
        "net_amount": net,
        "actual_weight": weight,
        "billed_weight": (weight * oversize).cast(AMOUNT),
        "recipient_country": F.when(
            kind != "FSC",
            F.when(returned, F.col("supplier_country")).otherwise(F.col("customer_country")),
        ),
        "sender_country": F.when(returned, F.col("customer_country")).otherwise(
            F.col("supplier_country")
        ),
        "recipient_name": F.when(returned, F.col("s_name")).otherwise(F.col("c_name")),
        "sender_name": F.when(returned, F.col("c_name")).otherwise(F.col("s_name")),
        "goods_description": F.col("p_type"),
        "entered_weight_note": noted("ENTERED WEIGHT: ", whole_kg),
        "audited_weight_note": noted("AUDITED WEIGHT: ", whole_kg + 1),
        "source_file": F.concat(F.lit("orders_"), order_year, F.lit(".csv")),
        "_overbilled": F.col("o_custkey") % 10 == 0,
    }


def shipments(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """The parcel rows written to the shared folder: joined (and ``spread``) once for several uses of the lines."""
    return landed(parcels(spark, sf_dir, spread))


def by_month(rows: DataFrame) -> DataFrame:
    """Parcel rows spread by the month of their lines, which are four times as many and far wider."""
    return rows.withColumn("_month", F.date_format("shipped", "yyyy-MM")).hint("rebalance", "_month")


def billing_fields(
    spark: SparkSession, sf_dir: str, invoice_totals: bool = False, rows: DataFrame | None = None
) -> DataFrame:
    """Typed billing lines without the derived columns, of all parcel rows or those given.

    ``invoice_total`` costs an aggregation and a join, so it is 0 unless asked for.
    """
    made = _columns()
    lines = (
        (parcels(spark, sf_dir) if rows is None else rows)
        .withColumn("kinds", _kinds())
        .select("*", F.inline("kinds"))
        .select(
            *[c.alias(name) for name, c in made.items()],
            F.struct("l_orderkey", "l_linenumber", "place", "kn").alias("line_ord"),
        )
    )
    if invoice_totals:
        cents = _lit("0.01", 18, 4)
        totals = lines.groupBy("invoice_number").agg(
            (F.sum("net_amount") + F.when(F.bool_or("_overbilled"), cents).otherwise(cents * 0))
            .cast(AMOUNT)
            .alias("invoice_total")
        )
        lines = lines.join(totals, "invoice_number", "left")
    absent = {
        name: F.lit(0).cast(AMOUNT)
        if name in ("invoice_total", "declared_value")
        else F.lit(None).cast("date" if name in ("pickup_date", "delivery_date") else "string")
        for name in POSITIONS
        if name not in lines.columns
    }
    return lines.withColumns(absent).select(*POSITIONS, "source_file", "line_ord")


def billing_lines(
    spark: SparkSession, sf_dir: str, invoice_totals: bool = False, rows: DataFrame | None = None
) -> DataFrame:
    """Billing lines with the derived columns."""
    return add_derived(billing_fields(spark, sf_dir, invoice_totals, rows))


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country dimension of these lines: one nation without a name, one without alpha-3."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    return (
        nation.filter(key != 23)
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_name").alias("alpha2"),
            F.when(
                key != 24, F.concat(F.lit("N"), F.lpad(key.cast("string"), 2, "0"))
            ).alias("alpha3"),
            F.concat("n_name", F.lit(" / "), "r_name").alias("name"),
        )
    )


# --- the same lines as text ----------------------------------------------------


def billing_text(spark: SparkSession, sf_dir: str, width: int = 176, rows: DataFrame | None = None) -> DataFrame:
    """The lines as headerless CSV records: ``value, source_file, line_ord``."""
    fields = billing_fields(spark, sf_dir, rows=rows)
    by_position = {p: n for n, p in POSITIONS.items()}

    def text(position: int) -> Column:
        name = by_position.get(position)
        if name is None:
            return F.lit("")
        c = F.coalesce(F.col(name).cast("string"), F.lit(""))
        return F.concat(F.lit(" "), c, F.lit("  ")) if name in TRIMMED_FIELDS else c

    quoted = {p: text(p) for p in range(width)}
    goods = POSITIONS["goods_description"]
    if goods < width:
        quoted[goods] = F.concat(F.lit('"'), text(goods), F.lit('"'))
    # Exploded, so that the text is put together once and not in every use of it.
    record = F.concat_ws(",", *quoted.values())
    return fields.select(F.explode(F.array(record)).alias("value"), "source_file", "line_ord")
