"""Named queries: every operator over the whole sample tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freightlens.functions.text import null_tokens
from freightlens.operators import accessorials as acc
from freightlens.operators import costs, destinations, duties, filters, rules, weights
from freightlens.operators import packages as rollup
from freightlens.operators import returns as ret
from freightlens.operators import summary as figures
from freightlens.operators.countries import with_country_name
from freightlens.operators.derive import add_derived
from freightlens.operators.packages import as_doubles
from freightlens.operators.top import top_expenses
from freightlens.operators.trends import by_service, trends
from freightlens.operators.typing import coerce_types
from freightlens.plans import charts, display, report
from freightlens.plans.analyzer import BillingAnalyzer
from freightlens.schema import NA_TOKENS, POSITIONS
from freightlens.session import landed, shared_folder, tune
from freightlens.sources import billing_csv as csv
from freightlens.sources import sample_tables as sample
from freightlens.sources.cells import LineCells
from freightlens.sources.facets import LandedFacets
from freightlens.sources.sinks import land_lines
from freightlens.streaming.refresh import LoadedTable
from freightlens.streaming.rollup import PackageStates

from catalog.oracle import COUNTRIES, END, SCANNED, SERVICES, START

Query = Callable[[SparkSession, str], DataFrame]

_LINE_KEYS = (
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


# --- shapes of query -----------------------------------------------------------


def on_lines(op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: as_doubles(op(sample.billing_lines(tune(spark), sf)))


def on_lines_dim(op: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: as_doubles(
        op(sample.billing_lines(tune(spark), sf), sample.countries(spark, sf))
    )


def on_joined(op: Callable[[DataFrame], DataFrame]) -> Query:
    """As ``on_lines``, for what reads the lines several times: their parcel rows are joined once."""
    return lambda spark, sf: as_doubles(op(_joined_lines(spark, sf)))


def on_joined_dim(op: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: as_doubles(op(_joined_lines(spark, sf), sample.countries(spark, sf)))


def _joined_lines(spark: SparkSession, sf: str) -> DataFrame:
    return sample.billing_lines(spark, sf, rows=sample.shipments(tune(spark), sf))


def on_packages(op: Callable[[DataFrame], DataFrame]) -> Query:
    return on_joined(lambda lines: op(rollup.packages(lines)))


def on_packages_dim(op: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return on_joined_dim(lambda lines, dim: op(rollup.packages(lines), dim))


def on_both(op: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return on_joined(lambda lines: op(lines, rollup.packages(lines)))


# --- sources -------------------------------------------------------------------

def as_files(records: DataFrame, folder: str | None = None, codec: str = "") -> str:
    """Records (``value, source_file, line_ord``) as one file for each source file; returns their folder.

    With a ``codec`` the files are compressed, and their names end with it.
    """
    base = f"{shared_folder(records.sparkSession)}/named-files-{uuid.uuid4().hex}"
    folder = folder or f"{base}/files"
    _write_named(records.repartition("source_file"), base, lambda name, part: f"{folder}/{name}", codec)
    return folder


# Text of the lines is ten to twenty times as large as their table: it is written compressed.
_PACKED = csv.CsvOptions(codec="gz")


def as_split_files(records: DataFrame, codec: str = "") -> str:
    """As ``as_files``, but each task writes what it has of a file, under its name in a folder of its own.

    No record is shuffled and no task writes a whole file. Returns a pattern for the folders.
    With a ``codec`` the files are compressed, and their names end with it.
    """
    base = f"{shared_folder(records.sparkSession)}/named-files-{uuid.uuid4().hex}"
    _write_named(records, base, lambda name, part: f"{base}/files/{part}/{name}", codec)
    return f"{base}/files/*"


def _write_named(records: DataFrame, base: str, target: Callable[[str, str], str], codec: str = "") -> None:
    jvm, conf = records.sparkSession.sparkContext._jvm, records.sparkSession.sparkContext._jsc.hadoopConfiguration()
    ordered = records.sortWithinPartitions("source_file", "line_ord")
    ordered.select("value", "source_file").write.partitionBy("source_file").text(f"{base}/parts", compression={"gz": "gzip"}.get(codec, codec) or None)
    at = lambda name: jvm.org.apache.hadoop.fs.Path(name)
    fs = at(base).getFileSystem(conf)
    for part in fs.globStatus(at(f"{base}/parts/source_file=*/part-*")):
        name = part.getPath().getParent().getName().split("=", 1)[1]
        to = at(target(f"{name}.{codec}" if codec else name, part.getPath().getName().split("-")[1]))
        fs.mkdirs(to.getParent())
        fs.rename(part.getPath(), to)


def scan_headerless_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Every mapped field of the lines, as text, from files."""
    fields = csv.scan_fields(spark, as_split_files(sample.billing_text(tune(spark), sf), "gz"), _PACKED)
    return fields.select(*[F.col(f"_c{POSITIONS[n]}").alias(n) for n in SCANNED])


def _ragged_text(spark: SparkSession, sf: str) -> DataFrame:
    """Lineitems as records of two to four fields and blank lines, ten files."""
    part = F.col("l_partkey")
    two = F.concat(
        F.col("l_orderkey").cast("string"),
        F.lit(',"a,""'),
        F.col("l_linenumber").cast("string"),
        F.lit('"""'),
    )
    three = F.concat_ws(",", two, part.cast("string"))
    record = (
        F.when(part % 13 == 0, "   ")
        .when(part % 11 == 0, F.concat(three, F.lit(",x")))
        .when(part % 7 == 0, two)
        .otherwise(three)
    )
    return sample.table(spark, sf, "lineitem").select(
        record.alias("value"),
        F.concat(F.lit("supp_"), (F.col("l_suppkey") % 10).cast("string")).alias("source_file"),
        F.struct(*_LINE_KEYS).alias("line_ord"),
    )


def scan_ragged_rows(spark: SparkSession, sf: str) -> DataFrame:
    folder = as_files(_ragged_text(tune(spark), sf))
    fields = csv.scan_fields(spark, [folder], csv.CsvOptions(scan_width=4))
    return fields.select("source_file", *[F.col(f"_c{i}").alias(f"c{i}") for i in range(4)])


def scan_null_tokens(spark: SparkSession, sf: str) -> DataFrame:
    tokens = (*NA_TOKENS, " NA", "nada", "Na", "NULL ", "none")
    key = F.col("p_partkey")
    token = F.element_at(F.array(*map(F.lit, tokens)), (key % len(tokens) + 1).cast("int"))
    raw = F.when(key % 2 == 0, F.col("p_name")).otherwise(token)
    return sample.table(spark, sf, "part").select(key, null_tokens(raw).alias("value"))


def decode_charset(spark: SparkSession, sf: str) -> DataFrame:
    """Customer names as bytes: files of even nations in UTF-8, of odd ones in Latin-1."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    text = (
        F.when(key % 3 == 0, F.col("c_name"))
        .when(key % 3 == 1, F.concat("c_name", F.lit(" Müller")))
        .otherwise(F.concat("c_name", F.lit(" Ã¼")))
    )
    data = F.when(nation % 2 == 0, F.encode(text, "UTF-8")).otherwise(
        F.encode(text, "ISO-8859-1")
    )
    record = F.concat(key.cast("string").cast("binary"), F.lit(b","), data)
    lines = sample.table(spark, sf, "customer").select(
        F.concat(F.lit("file_"), nation.cast("string")).alias("source_file"),
        key.alias("line_ord"),
        record.cast("string").alias("value"),
    )
    fields = csv.scan_fields(tune(spark), [as_files(lines)], csv.CsvOptions(scan_width=2))
    return fields.select("source_file", F.col("_c0").cast("long").alias("c_custkey"), F.col("_c1").alias("value"))


def project_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Files of 100 fields: what lies beyond is null."""
    lines = csv.read_folder(spark, as_split_files(sample.billing_text(tune(spark), sf, width=100), "gz"), _PACKED)
    return lines.select(
        "tracking_number",
        "charge_category",
        "recipient_country",
        F.col("pickup_date").cast("string").alias("pickup_date"),
        "goods_description",
        "audited_weight_note",
    )


def source_lineage(spark: SparkSession, sf: str) -> DataFrame:
    lines = csv.read_folder(spark, as_split_files(sample.billing_text(tune(spark), sf), "gz"), _PACKED)
    return lines.groupBy("source_file").agg(
        F.count("*").alias("lines"), F.sum("net_amount").cast("double").alias("net_amount")
    )


def _two_deliveries(spark: SparkSession, sf: str, after: Callable[[LoadedTable], None]) -> LoadedTable:
    """Two deliveries, each followed by a refresh: the second replaces a file that was cut short and adds one."""
    base = f"{shared_folder(tune(spark))}/deliveries-{uuid.uuid4().hex}"
    text, name = sample.billing_text(spark, sf, rows=sample.shipments(spark, sf)), F.col("source_file")
    late, short = name == "orders_1997.csv", name == "orders_1996.csv"
    table = LoadedTable(spark, f"{base}/table")
    for n, part in enumerate((~late & (~short | (F.col("line_ord.l_linenumber") < 4)), late | short)):
        as_files(text.filter(part), f"{base}/in/{n}", "gz")
        table.refresh(f"{base}/in/*", _PACKED)
        after(table)
    return table


def refresh_lines(spark: SparkSession, sf: str) -> DataFrame:
    table = _two_deliveries(spark, sf, lambda table: None)
    return table.lines.groupBy("source_file").agg(
        F.count("*").alias("lines"), F.sum("net_amount").cast("double").alias("net_amount")
    )


def refresh_packages(spark: SparkSession, sf: str) -> DataFrame:
    """The package rollup after two deliveries, merged from the states that each refresh added."""

    def states(table: LoadedTable) -> PackageStates:
        return PackageStates(table, f"{table.path}/states", buckets=8)

    table = _two_deliveries(spark, sf, lambda table: states(table).refresh())
    return as_doubles(states(table).packages)


def write_order_files(spark: SparkSession, sf: str, *odd_even: bool) -> list[str]:
    """Orders as billing CSV files in the shared folder; returns the folders."""
    key = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    made: dict[int, Column] = {
        4: F.date_format("o_orderdate", "yyyy-MM-dd"),
        5: F.concat(F.lit("INV"), key.cast("string")),
        52: F.when(key % 10 == 0, F.replace(price, F.lit("."), F.lit(","))).otherwise(price),
        74: F.concat(F.lit('Café Müller "'), F.col("o_custkey").cast("string"), F.lit('", x')),
    }
    orders = sample.table(spark, sf, "orders")
    fields = [made.get(i, F.lit("")).alias(f"c{i}") for i in range(csv.FULL_WIDTH)]
    base = f"{shared_folder(spark)}/order-files-{uuid.uuid4().hex}"
    folders = []
    for odd in odd_even or (None,):
        rows = orders if odd is None else orders.filter((key % 2 == 1) == F.lit(odd))
        folders.append(f"{base}/{'all' if odd is None else 'odd' if odd else 'even'}")
        rows.select(*fields).write.csv(folders[-1], quote='"', escape='"', emptyValue="")
    return folders


def scan_folder(spark: SparkSession, sf: str) -> DataFrame:
    (folder,) = write_order_files(tune(spark), sf)
    lines = csv.read_folder(spark, folder)
    return as_doubles(
        lines.select("invoice_number", "invoice_date", "net_amount", "recipient_name")
    )


def union_files(spark: SparkSession, sf: str) -> DataFrame:
    folders = write_order_files(tune(spark), sf, True, False)
    return csv.read_files(spark, folders).agg(
        F.count("*").alias("lines"),
        F.count_distinct("invoice_number").alias("invoices"),
        F.sum("net_amount").cast("double").alias("net_amount"),
        F.min("invoice_date").alias("first_date"),
        F.max("invoice_date").alias("last_date"),
    )


def _cut_off(spark: SparkSession, sf: str, folder: str) -> str:
    """The orders as small compressed files, one of which lost its second half; returns that one's path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda name: jvm.org.apache.hadoop.fs.Path(name)
    orders = sample.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string"))
    orders.write.option("compression", "gzip").option("maxRecordsPerFile", 1000).csv(f"{folder}/whole")
    files = at(folder).getFileSystem(conf)
    part = files.globStatus(at(f"{folder}/whole/*.gz"))[0].getPath()
    opened = files.open(part)
    half = opened.readNBytes(files.getFileStatus(part).getLen() // 2)
    opened.close()
    out = files.create(at(f"{folder}/cut-off.csv.gz"))
    out.write(bytearray(half))
    out.close()
    return f"{folder}/cut-off.csv.gz"


def isolate_bad_files(spark: SparkSession, sf: str) -> DataFrame:
    """The order files with an empty one, a damaged one and a missing path among them, by status."""
    (folder,) = write_order_files(tune(spark), sf)
    spark.createDataFrame([], "c0 string").coalesce(1).write.mode("append").csv(folder)
    paths = [folder, _cut_off(spark, sf, f"{folder}-damaged"), f"{folder}-missing"]
    return (
        csv.manifest(spark, paths, csv.CsvOptions(on_bad_file="skip"))
        .groupBy("status")
        .agg(
            F.sum("rows").alias("rows"),
            F.sum("bad_amounts").alias("bad_amounts"),
            F.max("charset").alias("charset"),
        )
    )


# --- typing --------------------------------------------------------------------


def coerce_numeric(spark: SparkSession, sf: str) -> DataFrame:
    """Prices in seven spellings, four of which are no numbers."""
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    n = F.col("l_linenumber")
    text = (
        F.when(n == 1, price)
        .when(n == 2, F.concat(F.lit("  +"), price, F.lit(" ")))
        .when(n == 3, F.concat(F.lit("1,"), price))
        .when(n == 4, F.replace(price, F.lit("."), F.lit(",")))
        .when(n == 5, F.concat(price, F.lit("e3")))
        .when(n == 6, "-")
    )
    rows = sample.table(tune(spark), sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", text.alias("net_amount")
    )
    return as_doubles(coerce_types(rows))


def coerce_date(spark: SparkSession, sf: str) -> DataFrame:
    day, n = F.col("l_shipdate").cast("date"), F.col("l_linenumber")
    text = (
        F.when(n <= 3, F.date_format(day, "yyyy-MM-dd"))
        .when(n == 4, F.date_format(day, "dd.MM.yyyy"))
        .when(n == 5, F.date_format(day, "yyyy-MM-dd 10:00"))
        .when(n == 6, "soon")
    )
    rows = sample.table(tune(spark), sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", text.alias("shipment_date")
    )
    return coerce_types(rows)


def trim_to_null(spark: SparkSession, sf: str) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    text = (
        F.when(k % 5 == 0, F.concat(F.lit(" \t"), name, F.lit(" \n ")))
        .when(k % 5 == 1, name)
        .when(k % 5 == 2, "   ")
        .when(k % 5 == 3, " nan ")
        .otherwise(F.concat(F.lit("x"), name, F.lit("\r\n")))
    )
    rows = sample.table(tune(spark), sf, "part").select(k, text.alias("charge_description"))
    return coerce_types(rows)


# --- derived columns -----------------------------------------------------------


def derive(column: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        lines = add_derived(sample.billing_fields(tune(spark), sf))
        return as_doubles(lines.select("tracking_number", "charge_category", column))

    return query


# --- filters -------------------------------------------------------------------


def _digest(lines: DataFrame) -> DataFrame:
    return lines.agg(
        F.count("*").alias("lines"),
        F.count_distinct("tracking_number").alias("parcels"),
        F.coalesce(F.sum("net_amount").cast("double"), F.lit(0.0)).alias("net_amount"),
    )


def filtered(**conditions: object) -> Query:
    return on_lines(lambda lines: _digest(filters.filter_lines(lines, **conditions)))


_MOST = {
    "start_date": START,
    "end_date": END,
    "countries": list(COUNTRIES),
    "services": list(SERVICES),
}


def on_cells(op: Callable[[LineCells], DataFrame]) -> Query:
    """Cells of lines that were landed in two deliveries, with a refresh after each."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        cells = LineCells(spark, f"{shared_folder(tune(spark))}/lines-{uuid.uuid4().hex}")
        lines = sample.billing_lines(spark, sf, rows=sample.shipments(spark, sf, spread=True))
        late = F.col("source_file") >= "orders_1996"
        for part, mode in ((~late, "overwrite"), (late, "append")):
            land_lines(lines.filter(part), cells.path, mode, spread=False)
            cells.refresh()
        return op(cells)

    return query


def on_landed(op: Callable[[LandedFacets], DataFrame]) -> Query:
    """Facets of the lines landed by month, with their dictionary."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        path = f"{shared_folder(tune(spark))}/lines-{uuid.uuid4().hex}"
        rows = sample.parcels(spark, sf, spread=True)
        land_lines(sample.billing_lines(spark, sf, rows=rows), path, spread=False)
        facets = LandedFacets(spark, path)
        facets.write()
        return op(facets)

    return query


def parse_facet_label(lines: DataFrame) -> DataFrame:
    labels = filters.service_choices(lines).select("label")
    return labels.withColumn("code", filters.code_of_label(F.col("label")))


# --- rollup --------------------------------------------------------------------


def package_fallback(lines: DataFrame) -> DataFrame:
    """The lines as if the carrier sent no freight rows: packages come from the others."""
    category = F.col("charge_category")
    unfreighted = lines.withColumn(
        "charge_category", F.when(category == "FRT", "INF").otherwise(category)
    )
    return rollup.packages(unfreighted).select(
        "tracking_number",
        "service_name",
        "charge_description",
        "recipient_country",
        "total_charge",
    )


def package_base_rows(lines: DataFrame) -> DataFrame:
    return rollup.freight_rows(lines).select("tracking_number", "invoice_number", "service_code")


def package_attributes(lines: DataFrame) -> DataFrame:
    return rollup.attributes(rollup.freight_rows(lines))


# --- summary -------------------------------------------------------------------


def picked(*names: str) -> Query:
    return on_both(lambda lines, pkgs: figures.summary(lines, pkgs).select(*names))


def summary_empty(lines: DataFrame) -> DataFrame:
    nowhere = filters.filter_lines(lines, countries=["nowhere"])
    return figures.summary(nowhere, rollup.packages(nowhere))


# --- bundles -------------------------------------------------------------------


def _cells(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """Every value of every table: the table's name, the column, and a text or a number."""
    out = None
    for key, df in tables.items():
        texts = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
        one = texts.unpivot([], texts.columns, "column", "value").withColumn(name, F.lit(key))
        out = one if out is None else out.unionByName(one)
    number = F.col("value").try_cast("double")
    return out.select(name, "column", F.when(number.isNull(), F.col("value")).alias("text"), number.alias("number"))


def _analyzer(lines: DataFrame, dim: DataFrame) -> BillingAnalyzer:
    """With the packages written to the shared folder, one rollup for all tables."""
    return BillingAnalyzer(lines, dim, landed(rollup.packages(lines, whole=True)))


def visualization_bundle(lines: DataFrame, dim: DataFrame) -> DataFrame:
    return _cells(_analyzer(lines, dim).chart_tables(), "dataset")


def report_bundle(lines: DataFrame, dim: DataFrame) -> DataFrame:
    return _cells(_analyzer(lines, dim).report_tables(), "section")


def display_bundle(lines: DataFrame, dim: DataFrame) -> DataFrame:
    return _cells(_analyzer(lines, dim).display_tables(), "table")


def _grouped(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(
        F.count("*").alias("lines"), F.sum("net_amount").cast("double").alias("net_amount")
    )


def invoice_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    return rules.invoice_reconciliation(
        sample.billing_lines(tune(spark), sf, invoice_totals=True)
    )


def queries() -> dict[str, Query]:
    def by_country(op):
        return on_packages_dim(lambda p, dim: op(destinations.by_destination(p, dim)))

    def code_names(pkgs: DataFrame, dim: DataFrame) -> DataFrame:
        totals = destinations.destination_totals(pkgs).select("country_code")
        return with_country_name(totals, dim)

    return {
        # sources
        "scan_headerless_csv": scan_headerless_csv,
        "scan_ragged_rows": scan_ragged_rows,
        "scan_null_tokens": scan_null_tokens,
        "decode_charset": decode_charset,
        "project_positions": project_positions,
        "source_lineage": source_lineage,
        "refresh_lines": refresh_lines,
        "refresh_packages": refresh_packages,
        "union_files": union_files,
        "scan_folder": scan_folder,
        "isolate_bad_files": isolate_bad_files,
        # typing
        "coerce_numeric": coerce_numeric,
        "coerce_date": coerce_date,
        "trim_to_null": trim_to_null,
        # derived columns
        "derive_total_charge": derive("total_charge"),
        "derive_service_name": derive("service_name"),
        "derive_category_name": derive("charge_category_name"),
        "derive_is_package_line": derive("is_package_line"),
        "derive_is_return": derive("is_return"),
        "derive_weight_difference": derive("weight_difference"),
        "derive_iso_week": derive("shipment_week"),
        "derive_month": derive("shipment_month"),
        "derive_year_month": derive("shipment_year_month"),
        # filters and facets
        "filter_start_date": filtered(start_date=START),
        "filter_end_date": filtered(end_date=END),
        "filter_countries": filtered(countries=list(COUNTRIES)),
        "filter_services": filtered(services=list(SERVICES)),
        "filter_returns_only": filtered(returns_only=True),
        "filter_combined": on_lines(
            lambda lines: rollup.packages(filters.filter_lines(lines, **_MOST)).select(
                "tracking_number", "total_charge"
            )
        ),
        "filter_then_summary": on_lines_dim(
            lambda lines, dim: BillingAnalyzer(lines, dim).filter_data(**_MOST).get_summary()
        ),
        "filter_then_destinations": on_lines_dim(
            lambda lines, dim: BillingAnalyzer(lines, dim)
            .filter_data(returns_only=True)
            .analyze_by_destination()
        ),
        "facet_date_bounds": on_lines(filters.date_bounds),
        "facet_countries": on_lines(filters.country_choices),
        "facet_services": on_lines(filters.service_choices),
        "landed_date_bounds": on_landed(LandedFacets.date_bounds),
        "landed_countries": on_landed(LandedFacets.country_choices),
        "landed_services": on_landed(LandedFacets.service_choices),
        "cells_charge_breakdown": on_cells(LineCells.charge_breakdown),
        "cells_acc_by_code": on_cells(LineCells.accessorials_by_code),
        "cells_filtered_trends": on_cells(lambda cells: cells.accessorial_trends(**_MOST)),
        "parse_facet_label": on_lines(parse_facet_label),
        # package rollup
        "package_base_rows": on_lines(package_base_rows),
        "package_attributes": on_lines(package_attributes),
        "package_fallback": on_joined(package_fallback),
        "charge_totals": on_lines(rollup.charge_totals),
        "packages": on_joined(
            lambda lines: rollup.packages(lines)
        ),
        # summary
        "summary": on_both(figures.summary),
        "summary_top_destination": picked("top_destination_country"),
        "summary_date_range": picked("date_from", "date_to"),
        "summary_return_rate": picked("return_rate"),
        "summary_currency": picked("currency"),
        "summary_category_totals": picked(
            "total_freight", "total_fuel_surcharge", "total_tax", "total_accessorial"
        ),
        "summary_counts": picked("total_invoices", "total_packages"),
        "summary_cost": picked("total_cost", "avg_cost_per_package"),
        "summary_weight": picked("total_weight_kg"),
        "summary_empty": on_joined(summary_empty),
        # costs, destinations, trends, services
        "cost_breakdown": on_lines(costs.category_totals),
        "cost_breakdown_pct": on_lines(costs.cost_breakdown),
        "charge_breakdown": on_lines(costs.charge_breakdown),
        "by_destination": on_packages(destinations.destination_totals),
        "by_destination_enriched": on_packages_dim(destinations.by_destination),
        "country_lookup": on_packages_dim(code_names),
        "trends_week": on_packages(lambda p: trends(p, "week")),
        "trends_month": on_packages(lambda p: trends(p, "month")),
        "by_service": on_packages(by_service),
        # returns
        "returns_filter": on_packages(
            lambda p: ret.returned(p).select("tracking_number", "sender_country", "total_charge")
        ),
        "returns_summary": on_packages(ret.returns_summary),
        "returns_by_reason": on_packages(ret.returns_by_reason),
        "returns_by_country": on_packages_dim(ret.returns_by_country),
        # weights
        "weights_filter": on_packages(
            lambda p: weights.weighed(p).select(
                "tracking_number", "actual_weight", "billed_weight"
            )
        ),
        "weights_diff": on_packages(
            lambda p: weights.weighed(p).select("tracking_number", "weight_diff")
        ),
        "weights_summary": on_packages(weights.weights_summary),
        "weights_distribution": on_packages(weights.weights_distribution),
        "weights_detail": on_packages(weights.weights_detail),
        # duties
        "duties_filter": on_lines(lambda x: _grouped(duties.import_lines(x), "charge_category")),
        "duties_summary": on_lines(duties.duties_summary),
        "duties_by_charge_type": on_lines(duties.duties_by_charge_type),
        "duties_shipments": on_lines(lambda x: duties.duties_shipments(x).drop("BRK", "GOV")),
        "duties_by_country": on_lines_dim(duties.duties_by_country),
        "duties_pivot": on_lines(duties.duties_pivot),
        "duties_detail": on_lines(duties.duties_detail),
        # accessorials
        "acc_filter": on_lines(lambda x: _grouped(acc.accessorial_lines(x), "charge_code")),
        "acc_summary": on_lines(acc.accessorials_summary),
        "acc_by_code": on_lines(acc.accessorials_by_code),
        "tracking_country": on_lines(acc.tracking_country),
        "acc_by_tracking": on_lines(acc.accessorials_by_parcel),
        "acc_with_country": on_lines(acc.accessorials_with_country),
        "acc_by_country": on_lines_dim(acc.accessorials_by_country),
        "acc_trends": on_lines(acc.accessorial_trends),
        # top expenses
        "top_expenses": on_lines(top_expenses),
        # chart data
        "kpi_cards": on_both(lambda lines, p: charts.kpi_cards(figures.summary(lines, p))),
        "map_points": on_packages_dim(
            lambda p, dim: charts.map_points(destinations.by_destination(p, dim), dim)
        ),
        "top_destinations": by_country(charts.top_destinations),
        "return_reasons_top": on_packages(
            lambda p: charts.return_reasons_top(ret.returns_by_reason(p))
        ),
        "weight_sample": on_packages(weights.weight_sample),
        "weight_axis_max": on_packages(weights.weight_axis_max),
        "duties_pie": on_lines(lambda x: charts.duties_pie(duties.duties_by_charge_type(x))),
        "duties_top_countries": on_lines_dim(
            lambda x, dim: charts.duties_top_countries(duties.duties_by_country(x, dim))
        ),
        "acc_bar": on_lines(lambda x: charts.accessorial_bars(acc.accessorials_by_code(x))),
        "acc_top_countries": on_lines_dim(
            lambda x, dim: charts.accessorial_top_countries(acc.accessorials_by_country(x, dim))
        ),
        "cost_pie": on_lines(lambda x: charts.cost_pie(costs.cost_breakdown(x))),
        "cost_bars": on_lines(lambda x: charts.cost_bars(costs.cost_breakdown(x))),
        "trend_series": on_packages(lambda p: charts.trend_series(trends(p))),
        "acc_trend_series": on_lines(
            lambda x: charts.accessorial_trend_series(acc.accessorial_trends(x))
        ),
        "service_compare": on_packages(lambda p: charts.service_compare(by_service(p))),
        "weight_bars": on_packages(lambda p: charts.weight_bars(weights.weights_distribution(p))),
        "visualization_bundle": on_joined_dim(visualization_bundle),
        "display_bundle": on_joined_dim(display_bundle),
        # display tables
        "display_cost": on_lines(lambda x: display.cost_table(costs.cost_breakdown(x))),
        "display_destinations": by_country(display.destination_table),
        "display_trends": on_packages(lambda p: display.trend_table(trends(p))),
        "display_returns_by_country": on_packages_dim(
            lambda p, dim: display.returns_country_table(ret.returns_by_country(p, dim))
        ),
        "display_services": on_packages(lambda p: display.service_table(by_service(p))),
        "display_duties": on_lines(lambda x: display.duties_table(duties.duties_detail(x))),
        "display_accessorials": on_lines(
            lambda x: display.accessorial_table(acc.accessorials_by_code(x))
        ),
        "display_top_expenses": on_lines(lambda x: display.top_expense_table(top_expenses(x), figures.currency(x))),
        "metrics_returns": on_packages(lambda p: display.returns_metrics(ret.returns_summary(p))),
        "metrics_weights": on_packages(
            lambda p: display.weights_metrics(weights.weights_summary(p))
        ),
        "metrics_duties": on_lines(
            lambda x: display.duties_metrics(duties.duties_summary(x), figures.currency(x))
        ),
        "metrics_accessorials": on_lines(
            lambda x: display.accessorials_metrics(
                acc.accessorials_summary(x), figures.currency(x)
            )
        ),
        # report tables
        "report_title": on_both(lambda x, p: report.report_title(figures.summary(x, p))),
        "report_summary": on_both(lambda x, p: report.report_summary(figures.summary(x, p))),
        "report_cost": on_lines(lambda x: report.report_cost(costs.cost_breakdown(x))),
        "report_destinations": by_country(report.report_destinations),
        "report_returns": on_packages(lambda p: report.report_returns(ret.returns_summary(p))),
        "report_return_types": on_packages(
            lambda p: report.report_return_types(ret.returns_by_reason(p))
        ),
        "report_top": on_lines(lambda x: report.report_top(top_expenses(x, 15))),
        "report_bundle": on_joined_dim(report_bundle),
        # documented rules
        "customer_of_shipment": on_packages(rules.customer_of_shipment),
        "invoice_reconciliation": invoice_reconciliation,
        "weight_audit_notes": on_lines(rules.weight_audits),
    }
