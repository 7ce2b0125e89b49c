"""Fixed values of the billing export and the shape of the tables built from it."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: field name -> 0-based position in a billing row -------------
POSITIONS = {
    "version": 0,
    "account_number": 1,
    "shipper_number": 2,
    "country_code": 3,
    "invoice_date": 4,
    "invoice_number": 5,
    "invoice_type": 6,
    "invoice_type_detail": 7,
    "vat_number": 8,
    "currency": 9,
    "invoice_total": 10,
    "shipment_date": 11,
    "reference_1": 13,
    "order_reference": 15,
    "payment_terms": 17,
    "package_indicator": 18,
    "tracking_number": 20,
    "actual_weight": 26,
    "actual_weight_unit": 27,
    "billed_weight": 28,
    "billed_weight_unit": 29,
    "package_type": 30,
    "zone": 31,
    "service_code": 33,
    "shipment_type": 34,
    "shipment_subtype": 35,
    "charge_category": 43,
    "charge_code": 44,
    "charge_description": 45,
    "discount_amount": 51,
    "net_amount": 52,
    "sender_name": 67,
    "sender_street": 68,
    "sender_city": 70,
    "sender_postal": 72,
    "sender_country": 73,
    "recipient_name": 74,
    "recipient_company": 75,
    "recipient_street": 76,
    "recipient_city": 78,
    "recipient_postal": 80,
    "recipient_country": 81,
    "pickup_date": 116,
    "delivery_date": 117,
    "declared_value": 129,
    "goods_description": 130,
    "entered_weight_note": 174,
    "audited_weight_note": 175,
}

# A complete row has at least this many fields.
FULL_WIDTH = 1 + max(POSITIONS.values())

# --- Fixed values: field kinds -------------------------------------------------
NUMERIC_FIELDS = (
    "invoice_total",
    "actual_weight",
    "billed_weight",
    "discount_amount",
    "net_amount",
    "declared_value",
)
DATE_FIELDS = ("invoice_date", "shipment_date", "pickup_date", "delivery_date")
TRIMMED_FIELDS = (
    "tracking_number",
    "service_code",
    "shipment_type",
    "shipment_subtype",
    "charge_category",
    "charge_code",
    "charge_description",
    "sender_name",
    "sender_street",
    "sender_city",
    "sender_country",
    "recipient_name",
    "recipient_company",
    "recipient_street",
    "recipient_city",
    "recipient_country",
    "goods_description",
    "entered_weight_note",
    "audited_weight_note",
)

# --- Fixed values: texts that mean "missing" in the export ---------------------
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# --- Fixed values: service code -> service name --------------------------------
SERVICE_NAMES = {
    "000": "Address Correction",
    "001": "Dom. Standard",
    "003": "TB Standard",
    "004": "TB Standard",
    "005": "TB Standard",
    "007": "WW Express Saver",
    "031": "TB Standard",
    "041": "TB Standard",
    "353": "TB Standard Undeliverable Return",
    "354": "TB Standard Undeliverable Return",
    "355": "TB Standard Undeliverable Return",
    "402": "TB Standard Undeliverable Return",
    "704": "WW Standard",
    "755": "WW Standard Undeliverable Return",
    "857": "WW Express Saver Undeliverable Return",
}

# The written documentation of the export names three more codes; pass
# ``service_names=DOCUMENTED_SERVICE_NAMES`` to use them.
DOCUMENTED_SERVICE_NAMES = {
    **SERVICE_NAMES,
    "006": "WW Standard",
    "010": "WW Express Saver",
    "042": "TB Express Saver",
}

# --- Fixed values: charge category -> display name -----------------------------
CATEGORY_NAMES = {
    "ACC": "Accessorial",
    "BRK": "Brokerage",
    "DAS": "Delivery Area Surcharge",
    "EXM": "Exemption/Credit",
    "FRT": "Freight",
    "FSC": "Fuel Surcharge",
    "GOV": "Government Charges",
    "INF": "Information Only",
    "MSC": "Miscellaneous",
    "RES": "Residential Surcharge",
    "TAX": "Tax (VAT)",
}

# --- Fixed values: accessorial code families -----------------------------------
RESIDENTIAL_CODES = ("RES",)
SURGE_CODES = ("PFR", "PFC")
AREA_CODES = ("RDS", "ESD", "LDS", "HIS", "AKS")

# --- Fixed values: right-closed weight buckets (upper edge in kg, label) -------
WEIGHT_BUCKETS = (
    (0.5, "0-0.5kg"),
    (1.0, "0.5-1kg"),
    (2.0, "1-2kg"),
    (5.0, "2-5kg"),
    (10.0, "5-10kg"),
    (20.0, "10-20kg"),
    (50.0, "20-50kg"),
    (float("inf"), "50kg+"),
)

OTHER = "Other"
DEFAULT_CURRENCY = "EUR"

# Amounts and weights are parsed and summed exactly, so a total does not depend
# on how the rows were partitioned; results are given as doubles.
AMOUNT = T.DecimalType(28, 4)

LINE_ORD = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("row", T.LongType()),
    ]
)


def field_type(name: str) -> T.DataType:
    """Type of a mapped field after typing."""
    if name in NUMERIC_FIELDS:
        return AMOUNT
    if name in DATE_FIELDS:
        return T.DateType()
    return T.StringType()


DERIVED_FIELDS = {
    "total_charge": AMOUNT,
    "service_name": T.StringType(),
    "charge_category_name": T.StringType(),
    "is_package_line": T.BooleanType(),
    "is_return": T.BooleanType(),
    "weight_difference": T.DecimalType(29, 4),
    "shipment_week": T.IntegerType(),
    "shipment_month": T.StringType(),
    "shipment_year_month": T.StringType(),
}

# The billing-line table: mapped fields, lineage, order, derived fields.
LINES_SCHEMA = T.StructType(
    [T.StructField(n, field_type(n)) for n in POSITIONS]
    + [T.StructField("source_file", T.StringType()), T.StructField("line_ord", LINE_ORD)]
    + [T.StructField(n, t) for n, t in DERIVED_FIELDS.items()]
)

# Partition column of a landed table: a copy of ``shipment_year_month``.
MONTH_PARTITION = "month"

# Attributes a package takes from its freight rows, besides charge_description. Fixed values.
PACKAGE_ATTRIBUTES = (
    "invoice_number",
    "invoice_date",
    "shipment_date",
    "order_reference",
    "service_code",
    "actual_weight",
    "billed_weight",
    "sender_name",
    "sender_city",
    "sender_country",
    "recipient_name",
    "recipient_company",
    "recipient_city",
    "recipient_country",
    "shipment_type",
    "shipment_subtype",
    "goods_description",
    "is_return",
    "source_file",
)
