"""The expected result of every named query, as SQL over the sample tables.

Written apart from the library: window row numbers for the line order, cross
joins with the charge kinds, and plain joins where the library uses other plans.
"""

from __future__ import annotations

from freightlens.schema import NUMERIC_FIELDS, POSITIONS, TRIMMED_FIELDS

_BASE = """
b AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate,
         l_discount, l_tax, l_returnflag, o_custkey, o_orderdate, o_orderpriority,
         c_name, c_mktsegment, s_name, p_size, p_type,
         cn.n_name AS c_country, sn.n_name AS s_country,
         CASE WHEN l_returnflag = 'R' THEN 'RTS'
              WHEN cn.n_regionkey <> sn.n_regionkey
              THEN CASE WHEN p_size % 2 = 0 THEN 'IMP' ELSE 'ISD' END
              ELSE 'NSD' END AS st,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS px,
         CAST(l_discount AS DECIMAL(4,2)) AS ds,
         CAST(l_tax AS DECIMAL(4,2)) AS tx,
         CAST(l_quantity AS DECIMAL(10,2)) AS q,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
           l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax, l_returnflag,
           l_linestatus) AS rn
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey
  JOIN part ON l_partkey = p_partkey
),
k AS (
  SELECT b.*, kn, kind,
         kind <> 'MSC' AND l_returnflag = 'R' AS back
  FROM b CROSS JOIN (VALUES (1, 'FRT'), (2, 'FSC'), (3, 'TAX'), (4, 'ACC'),
                            (5, 'BRK'), (6, 'GOV'), (7, 'MSC'), (8, 'ZZZ')) AS v(kn, kind)
  WHERE kind IN ('FRT', 'FSC')
     OR (kind = 'TAX' AND tx > 0)
     OR (kind = 'ACC' AND o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW'))
     OR (kind IN ('BRK', 'GOV') AND st = 'IMP')
     OR (kind = 'MSC' AND l_linenumber = 7)
     OR (kind = 'ZZZ' AND l_linenumber = 5 AND l_returnflag = 'N')
),
f AS (
  SELECT
    CAST(l_orderkey AS HUGEINT) * 1000000 + rn * 10 + kn AS ord,
    CASE WHEN kind <> 'MSC'
         THEN concat('1Z', lpad(CAST(l_orderkey AS VARCHAR), 12, '0'), l_linenumber) END
      AS tracking_number,
    kind AS charge_category,
    CASE WHEN kind <> 'FRT' THEN '0' WHEN p_size = 50 THEN '3' ELSE '1' END AS package_indicator,
    concat('INV', lpad(CAST(o_custkey AS VARCHAR), 10, '0'), '-', year(o_orderdate))
      AS invoice_number,
    CAST(o_orderdate AS DATE) AS invoice_date,
    CASE WHEN l_partkey % 50 <> 0 THEN CAST(l_shipdate AS DATE) END AS shipment_date,
    concat('#', l_orderkey) AS order_reference,
    'EUR' AS currency,
    CASE WHEN p_size <> 49 THEN CASE st WHEN 'NSD' THEN '003' WHEN 'ISD' THEN '704'
         WHEN 'IMP' THEN '007' ELSE '353' END END AS service_code,
    CASE WHEN kind <> 'FRT' THEN concat('Charge ', kind)
         WHEN p_size = 48 THEN NULL
         ELSE CASE st WHEN 'NSD' THEN 'TB Standard' WHEN 'ISD' THEN 'WW Standard'
              WHEN 'IMP' THEN 'WW Express Saver'
              ELSE 'TB Standard Undeliverable Return' END END AS charge_description,
    CASE WHEN kind = 'ACC' THEN CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'RES'
         WHEN 'BUILDING' THEN 'PFR' WHEN 'FURNITURE' THEN 'RDS' WHEN 'HOUSEHOLD' THEN 'PFC'
         WHEN 'MACHINERY' THEN 'SCF' END ELSE kind END AS charge_code,
    CASE WHEN kind = 'MSC' THEN 'MIS' WHEN back THEN 'RTN' ELSE 'SHP' END AS shipment_type,
    CASE WHEN kind = 'MSC' THEN 'SVCH' ELSE st END AS shipment_subtype,
    CAST(CASE WHEN kind = 'FRT' THEN round(px * ds * CAST(0.001 AS DECIMAL(4,3)), 2) ELSE 0 END
      AS DECIMAL(18,4)) AS discount_amount,
    CAST(CASE kind
      WHEN 'FRT' THEN round(px * (CAST(1 AS DECIMAL(3,2)) - ds) * CAST(0.001 AS DECIMAL(4,3)), 2)
      WHEN 'FSC' THEN round(px * CAST(0.0001 AS DECIMAL(5,4)), 2)
      WHEN 'TAX' THEN round(px * tx * CAST(0.001 AS DECIMAL(4,3)), 2)
      WHEN 'ACC' THEN round(q * CAST(0.35 AS DECIMAL(3,2)), 2)
      WHEN 'BRK' THEN 45
      WHEN 'GOV' THEN round(px * CAST(0.0005 AS DECIMAL(5,4)), 2)
      WHEN 'MSC' THEN 5
      ELSE 0 END AS DECIMAL(18,4)) AS net_amount,
    CAST(CASE WHEN kind = 'FRT' AND NOT (l_quantity = 7 AND l_linenumber = 7)
      THEN q * q * CAST(0.025 AS DECIMAL(4,3)) ELSE 0 END AS DECIMAL(18,4)) AS actual_weight,
    CASE WHEN p_size % 3 = 0 THEN CAST(1.5 AS DECIMAL(2,1)) ELSE CAST(1 AS DECIMAL(2,1)) END
      AS oversize,
    CASE WHEN kind <> 'FSC' THEN CASE WHEN back THEN s_country ELSE c_country END END
      AS recipient_country,
    CASE WHEN back THEN c_country ELSE s_country END AS sender_country,
    CASE WHEN back THEN s_name ELSE c_name END AS recipient_name,
    CASE WHEN back THEN c_name ELSE s_name END AS sender_name,
    p_type AS goods_description,
    concat('orders_', year(o_orderdate), '.csv') AS source_file,
    CASE WHEN kind = 'ACC' AND c_mktsegment = 'MACHINERY'
      THEN concat('ENTERED WEIGHT: ', CAST(l_quantity AS INT), '.0 KGS') END
      AS entered_weight_note,
    CASE WHEN kind = 'ACC' AND c_mktsegment = 'MACHINERY'
      THEN concat('AUDITED WEIGHT: ', CAST(l_quantity AS INT) + 1, '.0 KGS') END
      AS audited_weight_note,
    o_custkey % 10 = 0 AS overbilled
  FROM k
),
all_lines AS (
  SELECT * EXCLUDE (oversize),
    CAST(actual_weight * oversize AS DECIMAL(18,4)) AS billed_weight,
    net_amount AS total_charge,
    CASE WHEN charge_category = 'FRT' AND charge_description IS NOT NULL THEN charge_description
         ELSE CASE service_code WHEN '003' THEN 'TB Standard' WHEN '704' THEN 'WW Standard'
              WHEN '007' THEN 'WW Express Saver'
              WHEN '353' THEN 'TB Standard Undeliverable Return' ELSE 'Other' END END
      AS service_name,
    CASE charge_category WHEN 'FRT' THEN 'Freight' WHEN 'FSC' THEN 'Fuel Surcharge'
         WHEN 'TAX' THEN 'Tax (VAT)' WHEN 'ACC' THEN 'Accessorial' WHEN 'BRK' THEN 'Brokerage'
         WHEN 'GOV' THEN 'Government Charges' WHEN 'MSC' THEN 'Miscellaneous'
         ELSE 'Other' END AS charge_category_name,
    package_indicator = '1' AS is_package_line,
    shipment_type = 'RTN' AS is_return
  FROM f
),
dim AS (
  SELECT n_name AS alpha2, concat(n_name, ' / ', r_name) AS name,
         CASE WHEN n_nationkey <> 24 THEN concat('N', lpad(CAST(n_nationkey AS VARCHAR), 2, '0'))
         END AS alpha3
  FROM nation JOIN region ON n_regionkey = r_regionkey
  WHERE n_nationkey <> 23
)"""

_FIRSTS = (
    "invoice_number invoice_date shipment_date order_reference service_code charge_description "
    "actual_weight billed_weight sender_name sender_country recipient_name recipient_country "
    "shipment_type shipment_subtype goods_description is_return source_file"
).split()


def _packages(attribute_rows: str, service_name: str) -> str:
    firsts = ",\n    ".join(f"arg_min({c}, ord) AS {c}" for c in _FIRSTS)
    return f"""
base AS (
  SELECT tracking_number,
    {firsts},
    {service_name}
  FROM L WHERE tracking_number IS NOT NULL AND {attribute_rows}
  GROUP BY tracking_number
),
sums AS (
  SELECT tracking_number, sum(discount_amount) AS discount_amount,
         sum(net_amount) AS net_amount, sum(total_charge) AS total_charge
  FROM L WHERE tracking_number IS NOT NULL GROUP BY tracking_number
),
P AS (
  SELECT base.*, CAST(NULL AS VARCHAR) AS sender_city, CAST(NULL AS VARCHAR) AS recipient_city,
         CAST(NULL AS VARCHAR) AS recipient_company,
         sums.discount_amount, sums.net_amount, sums.total_charge
  FROM base LEFT JOIN sums USING (tracking_number)
)"""


_FREIGHT_P = _packages(
    "package_indicator = '1' AND charge_category = 'FRT'",
    "arg_min(charge_description, ord) AS service_name",
)


def lines_sql(body: str, where: str = "true") -> str:
    return f"WITH {_BASE},\nL AS (SELECT * FROM all_lines WHERE {where})\n{body}"


def packages_sql(body: str, where: str = "true", more: str = "") -> str:
    extra = f",\n{more}" if more else ""
    return (
        f"WITH {_BASE},\nL AS (SELECT * FROM all_lines WHERE {where}),{_FREIGHT_P}{extra}\n{body}"
    )


def dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def total(expr: str, where: str | None = None) -> str:
    cond = f" FILTER (WHERE {where})" if where else ""
    return f"coalesce(CAST(sum({expr}){cond} AS DOUBLE), 0.0)"


def r2(expr: str) -> str:
    return f"(round_even(({expr}) * 100, 0) / 100)"


def money(expr: str) -> str:
    return f"format('{{:,.2f}}', {expr})"


def tenths(expr: str) -> str:
    return f"format('{{:,.1f}}', {expr})"


def ptenths(expr: str) -> str:
    return f"format('{{:.1f}}', {expr})"


def count_text(expr: str) -> str:
    return f"format('{{:,}}', CAST({expr} AS BIGINT))"


def name_join(table: str, cols: str = "*") -> str:
    return (
        f"SELECT {table}.{cols}, coalesce(dim.name, {table}.country_code) AS country_name "
        f"FROM {table} LEFT JOIN dim ON dim.alpha2 = {table}.country_code"
    )


# --- reusable pieces -----------------------------------------------------------

BREAKDOWN = f"""
cat AS (
  SELECT charge_category, charge_category_name, {total('discount_amount')} AS discount_amount,
         {total('net_amount')} AS net_amount, {total('total_charge')} AS total_charge
  FROM L WHERE charge_category IS NOT NULL GROUP BY 1, 2
),
breakdown AS (
  SELECT cat.*, {r2('total_charge / (SELECT sum(CAST(total_charge AS DECIMAL(30,4))) FROM cat)::DOUBLE * 100')}
         AS percentage FROM cat
)"""

DESTINATION = f"""
dest0 AS (
  SELECT recipient_country AS country_code, count(*) AS package_count,
         {total('total_charge')} AS total_cost, {total('billed_weight')} AS total_weight,
         count(*) FILTER (WHERE is_return) AS return_count
  FROM P WHERE recipient_country IS NOT NULL GROUP BY 1
),
dest1 AS ({name_join('dest0')}),
destination AS (
  SELECT *, {r2('total_cost / package_count')} AS avg_cost_per_package,
         {r2('return_count / package_count * 100')} AS return_rate FROM dest1
)"""

SUMMARY = f"""
lt AS (
  SELECT count(DISTINCT invoice_number) AS total_invoices,
    {total('total_charge', "charge_category = 'FRT'")} AS total_freight,
    {total('total_charge', "charge_category = 'FSC'")} AS total_fuel_surcharge,
    {total('total_charge', "charge_category = 'TAX'")} AS total_tax,
    {total('total_charge', "charge_category = 'ACC'")} AS total_accessorial,
    strftime(min(shipment_date), '%Y-%m-%d') AS date_from,
    strftime(max(shipment_date), '%Y-%m-%d') AS date_to,
    coalesce(arg_min(currency, ord), 'EUR') AS currency
  FROM L
),
pt AS (
  SELECT count(*) AS total_packages, {total('total_charge')} AS total_cost,
    CASE WHEN count(*) > 0 THEN {dbl('sum(total_charge)')} / count(*) ELSE 0.0 END
      AS avg_cost_per_package,
    {total('billed_weight')} AS total_weight_kg,
    CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE is_return) / count(*) * 100 ELSE 0.0 END
      AS return_rate
  FROM P
),
td AS (
  SELECT recipient_country AS top_destination_country FROM P WHERE recipient_country IS NOT NULL
  GROUP BY 1 ORDER BY count(*) DESC, min(tracking_number) LIMIT 1
),
summary AS (
  SELECT lt.*, pt.*, (SELECT top_destination_country FROM td) AS top_destination_country
  FROM lt CROSS JOIN pt
)"""


def trend_cte(fmt: str) -> str:
    return f"""
trend AS (
  SELECT strftime(shipment_date, '{fmt}') AS period, count(*) AS package_count,
         {total('total_charge')} AS total_cost, {total('billed_weight')} AS total_weight,
         {r2(dbl('sum(total_charge)') + ' / count(*)')} AS avg_cost_per_package
  FROM P WHERE shipment_date IS NOT NULL GROUP BY 1
)"""


SERVICE = f"""
service AS (
  SELECT service_code, service_name, count(*) AS package_count,
         {total('total_charge')} AS total_cost, {total('billed_weight')} AS total_weight,
         {r2(dbl('sum(total_charge)') + ' / count(*)')} AS avg_cost_per_package
  FROM P WHERE service_code IS NOT NULL AND service_name IS NOT NULL GROUP BY 1, 2
)"""

RETURNS = f"""
ret_summary AS (
  SELECT count(*) FILTER (WHERE is_return) AS total_returns,
    {total('total_charge', 'is_return')} AS total_return_cost,
    count(*) FILTER (WHERE is_return) / count(*) * 100 AS return_rate,
    CAST(sum(total_charge) FILTER (WHERE is_return) AS DOUBLE)
      / count(*) FILTER (WHERE is_return) AS avg_return_cost
  FROM P HAVING count(*) FILTER (WHERE is_return) > 0
),
ret_reason AS (
  SELECT shipment_subtype AS reason, count(*) AS count, {total('total_charge')} AS total_cost
  FROM P WHERE is_return AND shipment_subtype IS NOT NULL GROUP BY 1
),
ret_country0 AS (
  SELECT sender_country AS country_code, count(*) AS return_count,
         {total('total_charge')} AS return_cost
  FROM P WHERE is_return AND sender_country IS NOT NULL GROUP BY 1
),
ret_country AS ({name_join('ret_country0')})"""

WEIGHTS = f"""
W AS (
  SELECT tracking_number, total_charge, actual_weight, billed_weight,
         billed_weight - actual_weight AS weight_diff
  FROM P WHERE billed_weight > 0 OR actual_weight > 0
),
w_summary AS (
  SELECT {total('actual_weight')} AS total_actual_weight,
    {total('billed_weight')} AS total_billed_weight,
    {dbl('sum(actual_weight)')} / count(*) AS avg_actual_weight,
    {dbl('sum(billed_weight)')} / count(*) AS avg_billed_weight,
    CASE WHEN sum(actual_weight) > 0
      THEN {dbl('sum(billed_weight) - sum(actual_weight)')} / {dbl('sum(actual_weight)')} * 100
      ELSE 0.0 END AS weight_premium,
    count(*) FILTER (WHERE weight_diff > 0) AS packages_with_dim_weight
  FROM W HAVING count(*) > 0
),
w_dist AS (
  SELECT weight_range, count(*) AS package_count, {total('total_charge')} AS total_cost
  FROM (SELECT *, CASE WHEN billed_weight <= 0 THEN NULL WHEN billed_weight <= 0.5 THEN '0-0.5kg'
          WHEN billed_weight <= 1 THEN '0.5-1kg' WHEN billed_weight <= 2 THEN '1-2kg'
          WHEN billed_weight <= 5 THEN '2-5kg' WHEN billed_weight <= 10 THEN '5-10kg'
          WHEN billed_weight <= 20 THEN '10-20kg' WHEN billed_weight <= 50 THEN '20-50kg'
          ELSE '50kg+' END AS weight_range FROM W)
  WHERE weight_range IS NOT NULL GROUP BY 1
),
w_sample AS (
  SELECT tracking_number, {dbl('actual_weight')} AS actual_weight,
         {dbl('billed_weight')} AS billed_weight, {dbl('weight_diff')} AS weight_diff
  FROM W ORDER BY md5(concat(tracking_number, '42')), tracking_number LIMIT 1000
)"""

DUTIES = f"""
imp AS (SELECT * FROM L WHERE shipment_subtype = 'IMP'),
d_summary0 AS (
  SELECT {total('net_amount')} AS total_cost,
    count(DISTINCT tracking_number) + max(CAST(tracking_number IS NULL AS INT)) AS shipment_count,
    {total('net_amount', "charge_category = 'BRK'")} AS brokerage_cost,
    {total('net_amount', "charge_category = 'GOV'")} AS customs_cost,
    coalesce(CAST(sum(net_amount) - sum(CASE WHEN charge_category IN ('BRK', 'GOV')
      THEN net_amount ELSE 0 END) AS DOUBLE), 0.0) AS other_cost
  FROM imp HAVING count(*) > 0
),
d_summary AS (SELECT *, total_cost / shipment_count AS avg_cost_per_shipment FROM d_summary0),
d_type AS (
  SELECT charge_category, charge_category_name AS charge_name, {total('net_amount')} AS total_cost,
         count(DISTINCT tracking_number) AS shipment_count
  FROM imp WHERE charge_category IS NOT NULL GROUP BY 1, 2
),
d_ship AS (
  SELECT tracking_number, arg_min(recipient_country, ord) AS recipient_country,
    arg_min(recipient_name, ord) AS recipient_name, CAST(NULL AS VARCHAR) AS recipient_city,
    arg_min(order_reference, ord) AS order_reference, arg_min(shipment_date, ord) AS shipment_date,
    sum(net_amount) AS net_amount
  FROM imp WHERE tracking_number IS NOT NULL GROUP BY 1
),
d_country0 AS (
  SELECT recipient_country AS country_code, count(*) AS shipment_count,
         {total('net_amount')} AS total_cost
  FROM d_ship WHERE recipient_country IS NOT NULL GROUP BY 1
),
d_country AS (
  SELECT *, {r2('total_cost / shipment_count')} AS avg_cost_per_shipment
  FROM ({name_join('d_country0')})
),
d_part AS (
  SELECT tracking_number, charge_category, sum(net_amount) AS amount
  FROM imp WHERE tracking_number IS NOT NULL GROUP BY 1, 2
),
d_detail AS (
  SELECT s.tracking_number, s.recipient_country AS country, s.recipient_name AS recipient,
    s.recipient_city AS city, s.order_reference, s.shipment_date,
    {dbl('s.net_amount')} AS total_cost, {dbl('coalesce(b.amount, 0)')} AS BRK,
    {dbl('coalesce(g.amount, 0)')} AS GOV
  FROM d_ship s
  LEFT JOIN d_part b ON b.tracking_number = s.tracking_number AND b.charge_category = 'BRK'
  LEFT JOIN d_part g ON g.tracking_number = s.tracking_number AND g.charge_category = 'GOV'
)"""

ACC = f"""
acc AS (SELECT * FROM L WHERE charge_category = 'ACC'),
a_summary0 AS (
  SELECT {total('net_amount')} AS total_cost, count(*) AS charge_count,
    count(DISTINCT tracking_number) AS shipment_count,
    {total('net_amount', "charge_code = 'RES'")} AS residential_cost,
    {total('net_amount', "charge_code IN ('PFR', 'PFC')")} AS surge_cost,
    {total('net_amount', "charge_code IN ('RDS', 'ESD', 'LDS', 'HIS', 'AKS')")}
      AS area_surcharge_cost
  FROM acc HAVING count(*) > 0
),
a_summary AS (
  SELECT *, CASE WHEN shipment_count > 0 THEN total_cost / shipment_count ELSE 0.0 END
    AS avg_per_shipment FROM a_summary0
),
a_code AS (
  SELECT charge_code, charge_description AS description, {total('net_amount')} AS total_cost,
         count(DISTINCT tracking_number) AS shipment_count
  FROM acc WHERE charge_code IS NOT NULL AND charge_description IS NOT NULL GROUP BY 1, 2
),
a_where AS (
  SELECT tracking_number, arg_min(recipient_country, ord) AS recipient_country
  FROM L WHERE recipient_country IS NOT NULL AND tracking_number IS NOT NULL GROUP BY 1
),
a_parcel AS (
  SELECT tracking_number, sum(net_amount) AS acc_cost
  FROM acc WHERE tracking_number IS NOT NULL GROUP BY 1
),
a_placed AS (SELECT * FROM a_parcel LEFT JOIN a_where USING (tracking_number)),
a_country0 AS (
  SELECT recipient_country AS country_code, count(*) AS shipment_count,
         {total('acc_cost')} AS total_cost
  FROM a_placed WHERE recipient_country IS NOT NULL GROUP BY 1
),
a_country AS (
  SELECT *, {r2('total_cost / shipment_count')} AS avg_per_shipment
  FROM ({name_join('a_country0')})
),
a_trend AS (
  SELECT strftime(shipment_date, '%Y-%m') AS period, {total('net_amount')} AS total_cost,
         count(DISTINCT tracking_number) AS shipment_count
  FROM acc WHERE shipment_date IS NOT NULL GROUP BY 1
)"""


def top_cte(n: int) -> str:
    return f"""
top AS (
  SELECT tracking_number, order_reference, shipment_date, recipient_name, recipient_company,
    recipient_city, recipient_country, sender_name, sender_country, service_name,
    {dbl('billed_weight')} AS billed_weight, goods_description,
    {dbl('total_charge')} AS total_charge, shipment_type, is_return
  FROM P ORDER BY P.total_charge DESC, tracking_number LIMIT {n}
)"""


PACKAGE_COLUMNS = ", ".join(
    ["tracking_number", "service_name", "sender_city", "recipient_city", "recipient_company"]
    + [c for c in _FIRSTS if not c.endswith("_weight")]
    + [f"{dbl(c)} AS {c}" for c in ("actual_weight", "billed_weight")]
    + [f"{dbl(c)} AS {c}" for c in ("discount_amount", "net_amount", "total_charge")]
)
ATTRIBUTE_COLUMNS = ", ".join(
    ["tracking_number", "service_name"]
    + [c for c in _FIRSTS if not c.endswith("_weight")]
    + [f"{dbl(c)} AS {c}" for c in ("actual_weight", "billed_weight")]
    + [f"CAST(NULL AS VARCHAR) AS {c}" for c in ("sender_city", "recipient_city", "recipient_company")]
)

NA_LIST = (
    "'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', "
    "'<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'"
)

# Filters used by the queries of the same names.
START, END = "1997-01-01", "1998-06-30"
COUNTRIES = ("NATION_3", "NATION_7", "NATION_11")
SERVICES = ("003", "704")

F_START = f"shipment_date >= DATE '{START}'"
F_END = f"shipment_date <= DATE '{END}'"
F_COUNTRIES = "recipient_country IN ('NATION_3', 'NATION_7', 'NATION_11')"
F_SERVICES = "service_code IN ('003', '704')"
F_RETURNS = "is_return"
F_MOST = f"{F_START} AND {F_END} AND {F_COUNTRIES} AND {F_SERVICES}"


def _chain(*ctes: str) -> str:
    return ",".join(c.strip("\n") for c in ctes)


def filtered(where: str) -> str:
    body = f"""SELECT count(*) AS lines, count(DISTINCT tracking_number) AS parcels,
      {total('net_amount')} AS net_amount FROM L"""
    return lines_sql(body, where)


_PARCELS_BY_CATEGORY = """SELECT cat.*, n.package_count FROM cat JOIN (SELECT charge_category,
    count(DISTINCT tracking_number) AS package_count FROM L GROUP BY 1) n USING (charge_category)"""


def lines_with(ctes: str, body: str, where: str = "true") -> str:
    return f"WITH {_BASE},\nL AS (SELECT * FROM all_lines WHERE {where}),{ctes}\n{body}"


def packages_with(ctes: str, body: str, where: str = "true") -> str:
    return packages_sql(body, where, ctes.strip("\n"))


def lines_columns(cols: str) -> str:
    return lines_sql(f"SELECT tracking_number, charge_category, {cols} FROM L")


_ORDER_FILES = """
  SELECT concat('INV', o_orderkey) AS invoice_number, CAST(o_orderdate AS DATE) AS invoice_date,
         CAST(CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE CAST(o_totalprice AS DECIMAL(18,2)) END
           AS DOUBLE) AS net_amount,
         concat('Café Müller "', o_custkey, '", x') AS recipient_name
  FROM orders"""


SCANNED = tuple(POSITIONS)
# Mapped fields that the sample lines leave empty.
_EMPTY = {
    "version", "account_number", "shipper_number", "country_code", "invoice_type", "invoice_type_detail", "vat_number",
    "invoice_total", "reference_1", "payment_terms", "actual_weight_unit", "billed_weight_unit", "package_type", "zone",
    "sender_street", "sender_city", "sender_postal", "recipient_company", "recipient_street", "recipient_city",
    "recipient_postal", "pickup_date", "delivery_date", "declared_value",
}


def _scanned(name: str) -> str:
    """A field's text as it stands in the files, null if empty: fields to be trimmed have blanks around them."""
    value = "NULL" if name in _EMPTY else name
    if name in NUMERIC_FIELDS:
        return f"CAST(CAST(coalesce({value}, 0) AS DECIMAL(28,4)) AS VARCHAR)"
    text = f"coalesce(CAST({value} AS VARCHAR), '')"
    return f"concat(' ', {text}, '  ')" if name in TRIMMED_FIELDS else f"nullif({text}, '')"


def sources() -> dict[str, str]:
    return {
        "scan_headerless_csv": lines_sql(f"SELECT {', '.join(f'{_scanned(n)} AS {n}' for n in SCANNED)} FROM L"),
        "scan_ragged_rows": """
            WITH r AS (
              SELECT concat('supp_', l_suppkey % 10) AS source_file,
                row_number() OVER (PARTITION BY l_suppkey % 10 ORDER BY l_orderkey, l_linenumber,
                  l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax,
                  l_returnflag, l_linestatus) AS n,
                CASE WHEN l_partkey % 13 = 0 THEN 0 WHEN l_partkey % 11 = 0 THEN 4
                     WHEN l_partkey % 7 = 0 THEN 2 ELSE 3 END AS width,
                CAST(l_orderkey AS VARCHAR) AS c0, concat('a,"', l_linenumber, '"') AS c1,
                CAST(l_partkey AS VARCHAR) AS c2
              FROM lineitem),
            w AS (SELECT source_file, arg_min(width, n) AS first_width FROM r WHERE width > 0
                  GROUP BY 1)
            SELECT source_file, c0, c1, CASE WHEN width >= 3 THEN c2 END AS c2,
                   CASE WHEN width >= 4 THEN 'x' END AS c3
            FROM r JOIN w USING (source_file) WHERE width > 0 AND width <= first_width""",
        "scan_null_tokens": f"""
            WITH t AS (SELECT p_partkey, p_name, [{NA_LIST}, ' NA', 'nada', 'Na', 'NULL ', 'none']
                       AS tokens FROM part)
            SELECT p_partkey, CASE WHEN raw NOT IN ({NA_LIST}) THEN raw END AS value
            FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name
                         ELSE tokens[CAST(p_partkey % 24 + 1 AS INT)] END AS raw FROM t)""",
        "decode_charset": """
            SELECT concat('file_', c_nationkey) AS source_file, c_custkey,
              CASE WHEN c_custkey % 3 = 0 THEN c_name
                   WHEN c_custkey % 3 = 1 THEN concat(c_name, ' Müller')
                   WHEN c_nationkey % 2 = 0 OR umlauts THEN concat(c_name, ' Ã¼')
                   ELSE concat(c_name, ' ü') END AS value
            FROM customer JOIN (SELECT c_nationkey, bool_or(c_custkey % 3 = 1) AS umlauts
                                FROM customer GROUP BY 1) USING (c_nationkey)""",
        "project_positions": lines_sql(
            """SELECT '' AS _x, tracking_number, charge_category, recipient_country,
               CAST(NULL AS VARCHAR) AS pickup_date, CAST(NULL AS VARCHAR) AS goods_description,
               CAST(NULL AS VARCHAR) AS audited_weight_note FROM L"""
        ).replace("'' AS _x, ", ""),
        "source_lineage": lines_sql(
            f"""SELECT source_file, count(*) AS lines, {total('net_amount')} AS net_amount
                FROM L GROUP BY 1"""
        ),
        "refresh_lines": lines_sql(
            f"""SELECT source_file, count(*) AS lines, {total('net_amount')} AS net_amount
                FROM L GROUP BY 1"""
        ),
        "scan_folder": _ORDER_FILES,
        "union_files": f"""
            SELECT count(*) AS lines, count(DISTINCT invoice_number) AS invoices,
                   CAST(sum(CAST(net_amount AS DECIMAL(18,4))) AS DOUBLE) AS net_amount,
                   min(invoice_date) AS first_date, max(invoice_date) AS last_date
            FROM ({_ORDER_FILES})""",
        "isolate_bad_files": """
            SELECT status, CASE status WHEN 'loaded' THEN n ELSE 0 END AS rows,
                   CASE status WHEN 'loaded' THEN bad ELSE 0 END AS bad_amounts,
                   CASE status WHEN 'loaded' THEN 'utf-8' END AS charset
            FROM (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey % 10 = 0) AS bad
                  FROM orders) CROSS JOIN (VALUES ('loaded'), ('empty'), ('failed'), ('missing')) AS v(status)""",
    }


def typing() -> dict[str, str]:
    return {
        "coerce_numeric": f"""
            SELECT l_orderkey, l_linenumber, l_partkey,
              CAST(CASE l_linenumber WHEN 1 THEN px WHEN 2 THEN px WHEN 3 THEN 0 WHEN 4 THEN 0
                WHEN 5 THEN px * 1000 WHEN 6 THEN 0 ELSE 0 END AS DOUBLE) AS net_amount
            FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS px FROM lineitem)""",
        "coerce_date": """
            SELECT l_orderkey, l_linenumber, l_partkey,
              CASE WHEN l_linenumber <= 3 THEN CAST(l_shipdate AS DATE) END AS shipment_date
            FROM lineitem""",
        "trim_to_null": """
            SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name
              WHEN 4 THEN concat('x', p_name) END AS charge_description
            FROM part""",
    }


def derived() -> dict[str, str]:
    week = "CAST(week(shipment_date) AS INT)"
    month = "strftime(shipment_date, '%Y-%m')"
    return {
        "derive_total_charge": lines_columns(f"{dbl('net_amount')} AS total_charge"),
        "derive_service_name": lines_columns("service_name"),
        "derive_category_name": lines_columns("charge_category_name"),
        "derive_is_package_line": lines_columns("is_package_line"),
        "derive_is_return": lines_columns("is_return"),
        "derive_weight_difference": lines_columns(
            f"{dbl('billed_weight - actual_weight')} AS weight_difference"
        ),
        "derive_iso_week": lines_columns(f"{week} AS shipment_week"),
        "derive_month": lines_columns(f"{month} AS shipment_month"),
        "derive_year_month": lines_columns(f"{month} AS shipment_year_month"),
    }


def filters() -> dict[str, str]:
    label = "concat(service_code, ' - ', service_name)"
    return {
        "filter_start_date": filtered(F_START),
        "filter_end_date": filtered(F_END),
        "filter_countries": filtered(F_COUNTRIES),
        "filter_services": filtered(F_SERVICES),
        "filter_returns_only": filtered(F_RETURNS),
        "filter_combined": packages_sql(
            f"SELECT tracking_number, {dbl('total_charge')} AS total_charge FROM P", F_MOST
        ),
        "filter_then_summary": packages_with(SUMMARY, "SELECT * FROM summary", F_MOST),
        "filter_then_destinations": packages_with(
            DESTINATION, "SELECT * FROM destination", F_RETURNS
        ),
        "facet_date_bounds": lines_sql(
            "SELECT min(shipment_date) AS min_date, max(shipment_date) AS max_date FROM L"
        ),
        "facet_countries": lines_sql(
            "SELECT DISTINCT recipient_country FROM L WHERE recipient_country IS NOT NULL"
        ),
        "facet_services": lines_sql(
            f"""SELECT *, {label} AS label FROM (SELECT service_code,
                arg_min(service_name, ord) AS service_name FROM L
                WHERE service_code IS NOT NULL GROUP BY 1)"""
        ),
        "landed_date_bounds": lines_sql(
            "SELECT min(shipment_date) AS min_date, max(shipment_date) AS max_date FROM L"
        ),
        "cells_charge_breakdown": lines_with(BREAKDOWN, _PARCELS_BY_CATEGORY),
        "cells_acc_by_code": lines_with(ACC, "SELECT * FROM a_code"),
        "cells_filtered_trends": lines_with(ACC, "SELECT * FROM a_trend", F_MOST),
        "landed_countries": lines_sql(
            "SELECT DISTINCT recipient_country FROM L WHERE recipient_country IS NOT NULL"
        ),
        "landed_services": lines_sql(
            f"""SELECT *, {label} AS label FROM (SELECT service_code,
                arg_min(service_name, ord) AS service_name FROM L
                WHERE service_code IS NOT NULL GROUP BY 1)"""
        ),
        "parse_facet_label": lines_sql(
            f"""SELECT {label} AS label, service_code AS code FROM (SELECT service_code,
                arg_min(service_name, ord) AS service_name FROM L
                WHERE service_code IS NOT NULL GROUP BY 1)"""
        ),
    }


def rollup() -> dict[str, str]:
    no_freight = f"WITH {_BASE},\nL AS (SELECT * REPLACE (CASE WHEN charge_category = 'FRT' THEN 'INF' ELSE charge_category END AS charge_category) FROM all_lines)," + _packages(
        "package_indicator = '1'", "arg_min(service_name, ord) AS service_name"
    )
    return {
        "package_base_rows": lines_sql(
            """SELECT tracking_number, invoice_number, service_code FROM L
               WHERE package_indicator = '1' AND charge_category = 'FRT'"""
        ),
        "package_attributes": packages_sql(f"SELECT {ATTRIBUTE_COLUMNS} FROM base"),
        "package_fallback": no_freight
        + f"""SELECT tracking_number, service_name, CAST(NULL AS VARCHAR) AS charge_description,
              recipient_country, {dbl('total_charge')} AS total_charge FROM P""",
        "charge_totals": packages_sql(
            f"""SELECT tracking_number, {dbl('discount_amount')} AS discount_amount,
                {dbl('net_amount')} AS net_amount, {dbl('total_charge')} AS total_charge
                FROM sums"""
        ),
        "packages": packages_sql(f"SELECT {PACKAGE_COLUMNS} FROM P"),
        "refresh_packages": packages_sql(f"SELECT {PACKAGE_COLUMNS} FROM P"),
    }


def summaries() -> dict[str, str]:
    def pick(cols: str) -> str:
        return packages_with(SUMMARY, f"SELECT {cols} FROM summary")

    return {
        "summary": pick("*"),
        "summary_top_destination": pick("top_destination_country"),
        "summary_date_range": pick("date_from, date_to"),
        "summary_return_rate": pick("return_rate"),
        "summary_currency": pick("currency"),
        "summary_category_totals": pick(
            "total_freight, total_fuel_surcharge, total_tax, total_accessorial"
        ),
        "summary_counts": pick("total_invoices, total_packages"),
        "summary_cost": pick("total_cost, avg_cost_per_package"),
        "summary_weight": pick("total_weight_kg"),
        "summary_empty": packages_with(
            SUMMARY, "SELECT * FROM summary", "recipient_country = 'nowhere'"
        ),
    }


def analyses() -> dict[str, str]:
    pivot = ", ".join(
        f"{total('amount', chr(34) + 'charge_category' + chr(34) + f' = {chr(39)}{c}{chr(39)}')} AS {c}"
        for c in "ACC BRK DAS EXM FRT FSC GOV INF MSC RES TAX".split()
    )
    known = "('ACC','BRK','DAS','EXM','FRT','FSC','GOV','INF','MSC','RES','TAX')"
    return {
        "cost_breakdown": lines_with(
            BREAKDOWN,
            """SELECT charge_category, charge_category_name, discount_amount, net_amount,
               total_charge FROM breakdown""",
        ),
        "cost_breakdown_pct": lines_with(BREAKDOWN, "SELECT * FROM breakdown"),
        "charge_breakdown": lines_with(BREAKDOWN, _PARCELS_BY_CATEGORY),
        "by_destination": packages_with(DESTINATION, "SELECT * FROM dest0"),
        "by_destination_enriched": packages_with(DESTINATION, "SELECT * FROM destination"),
        "country_lookup": packages_with(
            DESTINATION, "SELECT country_code, country_name FROM dest1"
        ),
        "trends_week": packages_with(trend_cte("%Y-W%W"), "SELECT * FROM trend"),
        "trends_month": packages_with(trend_cte("%Y-%m"), "SELECT * FROM trend"),
        "by_service": packages_with(SERVICE, "SELECT * FROM service"),
        "returns_filter": packages_sql(
            f"""SELECT tracking_number, sender_country, {dbl('total_charge')} AS total_charge
                FROM P WHERE is_return"""
        ),
        "returns_summary": packages_with(RETURNS, "SELECT * FROM ret_summary"),
        "returns_by_reason": packages_with(RETURNS, "SELECT * FROM ret_reason"),
        "returns_by_country": packages_with(RETURNS, "SELECT * FROM ret_country"),
        "weights_filter": packages_with(
            WEIGHTS,
            f"""SELECT tracking_number, {dbl('actual_weight')} AS actual_weight,
                {dbl('billed_weight')} AS billed_weight FROM W""",
        ),
        "weights_diff": packages_with(
            WEIGHTS, f"SELECT tracking_number, {dbl('weight_diff')} AS weight_diff FROM W"
        ),
        "weights_summary": packages_with(WEIGHTS, "SELECT * FROM w_summary"),
        "weights_distribution": packages_with(WEIGHTS, "SELECT * FROM w_dist"),
        "weights_detail": packages_with(
            WEIGHTS,
            f"""SELECT tracking_number, {dbl('actual_weight')} AS actual_weight,
                {dbl('billed_weight')} AS billed_weight, {dbl('weight_diff')} AS weight_diff
                FROM W""",
        ),
        "duties_filter": lines_with(
            DUTIES,
            f"""SELECT charge_category, count(*) AS lines, {total('net_amount')} AS net_amount
                FROM imp GROUP BY 1""",
        ),
        "duties_summary": lines_with(DUTIES, "SELECT * FROM d_summary"),
        "duties_by_charge_type": lines_with(DUTIES, "SELECT * FROM d_type"),
        "duties_shipments": lines_with(
            DUTIES,
            f"""SELECT tracking_number, recipient_country, recipient_name, recipient_city,
                order_reference, shipment_date, {dbl('net_amount')} AS net_amount FROM d_ship""",
        ),
        "duties_by_country": lines_with(DUTIES, "SELECT * FROM d_country"),
        "duties_pivot": lines_with(
            DUTIES,
            f"""SELECT tracking_number, {pivot},
                {total('amount', f'charge_category NOT IN {known}')} AS OTHER
                FROM d_part WHERE charge_category IS NOT NULL GROUP BY 1""",
        ),
        "duties_detail": lines_with(DUTIES, "SELECT * FROM d_detail"),
        "acc_filter": lines_with(
            ACC,
            f"""SELECT charge_code, count(*) AS lines, {total('net_amount')} AS net_amount
                FROM acc GROUP BY 1""",
        ),
        "acc_summary": lines_with(ACC, "SELECT * FROM a_summary"),
        "acc_by_code": lines_with(ACC, "SELECT * FROM a_code"),
        "tracking_country": lines_with(ACC, "SELECT * FROM a_where"),
        "acc_by_tracking": lines_with(
            ACC, f"SELECT tracking_number, {dbl('acc_cost')} AS acc_cost FROM a_parcel"
        ),
        "acc_with_country": lines_with(
            ACC,
            f"""SELECT tracking_number, {dbl('acc_cost')} AS acc_cost, recipient_country
                FROM a_placed""",
        ),
        "acc_by_country": lines_with(ACC, "SELECT * FROM a_country"),
        "acc_trends": lines_with(ACC, "SELECT * FROM a_trend"),
        "top_expenses": packages_with(top_cte(20), "SELECT * FROM top"),
    }


def chart_data() -> dict[str, str]:
    share = r2("total_cost / (SELECT sum(CAST(total_cost AS DECIMAL(30,4))) FROM d_type)::DOUBLE * 100")
    return {
        "kpi_cards": packages_with(
            SUMMARY,
            f"""SELECT concat({money('total_cost')}, ' ', currency) AS total_cost,
              {count_text('total_packages')} AS total_packages,
              concat({money('avg_cost_per_package')}, ' ', currency) AS avg_cost,
              concat({tenths('total_weight_kg')}, ' kg') AS total_weight,
              concat({ptenths('return_rate')}, '%') AS return_rate,
              CAST(total_invoices AS VARCHAR) AS total_invoices,
              CASE WHEN total_cost > 0 THEN
                concat({ptenths('total_freight / total_cost * 100')}, '%') ELSE '0%' END
                AS freight_pct,
              CASE WHEN total_cost > 0 THEN
                concat({ptenths('total_fuel_surcharge / total_cost * 100')}, '%') ELSE '0%' END
                AS fuel_pct FROM summary""",
        ),
        "map_points": packages_with(
            DESTINATION,
            """SELECT d.*, dim.alpha3 AS country_code_alpha3 FROM destination d
               JOIN dim ON dim.alpha2 = d.country_code WHERE dim.alpha3 IS NOT NULL""",
        ),
        "top_destinations": packages_with(
            DESTINATION,
            """SELECT country_name, country_code, total_cost, package_count FROM destination
               ORDER BY total_cost DESC, country_code LIMIT 15""",
        ),
        "return_reasons_top": packages_with(
            RETURNS,
            """SELECT *, CASE WHEN length(reason) > 40 THEN concat(substring(reason, 1, 40), '...')
               ELSE reason END AS reason_short FROM ret_reason
               ORDER BY count DESC, reason LIMIT 15""",
        ),
        "weight_sample": packages_with(WEIGHTS, "SELECT * FROM w_sample"),
        "weight_axis_max": packages_with(
            WEIGHTS,
            "SELECT greatest(max(actual_weight), max(billed_weight)) AS max_weight FROM w_sample",
        ),
        "duties_pie": lines_with(
            DUTIES, f"SELECT charge_name, total_cost, {share} AS percentage FROM d_type"
        ),
        "duties_top_countries": lines_with(
            DUTIES,
            """SELECT country_name, country_code, total_cost, shipment_count FROM d_country
               ORDER BY total_cost DESC, country_code LIMIT 15""",
        ),
        "acc_bar": lines_with(
            ACC,
            """SELECT *, concat(charge_code, ' - ', substring(description, 1, 30)) AS label
               FROM a_code ORDER BY total_cost DESC, charge_code, description LIMIT 15""",
        ),
        "acc_top_countries": lines_with(
            ACC,
            """SELECT country_name, country_code, total_cost, shipment_count FROM a_country
               ORDER BY total_cost DESC, country_code LIMIT 15""",
        ),
        "cost_pie": lines_with(
            BREAKDOWN, "SELECT charge_category_name, total_charge, percentage FROM breakdown"
        ),
        "cost_bars": lines_with(
            BREAKDOWN, "SELECT charge_category_name, total_charge FROM breakdown"
        ),
        "trend_series": packages_with(
            trend_cte("%Y-W%W"), "SELECT period, total_cost, package_count FROM trend"
        ),
        "acc_trend_series": lines_with(ACC, "SELECT * FROM a_trend"),
        "service_compare": packages_with(
            SERVICE, "SELECT service_name, total_cost, avg_cost_per_package FROM service"
        ),
        "weight_bars": packages_with(WEIGHTS, "SELECT * FROM w_dist"),
    }


def displays() -> dict[str, str]:
    def cur(x: str) -> str:
        return f"concat({money(x)}, ' EUR')"

    def rows(section: str, start: int, pairs: list[tuple[str, str]], source: str) -> list[str]:
        return [
            f"SELECT '{section}' AS section, {i} AS position, '{label}' AS label, {value} AS value"
            f" FROM {source}"
            for i, (label, value) in enumerate(pairs, start=start)
        ]

    def pct(x: str) -> str:
        return f"concat({ptenths(x)}, '%')"

    report_summary = " UNION ALL ".join(
        rows(
            "Executive Summary",
            1,
            [
                ("Total Cost", cur("total_cost")),
                ("Total Packages", count_text("total_packages")),
                ("Total Invoices", "CAST(total_invoices AS VARCHAR)"),
                ("Average Cost per Package", cur("avg_cost_per_package")),
                ("Total Weight", f"concat({tenths('total_weight_kg')}, ' kg')"),
                ("Return Rate", pct("return_rate")),
            ],
            "summary",
        )
        + rows(
            "Cost Components",
            7,
            [
                ("Freight Charges", cur("total_freight")),
                ("Fuel Surcharges", cur("total_fuel_surcharge")),
                ("Tax (VAT)", cur("total_tax")),
                ("Accessorial Charges", cur("total_accessorial")),
            ],
            "summary",
        )
    )
    report_returns = " UNION ALL ".join(
        rows(
            "Return Shipments Analysis",
            1,
            [
                ("Total Returns", count_text("total_returns")),
                ("Total Return Cost", money("total_return_cost")),
                ("Return Rate", pct("return_rate")),
                ("Average Return Cost", money("avg_return_cost")),
            ],
            "ret_summary",
        )
    )
    return {
        "display_cost": lines_with(
            BREAKDOWN,
            f"""SELECT charge_category_name AS "Charge Type", {money('discount_amount')} AS "Discount",
                {money('net_amount')} AS "Net Amount", {money('total_charge')} AS "Total",
                {pct('percentage')} AS "% of Total" FROM breakdown""",
        ),
        "display_destinations": packages_with(
            DESTINATION,
            f"""SELECT country_name AS "Country", country_code AS "Code",
                {count_text('package_count')} AS "Packages", {money('total_cost')} AS "Total Cost",
                {money('avg_cost_per_package')} AS "Avg Cost", {tenths('total_weight')} AS "Weight (kg)",
                {pct('return_rate')} AS "Return %" FROM destination""",
        ),
        "display_trends": packages_with(
            trend_cte("%Y-W%W"),
            f"""SELECT period AS "Period", {count_text('package_count')} AS "Packages",
                {money('total_cost')} AS "Total Cost", {tenths('total_weight')} AS "Weight (kg)",
                {money('avg_cost_per_package')} AS "Avg Cost/Pkg" FROM trend""",
        ),
        "display_returns_by_country": packages_with(
            RETURNS,
            f"""SELECT country_code, {count_text('return_count')} AS return_count,
                {money('return_cost')} AS return_cost, country_name FROM ret_country""",
        ),
        "display_services": packages_with(
            SERVICE,
            f"""SELECT service_name AS "Service", service_code AS "Code",
                {count_text('package_count')} AS "Packages", {money('total_cost')} AS "Total Cost",
                {money('avg_cost_per_package')} AS "Avg Cost", {tenths('total_weight')} AS "Weight (kg)"
                FROM service""",
        ),
        "display_duties": lines_with(
            DUTIES,
            f"""SELECT tracking_number AS "Tracking #", country AS "Country",
                recipient AS "Recipient", city AS "City", order_reference AS "Order Ref",
                strftime(shipment_date, '%Y-%m-%d') AS "Date", {money('total_cost')} AS "Total",
                {money('BRK')} AS "Brokerage", {money('GOV')} AS "Customs" FROM d_detail""",
        ),
        "display_accessorials": lines_with(
            ACC,
            f"""SELECT charge_code AS "Code", description AS "Description",
                {money('total_cost')} AS "Total Cost", {count_text('shipment_count')} AS "Shipments"
                FROM a_code""",
        ),
        "display_top_expenses": packages_with(
            top_cte(20),
            f"""SELECT tracking_number AS "Tracking #", order_reference AS "Reference",
                strftime(shipment_date, '%Y-%m-%d') AS "Date", recipient_name AS "Recipient",
                recipient_city AS "City", recipient_country AS "Country", service_name AS "Service",
                {ptenths('billed_weight')} AS "Weight (kg)", {money('total_charge')} AS "Cost",
                (SELECT coalesce(arg_min(currency, ord), 'EUR') FROM L) AS "Currency",
                is_return AS "Return?" FROM top""",
        ),
        "metrics_returns": packages_with(
            RETURNS,
            f"""SELECT {count_text('total_returns')} AS "Total Returns",
                {money('total_return_cost')} AS "Return Cost", {pct('return_rate')} AS "Return Rate",
                {money('avg_return_cost')} AS "Avg Return Cost" FROM ret_summary""",
        ),
        "metrics_weights": packages_with(
            WEIGHTS,
            f"""SELECT concat({tenths('total_actual_weight')}, ' kg') AS "Total Actual Weight",
                concat({tenths('total_billed_weight')}, ' kg') AS "Total Billed Weight",
                {pct('weight_premium')} AS "Dim Weight Premium",
                {count_text('packages_with_dim_weight')} AS "Pkgs w/ Dim Weight" FROM w_summary""",
        ),
        "metrics_duties": lines_with(
            DUTIES,
            f"""SELECT {cur('total_cost')} AS "Total Import Costs",
                {count_text('shipment_count')} AS "Shipments",
                {cur('brokerage_cost')} AS "Brokerage Fees", {cur('customs_cost')} AS "Customs Duties",
                {cur('avg_cost_per_shipment')} AS "Avg/Shipment" FROM d_summary""",
        ),
        "metrics_accessorials": lines_with(
            ACC,
            f"""SELECT {cur('total_cost')} AS "Total Accessorials",
                {count_text('shipment_count')} AS "Shipments Affected",
                {cur('residential_cost')} AS "Residential Fees", {cur('surge_cost')} AS "Surge Fees",
                {cur('area_surcharge_cost')} AS "Area Surcharges" FROM a_summary""",
        ),
        "report_title": packages_with(
            SUMMARY,
            """SELECT CASE WHEN date_from IS NULL THEN 'Period: All dates'
               ELSE concat('Period: ', date_from, ' to ', date_to) END AS period_text
               FROM summary""",
        ),
        "report_summary": packages_with(SUMMARY, report_summary),
        "report_cost": lines_with(
            BREAKDOWN,
            f"""SELECT substring(charge_category_name, 1, 30) AS "Charge Type",
                {money('discount_amount')} AS "Discount", {money('net_amount')} AS "Net Amount",
                {pct('percentage')} AS "% of Total" FROM breakdown""",
        ),
        "report_destinations": packages_with(
            DESTINATION,
            f"""SELECT substring(country_name, 1, 20) AS "Country",
                {count_text('package_count')} AS "Packages", {money('total_cost')} AS "Total Cost",
                {money('avg_cost_per_package')} AS "Avg Cost", {tenths('total_weight')} AS "Weight (kg)",
                {pct('return_rate')} AS "Return %" FROM destination
                ORDER BY destination.total_cost DESC, country_code LIMIT 15""",
        ),
        "report_returns": packages_with(RETURNS, report_returns),
        "report_return_types": packages_with(
            RETURNS,
            f"""SELECT coalesce(nullif(substring(reason, 1, 55), ''), 'Unknown') AS "Type",
                {count_text('count')} AS "Count", {money('total_cost')} AS "Total Cost"
                FROM ret_reason ORDER BY ret_reason.count DESC, reason LIMIT 10""",
        ),
        "report_top": packages_with(
            top_cte(15),
            """SELECT right(tracking_number, 12) AS "Tracking #",
               coalesce(substring(order_reference, 1, 12), '') AS "Reference",
               coalesce(substring(recipient_name, 1, 15), '') AS "Recipient",
               coalesce(substring(recipient_city, 1, 15), '') AS "City",
               coalesce(substring(recipient_country, 1, 5), '') AS "Country",
               coalesce(substring(service_name, 1, 12), '') AS "Service",
               format('{:,.0f}', total_charge) AS "Cost" FROM top""",
        ),
    }


def documented() -> dict[str, str]:
    return {
        "customer_of_shipment": packages_sql(
            """SELECT tracking_number, shipment_type,
               CASE WHEN shipment_type = 'RTN' THEN sender_name ELSE recipient_name END
                 AS customer_name,
               CASE WHEN shipment_type = 'RTN' THEN sender_country ELSE recipient_country END
                 AS customer_country FROM P"""
        ),
        "invoice_reconciliation": lines_sql(
            f"""SELECT invoice_number, net_sum, invoice_total, difference,
                abs(difference) <= 0.005 AS matches
                FROM (SELECT *, {r2('net_sum - invoice_total')} AS difference
                  FROM (SELECT invoice_number, {dbl('sum(net_amount)')} AS net_sum,
                    {dbl('sum(net_amount) + CASE WHEN bool_or(overbilled) THEN 0.01 ELSE 0 END')}
                      AS invoice_total FROM L GROUP BY 1))"""
        ),
        "weight_audit_notes": lines_sql(
            """SELECT tracking_number,
               CAST(regexp_extract(entered_weight_note, 'WEIGHT: ([0-9.]+)', 1) AS DOUBLE)
                 AS entered_kg,
               CAST(regexp_extract(audited_weight_note, 'WEIGHT: ([0-9.]+)', 1) AS DOUBLE)
                 AS audited_kg, 1.0::DOUBLE AS difference_kg
               FROM L WHERE entered_weight_note IS NOT NULL"""
        ),
    }


def _cells(name: str, tables: dict[str, str], sql: dict[str, str]) -> str:
    """Every value of the tables that other queries give, one by one."""
    parts = [
        f"""SELECT '{table}' AS "{name}", "column", value
            FROM (SELECT COLUMNS(*)::VARCHAR FROM ({sql[query]}))
            UNPIVOT INCLUDE NULLS (value FOR "column" IN (COLUMNS(*)))"""
        for table, query in tables.items()
    ]
    return f"""SELECT "{name}", "column", CASE WHEN number IS NULL THEN value END AS text, number
        FROM (SELECT *, TRY_CAST(value AS DOUBLE) AS number FROM ({" UNION ALL ".join(parts)}))"""


def bundles(sql: dict[str, str]) -> dict[str, str]:
    charts = {
        "cost_breakdown_pie": "cost_pie",
        "cost_breakdown_bar": "cost_bars",
        "destination_map": "map_points",
        "destination_bar": "top_destinations",
        "trend_chart": "trend_series",
        "return_reasons": "return_reasons_top",
        "weight_distribution": "weight_bars",
        "weight_scatter": "weight_sample",
        "service_comparison": "service_compare",
    }
    sections = ("title", "summary", "cost", "destinations", "returns", "return_types")
    report = {s: f"report_{s}" for s in sections} | {"top_expenses": "report_top"}
    displays = {
        "cost": "display_cost",
        "destination": "display_destinations",
        "trend": "display_trends",
        "returns_metrics": "metrics_returns",
        "returns_country": "display_returns_by_country",
        "weights_metrics": "metrics_weights",
        "service": "display_services",
        "duties_metrics": "metrics_duties",
        "duties": "display_duties",
        "accessorials_metrics": "metrics_accessorials",
        "accessorial": "display_accessorials",
        "top_expense": "display_top_expenses",
    }
    return {
        "visualization_bundle": _cells("dataset", charts, sql),
        "report_bundle": _cells("section", report, sql),
        "display_bundle": _cells("table", displays, sql),
    }


def oracle_sql() -> dict[str, str]:
    groups = (
        sources, typing, derived, filters, rollup, summaries, analyses, chart_data, displays,
        documented,
    )
    single = {name: sql for group in groups for name, sql in group().items()}
    return single | bundles(single)
