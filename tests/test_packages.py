from decimal import Decimal

from freightlens import BillingAnalyzer
from freightlens.operators.countries import DIMENSION
from freightlens.operators.packages import package_sums, packages
from freightlens.operators.top import top_expenses, top_packages
from tests.helpers import charge, frt, make_lines, plan, rows


def _totals(lines):
    return {r[0]: float(r[1]) for r in rows(packages(lines), "tracking_number", "total_charge")}


def test_all_charges_of_a_package_are_summed(spark):
    lines = make_lines(
        spark,
        [
            frt("A", net_amount=10),
            charge("A", "FSC", net_amount=2),
            charge("A", "TAX", net_amount=1),
            charge(None, "MSC", net_amount=5),
        ],
    )
    assert _totals(lines) == {"A": 13.0}


def test_without_freight_row_a_parcel_is_absent(spark):
    lines = make_lines(spark, [frt("A"), {**frt("B"), "charge_category": "INF"}])
    assert set(_totals(lines)) == {"A"}


def test_fallback_when_the_whole_table_has_no_freight(spark):
    lines = make_lines(
        spark, [{**frt("B", service_code="704", net_amount=3), "charge_category": "INF"}]
    )
    assert rows(packages(lines), "tracking_number", "service_name", "charge_description") == [
        ("B", "WW Standard", None)
    ]


def test_fallback_keeps_lines_without_a_category(spark):
    lines = make_lines(spark, [{**frt("B"), "charge_category": None}])
    assert set(_totals(lines)) == {"B"}


def test_indicator_is_compared_untrimmed_and_3_is_no_package(spark):
    lines = make_lines(
        spark,
        [
            frt("A"),
            {**frt("B"), "package_indicator": " 1"},
            {**frt("C"), "package_indicator": "3"},
        ],
    )
    assert set(_totals(lines)) == {"A"}


def test_first_non_null_is_per_column_in_line_order(spark):
    data = [
        frt("A", recipient_city=None, recipient_name="first", charge_description="X"),
        frt("A", recipient_city="Bonn", recipient_name="second", charge_description="Y"),
        frt("A", recipient_city="Köln", recipient_name="third"),
    ]
    for parts in (1, 2, 17):
        lines = make_lines(spark, data).repartition(parts)
        got = rows(packages(lines), "recipient_city", "recipient_name", "service_name")
        assert got == [("Bonn", "first", "X")]


def test_file_order_beats_row_order(spark):
    lines = make_lines(
        spark, [frt("A", recipient_city="late", file="b"), frt("A", recipient_city="early", file="a")]
    )
    assert rows(packages(lines), "recipient_city", "source_file") == [("early", "a")]


def test_blank_freight_description(spark):
    lines = make_lines(spark, [frt("A", service_code="704")])
    assert rows(lines, "service_name") == [("WW Standard",)]
    assert rows(packages(lines), "service_name") == [(None,)]


def test_unknown_service_code(spark):
    lines = make_lines(spark, [charge("A", "FSC", service_code="006"), charge("A", "FSC")])
    assert rows(lines, "service_name") == [("Other",), ("Other",)]


def test_package_sums_agree_with_packages(spark):
    lines = make_lines(
        spark, [frt("A", net_amount=1), charge("A", "FSC", net_amount=2), charge("B", "FSC", net_amount=9)]
    )
    assert rows(package_sums(lines)) == [("A", Decimal("3.0000"))]


def test_ties_of_the_top_keep_the_smallest_number(spark):
    lines = make_lines(spark, [frt("B", net_amount=5), frt("A", net_amount=5), frt("C", net_amount=4)])
    assert rows(top_expenses(lines, 1), "tracking_number") == [("A",)]
    assert rows(top_packages(packages(lines), 2), "tracking_number") == [("A",), ("B",)]


def test_filter_works_on_lines_before_the_rollup(spark):
    lines = make_lines(
        spark,
        [
            frt("A", net_amount=10, recipient_country="DE", shipment_date="2025-01-05"),
            charge("A", "FSC", net_amount=2),
            frt("B", net_amount=7, recipient_country="DE"),
            frt("C", net_amount=1, recipient_country="FR", shipment_date="2025-03-01"),
        ],
    )
    a = BillingAnalyzer(lines, spark.createDataFrame([], DIMENSION))
    assert dict(rows(a.filter_data(countries=["DE"]).packages, "tracking_number", "total_charge")) == {
        "A": 10.0,
        "B": 7.0,
    }
    dated = a.filter_data(start_date="2025-01-05", end_date="2025-02-01").packages
    assert rows(dated, "tracking_number") == [("A",)]
    assert a.filter_data(countries=[]).packages.count() == 3
    assert rows(a.date_bounds())[0][0].isoformat() == "2025-01-05"


def test_keep_and_release(spark):
    lines = make_lines(spark, [frt("A", net_amount=10)])
    with BillingAnalyzer(lines) as a:
        assert a.packages.count() == 1
        assert rows(a.get_top_expenses(5), "total_charge") == [(10.0,)]
    assert rows(a.get_top_expenses(5), "total_charge") == [(10.0,)]


def test_attributes_read_together_are_the_first_of_each(spark):
    place = {"invoice_number": "I", "invoice_date": "2025-12-01", "order_reference": "#1", "sender_name": "S", "sender_country": "DE",
             "recipient_name": "R", "recipient_country": "FR", "shipment_type": "SHP", "shipment_subtype": "NSD", "goods_description": "G"}
    some = {"shipment_date": "2025-12-02", "service_code": "003", "charge_description": "TB"}
    made = []
    for i in range(60):
        row = {n: f"{v}{i}" if n in ("sender_name", "recipient_name", "goods_description", "service_code", "charge_description") else v for n, v in {**place, **some}.items()}
        row |= {"actual_weight": i, "billed_weight": i, "recipient_city": f"c{i}" if i % 4 else None}
        lost = [n for k, n in enumerate(row) if (i * 7 + k * 5) % 11 < i % 4]  # every fourth row is whole
        made.append(frt(f"1Z{(i * i) % 9}", **{n: v for n, v in row.items() if n not in lost}))
        made.append(charge(f"1Z{i % 9}", "FSC", net_amount="1"))
    lines = make_lines(spark, made)
    kept = make_lines(spark, [*made[::4], *[{**r, "charge_category": "INF"} for r in made[1::4]]])
    for x in (lines, lines.repartition(3, "net_amount"), kept, kept.filter("charge_category != 'FRT'"), lines.filter("false")):
        one, all_ = packages(x), packages(x, whole=True)
        assert all_.dtypes == one.dtypes
        assert sorted(map(str, rows(all_))) == sorted(map(str, rows(one)))


def test_attributes_read_together_carry_two_orders(spark):
    made = packages(make_lines(spark, [frt("1Z1")]), whole=True)
    partial = next(line for line in plan(made).splitlines() if "partial_min" in line)
    assert partial.count("partial_min_by") == 3, partial  # cities and company
