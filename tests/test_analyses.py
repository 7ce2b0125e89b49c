import pytest

from freightlens import BillingAnalyzer
from freightlens.operators.countries import iso_countries, with_country_name
from freightlens.operators.rules import customer_of_shipment, invoice_reconciliation, weight_audits
from freightlens.plans.charts import kpi_cards, return_reasons_top
from freightlens.schema import LINES_SCHEMA
from tests.helpers import charge, frt, make_lines, rows


@pytest.fixture
def dim(spark):
    return spark.createDataFrame(
        [("DE", "DEU", "Germany"), ("FR", "FRA", "France")], "alpha2 string, alpha3 string, name string"
    )


def test_fees_count_in_the_breakdown_but_not_in_package_cost(spark, dim):
    a = BillingAnalyzer(
        make_lines(spark, [frt("A", net_amount=10), charge(None, "MSC", net_amount=5)]), dim
    )
    assert rows(a.analyze_cost_breakdown(), "charge_category", "total_charge", "percentage") == [
        ("FRT", 10.0, 66.67),
        ("MSC", 5.0, 33.33),
    ]
    assert rows(a.get_summary(), "total_cost") == [(10.0,)]


def test_percentage_is_null_when_all_totals_are_zero(spark, dim):
    a = BillingAnalyzer(make_lines(spark, [frt("A")]), dim)
    assert rows(a.analyze_cost_breakdown(), "percentage") == [(None,)]


def test_empty_table(spark, dim):
    a = BillingAnalyzer(spark.createDataFrame([], LINES_SCHEMA), dim)
    s = a.get_summary().first()
    assert (s.total_invoices, s.total_packages, s.total_cost, s.return_rate) == (0, 0, 0.0, 0.0)
    assert (s.avg_cost_per_package, s.total_weight_kg, s.total_tax) == (0.0, 0.0, 0.0)
    assert (s.date_from, s.date_to, s.top_destination_country, s.currency) == (None, None, None, "EUR")
    assert rows(a.analyze_cost_breakdown()) == []
    assert rows(a.analyze_returns().summary) == []
    assert rows(a.analyze_weights().summary) == []
    assert rows(a.analyze_duties_and_brokerage().summary) == []
    assert rows(a.analyze_accessorials().summary) == []
    assert rows(a.kpi_cards(), "freight_pct") == [("0%",)]


def test_weight_buckets_are_right_closed_and_zero_falls_out(spark, dim):
    data = [
        frt(n, billed_weight=w, actual_weight=1)
        for n, w in zip("ABCDE", ("0", "0.5", "0.51", "50", "50.01"))
    ]
    got = BillingAnalyzer(make_lines(spark, data), dim).analyze_weights()
    assert rows(got.distribution, "weight_range", "package_count") == [
        ("0-0.5kg", 1),
        ("0.5-1kg", 1),
        ("20-50kg", 1),
        ("50kg+", 1),
    ]
    assert rows(got.summary, "packages_with_dim_weight") == [(2,)]


def test_unweighed_packages_are_left_out(spark, dim):
    got = BillingAnalyzer(make_lines(spark, [frt("A"), frt("B", actual_weight=2)]), dim)
    assert rows(got.analyze_weights().detail) == [("B", 2.0, 0.0, -2.0)]


def test_lines_without_number_count_as_one_import_shipment(spark, dim):
    imp = {"shipment_subtype": "IMP"}
    lines = make_lines(
        spark,
        [
            frt("A", net_amount=1, recipient_country="DE", **imp),
            charge("A", "BRK", net_amount=2, **imp),
            charge(None, "GOV", net_amount=4, **imp),
            charge(None, "GOV", net_amount=8, **imp),
        ],
    )
    got = BillingAnalyzer(lines, dim).analyze_duties_and_brokerage()
    s = got.summary.first()
    assert (s.total_cost, s.shipment_count, s.brokerage_cost, s.customs_cost, s.other_cost) == (
        15.0,
        2,
        2.0,
        12.0,
        1.0,
    )
    assert s.avg_cost_per_shipment == 7.5
    assert rows(got.detail, "tracking_number", "total_cost", "BRK", "GOV") == [("A", 3.0, 2.0, 0.0)]
    assert rows(got.by_charge_type, "charge_category", "shipment_count") == [
        ("GOV", 0),
        ("BRK", 1),
        ("FRT", 1),
    ]


def test_accessorial_families(spark, dim):
    codes = {"RES": 3, "PFR": 2, "PFC": 1, "AKS": 4, "SCF": 9}
    lines = make_lines(
        spark,
        [charge("A", "ACC", charge_code=c, net_amount=n) for c, n in codes.items()]
        + [frt("A", recipient_country="DE"), charge("B", "ACC", charge_code="RES", net_amount=1)],
    )
    got = BillingAnalyzer(lines, dim).analyze_accessorials()
    s = got.summary.first()
    assert (s.total_cost, s.residential_cost, s.surge_cost, s.area_surcharge_cost) == (20, 4, 3, 4)
    assert (s.charge_count, s.shipment_count, s.avg_per_shipment) == (6, 2, 10.0)
    assert rows(got.by_charge_code) == []  # no descriptions
    assert rows(got.by_country, "country_code", "total_cost", "country_name") == [
        ("DE", 19.0, "Germany")
    ]


def test_week_labels_start_at_the_first_monday(spark, dim):
    lines = make_lines(
        spark, [frt("A", shipment_date="2025-01-05"), frt("B", shipment_date="2025-01-06"), frt("C")]
    )
    a = BillingAnalyzer(lines, dim)
    assert rows(a.analyze_trends(), "period") == [("2025-W00",), ("2025-W01",)]
    assert rows(a.analyze_trends("quarter"), "period", "package_count") == [("2025-01", 2)]
    assert [r[0] for r in rows(lines, "shipment_week")] == [1, 2, None]


def test_return_reasons(spark, dim):
    rtn = {"shipment_type": "RTN", "sender_country": "FR"}
    lines = make_lines(
        spark,
        [
            frt("A", shipment_subtype="RTS", **rtn),
            frt("B", shipment_subtype="ADC" * 20, **rtn),
            frt("C", shipment_subtype="RTS", **rtn),
            frt("D", sender_country="FR"),
        ],
    )
    got = BillingAnalyzer(lines, dim).analyze_returns()
    assert rows(got.by_reason, "reason", "count") == [("RTS", 2), ("ADC" * 20, 1)]
    assert rows(return_reasons_top(got.by_reason), "reason_short")[1] == (("ADC" * 20)[:40] + "...",)
    assert rows(got.summary, "total_returns", "return_rate") == [(3, 75.0)]
    assert rows(got.by_country, "country_code", "return_count", "country_name") == [("FR", 3, "France")]


def test_top_destination_tie_goes_to_the_smallest_number(spark, dim):
    lines = make_lines(
        spark,
        [
            frt("B", recipient_country="FR"),
            frt("A", recipient_country="DE"),
            frt("C"),
            frt("D"),
        ],
    )
    assert rows(BillingAnalyzer(lines, dim).get_summary(), "top_destination_country") == [("DE",)]


def test_first_currency_and_mixed_units(spark, dim):
    lines = make_lines(
        spark,
        [
            frt("A", net_amount=1, billed_weight=1, billed_weight_unit="L"),
            frt("B", net_amount=2, billed_weight=1, billed_weight_unit="K", currency="USD"),
            frt("C", net_amount=3, currency="EUR"),
        ],
    )
    got = BillingAnalyzer(lines, dim).get_summary()
    assert rows(got, "currency", "total_cost", "total_weight_kg") == [("USD", 6.0, 2.0)]


def test_unknown_and_empty_country_codes(spark, dim):
    df = spark.createDataFrame([("DE",), ("XX",), ("",)], "country_code string")
    got = dict(rows(with_country_name(df, dim), "country_code", "country_name"))
    assert got == {"DE": "Germany", "XX": "XX", "": "Unknown"}


def test_iso_countries_have_unique_codes(spark):
    dim = iso_countries(spark)
    assert dim.count() == dim.select("alpha2").distinct().count() > 200
    assert rows(dim.filter("alpha2 = 'DE'")) == [("DE", "DEU", "Germany")]


def test_kpi_text_rounds_ties_to_even_on_the_binary_value(spark, dim):
    a = BillingAnalyzer(make_lines(spark, [frt("A", net_amount="12345.675", invoice_number="i")]), dim)
    card = kpi_cards(a.get_summary()).first()
    assert card.total_cost == f"{12345.675:,.2f} EUR"
    assert (card.total_packages, card.total_invoices, card.freight_pct) == ("1", "1", "100.0%")


def test_average_rounding_is_half_even_on_the_scaled_value(spark, dim):
    data = [frt(str(i), net_amount=n, recipient_country="DE") for i, n in enumerate(("0.01", "0.24"))]
    got = BillingAnalyzer(make_lines(spark, data), dim).analyze_by_destination()
    assert rows(got, "avg_cost_per_package") == [(0.12,)]


def test_documented_rules(spark):
    people = {"sender_name": "s", "recipient_name": "r", "sender_country": "FR", "recipient_country": "DE"}
    from freightlens.operators.packages import packages

    lines = make_lines(
        spark,
        [
            frt("A", shipment_type="RTN", invoice_number="1", invoice_total=3, net_amount=3, **people),
            frt("B", shipment_type="SHP", invoice_number="2", invoice_total=3, net_amount="2.99", **people),
            frt("C", **people),
            charge(
                "C",
                "ACC",
                entered_weight_note="ENTERED WEIGHT: 5.0 KGS",
                audited_weight_note="AUDITED WEIGHT: 10.5 KGS",
            ),
        ],
    )
    assert sorted(rows(customer_of_shipment(packages(lines)), "tracking_number", "customer_name")) == [
        ("A", "s"),
        ("B", "r"),
        ("C", "r"),
    ]
    assert sorted(rows(invoice_reconciliation(lines), "invoice_number", "difference", "matches")) == [
        ("1", 0.0, True),
        ("2", -0.01, False),
    ]
    assert rows(weight_audits(lines)) == [("C", 5.0, 10.5, 5.5)]
