"""Plans and invariants on the sample tables."""

import re

import pytest
from pyspark.sql import functions as F

from catalog.queries import queries
from freightlens import BillingAnalyzer
from freightlens.operators.packages import packages
from freightlens.sources import sample_tables as sample
from freightlens.sources.sinks import land_lines
from tests.helpers import plan, rows


@pytest.fixture(scope="module")
def landed(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("landed") / "lines")
    return land_lines(sample.billing_lines(spark, sf_dir), path)


@pytest.fixture(scope="module")
def analyzer(spark, sf_dir, landed):
    return BillingAnalyzer(landed, sample.countries(spark, sf_dir))


def _all_results(a):
    r, w = a.analyze_returns(), a.analyze_weights()
    d, x = a.analyze_duties_and_brokerage(), a.analyze_accessorials()
    return {
        "packages": a.packages,
        "summary": a.get_summary(),
        "costs": a.analyze_cost_breakdown(),
        "charges": a.get_charge_breakdown(),
        "destinations": a.analyze_by_destination(),
        "weeks": a.analyze_trends(),
        "services": a.analyze_services(),
        "top": a.get_top_expenses(),
        **{f"returns.{k}": v for k, v in vars(r).items()},
        **{f"weights.{k}": v for k, v in vars(w).items()},
        **{f"duties.{k}": v for k, v in vars(d).items()},
        **{f"accessorials.{k}": v for k, v in vars(x).items()},
        **a.report_tables(),
    }


def test_no_python_and_no_cartesian_product(analyzer):
    for name, df in _all_results(analyzer).items():
        text = plan(df)
        assert not re.search(r"Python|ArrowEval|MapInPandas|Cartesian", text), name


def test_package_rollup_shuffles_by_number_only(spark, landed):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        main = plan(packages(landed)).split("Subqueries")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    exchanges = re.findall(r"Exchange (\w+)\((\w+)", main)
    assert exchanges == [("hashpartitioning", "tracking_number")] * 2, main


def test_scans_read_only_what_is_needed(analyzer):
    text = plan(analyzer.analyze_cost_breakdown())
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",") if ":" in c} == {
        "charge_category", "charge_category_name", "discount_amount", "net_amount", "total_charge",
    }
    duties = plan(analyzer.analyze_duties_and_brokerage().by_charge_type)
    assert "EqualTo(shipment_subtype,IMP)" in duties


def test_dates_prune_the_months_of_a_landed_table(analyzer):
    one_month = analyzer.filter_data(start_date="1997-03-05", end_date="1997-03-20")
    text = plan(one_month.analyze_cost_breakdown())
    assert re.search(r"PartitionFilters: \[[^]]*month#\d+ >= 1997-03", text)
    days = one_month.date_bounds().first()
    assert "1997-03-05" <= str(days.min_date) <= str(days.max_date) <= "1997-03-20"


def test_a_bundle_rolls_up_once_and_gives_its_space_back(spark, analyzer):
    held = spark.sparkContext._jsc.getPersistentRDDs
    before = held().size()
    for bundle in (analyzer.report_tables, analyzer.chart_tables, analyzer.display_tables):
        with bundle() as tables:
            for df in tables.values():
                df.count()
            assert held().size() > before
            assert "InMemoryTableScan" in plan(list(tables.values())[-1])
        assert held().size() == before


def test_top_expenses_is_a_top_k(analyzer):
    assert "TakeOrderedAndProject" in plan(analyzer.get_top_expenses(20))


def test_results_do_not_depend_on_partitioning(spark, sf_dir, landed, analyzer):
    want = {k: sorted(map(str, rows(v))) for k, v in _all_results(analyzer).items()}
    shuffled = landed.repartition(17, F.rand(seed=3))
    again = BillingAnalyzer(shuffled, sample.countries(spark, sf_dir))
    for name, df in _all_results(again).items():
        assert sorted(map(str, rows(df))) == want[name], name


def test_kept_packages_give_the_same_results(analyzer):
    want = {k: sorted(map(str, rows(v))) for k, v in analyzer.report_tables().items()}
    with BillingAnalyzer(analyzer.lines, analyzer.countries) as kept:
        got = {k: sorted(map(str, rows(v))) for k, v in kept.report_tables().items()}
    assert got == want


def test_invariants(analyzer):
    lines, a = analyzer.lines, analyzer
    exact = lines.agg(F.sum("net_amount").cast("double")).first()[0]
    costs = rows(a.analyze_cost_breakdown(), "total_charge", "percentage")
    assert sum(c for c, _ in costs) == pytest.approx(exact)
    assert sum(p for _, p in costs) == pytest.approx(100, abs=0.05)
    numbers = a.packages.select("tracking_number")
    based = lines.join(numbers, "tracking_number", "left_semi")
    assert a.packages.agg(F.sum("total_charge")).first()[0] == pytest.approx(
        based.agg(F.sum("net_amount").cast("double")).first()[0]
    )
    w = a.analyze_weights()
    assert w.distribution.agg(F.sum("package_count")).first()[0] <= w.detail.count()
    d = a.analyze_duties_and_brokerage().summary.first()
    assert d.brokerage_cost + d.customs_cost + d.other_cost == pytest.approx(d.total_cost)


def test_bundles_are_written(analyzer, tmp_path):
    assert len(analyzer.chart_tables()) == 9
    written = analyzer.write_report(str(tmp_path), "run1")
    assert [p.rsplit("/", 1)[1] for p in written] == [
        "title", "summary", "cost", "destinations", "returns", "return_types", "top_expenses",
    ]
    spark = analyzer.lines.sparkSession
    assert spark.read.parquet(written[-1]).count() == 15
    for name, df in analyzer.display_tables().items():
        assert df.columns, name


def test_queries_and_oracle_are_paired():
    from catalog.oracle import oracle_sql

    assert set(queries()) == set(oracle_sql())
