"""The analyzer: billing lines, their packages, and every analysis on them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from freightlens.operators import accessorials as acc
from freightlens.operators import duties, rules, weights
from freightlens.operators.costs import charge_breakdown, cost_breakdown
from freightlens.operators.countries import iso_countries
from freightlens.operators.destinations import by_destination
from freightlens.operators.filters import (
    country_choices,
    date_bounds,
    filter_lines,
    service_choices,
)
from freightlens.operators.packages import as_doubles, packages
from freightlens.operators.returns import returns_by_country, returns_by_reason, returns_summary
from freightlens.operators.summary import currency, summary
from freightlens.operators.top import top_expenses, top_packages
from freightlens.operators.trends import by_service, trends
from freightlens.plans import charts, display, report
from freightlens.sources.sinks import write_tables


@dataclass(frozen=True)
class ReturnsResult:
    summary: DataFrame
    by_reason: DataFrame
    by_country: DataFrame


@dataclass(frozen=True)
class WeightsResult:
    summary: DataFrame
    distribution: DataFrame
    detail: DataFrame


@dataclass(frozen=True)
class DutiesResult:
    summary: DataFrame
    by_charge_type: DataFrame
    by_country: DataFrame
    detail: DataFrame


@dataclass(frozen=True)
class AccessorialsResult:
    summary: DataFrame
    by_charge_code: DataFrame
    by_country: DataFrame
    trends: DataFrame


class Bundle(dict[str, DataFrame]):
    """Named tables. As a context manager, it keeps what they share while they are read.

    ``with a.report_tables() as tables:`` computes the package rollup once for all of
    them and gives its space back at the end.
    """

    def __init__(self, tables: dict[str, DataFrame], *shared: DataFrame):
        super().__init__(tables)
        self._shared = [df for df in shared if df.storageLevel == StorageLevel.NONE]

    def __enter__(self) -> Bundle:
        for df in self._shared:
            df.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def __exit__(self, *exc: object) -> None:
        for df in self._shared:
            df.unpersist()


class BillingAnalyzer:
    """All analyses as lazy DataFrames over one table of billing lines.

    Single analyses need nothing else: each reads just its columns. For several of
    them, call :meth:`keep_packages` first, or give the ``packages`` of these lines
    that were written before, so that the rollup is computed once.
    """

    def __init__(self, lines: DataFrame, countries: DataFrame | None = None, packages: DataFrame | None = None):
        self.lines = lines
        self._countries = countries
        self._written = packages
        self._kept: DataFrame | None = packages

    @cached_property
    def countries(self) -> DataFrame:
        if self._countries is not None:
            return self._countries
        return iso_countries(self.lines.sparkSession)

    # --- packages ---

    @cached_property
    def _rolled_up(self) -> DataFrame:
        return packages(self.lines)

    @property
    def _pkgs(self) -> DataFrame:
        return self._rolled_up if self._kept is None else self._kept

    @property
    def packages(self) -> DataFrame:
        return as_doubles(self._pkgs)

    def keep_packages(self) -> BillingAnalyzer:
        """Keep the rolled-up packages on the executors until :meth:`release`."""
        if self._kept is None:
            self._kept = self._rolled_up.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def release(self) -> None:
        if self._kept is not None and self._written is None:
            self._kept.unpersist()
            self._kept = None

    def __enter__(self) -> BillingAnalyzer:
        return self.keep_packages()

    def __exit__(self, *exc: object) -> None:
        self.release()

    # --- filters ---

    def filter_data(
        self,
        start_date: str | None = None,
        end_date: str | None = None,
        countries: Sequence[str] | None = None,
        services: Sequence[str] | None = None,
        returns_only: bool = False,
    ) -> BillingAnalyzer:
        """A new analyzer on the lines that meet all conditions."""
        kept = filter_lines(self.lines, start_date, end_date, countries, services, returns_only)
        return BillingAnalyzer(kept, self._countries)

    def date_bounds(self) -> DataFrame:
        return date_bounds(self.lines)

    def country_choices(self) -> DataFrame:
        return country_choices(self.lines)

    def service_choices(self) -> DataFrame:
        return service_choices(self.lines)

    # --- analyses ---

    def get_summary(self) -> DataFrame:
        return summary(self.lines, self._pkgs)

    def analyze_cost_breakdown(self) -> DataFrame:
        return cost_breakdown(self.lines)

    def get_charge_breakdown(self) -> DataFrame:
        return charge_breakdown(self.lines)

    def analyze_by_destination(self) -> DataFrame:
        return by_destination(self._pkgs, self.countries)

    def analyze_trends(self, period: str = "week") -> DataFrame:
        return trends(self._pkgs, period)

    def analyze_services(self) -> DataFrame:
        return by_service(self._pkgs)

    def analyze_returns(self) -> ReturnsResult:
        return ReturnsResult(
            returns_summary(self._pkgs),
            returns_by_reason(self._pkgs),
            returns_by_country(self._pkgs, self.countries),
        )

    def analyze_weights(self) -> WeightsResult:
        return WeightsResult(
            weights.weights_summary(self._pkgs),
            weights.weights_distribution(self._pkgs),
            as_doubles(weights.weights_detail(self._pkgs)),
        )

    def analyze_duties_and_brokerage(self) -> DutiesResult:
        return DutiesResult(
            duties.duties_summary(self.lines),
            duties.duties_by_charge_type(self.lines),
            duties.duties_by_country(self.lines, self.countries),
            duties.duties_detail(self.lines),
        )

    def analyze_accessorials(self) -> AccessorialsResult:
        return AccessorialsResult(
            acc.accessorials_summary(self.lines),
            acc.accessorials_by_code(self.lines),
            acc.accessorials_by_country(self.lines, self.countries),
            acc.accessorial_trends(self.lines),
        )

    def get_top_expenses(self, n: int = 20) -> DataFrame:
        if self._kept is not None:
            return top_packages(self._kept, n)
        return top_expenses(self.lines, n)

    def _top_of_packages(self, n: int) -> DataFrame:
        """From the packages that a bundle has rolled up for its other tables anyway."""
        return top_packages(self._pkgs, n)

    def customers(self) -> DataFrame:
        return rules.customer_of_shipment(self._pkgs)

    def reconcile_invoices(self) -> DataFrame:
        return rules.invoice_reconciliation(self.lines)

    def weight_audits(self) -> DataFrame:
        return rules.weight_audits(self.lines)

    # --- bundles ---

    def kpi_cards(self) -> DataFrame:
        return charts.kpi_cards(self.get_summary())

    def chart_tables(self) -> Bundle:
        """The datasets of the nine overview charts."""
        breakdown, places = self.analyze_cost_breakdown(), self.analyze_by_destination()
        weight = self.analyze_weights()
        tables = {
            "cost_breakdown_pie": charts.cost_pie(breakdown),
            "cost_breakdown_bar": charts.cost_bars(breakdown),
            "destination_map": charts.map_points(places, self.countries),
            "destination_bar": charts.top_destinations(places),
            "trend_chart": charts.trend_series(self.analyze_trends()),
            "return_reasons": charts.return_reasons_top(self.analyze_returns().by_reason),
            "weight_distribution": charts.weight_bars(weight.distribution),
            "weight_scatter": as_doubles(weights.weight_sample(self._pkgs)),
            "service_comparison": charts.service_compare(self.analyze_services()),
        }
        return Bundle(tables, self._pkgs)

    def display_tables(self, period: str = "week", top_n: int = 20) -> Bundle:
        """The dashboard's tables and metric strips as display text."""
        back, duty = self.analyze_returns(), self.analyze_duties_and_brokerage()
        extra, unit = self.analyze_accessorials(), currency(self.lines)
        tables = {
            "cost": display.cost_table(self.analyze_cost_breakdown()),
            "destination": display.destination_table(self.analyze_by_destination()),
            "trend": display.trend_table(self.analyze_trends(period)),
            "returns_metrics": display.returns_metrics(back.summary),
            "returns_country": display.returns_country_table(back.by_country),
            "weights_metrics": display.weights_metrics(self.analyze_weights().summary),
            "service": display.service_table(self.analyze_services()),
            "duties_metrics": display.duties_metrics(duty.summary, unit),
            "duties": display.duties_table(duty.detail),
            "accessorials_metrics": display.accessorials_metrics(extra.summary, unit),
            "accessorial": display.accessorial_table(extra.by_charge_code),
            "top_expense": display.top_expense_table(self._top_of_packages(top_n), unit),
        }
        return Bundle(tables, self._pkgs, unit)

    def report_tables(self) -> Bundle:
        """The report's tables in the order of its sections."""
        figures, back = self.get_summary(), self.analyze_returns()
        tables = (
            report.report_title(figures),
            report.report_summary(figures),
            report.report_cost(self.analyze_cost_breakdown()),
            report.report_destinations(self.analyze_by_destination()),
            report.report_returns(back.summary),
            report.report_return_types(back.by_reason),
            report.report_top(self._top_of_packages(15)),
        )
        return Bundle(dict(zip(report.SECTIONS, tables, strict=True)), self._pkgs, figures)

    def write_report(self, path: str, run_id: str, fmt: str = "parquet") -> list[str]:
        """Write the report's tables under one run id, with one package rollup for all."""
        with self.report_tables() as tables:
            return write_tables(tables, path, run_id, fmt)
