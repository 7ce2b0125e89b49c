"""Time the headline queries and print one JSON line.

The billing lines are derived from the sample tables and landed as Parquet once
(timed as ``land_lines``), as a deployment would; the analyses then run on the
landed table. ``raw_*`` queries run from the sample tables instead. Each query
runs once to warm up and then ``BENCH_RUNS`` times; the median counts. ``report`` and
``charts`` read all tables of a bundle; ``csv_ingest`` reads and lands written CSV files.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalog.queries import write_order_files
from freightlens import BillingAnalyzer
from freightlens.operators.duties import duties_pivot
from freightlens.plans.analyzer import Bundle
from freightlens.session import tune
from freightlens.sources import sample_tables as sample
from freightlens.sources.billing_csv import read_folder
from freightlens.sources.sinks import land_lines, read_lines

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(run: Callable[[], None], runs: int, warm: bool = True) -> float:
    if warm:
        run()
    seconds = []
    for _ in range(runs):
        start = time.perf_counter()
        run()
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds), 3)


def main() -> None:
    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = tune(
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", scratch)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    path, took = f"{scratch}/lines", {}

    def land() -> None:
        land_lines(sample.billing_lines(spark, SF_DIR), path)

    took["land_lines"] = timed(land, 1, warm=False)
    (folder,) = write_order_files(spark, SF_DIR)
    took["csv_ingest"] = timed(lambda: land_lines(read_folder(spark, folder), f"{scratch}/orders"), 1, warm=False)
    countries = sample.countries(spark, SF_DIR)
    a = BillingAnalyzer(read_lines(spark, path), countries)
    raw = BillingAnalyzer(sample.billing_lines(spark, SF_DIR), countries)
    year = a.filter_data(start_date="1997-01-01", end_date="1997-12-31")

    queries: dict[str, Callable[[], DataFrame]] = {
        "packages": lambda: a.packages,
        "summary": a.get_summary,
        "cost_breakdown": a.analyze_cost_breakdown,
        "charge_breakdown": a.get_charge_breakdown,
        "by_destination": a.analyze_by_destination,
        "trends_week": a.analyze_trends,
        "by_service": a.analyze_services,
        "returns_by_country": lambda: a.analyze_returns().by_country,
        "weights_distribution": lambda: a.analyze_weights().distribution,
        "duties_summary": lambda: a.analyze_duties_and_brokerage().summary,
        "duties_detail": lambda: a.analyze_duties_and_brokerage().detail,
        "duties_pivot": lambda: duties_pivot(a.lines),
        "acc_by_country": lambda: a.analyze_accessorials().by_country,
        "acc_summary": lambda: a.analyze_accessorials().summary,
        "top_expenses": a.get_top_expenses,
        "one_year_destinations": year.analyze_by_destination,
        "service_choices": a.service_choices,
        "raw_by_destination": raw.analyze_by_destination,
        "raw_cost_breakdown": raw.analyze_cost_breakdown,
    }
    for name, query in queries.items():
        took[name] = timed(lambda: drain(query()), RUNS)
        print(f"{name} {took[name]}", file=sys.stderr)

    def drain_all(bundle: Callable[[], Bundle]) -> None:
        with bundle() as tables:
            for df in tables.values():
                drain(df)

    for name, bundle in {"report": a.report_tables, "charts": a.chart_tables}.items():
        took[name] = timed(lambda: drain_all(bundle), RUNS)
        print(f"{name} {took[name]}", file=sys.stderr)
    result = {
        "metric": "total_seconds",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": os.path.basename(SF_DIR.rstrip("/")),
        "lines": a.lines.count(),
        "cpus": int(CPUS),
        "spark": spark.version,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
