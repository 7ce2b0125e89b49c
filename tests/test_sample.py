"""How the sample's lines and files are made."""

import re
from pathlib import Path

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.queries import as_split_files, queries
from freightlens.operators.filters import service_choices
from freightlens.session import tune
from freightlens.sources import billing_csv as csv
from freightlens.sources import sample_tables as sample
from freightlens.sources.sinks import write_lines
from tests.helpers import plan, rows


def test_items_are_not_shuffled_for_small_dimensions(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        text = plan(sample.billing_lines(spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert set(re.findall(r"hashpartitioning\((\w+)#", text)) <= {"l_orderkey", "o_orderkey"}, text


def test_bare_items_are_shuffled_where_nothing_may_be_broadcast(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(sample.billing_lines(spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    keys = re.findall(r"hashpartitioning\((\w+)#", text)
    assert "l_suppkey" not in keys, text
    assert keys.index("l_orderkey") < keys.index("l_partkey"), text  # the plan's last step is printed first


def test_items_without_a_part_count_for_the_places_of_others(spark, sf_dir, tmp_path):
    for name in ("nation", "customer", "supplier", "orders"):
        sample.table(spark, sf_dir, name).write.parquet(f"{tmp_path}/{name}.parquet")
    part, item = sample.table(spark, sf_dir, "part"), sample.table(spark, sf_dir, "lineitem")
    part.filter("p_partkey % 3 != 0").unionByName(part.filter("p_partkey = 1")).write.parquet(f"{tmp_path}/part.parquet")
    item = item.withColumn("l_linenumber", F.lit(1))
    item.unionByName(item.filter("l_orderkey % 2 = 0").withColumn("l_partkey", F.lit(None).cast("long"))).write.parquet(
        f"{tmp_path}/lineitem.parquet"
    )
    item, part = sample.table(spark, str(tmp_path), "lineitem"), sample.table(spark, str(tmp_path), "part")
    in_order = Window.partitionBy("l_orderkey").orderBy(*sample._ROW_ORDER[1:])
    placed = item.withColumn("place", F.dense_rank().over(in_order)).join(part, F.col("l_partkey") == F.col("p_partkey"))
    wanted = placed.select("l_orderkey", "place", "l_quantity", "p_size")
    got = sample.parcels(spark, str(tmp_path)).select(*wanted.columns)
    assert got.count() and not got.exceptAll(wanted).count() and not wanted.exceptAll(got).count()


def test_a_named_file_may_be_written_by_several_tasks(spark):
    made = [(f"{i},a", "x.csv" if i % 3 else "y.csv", i) for i in range(12)]
    records = spark.createDataFrame(made, "value string, source_file string, line_ord int").repartition(3, "line_ord")
    fields = csv.scan_fields(spark, as_split_files(records), csv.CsvOptions(scan_width=2))
    assert sorted(rows(fields, "_c0", "source_file")) == sorted((str(i), name) for _, name, i in made)
    assert fields.select("file_key").distinct().count() > 2


def test_kinds_are_not_interpreted_by_row(spark, sf_dir):
    text = plan(queries()["charge_breakdown"](spark, sf_dir))
    assert "lambda" not in text, text


def test_parcel_rows_hold_only_what_lines_read(spark, sf_dir):
    types = dict(sample.parcels(spark, sf_dir).dtypes)
    assert not {"l_suppkey", "l_linestatus", "customer_region", "supplier_region"} & set(types)
    assert (types["shipped"], types["price"]) == ("date", "decimal(18,2)")


def test_services_are_found_without_a_sort_of_the_lines(spark, sf_dir):
    text = plan(service_choices(sample.billing_lines(spark, sf_dir)))
    assert "ObjectHashAggregate" in text and "SortAggregate" not in text, text


def test_partitions_grow_from_the_default_only(spark):
    other = spark.newSession()
    for chosen, wanted in (("200", "1200"), ("7", None)):
        other.conf.set("spark.sql.shuffle.partitions", chosen)
        other.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
        assert tune(other).conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) == wanted


def test_written_parcel_rows_are_read_in_small_parts(spark):
    key = "spark.sql.files.maxPartitionBytes"
    for chosen, wanted in ((None, "16m"), ("32m", "32m")):
        other = spark.newSession()
        other.conf.unset(key)
        if chosen:
            other.conf.set(key, chosen)
        assert tune(other).conf.get(key) == wanted


def test_lines_are_written_by_month_without_a_sort(spark, sf_dir, tmp_path):
    assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) > 0
    lines = sample.billing_lines(spark, sf_dir, rows=sample.by_month(sample.parcels(spark, sf_dir)))
    write_lines(lines, str(tmp_path / "lines"), spread=False)
    files = list((tmp_path / "lines").glob("month=*/*.parquet"))
    assert files and all(".zstd." in f.name for f in files)
    assert spark.read.parquet(str(tmp_path / "lines")).count() == lines.count()


def test_text_of_the_lines_is_written_compressed(spark, sf_dir):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    for name in ("scan_headerless_csv", "project_positions", "source_lineage"):
        before = set(shared.glob("named-files-*"))
        queries()[name](spark, sf_dir)
        (folder,) = set(shared.glob("named-files-*")) - before
        files = [p for p in folder.glob("files/*/*") if not p.name.startswith(".")]
        assert files and all(p.name.endswith(".csv.gz") for p in files), name


def test_names_are_looked_up_behind_the_shuffle_by_month(spark, sf_dir):
    spread = sample.parcels(spark, sf_dir, spread=True)
    above = plan(spread).split("REBALANCE_PARTITIONS_BY_COL", 1)[0]
    assert set(re.findall(r"BroadcastHashJoin \[(\w+)#", above)) == {"l_suppkey", "c_nationkey", "s_nationkey"}
    rows_, spread = sample.parcels(spark, sf_dir), spread.select(sample.parcels(spark, sf_dir).columns)
    assert not rows_.exceptAll(spread).count() and not spread.exceptAll(rows_).count()
