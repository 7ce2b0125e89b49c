import bz2
import gzip
import random
import re
from dataclasses import replace
from datetime import date, datetime

import pytest
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from freightlens import CsvOptions, manifest, read_content, read_files, read_folder
from freightlens.functions.text import field_count
from freightlens.operators.filters import filter_lines
from freightlens.schema import DOCUMENTED_SERVICE_NAMES, LINES_SCHEMA
from freightlens.sources.catalogue import Files, damaged
from freightlens.sources.records import stitched
from freightlens.sources.sinks import land_lines, write_tables
from tests.helpers import csv_row, plan, rows

BASE = {
    "version": "2.1",
    "tracking_number": " 1Z1 ",
    "package_indicator": "1",
    "net_amount": "10.5",
    "shipment_date": "2025-12-23",
    "charge_category": "FRT",
    "service_code": "704",
    "recipient_city": "München",
    "recipient_country": "DE",
}


SKIP = CsvOptions(on_bad_file="skip")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("invoices")
    full, quoted = csv_row(**BASE), csv_row(**{**BASE, "recipient_city": 'a "b", c'})
    dirty = {**BASE, "net_amount": "12,50", "shipment_date": "23.12.2025", "recipient_country": "NA"}
    files = {
        "utf8 full+.csv": ("﻿" + full + "\r\n" + quoted + "\r\n").encode(),
        "latin1_full.csv": (full + "\n" + csv_row(**{**BASE, "recipient_city": "Ã¼"}) + "\n").encode("latin1"),
        "narrow.csv": (csv_row(100, **BASE, goods_description="lost") + "\n").encode("latin1"),
        "ragged.csv": "\n".join([full, full + ",a,b", csv_row(90, **BASE), "", "  \t"]).encode(),
        "dirty.csv": (csv_row(**{**dirty, "recipient_city": "  "}) + "\n").encode(),
        "empty.csv": b"",
        "other.txt": b"no billing file",
    }
    for name, data in files.items():
        (d / name).write_bytes(data)
    (d / "sub").mkdir()
    (d / "sub" / "deeper.csv").write_bytes(full.encode())
    return d


@pytest.mark.parametrize("multiline", ["auto", True, False])
def test_folder(spark, folder, multiline):
    lines = read_folder(spark, str(folder), CsvOptions(multiline=multiline))
    assert lines.schema.fieldNames() == LINES_SCHEMA.fieldNames()
    got = rows(lines.orderBy("line_ord"), "source_file", "version", "recipient_city", "net_amount")
    assert [(f, v, c, float(n)) for f, v, c, n in got] == [
        ("dirty.csv", "2.1", None, 0.0),
        ("latin1_full.csv", "2.1", "München", 10.5),
        ("latin1_full.csv", "2.1", "Ã¼", 10.5),
        ("narrow.csv", "2.1", "München", 10.5),
        ("ragged.csv", "2.1", "München", 10.5),
        ("ragged.csv", "2.1", "München", 10.5),
        ("utf8 full+.csv", "2.1", "München", 10.5),
        ("utf8 full+.csv", "2.1", 'a "b", c', 10.5),
    ]
    assert {r[0] for r in rows(lines, "tracking_number")} == {"1Z1"}
    # beyond the file's width: null, and lost with the position
    assert {r[0] for r in rows(lines, "goods_description")} == {None}
    dirty = lines.filter("source_file = 'dirty.csv'").first()
    assert (dirty.shipment_date, dirty.recipient_country) == (None, None)


@pytest.mark.parametrize("multiline", ["auto", True, False])
def test_list_of_files_keeps_its_order(spark, folder, multiline):
    paths = [str(folder / n) for n in ("ragged.csv", "missing.csv", "dirty.csv", "utf8 full+.csv")]
    lines = read_files(spark, paths, CsvOptions(multiline=multiline, on_bad_file="skip"))
    got = [r[0] for r in rows(lines.orderBy("line_ord"), "source_file")]
    assert got == ["ragged.csv"] * 2 + ["dirty.csv"] + ["utf8 full+.csv"] * 2


def test_nothing_to_read(spark, tmp_path):
    for lines in (
        read_folder(spark, str(tmp_path)),
        read_folder(spark, str(tmp_path / "none"), SKIP),
        read_files(spark, [str(tmp_path / "none.csv")], SKIP),
    ):
        assert lines.schema.fieldNames() == LINES_SCHEMA.fieldNames()
        assert lines.count() == 0


def test_a_missing_path_fails_unless_it_is_to_be_skipped(spark, folder):
    paths = [str(folder / "missing.csv"), str(folder / "dirty.csv")]
    with pytest.raises(AnalysisException):
        read_files(spark, paths)
    with pytest.raises(AnalysisException):
        read_folder(spark, str(folder / "none"))
    got = manifest(spark, paths, SKIP).orderBy("source_file")
    assert rows(got, "source_file", "rows", "bad_amounts", "bad_dates", "status") == [
        ("dirty.csv", 1, 1, 1, "loaded"),
        ("missing.csv", 0, 0, 0, "missing"),
    ]


def test_a_damaged_file_is_left_out_whole(spark, tmp_path):
    whole = gzip.compress("".join(csv_row(**BASE) + "\n" for _ in range(4000)).encode(), mtime=0)
    (tmp_path / "cut off.csv.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "also.csv.gz").write_bytes(whole[:-40])
    (tmp_path / "good.csv.gz").write_bytes(whole)
    paths = [str(tmp_path / n) for n in ("cut off.csv.gz", "good.csv.gz", "also.csv.gz")]
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        read_files(spark, paths).count()
    stated = CsvOptions(charset="UTF-8", width=300, scan_width=176, multiline=False)
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        read_files(spark, paths, stated).count()
    for options in (SKIP, replace(stated, on_bad_file="skip")):
        assert read_files(spark, paths, options).count() == 4000
    got = manifest(spark, paths, SKIP).orderBy("source_file").collect()
    assert [(r.source_file, r.rows, r.status, r.reason is None) for r in got] == [
        ("also.csv.gz", 0, "failed", False),
        ("cut off.csv.gz", 0, "failed", False),
        ("good.csv.gz", 4000, "loaded", True),
    ]


def test_a_file_removed_after_listing_fails(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text(csv_row(**BASE) + "\n")
    lines = read_folder(spark, str(tmp_path))
    (tmp_path / "b.csv").unlink()
    with pytest.raises(Exception, match="FILE_NOT_EXIST"):
        lines.count()


def test_nothing_stays_persisted(spark, folder):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    read_folder(spark, str(folder)).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_amounts_beyond_18_digits(spark, tmp_path):
    amounts = ("123456789012345.67", "100000000000000", "1.00005", "1e30", "x")
    (tmp_path / "a.csv").write_text("".join(csv_row(**{**BASE, "net_amount": a}) + "\n" for a in amounts))
    lines = read_folder(spark, str(tmp_path)).orderBy("line_ord")
    assert [str(r[0]) for r in rows(lines, "net_amount")] == ["123456789012345.6700", "100000000000000.0000", "1.0001", "0.0000", "0.0000"]
    assert rows(manifest(spark, str(tmp_path)), "bad_amounts", "too_large", "rounded") == [(1, 1, 1)]


def test_a_scan_that_leaves_out_mapped_fields_is_refused(spark, folder):
    with pytest.raises(ValueError):
        read_folder(spark, str(folder), CsvOptions(scan_width=100))


def test_first_row_sets_the_width(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\nc,d,e\nf\n")
    for multiline in ("auto", True, False):
        lines = read_folder(spark, str(tmp_path), CsvOptions(multiline=multiline))
        assert sorted(rows(lines, "version", "account_number")) == [("a", "b"), ("f", None)]
        every = read_folder(spark, str(tmp_path), CsvOptions(multiline=multiline, width=None))
        assert every.count() == 3
        short = read_folder(spark, str(tmp_path), CsvOptions(multiline=multiline, width=1))
        assert short.count() == 1


def test_rows_wider_than_the_map(spark, tmp_path):
    wide = csv_row(**BASE) + "," * 74
    (tmp_path / "a.csv").write_text(f"{wide}\n{wide},x\n{csv_row(**BASE)}\n")
    for multiline in ("auto", True, False):
        lines = read_folder(spark, str(tmp_path), CsvOptions(multiline=multiline))
        assert rows(lines, "tracking_number") == [("1Z1",)] * 2


def test_first_row_is_found_in_a_file_of_many_splits(spark, tmp_path):
    short = csv_row(100, **BASE)
    long = csv_row(120, **BASE)
    (tmp_path / "a.csv").write_text("\n".join([short] + [long, short] * 200))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = read_folder(spark, str(tmp_path), CsvOptions(multiline=False))
        assert lines.rdd.getNumPartitions() > 3
        assert lines.count() == 201
        assert lines.select("line_ord").distinct().count() == 201
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_line_breaks_in_fields(spark, tmp_path):
    text = csv_row(**{**BASE, "recipient_city": "one\ntwo"}) + "\n" + csv_row(**BASE) + "\n"
    (tmp_path / "a.csv").write_text(text)
    (tmp_path / "plain.csv").write_text(csv_row(**{**BASE, "recipient_city": "Ulm"}))
    want = ["one\ntwo", "München"]
    lines = read_folder(spark, str(tmp_path)).orderBy("line_ord")
    assert [r[0] for r in rows(lines, "recipient_city")] == [*want, "Ulm"]
    assert "FileScan csv" not in plan(lines)
    assert [r[1] for r in sorted(rows(manifest(spark, str(tmp_path)), "source_file", "rows"))] == [2, 1]
    uploaded = read_content(spark, text, "up.csv").orderBy("line_ord")
    assert rows(uploaded, "source_file", "recipient_city") == [("up.csv", c) for c in want]


@pytest.mark.parametrize("multiline", [True, False])
def test_named_charset_and_width_need_no_facts(spark, folder, multiline):
    def city(charset):
        options = CsvOptions(charset=charset, width=300, scan_width=176, multiline=multiline)
        lines = read_files(spark, [str(folder / "latin1_full.csv")], options)
        assert "InMemoryTableScan" not in plan(lines)
        return rows(lines.orderBy("line_ord"), "recipient_city")[0][0]

    assert city("ISO-8859-1") == "München"
    assert city("UTF-8") == "M\ufffdnchen"


def test_manifest(spark, folder):
    got = manifest(spark, str(folder)).orderBy("source_file")
    assert rows(got, "source_file", "rows", "dropped_rows", "bad_amounts", "charset", "status") == [
        ("dirty.csv", 1, 0, 1, "utf-8", "loaded"),
        ("empty.csv", 0, 0, 0, None, "empty"),
        ("latin1_full.csv", 2, 0, 0, "latin-1", "loaded"),
        ("narrow.csv", 1, 0, 0, "latin-1", "loaded"),
        ("ragged.csv", 2, 1, 0, "utf-8", "loaded"),
        ("utf8 full+.csv", 2, 0, 0, "utf-8", "loaded"),
    ]


def test_options(spark):
    text = csv_row(**{**BASE, "recipient_country": "NA", "shipment_date": "23.12.2025", "service_code": "006"})
    options = CsvOptions(
        na_tokens=("",),
        date_formats=("yyyy-MM-dd", "dd.MM.yyyy"),
        service_names=DOCUMENTED_SERVICE_NAMES,
    )
    line = read_content(spark, text, options=options).first()
    assert (line.recipient_country, line.shipment_date) == ("NA", date(2025, 12, 23))
    assert line.service_name == "WW Standard"
    plain = read_content(spark, text).first()
    assert (plain.recipient_country, plain.shipment_date, plain.service_name) == (None, None, "Other")


@pytest.mark.parametrize(
    "record,n",
    [
        ("", 1),
        ("a", 1),
        ("a,b,", 3),
        ('"a,b",c', 2),
        ('"a""b,",c', 2),
        ('"","",""', 3),
        ('""""",",x', 2),
        ('a"b,c"d', 2),
        ('"one\ntwo,",3', 2),
    ],
)
def test_field_count(spark, record, n):
    df = spark.createDataFrame([(record,)], "v string")
    assert rows(df.select(field_count(df.v))) == [(n,)]


@pytest.mark.parametrize(
    "text,value",
    [
        ("1,2", 0), ("12,50", 0), ("0x10", 0), ("1_000", 0), ("-", 0), ("", 0), (None, 0),
        ("1.5d", 0), ("inf", 0), (" 2 ", 2), ("1e3", 1000), ("+3", 3), ("-4.25", -4.25),
    ],
)
def test_amounts(spark, text, value):
    from freightlens.operators.typing import coerce_types

    df = spark.createDataFrame([(text,)], "net_amount string")
    assert float(coerce_types(df).first()[0]) == value


def test_landed_lines_and_tables(spark, folder, tmp_path):
    lines = read_folder(spark, str(folder))
    landed = land_lines(lines, str(tmp_path / "lines"))
    assert sorted(map(str, rows(landed.drop("month")))) == sorted(map(str, rows(lines)))
    assert {p.name for p in (tmp_path / "lines").glob("month=*")} == {
        "month=2025-12",
        "month=__HIVE_DEFAULT_PARTITION__",
    }
    paths = write_tables({"a": lines.select("version")}, str(tmp_path), "run1", "csv")
    assert spark.read.csv(paths[0], header=True).count() == lines.count()


@pytest.mark.parametrize("start, end", [("1997-3-5", None), ("1997-03-05", "1997-12-24"), (date(1997, 3, 5), datetime(1997, 12, 24, 10)), (None, "1997"), (None, " 1997-5-1")])
def test_date_filters_agree_on_a_landed_table(spark, tmp_path, start, end):
    days = ["1996-12-31", "1997-01-01", "1997-03-04", "1997-03-05", "1997-12-24", "1998-01-01", ""]
    (tmp_path / "a.csv").write_text("".join(csv_row(**{**BASE, "shipment_date": d}) + "\n" for d in days))
    lines = read_folder(spark, str(tmp_path))
    landed = filter_lines(land_lines(lines, str(tmp_path / "landed")), start, end)
    want = sorted(rows(filter_lines(lines, start, end), "shipment_date"))
    assert sorted(rows(landed, "shipment_date")) == want and 0 < len(want) < 6
    assert re.search(r"PartitionFilters: \[[^\]]*month#\d+ [<>]= \d{4}-\d\d\b", plan(landed))


def test_a_file_is_appended_once(spark, folder, tmp_path):
    path, lines = str(tmp_path / "landed"), read_folder(spark, str(folder))
    first = land_lines(lines.filter("source_file <> 'dirty.csv'"), path, mode="append").count()
    assert land_lines(lines, path, mode="append").count() == first + 1
    assert land_lines(lines, path, mode="append").count() == first + 1


def _csv_fields(rng):
    draw = rng.random()
    if draw < 0.25:
        return "".join(rng.choice('ab"\n,') for _ in range(rng.randint(0, 6)))
    if draw < 0.4:
        return rng.choice(['x"y', '5" pipe', '"', '""'])
    return "".join(rng.choice("abc") for _ in range(rng.randint(0, 4)))


def _quoted(text):
    return '"' + text.replace('"', '""') + '"' if text[:1] == '"' or "," in text or "\n" in text else text


def test_records_are_found_across_splits(spark):
    rng, given, want = random.Random(2), [], {}
    for f in range(40):
        made = [[_csv_fields(rng) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 40))]
        want[f"f{f}"] = [",".join(map(_quoted, r)) for r in made]
        block = 0
        for i, line in enumerate("\n".join(want[f"f{f}"]).split("\n")):
            block += 100 * (rng.random() < 0.2)
            given.append((f"f{f}", f"f{f}", block, i, line))
    lines = spark.createDataFrame(given, "file_key string, source_file string, block long, row long, value string").repartition(7)
    got = {}
    for r in stitched(lines).orderBy("file_key", "block", "row").collect():
        got.setdefault(r.file_key, []).append(r.value)
    assert got == want


def test_a_quote_that_is_never_closed_opens_nothing(spark):
    text = ['a,"b', 'c"', 'd,"e', "f", "", "g"]
    lines = spark.createDataFrame([("f", "f", i // 2, i, v) for i, v in enumerate(text)], "file_key string, source_file string, block long, row long, value string")
    got = [r.value for r in stitched(lines).orderBy("block", "row").collect()]
    assert got == ['a,"b\nc"', 'd,"e', "f", "", "g"]


def test_many_damaged_files_are_found_together(spark, tmp_path, monkeypatch):
    text = "".join(csv_row(**BASE) + "\n" for _ in range(300)).encode()
    packed = {"gz": gzip.compress(text, mtime=0), "bz2": bz2.compress(text), "zst": zstandard.compress(text)}
    for i in range(20):
        kind = ("gz", "bz2", "zst")[i % 3]
        (tmp_path / f"bad{i:02}.csv.{kind}").write_bytes(packed[kind][: len(packed[kind]) * (i + 1) // 22] if i % 4 else b"\x00" + packed[kind][1:])
    for kind in packed:
        (tmp_path / f"good.csv.{kind}").write_bytes(packed[kind])
    (tmp_path / "two streams.csv.gz").write_bytes(packed["gz"] * 2)
    passes = []
    lines = Files.lines
    monkeypatch.setattr(Files, "lines", lambda self, *a, **k: passes.append(k) or lines(self, *a, **k))
    stated = replace(SKIP, scan_width=176)
    got = {r.source_file: r for r in manifest(spark, [str(tmp_path)], stated).collect()}
    assert sum(r.status == "failed" and bool(r.reason) for r in got.values()) == 20
    assert {n: r.rows for n, r in got.items() if r.status == "loaded"} == {"good.csv.gz": 300, "good.csv.bz2": 300, "good.csv.zst": 300, "two streams.csv.gz": 600}
    assert len(passes) == 2  # one over all files, one for what is left


def test_a_plain_file_cut_short_by_a_failure_is_found(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿x,y\r\nz\r\n")
    files = Files(spark, str(tmp_path))
    table = files.table().withColumn("seen", F.lit(4).cast("long"))
    assert [r.reason for r in damaged(files, table).collect()] == ["4 of 11 bytes could be read"]
    assert damaged(files, table.withColumn("seen", F.lit(8).cast("long"))).collect() == []


def test_many_files_are_a_table(spark, tmp_path):
    for d in ("b", "a"):
        (tmp_path / d).mkdir()
        for i in range(5_000):
            with open(tmp_path / d / f"{i:06}.csv", "wb") as f:
                f.write(b"x")
    one = Files(spark, str(tmp_path / "a")).table()
    assert one.count() == 5_000 and not re.search(r"LocalTableScan|isin|InSet", plan(one))
    both = Files(spark, [str(tmp_path / "b"), str(tmp_path / "a" / "*.csv")]).table()
    assert both.agg(F.count_distinct("place"), F.count("*")).first()[:] == (10_000, 10_000)
    first, last = (both.orderBy(o).first() for o in (F.asc("place"), F.desc("place")))
    assert (first.source_file, last.source_file) == ("000000.csv", "004999.csv")
    assert "/b/" in first.file_key and "/a/" in last.file_key


def test_compressed_files_of_a_folder_have_their_plain_names(spark, tmp_path):
    text = "".join(csv_row(**{**BASE, "recipient_city": c}) + "\n" for c in ("Köln", "Ulm")).encode()
    (tmp_path / "a b+.csv.gz").write_bytes(gzip.compress(text, mtime=0))
    (tmp_path / "cut.csv.gz").write_bytes(gzip.compress(text * 50, mtime=0)[:-40])
    (tmp_path / "plain.csv").write_bytes(text)
    folder, packed = str(tmp_path), CsvOptions(codec="gz", on_bad_file="skip")
    lines = read_folder(spark, folder, packed)
    assert sorted(rows(lines, "source_file", "recipient_city")) == [("a b+.csv", "Köln"), ("a b+.csv", "Ulm")]
    assert rows(lines.select("line_ord.file").distinct()) == [("a b+.csv",)]
    found = rows(manifest(spark, folder, packed).select("source_file", "rows", "status"))
    assert sorted(found) == [("a b+.csv", 2, "loaded"), ("cut.csv", 0, "failed")]
    assert {r[0] for r in rows(read_folder(spark, folder), "source_file")} == {"plain.csv"}
