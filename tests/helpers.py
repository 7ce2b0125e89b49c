"""Hand-made billing lines and CSV records."""

from __future__ import annotations

import re
from contextlib import redirect_stdout
from io import StringIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightlens.operators.derive import add_derived
from freightlens.schema import LINE_ORD, POSITIONS, field_type


def make_lines(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Billing lines in the order of ``rows``; fields not given are null, amounts 0."""
    names = list(POSITIONS)
    data = []
    for i, row in enumerate(rows):
        values = [row.get(n) for n in names]
        data.append((*[None if v is None else str(v) for v in values], row.get("file", "f"), i))
    ddl = ", ".join(f"{n} string" for n in names) + ", source_file string, pos long"
    raw = spark.createDataFrame(data, ddl)
    typed = []
    for n in names:
        t = field_type(n)
        c = F.col(n).cast(t)
        if t.typeName() == "decimal":
            c = F.coalesce(c, F.lit(0).cast(t))
        typed.append(c.alias(n))
    order = F.struct(
        F.col("source_file").alias("file"), F.lit(0).cast("long").alias("block"), F.col("pos").alias("row")
    ).cast(LINE_ORD)
    return add_derived(raw.select(*typed, "source_file", order.alias("line_ord")))


def frt(tn: str | None, **kw) -> dict:
    return {"tracking_number": tn, "charge_category": "FRT", "package_indicator": "1", **kw}


def charge(tn: str | None, category: str, **kw) -> dict:
    return {"tracking_number": tn, "charge_category": category, "package_indicator": "0", **kw}


def csv_row(width: int = 176, **kw: str) -> str:
    fields = [""] * width
    for name, value in kw.items():
        if POSITIONS[name] < width:
            fields[POSITIONS[name]] = value
    return ",".join(
        '"' + f.replace('"', '""') + '"' if re.search(r'[,"\n]', f) else f for f in fields
    )


def rows(df: DataFrame, *names: str) -> list[tuple]:
    return [tuple(r) for r in (df.select(*names) if names else df).collect()]


def plan(df: DataFrame) -> str:
    out = StringIO()
    with redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()
