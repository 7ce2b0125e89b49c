"""The manifest against hashing on one machine, and its join's salts."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from freightlens.llm import merkle


def _hash(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _said(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def _leaf(row, text):
    return _hash("".join(_said(v) for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def brute(rows):
    way = {}

    def climb(nodes):
        while len(nodes) > 1:
            level = []
            for at in range(0, len(nodes), 16):
                run = nodes[at : at + 16]
                for j, (_, below) in enumerate(run):
                    for k in below:
                        way[k].append(("".join(d for d, _ in run[:j]), "".join(d for d, _ in run[j + 1 :])))
                level.append((_hash("".join(d for d, _ in run)), [k for _, below in run for k in below]))
            nodes = level
        return nodes[0]

    by_source, tops = {}, []
    for row in rows:
        by_source.setdefault(row["source"], []).append(row)
    given = {}
    for source in sorted(by_source, key=lambda s: (s is not None, (s or "").encode())):
        nodes = []
        for row in sorted(by_source[source], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r, r["text"]))):
            k = len(given)
            given[k], way[k] = row, []
            nodes.append((_leaf(row, row["text"]), [k]))
        tops.append(climb(nodes))
    subroot = {k: d for d, below in tops for k in below}
    root = climb(tops)[0] if tops else None
    out = []
    for k, row in given.items():
        leaf = at = _leaf(row, row["text"])
        if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0 and row["text"] is not None:
            at = _leaf(row, "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"]))
        for left, right in way[k]:
            at = _hash(left + at + right)
        out.append((row["doc_id"], leaf, subroot[k], root, _hash("".join(a + b for a, b in way[k])), at, at == root))
    return out


def check(df):
    key = lambda r: tuple(map(str, r))
    got = merkle.manifest(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(df.collect()), key=key)


@pytest.mark.parametrize("source", ["given", "one", "each its own", "hot", "null"])
def test_manifest_equals_brute_force(docs, source):
    doc = F.col("doc_id")
    made = {
        "given": F.col("source"),
        "one": F.lit("x"),
        "each its own": F.concat(F.lit("ü"), doc.cast("string")),
        "hot": F.when(doc % 3 > 0, "hot").otherwise((doc % 23).cast("string")),
        "null": F.when(doc % 2 > 0, F.lit("a")),
    }
    check(docs.withColumn("source", made[source]))


def test_tampered_rows_fail_and_others_pass(docs):
    rows = merkle.manifest(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    changed = {d for d, t in texts.items() if zlib.crc32(str(d).encode()) % 5 == 0 and t and any("A" <= c <= "Z" for c in t)}
    assert changed and {r["doc_id"] for r in rows if not r["verified"]} == changed


def test_salted_rounds(docs, monkeypatch):
    monkeypatch.setattr(merkle, "SALT_RUNS", 2)
    check(docs.withColumn("source", F.lit("x")))


@pytest.mark.parametrize("count", [0, 1, 2, 16, 17])
def test_small_tables(docs, count):
    check(docs.orderBy("doc_id").limit(count).withColumn("source", F.lit("x")))


def test_odd_rows(odd, spark):
    check(odd)  # nulls, repeated rows, ids of null, a clashing column
    check(odd.withColumn("source", F.lit("Ä" * 5)))
    long = spark.createDataFrame([(i, "Aé " * 1_000_000, None, "s", 1) for i in range(3)], odd.select("doc_id", "text", "lang", "source", "n_chars").schema)
    check(long)
