"""Exact dedup, decontamination and URL filters: SQL, odd rows and brute force."""

from __future__ import annotations

import hashlib
import itertools
import re

import pytest

from freightlens.llm import decontaminate as dc
from freightlens.llm import exact_dedup as ed
from freightlens.llm.components import components
from freightlens.llm.oracle import oracle_sql
from freightlens.llm.queries import queries
from freightlens.llm.url_filter import judge_urls
from tests.check_oracle import compare, connect


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_against_sql(spark, sf_dir, name):
    assert compare(queries()[name](spark, sf_dir), connect(sf_dir), oracle_sql()[name]) == ""


def _no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_exact_dedup_of_odd_rows(odd, monkeypatch):
    for cells in (16, 2):  # a crowded filter must not change the result
        monkeypatch.setattr(ed, "CELLS_FOR_TEXT", cells)
        got = ed.exact_duplicates(odd)
        _no_python(got)
        rows = {r["doc_id"]: r for r in got.collect()}
        assert got.count() == odd.count()
        assert [rows[i]["keep_id"] for i in range(8)] == [0, 0, 2, 3, 4, 4, 6, 6]
        assert rows[6]["group_size"] == 3 and rows[6]["kept"] and not rows[7]["kept"]
        assert rows[0]["text_sha256"] == hashlib.sha256(b"").hexdigest()
        assert rows[None]["keep_id"] is None and rows[None]["kept"]
    kept = ed.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, i) for i in (0, 2, 3, 4, 6, 8, 9, 10, 11)] + [(True, None)]
    assert ed.exact_duplicates(odd.limit(0)).collect() == [] == ed.drop_exact_duplicates(odd.limit(0)).collect()


def test_masks_find_every_window():
    for gone in itertools.combinations(range(dc.WINDOW), dc.SUBSTITUTIONS):
        left = set(range(dc.WINDOW)) - set(gone)
        assert any(all(s + o in left for o in mask) for mask in dc.MASKS for s in range(dc.WINDOW - mask[-1]))


def test_decontamination_of_planted_passages(spark, docs, odd):
    item = " ".join(f"Word{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (2, "too short to look for"), (3, None), (1, item)], "item_id long, text string")
    words = item.lower().split()
    changed = [w if i not in (5, 9) else "other" for i, w in enumerate(words[:13])]
    broken = [w if i % 4 else "other" for i, w in enumerate(words)]
    rows = [(1, f"before it\n{item.upper()} after"), (2, "x " + " ".join(changed)), (3, " ".join(broken)), (4, " ".join(words[:12])), (5, "too short to look for"), (6, None), (None, item)]
    planted = spark.createDataFrame(rows, "doc_id long, text string")
    got = dc.overlaps(planted, bench)
    _no_python(got)
    assert sorted((r["doc_id"] or 0, r["item_id"], r["doc_from"], r["doc_to"], r["agree"]) for r in got.collect()) == [(0, 1, 0, 20, 13), (1, 1, 2, 22, 13), (2, 1, 1, 14, 11)]
    left = dc.drop_contaminated(planted, bench)
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5, 6]
    assert dc.overlaps(odd, bench).collect() == []
    assert dc.overlaps(planted.limit(0), bench).collect() == [] == dc.overlaps(planted, bench.limit(0)).collect()


def test_decontamination_judges_rows_of_one_id_apart(spark):
    item = " ".join(f"Word{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, item), (None, "a clean text"), (None, None), (7, item + " x"), (7, "another clean text"), (7, item + " x")]
    planted = spark.createDataFrame(rows, "doc_id long, text string")
    left = {(r["doc_id"], r["text"]) for r in dc.drop_contaminated(planted, bench).collect()}
    assert left == {(None, "a clean text"), (None, None), (7, "another clean text")}
    assert sorted((r["doc_id"] or 0, r["doc_to"]) for r in dc.overlaps(planted, bench).collect()) == [(0, 20), (7, 20)]


def test_components_against_union_find(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(0, 60) if i % 13] + [("hub", f"leaf{i}") for i in range(200)] + [("a", "a"), (None, "b")]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u string, v string")).collect()}
    root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in edges:
        if a in root and b in root:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root}


def test_url_rules_and_aliases(spark):
    link = "<html><link href='{}' rel='canonical'></html>".format
    pages = [
        (1, "http://A.Example.com/en/x?q#f", None),  # blocked by its own rule
        (2, "http://www.example.com/en/", link("http://other.example.com/en/")),  # its own allow goes first
        (3, "http://site.org/a/b", link("//x.example.com/en/1")),  # alias of a blocked url
        (4, "https://SITE.org/a/c", link("b")),  # alias of an alias
        (5, "http://mirror.org", '<META http-equiv="refresh" content="0; url=http://site.org/a/b">'),
        (6, "http://free.org/", None),
        (7, None, link("http://b.net/fr/")),
        (8, "no scheme", None),
        (9, "http://mixed.org/", link("http://q.net/es/1")),
        (10, "http://mixed.org/2", '<link rel=canonical href="/"><meta http-equiv=refresh content="1;url=http://ok.com/">'),
        (11, "http://x.net/es", None),
        (12, "ftp://net/es/?a://b", None),
        (12, "ftp://net/es/?a://b", None),
    ]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, verdict string")
    got = judge_urls(df)
    rows = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect())
    assert rows[:5] == [
        (1, "a.example.com", "/en/x", "example.com/en/", "block"),
        (2, "www.example.com", "/en/", "www.example.com/en/", "allow"),
        (3, "site.org", "/a/b", None, "block"),
        (4, "site.org", "/a/c", None, "block"),
        (5, "mirror.org", "", None, "block"),
    ]
    assert [(r[0], r[3], r[4]) for r in rows[5:]] == [
        (6, None, "allow"), (7, None, "allow"), (8, None, "allow"), (9, None, "allow"), (10, None, "allow"), (11, None, "allow"), (12, "net/es/", "block"), (12, "net/es/", "block"),
    ]
    con = connect("/root/testdata/sf0.001")
    con.register("given_pages", df.toPandas())
    con.execute("CREATE OR REPLACE VIEW pages AS SELECT * FROM given_pages")
    assert compare(got.drop("component"), con, oracle_sql()["op10_url_filter"]) == ""
    assert judge_urls(df.limit(0)).collect() == []
