"""The Jaccard join against all pairs of shingle sets."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from freightlens.llm import jaccard_join as jj
from freightlens.llm.words import shingle_hashes, word_hashes


def brute(rows, threshold=0.8):
    words = {}
    for doc, text in rows:
        words[doc] = tuple((text or "").lower().split())
    first = {}
    for doc in sorted(words):
        first.setdefault(words[doc], doc)
    sets = {d: {w[i : i + 5] for i in range(max(1, len(w) - 4))} for w, d in first.items() if w}
    links, root = {d: 0 for d in first.values()}, {d: d for d in first.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (find(first[w]), first[w], links[first[w]]) for d, w in words.items()}


@pytest.fixture(scope="module")
def family(spark):
    """One group of 400 near copies around the threshold, 200 exact copies, and other texts."""
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    texts = [" ".join(base)] * 200
    for _ in range(400):
        words = list(base)
        for at in rng.sample(range(150), rng.randint(0, 5)):
            words[at] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    rng.shuffle(texts)
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_family_against_all_pairs(monkeypatch, family):
    monkeypatch.setattr(jj, "TILE", 64)  # a node of 400 is many groups
    got = {r["doc_id"]: tuple(r)[1:] for r in jj.jaccard_links(family).collect()}
    want = brute([(r["doc_id"], r["text"]) for r in family.collect()])
    assert set(got) == set(want)
    assert {d: x[1] for d, x in got.items()} == {d: x[1] for d, x in want.items()}
    found, true = sum(x[2] for x in got.values()), sum(x[2] for x in want.values())
    assert all(got[d][2] <= want[d][2] for d in want)
    assert found >= jj.TARGET_RECALL * true > 10_000


def test_sample_documents_against_all_pairs(docs):
    got = {r["doc_id"]: tuple(r)[1:] for r in jj.jaccard_links(docs).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_stage_keeps_one_of_each_class(docs):
    kept = jj.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = {x[0] for x in brute([(r["doc_id"], r["text"]) for r in docs.collect()]).values()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_odd_rows(odd, spark):
    rows = jj.jaccard_links(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[0]["copy_of"] == by_id[1]["copy_of"] == by_id[2]["copy_of"] == 0
    assert by_id[5]["copy_of"] == 4 and by_id[7]["class_id"] == 6
    assert by_id[None]["class_id"] is None
    same = spark.createDataFrame([(1, "a b c d e f"), (1, "quite another text of many words"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["copy_of"]) for r in jj.jaccard_links(same).collect()) == [(1, 1), (1, 1), (2, 1)]
    assert jj.jaccard_links(odd.limit(0)).collect() == []


def test_prefix_depth_reaches_the_target():
    depth = jj.shortened(0.8, jj.TARGET_RECALL)
    assert jj.recall_at(depth, 0.8) >= jj.TARGET_RECALL > jj.recall_at(depth + 1, 0.8)
    with pytest.raises(ValueError):
        jj.shortened(0.01, 0.9)


def test_shingles():
    off, words = word_hashes(pa.array([" a b ", "", None, "a b c d e f", "A B"]))
    s_off, shingles = shingle_hashes(off, words)
    assert np.diff(off).tolist() == [2, 0, 0, 6, 2] and np.diff(s_off).tolist() == [1, 0, 0, 2, 1]
    assert shingles[0] == shingles[3] and len(set(shingles.tolist())) == 3
