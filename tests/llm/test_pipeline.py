"""The pipeline's stages, each against what its own input says."""

from __future__ import annotations

import hashlib
import random
import string

from freightlens.llm.common import written
from tests.llm.test_jaccard import brute

import corpus_pipeline as cp


def _words(text):
    return [w for w in (text or "").lower().split() if w]


def test_stages(spark, sf_dir, docs):
    assert [n for n, _ in cp.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "decontamination", "bpe_codec"]
    from pyspark.sql import functions as F

    extra = docs.limit(3).withColumns({"doc_id": F.col("doc_id") + 10**9, "text": F.lit(None).cast("string")})
    given = written(docs.unionByName(extra).unionByName(docs.limit(5).withColumn("doc_id", F.col("doc_id") + 10**9 + 50)))
    had, kept = {}, {r["doc_id"]: r["text"] for r in given.collect()}
    df = given
    for name, stage in cp.STAGES[:-1]:
        df = written(stage(spark, df, sf_dir))
        assert df.columns == docs.columns
        had, kept = kept, {r["doc_id"]: r["text"] for r in df.collect()}
        assert kept.items() <= had.items()
        if name == "language_id":
            assert set(had) - set(kept) == {d for d, t in had.items() if not any(c.isalpha() for c in t or "")}
        elif name == "exact_dedup":
            first = {}
            for d in sorted(had):
                first.setdefault(" ".join((had[d] or "").split()), d)
            assert set(kept) == set(first.values())
        elif name == "jaccard_join":
            assert set(kept) == {x[0] for x in brute(list(had.items())).values()}
        else:
            items = [_words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            runs = {tuple(i[s : s + 13]) for i in items for s in range(len(i) - 12)}
            exact = {d for d, t in had.items() if any(tuple(w[s : s + 13]) in runs for w in [_words(t)] for s in range(len(w) - 12))}
            assert exact and exact <= set(had) - set(kept)
    last = {r["doc_id"]: r for r in cp.STAGES[-1][1](spark, df, sf_dir).collect()}
    assert {d: r["decoded_sha256"] for d, r in last.items()} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in kept.items()}


def test_run(spark, sf_dir):
    rows = cp.run(spark, sf_dir).collect()
    assert rows and len({r["doc_id"] for r in rows}) == len(rows)


def test_language_stage_drops_foreign_and_gibberish_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(1)
    drawn = lambda letters, least, most, n: " ".join("".join(rng.choices(letters, k=rng.randint(least, most))) for _ in range(n))
    low, keys = string.ascii_lowercase, string.ascii_letters + string.digits
    planted = [
        drawn(low, 3, 9, 200), drawn(low, 3, 9, 15), drawn(keys, 40, 40, 50),
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    ]
    rows = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(planted)], "doc_id long, text string")
    given = written(docs.unionByName(rows, allowMissingColumns=True))
    kept = {r["doc_id"] for r in cp.language_id(spark, given, "").select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
