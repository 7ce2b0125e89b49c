"""Language ID, quality, language model and license scans: held-out accuracy, brute force, odd rows."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from freightlens.llm import language_id as li
from freightlens.llm import license_scan as ls
from freightlens.llm import lm_score as lm
from freightlens.llm import quality as ql
from freightlens.llm.queries import VOCABULARY

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def big(spark):
    return spark.read.parquet(f"{BIG}/documents.parquet")


def _rest(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def test_language_on_held_out_rows(big):
    truth = {r["doc_id"]: r["lang"] for r in big.select("doc_id", "lang").collect()}
    rows = li.identify(big).collect()
    assert {r["doc_id"] for r in rows} == set(truth)
    assert all(r["held_out"] == (_rest(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_language_never_reads_the_label_of_what_it_predicts(spark, big):
    from pyspark.sql import functions as F

    model = li.fit(big)
    other = big.withColumns({"lang": F.lit("xx"), "source": F.lit("y"), "doc_id": F.col("doc_id") + 1_000_000})
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in li.identify(big, model=model).collect()}
    b = {r["doc_id"] - 1_000_000: (r["lang_pred"], r["score"]) for r in li.identify(other, model=model).collect()}
    assert a == b


def test_language_of_odd_rows(spark, odd, big):
    rows = {r["doc_id"]: r for r in li.identify(odd, model=li.fit(big)).collect()}
    assert [(rows[i]["lang_pred"], rows[i]["score"]) for i in range(3)] == [("und", 0.0)] * 3
    assert rows[3]["lang_pred"] != "und"
    assert len(li.identify(odd).collect()) == odd.count()
    assert {r["lang_pred"] for r in li.identify(odd.drop("lang").selectExpr("*", "cast(null as string) as lang")).collect()} == {"und"}
    assert li.identify(odd.limit(0)).collect() == []
    kept = li.keep_identified(odd, 0.0)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({0, 1, 2})


def test_every_one_of_many_languages_is_learned(spark, monkeypatch):
    monkeypatch.setattr(li, "MOST_ROWS", 300)
    rng = np.random.default_rng(0)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = [["".join(rng.choice(letters, 7)) for _ in range(6)] for _ in range(70)]
    rows = [(k * 100 + i, " ".join(rng.choice(words[k], 20)), f"l{k:02}") for k in range(70) for i in range(10 if k < 66 else 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = {r[2] for r in rows if _rest(r[0], 4) != 2}
    assert len(learned) > 64
    model = li.fit(df)
    assert {m for f in model.families for m in f} == learned
    got = {r["doc_id"]: r["lang_pred"] for r in li.identify(df, model=model).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows if lang in learned]) > 0.95


def test_quality_on_held_out_rows(spark, big):
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = ql.score_quality(big, labels).collect()
    assert len(rows) == big.count()
    assert all(r["held_out"] == (_rest(r["doc_id"], 4) == 2) and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.95


def test_quality_of_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in ql.score_quality(odd, none).collect()} == {0.5}
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(3, 0, 0), (4, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = ql.score_quality(odd, some).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert ql.score_quality(odd.limit(0), some).collect() == []


def test_quality_tables_recover_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(ql.NAMES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = ql.Model.train(x[:2000], y[:2000])
    assert (0, 1) in model.pairs
    assert np.mean((model.score(x[2000:]) > 0.5) == y[2000:]) > 0.95


def _words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\v\f\r":
        low = low.replace(blank, " ")
    return [w for w in low.split(" ") if w] + ["\n"]


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_base_score_against_brute_force(request, name, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN_WORDS", 50)  # most words take the join
    monkeypatch.setattr(lm, "STEPS", 20)
    df = request.getfixturevalue(name)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    counts = Counter(w for d, t in rows if d is not None and _rest(d, 7) != 2 for w in _words(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (d is None, d or 0, len(_words(t)), sum(counts[w] > 0 for w in _words(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in _words(t)), 4))
        for d, t in rows
    )
    got = lm.score_texts(df, VOCABULARY).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and _rest(r["doc_id"], 7) == 2) for r in got)


def test_model_of_an_empty_table(docs):
    assert lm.score_texts(docs.limit(0), VOCABULARY).collect() == []


def test_training_covers_all_texts(spark, monkeypatch):
    """More texts than a fixed sample of 1,500 would hold, dealt to several shards."""
    monkeypatch.setattr(lm, "STEPS", 60)
    trained, given = [], lm._trained
    monkeypatch.setattr(lm, "_trained", lambda texts, *a: trained.append((texts.count(), texts.select("shard").distinct().count())) or given(texts, *a))
    rng = np.random.default_rng(0)
    names = ["stone", "river", "green", "silver", "winter", "golden", "summer", "market"]
    text = lambda n: " ".join(f"{names[k]} {('north', 'south')[k % 2]}" for k in rng.integers(0, 8, n))
    rows = [(i, text(90)) for i in range(3000)]
    turned = [(10**6 + i, t.replace("north", "#").replace("south", "north").replace("#", "south")) for i, t in rows[:50]]
    df = spark.createDataFrame(rows + turned, "doc_id long, text string").repartition(4, "doc_id")
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(df, VOCABULARY).collect()}
    assert sum(n for n, _ in trained) == sum(_rest(i, 7) != 2 for i, _ in rows + turned)
    assert len(trained) == lm.ROUNDS and all(shards > 1 for _, shards in trained)
    assert np.mean([got[i] - got[10**6 + i] for i in range(50)]) > 5


def test_attention_tells_ids_of_one_symbol_apart():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 50, (500, lm.WINDOW))
    x, y = np.full(ids.shape, lm.OUTPUTS - 1), ids % 2
    model = lm.Attention.fresh(ids=50)
    model.train(x, y, np.ones(x.shape, np.float32), steps=150, ids=ids)
    assert model.log10(x, y, ids).mean() > -0.1  # -0.3 is a guess


def test_rows_restore_the_parameters():
    model = lm.Attention.fresh(2, ids=9)
    model.p["id"][:] = np.arange(9)[:, None]
    row, weight, values = model.rows(3.0, np.array([0, 2, 0, 0, 0, 0, 0, 0, 1.0]))
    assert sorted(set(weight)) == [1.0, 2.0, 3.0]
    back = lm.Attention.fresh(5, ids=9).with_rows(row, values)
    assert all((back.p[k] == a).all() for k, a in model.p.items() if k != "id")
    assert back.p["id"][:, 0].tolist() == [0, 1, 0, 0, 0, 0, 0, 0, 8]


def _model(symbols=40):
    model = lm.Attention.fresh(3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(1)
    return model, rng.integers(0, symbols, (3, lm.WINDOW)), rng.integers(0, symbols, (3, lm.WINDOW))


def test_gradients_against_differences():
    model, x, y = _model()
    weight = np.ones(x.shape)
    weight[0, :5] = 0
    got = model.gradients(x, y, weight)
    loss = lambda: -(model.log10(x, y) * np.log(10) * weight).sum() / weight.sum()
    for name, grad in got.items():
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        old, step = model.p[name][at], 1e-4
        model.p[name][at] = old + step
        up = loss()
        model.p[name][at] = old - step
        down = loss()
        model.p[name][at] = old
        assert (up - down) / (2 * step) == pytest.approx(grad[at], rel=2e-2), name


def test_attention_is_causal_and_sums_to_one():
    model, x, y = _model()
    before = model.log10(x, y)
    x[:, 20:] = 7
    assert np.allclose(model.log10(x, y)[:, :20], before[:, :20])
    total = sum(10 ** model.log10(x[:1], np.full((1, lm.WINDOW), s)) for s in range(lm.OUTPUTS))
    assert np.allclose(total, 1, atol=1e-5)


def test_each_symbol_is_scored_once():
    lengths = [0, 1, lm.WINDOW, lm.WINDOW + 1, 3 * lm.WINDOW + 5, 0, lm.STRIDE]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    symbols = np.arange(offsets[-1]) % lm.OUTPUTS
    x, y, place = lm.windows(offsets, symbols)
    scored = place[place >= 0]
    assert sorted(scored.tolist()) == list(range(offsets[-1]))
    assert (y[place >= 0] == symbols[scored]).all()
    firsts = np.isin(scored, offsets[:-1])
    assert (x[place >= 0][firsts] == lm.OUTPUTS).all() and (x[place >= 0][~firsts] == symbols[scored[~firsts] - 1]).all()


def test_no_probabilities_of_context_are_worked_out(monkeypatch):
    rng = np.random.default_rng(2)
    lengths = np.array([0, 1, lm.WINDOW, 40 * lm.WINDOW + 5, 30 * lm.WINDOW])
    offsets, ids = np.concatenate([[0], np.cumsum(lengths)]), rng.integers(0, 300, lengths.sum())
    symbols = lm.Symbols.of(np.bincount(ids, minlength=300).astype(float), ids)
    model = lm.Model(None, symbols, lm.Attention.fresh(ids=301))
    model.attention.p["id"][:] = rng.standard_normal((301, lm.WIDTH))
    x, y, place = lm.windows(offsets, ids, start=300)
    said = np.where(place >= 0, model.attention.log10(symbols.with_start()[x], symbols.with_start()[y], x), 0).sum(axis=1)
    want = np.bincount(np.searchsorted(offsets, place.max(axis=1), "right") - 1, said, len(lengths))
    want += np.bincount(np.repeat(np.arange(len(lengths)), lengths), symbols.share[ids], len(lengths))
    rows, given = [], lm.Attention.logits
    monkeypatch.setattr(lm.Attention, "logits", lambda self, h2: rows.append(len(h2)) or given(self, h2))
    assert np.allclose(model.score(offsets, ids), want, rtol=1e-5)
    assert sum(rows) <= lengths.sum() + len(lengths) * lm.WINDOW  # with context it was nearly twice that


def test_each_symbol_behind_a_border_has_half_a_window_of_context():
    n = 5 * lm.WINDOW + 3
    _, _, place = lm.windows(np.array([0, n]), np.arange(n) % lm.OUTPUTS)
    context = (place < 0).argmin(axis=1)[1:]  # ids of the window in front of its first scored one
    assert len(context) and (context >= lm.WINDOW // 2).all()


def test_training_beats_the_unigram(docs):
    rows = docs.select("text").limit(150).toPandas()["text"].tolist()
    vocabulary = lm.bpe.load(VOCABULARY)
    off, index, w_off, w_data = lm.cut_words(pa.array(rows, pa.string()))
    p_off, p_ids = lm._merged(w_off, w_data, vocabulary)
    _, ids = lm.taken(p_off, p_ids, index)
    size = np.add.reduceat(np.diff(p_off)[index], off[:-1])
    counts = np.bincount(ids, minlength=len(vocabulary.ids) + 1).astype(float)
    model = lm.Model(vocabulary, lm.Symbols.of(counts, ids), lm.Attention.fresh())
    offsets = np.concatenate([[0], np.cumsum(size)])
    x, y, place = lm.windows(offsets, model.symbols.symbol[ids].astype(np.int64))
    model.attention.train(x, y, (place >= 0).astype(np.float32), steps=300)
    unigram = np.log10((counts[ids] + 1) / (counts.sum() + len(counts))).sum()
    assert model.score(offsets, ids).sum() > 0.9 * unigram


def _brute_licenses(text):
    words = (text or "").lower().split()
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    have = sets(words)
    return {n for n, t in ls.TEMPLATES.items() if len(have & (s := sets(t.lower().split()))) >= 0.8 * len(s) - 1e-9}


def test_license_scan_against_brute_force(spark, big):
    long = ls.TEMPLATES["MIT-text"].split()
    planted = [
        (10**9, "x " * 700 + " ".join(long) + " y" * 900), (10**9 + 1, " ".join(long[:48] + ["changed"] + long[49:])),
        (10**9 + 2, " ".join(long[:30])), (10**9 + 3, ls.TEMPLATES["GPL-3.0"].upper().replace("3.", "2.")), (10**9 + 4, None), (None, ls.TEMPLATES["MIT"]),
        (10**9 + 5, ls.TEMPLATES["MIT"] + " z" * 50 + " " + ls.TEMPLATES["MIT"]),
    ]
    df = big.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    got = ls.scan_licenses(df).collect()
    want = {(r["doc_id"], n) for r in df.collect() for n in _brute_licenses(r["text"])}
    assert {(r["doc_id"], r["license"]) for r in got} == want
    at = {(r["doc_id"], r["license"]): r for r in got}
    assert (at[10**9, "MIT-text"]["word_from"], at[10**9, "MIT-text"]["word_to"]) == (700, 700 + len(long))
    assert sum(r["doc_id"] == 10**9 + 5 for r in got) == 2


def test_license_bands_reach_their_guarantee(spark, odd):
    scanner = ls.Scanner.compile(ls.TEMPLATES)
    for size in scanner.sizes:
        for i in {t for _, members in size.keys for t in members.tolist()}:
            n = len(scanner.sets[i])
            common = ls.least_common(n, ls.CONTAINMENT)
            assert 1 - (1 - (common / (size.window + n - common)) ** ls.ROWS) ** size.bands >= ls.COLLISION
    assert ls.scan_licenses(odd).collect() == [] == ls.scan_licenses(odd.limit(0)).collect()
