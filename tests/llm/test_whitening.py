"""Whitening against the covariance's eigenvectors, and the solver against a plain one."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from freightlens.llm.bidiagonal import right_singular, squared_values
from freightlens.llm.whitening import fit_whitening, quantised, whiten


@pytest.fixture(scope="module")
def embeddings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def brute(rows, k=16):
    rows = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [tuple(math.floor(64 * c) + 1000000 for c in v) for _, v in rows]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    far = {v: [n * c - s for c, s in zip(v, sums, strict=True)] for v in fit}
    centred = np.array([far[v] for v in fit], float) / n
    e, vectors = np.linalg.eigh(centred.T @ centred / n)
    e, vectors = e[::-1], vectors[:, ::-1][:, :k]
    scores = np.array([far[v] for v in x], float) / n @ vectors / np.sqrt(e[:k])
    return rows, n, [sum(d * d for d in far[v]) for v in x], scores, e[:k] / e.sum()


def check(df, k=16):
    rows, n, deviation, scores, explained = brute([(r[0], r[1]) for r in df.select("vec_id", "embedding").collect()], k)
    out = whiten(df, components=k)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = {(r["vec_id"], r["component"]): r for r in out.collect()}
    assert len(got) == len(rows) * k
    assert {r["n"] for r in got.values()} == {n} and max(r["identity_error"] for r in got.values()) < 1e-9
    assert [got[i, 1]["deviation"] for i, _ in rows] == deviation
    np.testing.assert_allclose([got[rows[0][0], c + 1]["explained"] for c in range(k)], explained, rtol=1e-9)
    mine = np.array([[got[i, c + 1]["whitened"] for c in range(k)] for i, _ in rows])
    np.testing.assert_allclose(mine * np.sign((mine * scores).sum(axis=0)), scores, atol=1e-7)


def test_whitening_equals_eigenvectors(embeddings):
    check(embeddings)


def test_repeats_count_once_and_unusable_rows_go(spark, embeddings):
    again = embeddings.withColumn("vec_id", F.col("vec_id") + 10**6)
    odd = [(-1, None, 0), (-2, [1.0, None] * 32, 0), (-3, [float("nan")] * 64, 0), (-4, [float("inf")] + [0.0] * 63, 0), (-5, [], 0), (-6, [1e30] * 64, 0)]
    odd += [(-7, [1.0] * 3, 0)]  # of another length
    extra = spark.createDataFrame(odd, embeddings.schema)
    got = whiten(embeddings.unionByName(again).unionByName(extra).repartition(23))
    assert {r[0] for r in got.select("vec_id").distinct().collect()} == {r[0] for r in embeddings.unionByName(again).collect()}
    check(embeddings.unionByName(again).unionByName(extra.filter("vec_id > -6")).repartition(40))


def test_result_does_not_depend_on_partitions(embeddings):
    key = lambda df: {(r["vec_id"], r["component"]): abs(r["whitened"]) for r in whiten(df).collect()}
    a, b = key(embeddings), key(embeddings.repartition(37))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-9


def test_small_and_flat_tables(spark, embeddings):
    assert whiten(embeddings.limit(0)).collect() == []
    assert whiten(embeddings.limit(1)).collect() == []
    three = whiten(embeddings.limit(3)).collect()
    assert {r["component"] for r in three} == {1, 2}  # three points lie in a plane
    flat = spark.createDataFrame([(None, [1.0, float(i % 7), 5.0], "x") for i in range(50)], "vec_id long, embedding array<double>, n string")
    assert [(r["vec_id"], r["component"], r["n"]) for r in whiten(flat).collect()] == [(None, 1, 7)] * 50


def test_sums_beyond_64_bits_stay_exact(spark):
    big = 2.0**54
    rows = [(i, [big * (i % 3), -big * (i % 2), float(i)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = fit_whitening(df.select(quantised(F.col("embedding")).alias("x")), 3)
    x = {tuple(math.floor(64 * c) + 1000000 for c in v) for _, v in rows}
    assert model.centre.sums == tuple(sum(c) for c in zip(*x, strict=True)) and model.centre.n == len(x)
    assert all(r["deviation"] is None for r in whiten(df).collect())


@pytest.mark.parametrize("seed", range(40))
def test_solver_on_random_matrices(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(1, 40))
    matrix = rng.normal(size=(d, d)) * rng.choice([0, 1], size=(d, d), p=[0.4, 0.6]) * 10.0 ** rng.integers(-3, 3)
    if seed % 4 == 0:
        matrix = np.linalg.qr(rng.normal(size=(d, d)))[0] * 3  # all values equal
    values, vectors = right_singular(matrix, 16)
    want = np.linalg.svd(matrix)[1]
    np.testing.assert_allclose(np.sqrt(values), want, atol=1e-13 * max(want[0], 1e-300))
    k = vectors.shape[1]
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(k), atol=1e-9)
    np.testing.assert_allclose(matrix.T @ matrix @ vectors, vectors * values[:k], atol=1e-11 * max(want[0], 1e-300) ** 2)


def test_small_values_keep_their_accuracy():
    a, b = 10.0 ** -np.arange(12.0), 0.5 * 10.0 ** -np.arange(11.0)
    got = np.sqrt(squared_values(a, b))
    exact = np.linalg.inv(np.diag(a) + np.diag(b, 1))  # its largest value is one over the least
    assert abs(got[-1] * np.linalg.svd(exact)[1][0] - 1) < 1e-12
    assert abs(np.prod(got) / np.prod(a) - 1) < 1e-12


def test_close_pairs_get_vectors_of_their_own():
    matrix = np.diag(np.abs(np.arange(-10.0, 11))) + np.diag(np.ones(20), 1)
    values, vectors = right_singular(matrix, 16)
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(16), atol=1e-11)
    np.testing.assert_allclose(matrix.T @ matrix @ vectors, vectors * values[:16], atol=1e-11 * values[0])
