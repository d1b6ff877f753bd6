"""Whitening: the spectral division against known spectra, the whole against a plain eigendecomposition."""

from __future__ import annotations

import math

import numpy as np
import pytest

from sealroute.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, x string, n int"


def rotated(values, seed=3):
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return basis @ np.diag(values) @ basis.T


@pytest.mark.parametrize("values", [
    [1.0], [3.0, 1.0], [1.0, 1.0, 1.0], [5, 5, 5, 1, 1, 0], [1e6, 1e3, 1, 1e-3, 1e-6], [0, 0, 0, 7], list(range(1, 41))])
def test_spectral_parts(values):
    matrix = rotated(values)
    found, vectors = whitening.spectral_parts(matrix)
    assert np.allclose(found, sorted(values, reverse=True), atol=1e-14 * max(values) * len(values), rtol=0)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-13 * max(values)


def test_polar_factor():
    matrix = rotated([4, 2, -1, -3])
    factor = whitening.polar(matrix)
    assert np.abs(factor @ factor - np.eye(4)).max() < 1e-13
    assert np.linalg.eigvalsh(factor @ matrix).min() > 0.99


def expected(vectors):
    """(n, deviations, components up to sign, explained) by a plain eigendecomposition."""
    whole = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vector] for vector in vectors])
    fit = np.unique(whole, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    covariance = centred.T @ centred / n
    values, parts = np.linalg.eigh(covariance)
    values, parts = values[::-1][:16], parts[:, ::-1][:, :16]
    return n, ((n * whole - sums) ** 2).sum(axis=1), (whole - sums / n) @ parts / np.sqrt(values), values / np.trace(covariance)


def compare(rows, vectors, count):
    n, deviations, whitened, explained = expected(vectors)
    assert len(rows) == len(vectors) * count
    rows = sorted(rows, key=lambda row: (row.vec_id, row.component))
    assert [row.component for row in rows[:count]] == list(range(1, count + 1))
    got = np.array([row.whitened for row in rows]).reshape(-1, count)
    signs = np.sign((got * whitened).sum(axis=0))
    assert np.abs(got * signs - whitened).max() < 1e-8
    assert [row.deviation for row in rows[::count]] == deviations.tolist()
    assert {row.n for row in rows} == {n}
    assert np.allclose([row.explained for row in rows[:count]], explained, rtol=1e-9)
    assert {row.identity_error for row in rows}.pop() < 1e-9


def test_against_eigendecomposition(spark):
    draw = np.random.default_rng(5)
    vectors = (draw.standard_normal((300, 24)) * np.linspace(0.2, 3, 24)).tolist()
    vectors += [vectors[0]] * 150 + [vectors[1]]
    made = [(i, vector, "clash", 1) for i, vector in enumerate(vectors)]
    odd = [(-1, None, "", 1), (-2, [None] + vectors[0][1:], "", 1), (-3, [math.nan] + vectors[0][1:], "", 1),
           (-4, [math.inf] + vectors[0][1:], "", 1), (-5, [1.0, 2.0], "", 1), (-6, [], "", 1), (-7, [3e38] * 24, "", 1)]
    frame = spark.createDataFrame(made + odd, SCHEMA).repartition(7)
    compare(whitening.whiten(frame).collect(), vectors, 16)


def test_few_dimensions_and_repeated_keys(spark):
    vectors = [[1.0, 0.0], [0.0, 2.0], [3.0, 1.0], [3.0, 1.0]]
    rows = whitening.whiten(spark.createDataFrame([(None, vector, "", 1) for vector in vectors], SCHEMA)).collect()
    assert len(rows) == 8 and {row.vec_id for row in rows} == {None} and {row.n for row in rows} == {3}


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None, [math.nan]], [[], []]])
def test_without_variance(spark, vectors):
    frame = spark.createDataFrame([(i, vector, "", 1) for i, vector in enumerate(vectors)], SCHEMA)
    found = whitening.whiten(frame)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert found.collect() == []


def test_large_entries_are_exact(spark):
    vectors = [[2.0**40, 1.0], [-(2.0**40), 1.0], [0.0, 2.0]]
    rows = whitening.whiten(spark.createDataFrame([(i, v, "", 1) for i, v in enumerate(vectors)], SCHEMA)).collect()
    assert {row.deviation for row in rows} == {None, 128**2}


def test_registered_query_whitens_its_table(spark):
    from sealroute.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op11_whitening"][0](spark, sf).collect()
    given = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    compare(rows, [row.embedding for row in given], 16)
