"""Embedding whitening against plain linear algebra on exact covariances."""

import math
import os
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import registry, whitening
from cohortloom.llm.common import read_table

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, components=4):
    """{vec_id: [(deviation, {component: |whitened|})]} and (n, shares) from exact sums."""
    kept = [(i, v) for i, v in rows if v is not None and all(
        c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in kept), default=0)
    whole = [(i, [math.floor(256 * float(np.float32(c))) for c in v] + [0] * (d - len(v)))
             for i, v in kept]
    fit = sorted({tuple(x) for _, x in whole})
    n = len(fit)
    sums = [sum(c) for c in zip(*fit, strict=True)]
    centred = [[Fraction(a) - Fraction(s, n) for a, s in zip(x, sums, strict=True)] for x in fit]
    exact = np.array([[float(sum(c[i] * c[j] for c in centred) / n) for j in range(d)]
                      for i in range(d)])
    values, vectors = np.linalg.eigh(exact)
    keep = [k for k in range(d)[::-1] if values[k] > 1e-12 * max(values)][:components]
    out = {}
    for i, x in whole:
        far = [n * a - s for a, s in zip(x, sums, strict=True)]
        y = np.array([float(Fraction(f, n)) for f in far])
        out.setdefault(i, []).append((sum(f * f for f in far), [
            abs(y @ vectors[:, k]) / math.sqrt(values[k]) for k in keep]))
    return out, n, [values[k] / np.trace(exact) for k in keep]


def check(frame, rows):
    found, (expected, n, shares) = frame.collect(), brute(rows)
    by_row = {}
    for r in found:
        assert r.n == n and r.identity_error < 1e-6
        assert r.explained == pytest.approx(shares[r.component - 1], rel=1e-9)
        by_row.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    assert len(found) == len(shares) * sum(map(len, expected.values()))
    for vec_id, own in expected.items():
        for deviation, coordinates in own:
            parts = by_row[vec_id, deviation if deviation < 2**63 else None]
            for k, value in enumerate(coordinates, 1):
                assert any(abs(r.whitened) == pytest.approx(value, rel=1e-6, abs=1e-8)
                           for r in parts[k])
    return found


def test_small_table(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(6) * [3, 2, 1, .5, .2, .1]).tolist()) for i in range(80)]
    rows += [(5, rows[0][1]), (None, rows[1][1]), (200, None), (201, [None, 1., 1., 1., 1., 1.]),
             (202, [float("nan")] * 6), (203, [float("inf"), 0., 0., 0., 0., 0.]), (204, [-0.0] * 6),
             (205, [1.0, 2.0]), (206, [])]
    frame = spark.createDataFrame(rows, SCHEMA).select(
        "*", *[F.lit("clash").alias(c) for c in ("x", "v", "i", "j", "l0", "n", "component", "label")])
    found = check(whitening.whitened(frame), rows)
    signs = {(r.vec_id, r.component): r.whitened for r in found if r.vec_id in (0, 5)}
    assert all(signs[0, k] in (signs[5, k], signs[0, k]) for k in (1, 2, 3, 4))
    again = {(r.vec_id, r.component): r.whitened for r in
             whitening.whitened(frame.repartition(7)).collect() if r.vec_id == 30}
    assert again == {(r.vec_id, r.component): r.whitened for r in found if r.vec_id == 30}


def test_hot_and_huge_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)]
    rows += [(1000 + i, rng.standard_normal(3).tolist()) for i in range(50)]
    check(whitening.whitened(spark.createDataFrame(rows, SCHEMA)), rows)
    huge = [(i, [float(np.float32(c)) for c in rng.standard_normal(3) * [1e9, 1e8, 1e7]])
            for i in range(40)]
    check(whitening.whitened(spark.createDataFrame(huge, SCHEMA)), huge)
    beyond = spark.createDataFrame([(1, [3e38]), (2, [-3e38]), (3, [0.0])], SCHEMA)
    assert {r.deviation for r in whitening.whitened(beyond).collect()} <= {None, 0, 1, 2, 3}


@pytest.mark.parametrize("rows", [
    [], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect() == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query(spark):
    rows = [tuple(r) for r in read_table(spark, FOLDER, "embeddings").select(
        "vec_id", "embedding").collect()]
    found = registry.op13_embedding_whitening(spark, FOLDER).collect()
    x = np.floor(256 * np.array([v for _, v in rows], np.float64))
    fit = np.unique(x, axis=0)
    assert len(found) == 4 * len(rows) and {r.n for r in found} == {len(fit)}
    y = x - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    at = {i: k for k, (i, _) in enumerate(rows)}
    for r in found:
        value = y[at[r.vec_id]] @ vectors[:, -r.component] / np.sqrt(values[-r.component])
        assert abs(r.whitened) == pytest.approx(abs(value), abs=1e-9)
        assert r.explained == pytest.approx(values[-r.component] / values.sum(), rel=1e-9)
        assert r.identity_error < 1e-9
    deviation = ((len(fit) * x - fit.sum(axis=0)).astype(np.int64) ** 2).sum(axis=1)
    assert all(r.deviation == deviation[at[r.vec_id]] for r in found)


def spectra(d):
    rng = np.random.default_rng(d)
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
    for values in (np.arange(d), np.ones(d), np.geomspace(1, 1e-8, d), np.arange(d) // 3,
                   np.minimum(np.arange(d), 3), np.where(np.arange(d) > d - 4, 1, 1 - 1e-9)):
        matrix = (turn * values) @ turn.T
        yield (matrix + matrix.T) / 2


@pytest.mark.parametrize("d", [1, 2, 5, 16, 60])
def test_contour_integration(d):
    for matrix in spectra(d):
        exact = np.linalg.eigvalsh(matrix)[::-1]
        inertia = whitening.Inertia(matrix)
        for shift in (-1.0, 0.35, 0.99999, 2.5, 70.0):
            assert inertia.above(shift) == (exact > shift).sum()
        for wanted in (1, 4, d):
            values, vectors = whitening.leading_pairs(matrix, wanted)
            assert np.allclose(values, exact[:values.size], rtol=1e-11, atol=1e-12 * max(exact[0], 1))
            assert values.size == min(wanted, (exact > 1e-11 * max(exact[0], 0.1)).sum()) or d < 3
            assert np.abs(vectors.T @ vectors - np.eye(values.size)).max(initial=0) < 1e-11
            assert np.abs(matrix @ vectors - vectors * values).max(initial=0) < 1e-11 * max(exact[0], 1)


def test_projection_finds_only_the_interval():
    matrix = np.diag(np.arange(1.0, 31.0))
    values, vectors = whitening.feast(matrix, 9.5, 14.5, 5)
    assert np.allclose(values, [10, 11, 12, 13, 14])
    assert np.allclose(np.abs(vectors[9:14]), np.eye(5))


def test_limbs_and_products_are_exact():
    numbers = [0, 1, -1, 2**31, -2**31, 2**63 - 1, -2**63, 2**70 + 5, -2**100 - 7]
    for row, number in zip(whitening.limbs(np.array(numbers, object)), numbers, strict=True):
        assert sum(int(v) << (32 * k) for k, v in enumerate(row)) == number
    rng = np.random.default_rng(0)
    for scale in (10, 2**25, 2**40):
        rows = rng.integers(-scale, scale, (50, 4))
        exact = rows.astype(object).T @ rows.astype(object)
        assert (whitening.gram(rows) == exact).all()
    lists = pa.array([[1, 2], [3, 4], [5, 6]], pa.list_(pa.int64()))
    assert whitening.matrix_of(lists.slice(1)).tolist() == [[3, 4], [5, 6]]
