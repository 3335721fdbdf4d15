"""Embedding whitening against a brute-force fit in exact integers and numpy's eigen-solver."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from muster.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, components=16):
    x = {}
    for k, (_, v, _) in enumerate(rows):
        x[k] = [math.floor(64 * float(c)) + 1_000_000 for c in v]
    fit = sorted({tuple(v) for v in x.values()})
    n, dim = len(fit), len(fit[0])
    sums = [sum(v[i] for v in fit) for i in range(dim)]
    centred = np.array([[float(Fraction(v[i]) - Fraction(sums[i], n)) for i in range(dim)] for v in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for k, row in enumerate(rows):
        score = np.array([float(Fraction(c) - Fraction(s, n)) for c, s in zip(x[k], sums)]) @ vectors / np.sqrt(values)
        out[row[0]] = (n, sum((n * c - s) ** 2 for c, s in zip(x[k], sums)), score, values / np.trace(centred.T @ centred / n))
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(3)
    vectors = (rnd.normal(size=(600, 20)) * np.linspace(0.2, 1, 20)).astype(np.float32).tolist()
    rows = [(k, v, k % 3) for k, v in enumerate(vectors)]
    return rows + [(1000 + k, vectors[7], 0) for k in range(300)]


def test_equals_brute_force(spark, rows):
    odd = [(2000, None, 1), (2001, [1.0] * 19 + [None], 1), (2002, [float("nan")] * 20, 1), (2003, [float("inf")] * 20, 1), (2004, [], 1), (2005, [0.5], 1)]
    got = whitening.whiten(spark.createDataFrame(rows + odd, SCHEMA).repartition(40)).toPandas()
    want = brute(rows)
    assert got.groupby("vec_id").size().to_dict() == dict.fromkeys(want, 16)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10
    signs = {}
    for r in got.itertuples():
        n, deviation, score, explained = want[r.vec_id]
        k = r.component - 1
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.explained / explained[k] - 1) < 1e-10
        assert abs(abs(r.whitened) - abs(score[k])) < 1e-9 * max(1, abs(score[k]))
        if abs(score[k]) > 1e-6:
            assert signs.setdefault(k, np.sign(r.whitened) == np.sign(score[k])) == (np.sign(r.whitened) == np.sign(score[k]))


def test_partitions_do_not_matter(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    one, many = (whitening.whiten(frame.repartition(k)).toPandas().set_index(["vec_id", "component"]).sort_index() for k in (1, 50))
    assert np.allclose(one.whitened, many.whitened, rtol=0, atol=1e-10) and (one.deviation == many.deviation).all()


def test_moments_are_welford_merged(spark):
    x = np.random.default_rng(1).integers(-50, 50, (500, 6)) + 10**6
    from muster.llm.tables import scratch

    with scratch(spark) as keep:
        frame = spark.createDataFrame([(v,) for v in x.tolist()], "x array<long>").repartition(37)
        got = whitening.moments(frame, keep)
    assert got["n"] == 500 and got["sums"] == x.sum(0).tolist()
    assert np.allclose(np.array(got["spread"]).reshape(6, 6), np.cov(x.T, bias=True) * 500, rtol=1e-12)


@pytest.mark.parametrize("n", [1, 2, 5, 60])
def test_symmetric_qr(n):
    a = np.random.default_rng(n).normal(size=(n, 2 * n))
    a = a @ a.T
    values, vectors = whitening.symmetric_qr(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1]) and np.allclose(a @ vectors, vectors * values) and np.allclose(vectors.T @ vectors, np.eye(n))


def test_degenerate_matrices():
    for a in (np.eye(4), np.zeros((3, 3)), np.ones((5, 5)), np.diag([2.0, 1, 1, 0])):
        values, vectors = whitening.symmetric_qr(a)
        assert np.allclose(a @ vectors, vectors * values) and np.allclose(vectors.T @ vectors, np.eye(len(a)))


def test_edge_cases(spark):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame([(1, None, 1), (2, [], 1)])).count() == 0
    alone = whitening.whiten(frame([(1, [0.5, 0.25], 1), (None, [0.5, 0.25], 1)])).collect()
    assert len(alone) == 4 and {r.whitened for r in alone} == {None} and {r.explained for r in alone} == {None} and {r.identity_error for r in alone} == {None}
    flat = whitening.whiten(frame([(k, [float(k), 1.0, 1.0], 1) for k in range(9)])).collect()
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True), (3, True)}
    huge = whitening.whiten(frame([(1, [1e15, 0.0], 1), (2, [0.0, 0.0], 1)])).collect()
    assert {r.deviation for r in huge} == {None}
    clash = frame([(k, [float(k), float(k % 3)], 1) for k in range(9)]).withColumns({c: F.lit(1) for c in ("x", "n", "vector", "component", "sums")})
    assert whitening.whiten(clash).count() == 18
