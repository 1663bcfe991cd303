"""Whitening: exact parts against plain exact arithmetic, components against a dense solver, defined cases."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from sparkloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, component string"


def faddeev(a):
    """Coefficients of det(t - a), lowest first, in exact arithmetic."""
    d = len(a)
    a = np.array(a, object).reshape(d, d)
    m, out = np.zeros((d, d), object), [1]
    for k in range(1, d + 1):
        m = a.dot(m) + out[-1] * np.eye(d, dtype=int).astype(object)
        out.append(-int(a.dot(m).trace()) // k)
    return out[::-1]


def from_roots(roots):
    c = [1]
    for r in roots:
        c = [(c[i - 1] if i else 0) - r * (c[i] if i < len(c) else 0) for i in range(len(c) + 1)]
    return c


@pytest.mark.parametrize("d", [1, 2, 3, 8, 17])
def test_polynomial_is_exact(spark, d):
    rng = np.random.default_rng(d)
    x = rng.integers(-(10**9), 10**9, (2 * d, d)).astype(object)
    x[:, d // 2] = x[:, 0] if d > 4 else x[:, d // 2]  # a zero root
    a = x.T.dot(x).tolist()
    assert whitening.characteristic_polynomial(spark, a) == faddeev(a)


def test_roots_with_multiplicity():
    roots = [0, 0, 1, 1, 7, 7, 7, 10**20, 10**20 + 1, 3]
    found = whitening.Roots(from_roots(roots)).largest(len(roots))
    assert [(round(r), m) for r, m in found] == [(10**20 + 1, 1), (10**20, 1), (7, 3), (3, 1), (1, 2), (0, 2)]
    assert sum(m for _, m in whitening.Roots(from_roots(roots)).largest(3)) >= 3
    for r, _ in found:
        assert abs(r - round(r)) * 2**250 <= max(r, 1)


def test_gram_is_exact():
    x = np.array([[2**61, -5, 3], [-(2**62), 7, -(2**40)], [1, 0, 2**21]], np.int64)
    want = [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j])) for j in range(3)] for i in range(3)]
    assert whitening.gram(x).tolist() == want
    assert whitening.gram(np.zeros((0, 2), np.int64)).tolist() == [[0, 0], [0, 0]]


def test_repeated_root_has_an_orthonormal_basis():
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(4, 4)))
    a = [[3, 1, 1, 0], [1, 3, 1, 0], [1, 1, 3, 0], [0, 0, 0, 9]]  # roots 9, 5, 2, 2
    u = whitening.null_space(a, Fraction(2), 2)
    assert np.abs(u @ u.T - np.eye(2)).max() < 1e-15
    assert np.abs(np.array(a) @ u.T - 2 * u.T).max() < 1e-14


def plain(rows):
    """By numpy alone: x, eigenvalues and unit vectors of the covariance, falling."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in rows], float)
    centred = x - x.mean(0)
    e, u = np.linalg.eigh(centred.T @ centred / len(x))
    return x, centred, e[::-1], u[:, ::-1]


def test_equals_a_dense_solver(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 40)) @ np.diag(np.linspace(0.2, 4, 40))
    v = v.astype(np.float32)
    v[7] = v[8]
    rows = [(i, r.tolist(), "a", "b") for i, r in enumerate(v)]
    bad = [(900, None, "", ""), (901, [None] + [1.0] * 39, "", ""), (902, [math.nan] * 40, "", ""), (903, [math.inf] + [0.0] * 39, "", "")]
    df = spark.createDataFrame(rows + bad + [(None, v[0].tolist(), "", "")], SCHEMA).repartition(5)
    got = whitening.by_component(df).collect()
    x, centred, e, u = plain([*v, v[0]])
    n, sums = len(x), [sum(int(c) for c in col) for col in x.T]
    assert len(got) == n * 32 and {r.vec_id for r in got} == {*range(300), None}
    z = centred @ u / np.sqrt(e)
    signs = {}
    for r in got:
        i, k = 300 if r.vec_id is None else r.vec_id, r.component - 1
        signs.setdefault(k, np.sign(z[i, k] * r.whitened) if abs(z[i, k]) > 1e-3 else None)
        if signs[k] is None:
            del signs[k]
            continue
        assert abs(r.whitened - signs[k] * z[i, k]) < 1e-9
        assert r.n == n and abs(r.explained / (e[k] / e.sum()) - 1) < 1e-12 and r.identity_error < 1e-9
        assert r.deviation == sum((n * int(c) - s) ** 2 for c, s in zip(x[i], sums))


def test_close_eigenvalues_are_told_apart(spark):
    """Two directions whose variances differ by a part in 10 ** 9 or so still get their own vectors."""
    rng = np.random.default_rng(9)
    v = np.round(rng.normal(size=(4000, 2)) * 4096) / 64
    v = np.concatenate([v, -v, v[:, ::-1], -v[:, ::-1]])[:, :2]
    v[0, 0] += 1 / 64
    df = spark.createDataFrame([(i, r.tolist(), "", "") for i, r in enumerate(v)], SCHEMA)
    got = whitening.by_component(df).where("component = 1").agg({"identity_error": "max"}).first()[0]
    assert got < 1e-9


@pytest.mark.parametrize("rows", [[[1.0, 2.0, 3.0]], [[1.0, 2.0], [1.0, 2.0], [1.0, 2.0]]])
def test_no_variance(spark, rows):
    df = spark.createDataFrame([(i, r, "", "") for i, r in enumerate(rows)], SCHEMA)
    got = whitening.by_component(df).collect()
    assert len(got) == len(rows) * len(rows[0])
    assert {(r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(0, None, 0.0, None)}


def test_fewer_rows_than_dimensions_and_short_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 5.0], "", ""), (2, [0.0, 2.0], "", ""), (3, [], "", "")], SCHEMA)
    got = {(r.vec_id, r.component): r for r in whitening.by_component(df).collect()}
    assert len(got) == 12 and got[1, 1].identity_error < 1e-12
    assert got[1, 3].whitened is None and got[1, 3].explained == 0 and got[2, 2].whitened is not None
    assert abs(got[1, 1].explained + got[1, 2].explained - 1) < 1e-12


def test_huge_entries_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [3e38, 0.0], "", ""), (2, [0.0, 1.0], "", "")], SCHEMA)
    got = {(r.vec_id, r.component): r for r in whitening.by_component(df).collect()}
    assert got[1, 1].deviation is None and abs(abs(got[1, 1].whitened) - 1) < 1e-12
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.by_component(empty).collect() == []
    assert whitening.by_component(empty).dtypes == whitening.by_component(df).dtypes
    assert whitening.by_component(spark.createDataFrame([(1, [], "", "")], SCHEMA)).collect() == []
