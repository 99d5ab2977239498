"""Whitening against numpy's eigenvectors and whole-number arithmetic, on vectors with nulls, repeats, ties and clashing columns."""

import random

import numpy as np
import pytest

from factloom.llm import queries as q
from factloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, component string, n string"


def rows_with_gaps(dims=6, count=300, seed=1):
    rng = np.random.default_rng(seed)
    made = (rng.normal(size=(count, dims)) @ rng.normal(size=(dims, dims)) + 3).astype(np.float32)
    rows = [(i, made[i].tolist(), 0, "x", "c", "n") for i in range(count)]
    odd = [None, [], [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1), [1e30] * dims, [1.0]]
    rows += [(1000 + i, v, 0, None, None, None) for i, v in enumerate(odd)]
    # Copies of a vector under other ids, one id twice and none.
    return rows + [(2000 + i, made[0].tolist(), 0, "x", "c", "n") for i in range(150)] + [(5, made[7].tolist(), 0, "x", "c", "n"), (None, made[9].tolist(), 0, "x", "c", "n")]


def expected(vectors):
    """Exact columns by Python's whole numbers, components by numpy."""
    x = [[int(np.floor(256 * float(c))) for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[c - s / n for c, s in zip(v, sums)] for v in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for v in set(map(tuple, x)):
        d = np.array([c - s / n for c, s in zip(v, sums)])
        out[v] = (sum((n * c - s) ** 2 for c, s in zip(v, sums)), [d @ vectors[:, k] / np.sqrt(values[k]) for k in range(min(4, len(sums)))])
    return n, out, values / values.sum()


@pytest.mark.parametrize("dims", [2, 6, 17])
def test_whitened_equals_eigenvectors(spark, dims):
    rows = rows_with_gaps(6 if dims == 6 else dims, 300, dims) if dims == 6 else [(i, v, 0, "x", "c", "n") for i, v in enumerate(np.random.default_rng(dims).normal(size=(200, dims)).tolist())]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    good = [(i, v) for i, v, *_ in rows if v and len(v) == dims and all(c is not None and abs(c) < 1e13 for c in v)]
    n, want, share = expected([np.float32(v).tolist() for _, v in good])
    assert len(found) == len(good) * min(4, dims)
    by = {}
    for r in found:
        assert r.n == n and r.identity_error < 1e-9 and abs(r.explained - share[r.component - 1]) < 1e-9
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    sign = None
    for i, v in good:
        x = tuple(int(np.floor(256 * float(np.float32(c)))) for c in v)
        deviation, whitened = want[x]
        got = np.array([by[i, deviation][k + 1][0] for k in range(min(4, dims))])
        sign = np.sign(got * whitened) if sign is None else sign
        assert np.allclose(got, sign * whitened, atol=1e-8)


def test_edges(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    row = lambda i, v: (i, v, 0, "", "", "")
    assert make([]).count() == 0
    assert make([row(1, None), row(2, [None])]).count() == 0
    assert make([row(i, [1.0, 2.0]) for i in range(5)]).count() == 0  # no variance at all
    flat = make([row(i, [float(i), 2.0 * i, 0.0]) for i in range(5)]).collect()  # one component only
    assert len(flat) == 5 and {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12
    ties = make([row(0, [1.0, 0.0]), row(1, [-1.0, 0.0]), row(2, [0.0, 1.0]), row(3, [0.0, -1.0])]).collect()  # equal eigenvalues
    assert len(ties) == 8 and {round(r.explained, 9) for r in ties} == {0.5} and all(r.identity_error < 1e-12 for r in ties)
    far = make([row(i, [1e9 + 64 * i, float(i % 7)]) for i in range(50)]).collect()  # a mean far off costs no digits
    assert len(far) == 100 and all(r.identity_error < 1e-9 for r in far)
    wide = make([row(i, [(-1) ** i * 1e12, float(i)]) for i in range(9)]).collect()  # no long holds these deviations
    assert {r.deviation for r in wide} == {None}


def test_factor_and_rotations():
    rng = np.random.default_rng(4)
    for d, rank in ((1, 1), (5, 5), (9, 4), (40, 40), (31, 7)):
        b = rng.normal(size=(d, rank)) * np.logspace(0, -5, rank)
        a = b @ b.T
        factor, order = whitening.pivoted_cholesky(a)
        assert factor.shape[1] == rank and np.allclose(factor @ factor.T, a[np.ix_(order, order)], atol=1e-12 * np.trace(a))
        assert np.allclose(factor, np.tril(factor)) and (np.diff(np.diag(factor)) <= 1e-12).all()
        values, columns = whitening.principal(a)
        assert np.allclose(values, np.linalg.svd(b)[1] ** 2, rtol=1e-8) and np.allclose(columns.T @ columns, np.eye(rank), atol=1e-8)
    assert whitening.principal(np.zeros((3, 3)))[0].size == 0


def test_query_over_its_table(spark, sf):
    found = q.QUERIES["op11_embedding_whitening"](spark, sf)
    assert found.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = found.collect()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    n, want, share = expected([r.embedding for r in table])
    assert len(rows) == 4 * len(table) and {r.n for r in rows} == {n} and max(r.identity_error for r in rows) < 1e-4
    ids = {r.vec_id: tuple(int(np.floor(256 * float(c))) for c in r.embedding) for r in table}
    picked = random.Random(1).sample(rows, 100)
    assert all(r.deviation == want[ids[r.vec_id]][0] and abs(abs(r.whitened) - abs(want[ids[r.vec_id]][1][r.component - 1])) < 1e-8 for r in picked)
    assert all(abs(r.explained / share[r.component - 1] - 1) < 1e-9 for r in picked)
