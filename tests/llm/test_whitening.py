"""Whitening against a plain eigendecomposition."""
import numpy as np
import pytest

from llm_helpers import SMALL, rows_of
from rollbook.llm import queries, whitening


def expected(vectors):
    """The fit list's count, sums, covariance, eigenvalues falling, and vectors."""
    fit = np.unique(vectors, axis=0)
    y = fit - fit.mean(axis=0)
    values, turn = np.linalg.eigh(y.T @ y / len(fit))
    return len(fit), fit.sum(axis=0), values[::-1], turn[:, ::-1]


def compare(rows, vectors, most=4):
    n, sums, values, turn = expected(np.array(list(vectors.values())))
    trace = values.sum()
    assert {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error <= 1e-9
    for c in range(1, most + 1):
        part = {r.vec_id: r for r in rows if r.component == c}
        assert set(part) == set(vectors)
        ids = list(vectors)
        x = np.array([vectors[i] for i in ids])
        want = (x - sums / n) @ turn[:, c - 1] / np.sqrt(values[c - 1])
        got = np.array([part[i].whitened for i in ids])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-7
        assert all(abs(part[i].explained - values[c - 1] / trace) < 1e-10 for i in ids)
        assert [int(part[i].deviation) for i in ids] == [sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums)) for v in x]


def test_query(spark):
    vectors = {i: np.floor(256 * np.array(v, dtype=float)).astype(int) for i, v in rows_of(SMALL, "embeddings", "vec_id, embedding")}
    rows = queries.op11_whitening(spark, SMALL).collect()
    assert len(rows) == 4 * len(vectors)
    compare(rows, vectors)


@pytest.mark.parametrize("d", [1, 2, 8, 40])
def test_leading_eigenpairs(d):
    random = np.random.default_rng(d)
    turn, _ = np.linalg.qr(random.standard_normal((d, d)))
    spectra = [np.sort(random.uniform(0.1, 9, d)), np.full(d, 3.0), np.r_[np.zeros(d - 1), 2.0], np.geomspace(1e-6, 1e6, d), np.r_[np.full(d - 1, 1.0), 1 + 1e-9]]
    for spectrum in spectra:
        a = (turn * spectrum) @ turn.T
        a = (a + a.T) / 2
        exact = np.linalg.eigvalsh(a)
        for shift in random.uniform(-1, exact.max() + 1, 6):
            assert whitening.inertia(a, shift) == (exact > shift).sum()
        pairs = whitening.leading(a, 4)
        assert len(pairs) == min(4, (exact > 1e-13 * exact.max() * d).sum())
        values, vectors = [e for e, _ in pairs], np.array([v for _, v in pairs])
        assert np.allclose(values, exact[::-1][:len(pairs)], rtol=1e-9, atol=1e-12 * exact.max())
        assert np.abs(vectors @ vectors.T - np.eye(len(pairs))).max() < 1e-9
        assert max(np.linalg.norm(a @ v - e * v) for e, v in pairs) < 1e-10 * exact.max()


def test_inertia_with_zero_pivots():
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert whitening.inertia(np.zeros((3, 3)), -1.0) == 3 and whitening.inertia(np.zeros((3, 3)), 1.0) == 0


def test_odd_vectors(spark):
    random = np.random.default_rng(4)
    good = [(i, [float(c) for c in random.normal(0, 2, 6)]) for i in range(80)]
    good += [(100 + i, good[0][1]) for i in range(150)]  # a third and more are copies
    odd = [(None, good[1][1]), (7, good[7][1]), (500, None), (501, []), (502, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (503, [float("nan")] * 6), (504, [float("inf")] * 6), (505, [1e300] * 6),
           (506, [1.0, 2.0])]
    frame = spark.createDataFrame([(*r, "clash", 1.5, 3) for r in good + odd], "vec_id long, embedding array<double>, x string, whitened double, n int")
    model, rows = whitening.fit(whitening.whole(frame))
    out = whitening.apply(rows, model).collect()
    assert len(out) == 4 * (len(good) + 2) and len([r for r in out if r.vec_id is None]) == 4 and len([r for r in out if r.vec_id == 7]) == 8
    vectors = {i: np.floor(256 * np.array(v)).astype(int) for i, v in good}
    compare([r for r in out if r.vec_id is not None], vectors)
    assert model.n == 80


def test_wide_numbers(spark):
    frame = spark.createDataFrame([(i, [2.0 ** 40 * i, -3.0 * i]) for i in range(9)], "vec_id long, embedding array<double>")
    model, rows = whitening.fit(whitening.whole(frame))
    out = whitening.apply(rows, model).collect()
    sums = [sum(256 * 2 ** 40 * i for i in range(9)), sum(-768 * i for i in range(9))]
    assert {int(r.deviation) for r in out if r.vec_id == 5} == {(9 * 256 * 2 ** 40 * 5 - sums[0]) ** 2 + (9 * -768 * 5 - sums[1]) ** 2}


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0], [1.0, 2.0]], [[], []], [None]])
def test_no_components(spark, vectors):
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    model, rows = whitening.fit(whitening.whole(frame))
    assert model is None and whitening.apply(rows, model).count() == 0


def test_fewer_components_than_asked(spark):
    frame = spark.createDataFrame([(i, [float(i), float(i * i), 0.0]) for i in range(7)], "vec_id long, embedding array<float>")
    model, rows = whitening.fit(whitening.whole(frame))
    assert sorted({r.component for r in whitening.apply(rows, model).collect()}) == [1, 2]
