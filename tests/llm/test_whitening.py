import math
from fractions import Fraction

import numpy as np
import pytest

from feescope.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n long, dim int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 7, 9) for i, v in rows], SCHEMA).repartition(3)


def whole(v):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]


def takes_part(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


def exact_polynomial(a):
    """Faddeev and LeVerrier, in fractions."""
    d = len(a)
    m, c = np.zeros((d, d), object), [Fraction(1)]
    eye = np.array([[int(i == j) for j in range(d)] for i in range(d)], object)
    for k in range(1, d + 1):
        m = a.dot(m) + c[-1] * eye
        c.append(Fraction(-1, k) * sum(a.dot(m)[i, i] for i in range(d)))
    return [int(x) for x in reversed(c)]


def check(spark, rows, digits=1e-9):
    """The query against exact sums and a dense eigenvalue routine."""
    used = {(i, tuple(v)) for i, v in rows if takes_part(v)}
    fit = np.array(sorted({tuple(whole(v)) for _, v in used}), object)
    n, s = len(fit), fit.sum(0)
    centred = (fit - s // n).astype(float) - np.array([float(Fraction(int(x % n), n)) for x in s])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:16]
    values, vectors, total = values[order], vectors[:, order], values.sum()
    found = {(r.vec_id, r.component): r for r in whitening.whitened_components(table(spark, rows)).collect()}
    k = max(c for _, c in found)
    for i, v in used:
        x = np.array(whole(v), object)
        away = (x - s // n).astype(float) - np.array([float(Fraction(int(y % n), n)) for y in s])
        for c in range(1, k + 1):
            r = found[i, c]
            assert (r.n, r.deviation) == (n, sum(int(n * a - b) ** 2 for a, b in zip(x, s)))
            assert r.identity_error < 1e-9 and abs(r.explained / (values[c - 1] / total) - 1) < 1e-6
            if all(abs(values[c - 1] - values[j]) > 1e-4 * values[0] for j in range(len(values)) if j != c - 1):
                assert abs(abs(r.whitened) - abs(away @ vectors[:, c - 1]) / math.sqrt(values[c - 1])) < digits + 1e-6
    assert {i for i, _ in found} == {i for i, _ in used}
    return found


@pytest.mark.parametrize("d", [1, 2, 5, 9])
def test_polynomial_against_exact_recurrence(spark, d):
    rng = np.random.default_rng(d)
    b = rng.integers(-(10**6), 10**6, (d, d)).astype(object)
    a = b.dot(b.T)
    assert whitening.characteristic_polynomial(spark, a) == exact_polynomial(a)
    a[:, -1] = a[-1, :] = 0
    assert whitening.characteristic_polynomial(spark, a) == exact_polynomial(a)


def test_roots_with_repeats_and_near_each_other():
    p = [1]
    roots = [Fraction(5), Fraction(5), Fraction(3), Fraction(7), Fraction(7) + Fraction(1, 10**15), Fraction(1, 3), Fraction(1, 3), Fraction(1, 3)]
    for r in roots:
        p = [a - b for a, b in zip([0, *[c * r.denominator for c in p]], [*[c * r.numerator for c in p], 0])]
    found = whitening.greatest_roots(p, 99)
    assert [r.times for r in found] == [1, 1, 2, 1, 3] and [r.rank for r in found] == [1, 2, 3, 4, 5]
    simple = whitening.simple_part(p)
    fine = [whitening.refined(simple, r, 120) for r in found]
    for r, want in zip(fine, sorted(set(roots), reverse=True)):
        assert Fraction(r.low, 1 << r.scale) < want <= Fraction(r.low + 1, 1 << r.scale)
    assert [r.times for r in whitening.greatest_roots(p, 3)] == [1, 1, 2]


def test_products_are_exact():
    rng = np.random.default_rng(4)
    for most in (3, 1 << 23, 1 << 30, 1 << 61):
        y = rng.integers(-most, most, (300, 4))
        assert (whitening.exact_products(y) == y.astype(object).T.dot(y.astype(object))).all()


def test_eigenvectors_of_a_repeated_root(spark):
    a = np.array([[2, 1, 0, 0], [1, 2, 0, 0], [0, 0, 3, 0], [0, 0, 0, 1]], object)
    found = whitening.components(spark, a, 4)
    assert [round(float(v), 12) for v, _ in found] == [3, 3, 1, 1]
    w = np.stack([v for _, v in found])
    assert np.abs(w @ w.T - np.eye(4)).max() < 1e-14
    for value, v in found:
        assert np.abs(a.astype(float) @ v - float(value) * v).max() < 1e-14


def test_nearly_equal_eigenvalues_keep_right_angles(spark):
    a = np.array([[10**20, 1, 0], [1, 10**20 + 1, 0], [0, 0, 5]], object)
    found = whitening.components(spark, a, 3)
    w = np.stack([v for _, v in found])
    assert np.abs(w @ w.T - np.eye(3)).max() < 1e-14
    t = math.atan(2 / 1) / 2  # [[0, 1], [1, 1]] turned by half the angle of 2 b / (c - a)
    assert abs(abs(w[0] @ [math.sin(t), math.cos(t), 0]) - 1) < 1e-14


def test_query_against_dense_eigenvectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(400, 20)) @ np.diag(np.linspace(0.2, 3, 20)))]
    rows += [(1000 + i, rows[i][1]) for i in range(50)] + [(2000 + i, rows[0][1]) for i in range(200)]
    rows += [(3000, None), (3001, [None] * 20), (3002, [math.nan] * 20), (3003, [math.inf] + [0.0] * 19), (3004, [])]
    found = check(spark, rows)
    assert max(c for _, c in found) == 16


def test_few_dimensions_ties_and_far_values(spark):
    check(spark, [(i, [float(i % 2), float(i // 2 % 2)]) for i in range(8)] + [(None, [1.0, 3.0])])
    check(spark, [(i, [1e6 + i, -1e6 + 3 * i * i]) for i in range(30)])
    huge = whitening.whitened_components(table(spark, [(1, [1e38, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])])).collect()
    assert {r.vec_id for r in huge} == {1, 2, 3} and huge[0].identity_error < 1e-6


def test_other_lengths_and_no_variance(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [0.5, 0.5]), (4, [1.0, 2.0, 3.0])]
    assert {r.vec_id for r in whitening.whitened_components(table(spark, rows)).collect()} == {1, 2, 3}
    flat = whitening.whitened_components(table(spark, [(i, [1.0, float(i), 4.0]) for i in range(9)])).collect()
    assert {r.component for r in flat} == {1} and {r.explained for r in flat} == {1.0}
    assert whitening.whitened_components(table(spark, [(1, [1.0, 2.0])] * 5)).count() == 0
    assert whitening.whitened_components(table(spark, [(1, None)])).count() == 0
    empty = whitening.whitened_components(table(spark, []))
    assert empty.count() == 0 and empty.columns[:4] == ["vec_id", "component", "n", "deviation"]


def test_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    check(spark, rows)
