"""Whitening against exact fractions and a plain eigensolver."""

from fractions import Fraction

import numpy as np
import pytest

from lexspan.llm import whitening


def frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, component int").repartition(3)


def check(spark, rows, vectors, most=8):
    """`vectors` are those that take part, in the order of their ids."""
    got = sorted(whitening.whiten(frame(spark, rows), most=most).collect(), key=lambda r: (r.vec_id, r.component))
    x = np.array([[int(np.floor(1024 * c)) + 100000 for c in v] for v in vectors], dtype=object)
    n, total = len(x), x.sum(axis=0)
    covariance = np.array([[float(Fraction(int((x[:, i] * x[:, j]).sum()) * n - int(total[i] * total[j]), n * n)) for j in range(x.shape[1])] for i in range(x.shape[1])])
    values, units = np.linalg.eigh(covariance)
    values, units = values[::-1], units[:, ::-1]
    count = min(most, int((values > values[0] * 1e-12).sum()))
    assert len(got) == n * count
    deviation = [int(sum((n * a - t) ** 2 for a, t in zip(row, total))) for row in x]
    assert [int(row.deviation) for row in got] == [d for d in deviation for _ in range(count)]
    assert {row.n for row in got} == {n} and all(row.identity_error < 1e-9 for row in got)
    assert np.allclose([row.explained for row in got[:count]], values[:count] / values.sum(), rtol=1e-9)
    whitened = np.array([row.whitened for row in got]).reshape(n, count)
    assert np.allclose(whitened.T @ whitened / n, np.eye(count), atol=1e-9)
    return whitened, (x - np.array([Fraction(int(t), n) for t in total])).astype(float), values, units


def test_components_are_those_of_the_covariance(spark):
    draw = np.random.default_rng(3)
    vectors = (draw.normal(size=(300, 12)) * np.linspace(1, 2, 12)).tolist()
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    rows += [(400, None, 0), (401, [None] * 12, 0), (402, [float("nan")] * 12, 0), (403, [float("inf")] + [0.0] * 11, 0), (404, [1.0], 0), (405, [], 0)]
    whitened, apart, values, units = check(spark, rows, vectors)
    plain = apart @ units[:, :8] / np.sqrt(values[:8])
    signs = np.sign((plain * whitened).sum(axis=0))
    assert np.allclose(plain * signs, whitened, atol=1e-8)


def test_equal_eigenvalues_low_rank_and_large_entries(spark):
    cross = [[s if k == i else 0.0 for k in range(5)] for i in range(5) for s in (1.0, -1.0)]
    check(spark, [(i, v, 0) for i, v in enumerate(cross)], cross)
    flat = [[float(i), 2.0 * i, 5.0] for i in range(7)]
    check(spark, [(i, v, 0) for i, v in enumerate(flat)], flat)
    large = [[1e12, -3e11, 0.5], [-2e12, 1.0, 7.0], [3.0, 4e12, 1e9], [5e11, 1.0, 1.0]]
    check(spark, [(i, v, 0) for i, v in enumerate(large)], large)


def test_empty_and_constant_tables(spark):
    rows = [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]
    assert whitening.whiten(frame(spark, rows)).count() == 0
    empty = whitening.whiten(frame(spark, rows).limit(0))
    assert empty.count() == 0 and empty.columns == whitening.whiten(frame(spark, [*rows, (3, [1.0, 3.0], 0)])).columns
    assert whitening.whiten(frame(spark, [(1, [], 0), (2, None, 0)])).count() == 0
    repeated = whitening.whiten(frame(spark, [(1, [1.0], 0), (1, [1.0], 0), (None, [4.0], 0)])).collect()
    assert sorted(str(row.vec_id) for row in repeated) == ["1", "1", "None"]


@pytest.mark.parametrize("size", [1, 2, 3, 9])
def test_polynomial_is_exact(spark, size):
    draw = np.random.default_rng(size)
    half = draw.integers(-50, 50, (size, size)).astype(object)
    half[0, :-1] = 0
    matrix = half @ half.T
    f = whitening.characteristic(spark, matrix)
    for x in range(size + 1):  # as many places as settle a polynomial of this degree
        rows = [[Fraction(x * (i == j) - int(matrix[i, j])) for j in range(size)] for i in range(size)]
        value = Fraction(1)
        for k in range(size):
            at = next((r for r in range(k, size) if rows[r][k]), None)
            if at is None:
                value = Fraction(0)
                break
            if at != k:
                rows[k], rows[at], value = rows[at], rows[k], -value
            value *= rows[k][k]
            for r in range(k + 1, size):
                times = rows[r][k] / rows[k][k]
                rows[r] = [a - times * b for a, b in zip(rows[r], rows[k])]
        assert whitening.value_at(f, x) == value


def test_products_are_exact():
    draw = np.random.default_rng(0)
    y = np.vstack([draw.integers(-(1 << 62), 1 << 62, (50, 4)), draw.integers(-9, 9, (whitening.BLOCK, 4))])
    plain = y.astype(object)
    assert (whitening.products(y) == plain.T @ plain).all()
