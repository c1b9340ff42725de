from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermalake.llm import whitening

NAN, INF = float("nan"), float("inf")


def exact(vectors):
    """(n, sums, covariance) of the distinct whole vectors, in fractions."""
    fit = sorted({tuple(int(np.floor(64 * c)) + 1_000_000 for c in v) for v in vectors})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    cov = [[sum(Fraction(n * x[i] - sums[i], n) * Fraction(n * x[j] - sums[j], n) for x in fit) / n for j in range(d)] for i in range(d)]
    return n, sums, np.array([[float(c) for c in row] for row in cov])


def check(vectors, got, most=16):
    n, sums, cov = exact(vectors.values())
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(most, len(values))
    assert len(got) == len(vectors) * k and {r.n for r in got} == {n}
    assert all(r.identity_error <= 1e-9 for r in got)
    table = {(r.vec_id, r.component): r for r in got}
    signs = {}
    for i, v in vectors.items():
        x = [int(np.floor(64 * c)) + 1_000_000 for c in v]
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        centred = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)])
        for c in range(k):
            r = table[i, c + 1]
            assert r.deviation == (deviation if deviation < 1 << 63 else None)
            if values[c] > 1e-12 * values[0]:
                want = centred @ axes[:, c] / np.sqrt(values[c])
                if abs(want) > 1e-3:
                    signs.setdefault(c, np.sign(want * r.whitened))
                assert abs(r.whitened - signs.get(c, 1) * want) < 1e-7
                assert abs(r.explained / (values[c] / cov.trace()) - 1) < 1e-9
            else:
                assert r.whitened is None and r.explained == 0


def table(spark, vectors, extra=()):
    rows = [(i, [float(x) for x in v]) for i, v in vectors.items()] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7).withColumns({"x": F.lit("a"), "dim": F.lit(9), "n": F.lit(2)})


def test_against_fractions(spark):
    rng = np.random.default_rng(2)
    vectors = {i: rng.normal(size=20) * np.linspace(3, 0.2, 20) for i in range(300)}
    vectors |= {1000 + i: vectors[0] for i in range(500)}  # copies count once in the fit
    odd = [(1, None), (2, [NAN] * 20), (3, [INF] + [0.0] * 19), (4, [None] + [0.0] * 19), (5, []), (6, [1e300] * 20)]
    check(vectors, whitening.whiten(table(spark, vectors, odd)).collect())


def test_large_level_few_rows_and_flat_dimensions(spark, monkeypatch):
    monkeypatch.setattr(whitening, "_MERGED", 2)
    rng = np.random.default_rng(3)
    vectors = {i: np.r_[1e9 + rng.normal(size=3) * 0.5, 5.0, rng.normal(), 0.0] for i in range(60)}
    check(vectors, whitening.whiten(table(spark, vectors)).collect())
    check({0: np.ones(3)}, whitening.whiten(table(spark, {0: np.ones(3)})).collect())
    wide = {0: [1e9, 0.0], 1: [-1e9, 1.0], 2: [3e8, 5.0]}
    check(wide, whitening.whiten(table(spark, wide)).collect())


def test_dimensions_apart_repeats_and_no_rows(spark):
    a, b = {i: [i % 5, i % 3] for i in range(30)}, {100 + i: [i % 7, i % 2, i % 3] for i in range(30)}
    got = whitening.whiten(table(spark, a | b, [(None, [1.0, 1.0]), (3, [3.0, 0.0])])).collect()
    check(b, [r for r in got if r.vec_id is not None and r.vec_id >= 100])
    assert sum(r.vec_id is None for r in got) == 2 and sum(r.vec_id == 3 for r in got) == 4
    assert whitening.whiten(table(spark, a).limit(0)).count() == 0


def test_outer_products_are_exact_to_double_double():
    rng = np.random.default_rng(4)
    x = rng.integers(10**6, 10**6 + 300, (3000, 4)) * np.array([1, 1, 1000, 1])
    n, sums = len(x), [int(s) for s in x.sum(0)]
    high, low = whitening.outer_products(*whitening.centred(x, n, sums))
    for i in range(4):
        for j in range(4):
            true = sum(Fraction(n * int(a) - sums[i], n) * Fraction(n * int(b) - sums[j], n) for a, b in zip(x[:, i], x[:, j]))
            scale = float(np.sqrt(high[i, i] * high[j, j]))
            assert abs(float(Fraction(high[i, j]) + Fraction(low[i, j]) - true)) <= 1e-27 * scale


@pytest.mark.parametrize("high, low, more", [(1.0, 1e-20, 1e8), (1e16, 1.0, -1e16), (1.0, 2.0**-80, -1.0)])
def test_double_double_keeps_low_parts(high, low, more):
    h, e = whitening.add_double_double(np.array([high]), np.array([low]), np.array([more]))
    true = Fraction(high) + Fraction(low) + Fraction(more)
    assert abs(Fraction(h[0]) + Fraction(e[0]) - true) <= abs(true) * Fraction(2) ** -100
