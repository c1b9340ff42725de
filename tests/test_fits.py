"""Iterative fits against direct solutions and known models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermalake.functions import physics
from thermalake.functions.rng import normal, uniform
from thermalake.operators import fits


def test_polynomials_in_raw_temperatures(spark):
    df = spark.range(3000).select(*[(F.lit(220.0) + 80.0 * uniform(i, "id")).alias(f"t{i}") for i in range(6)])
    values = [F.col(f"t{i}") for i in range(6)]
    for degree in (1, 2, 3):
        terms = physics.polynomial_terms(values, degree)
        y = sum((t * (((i * 37) % 11 - 5) / 250.0 ** (1 if i < 6 else 2 if i < 27 else 3)) for i, t in enumerate(terms)), F.lit(3.0))
        fit = fits.fit_polynomial(df, values, y, degree=degree)
        row = df.agg(F.max(F.abs(fit.column(values) - y)).alias("far"), F.stddev_pop(y).alias("sd")).first()
        assert row.far < 1e-8 * row.sd


def test_weighted_least_squares_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3)) * [1, 30, 0.01] + [1e4, -500, 7]
    y, w = x @ [2.0, -0.5, 80.0] + rng.normal(size=400), rng.random(400) + 0.1
    df = spark.createDataFrame([(*map(float, r), float(a), float(b)) for r, a, b in zip(x, y, w, strict=True)] + [(None, 1.0, 1.0, 1.0, 1.0)], "a double, b double, c double, y double, w double")
    got = fits.least_squares(df, [F.col("a"), F.col("b"), F.col("c")], F.col("y"), F.col("w"))
    root = np.sqrt(w)[:, None]
    want = np.linalg.lstsq(np.c_[np.ones(400), x] * root, y * root[:, 0], rcond=None)[0]
    assert got == pytest.approx(want, rel=1e-6)
    constant = fits.least_squares(df.withColumn("d", F.lit(3.0)), [F.col("a"), F.col("d")], F.col("a") * 2.0)
    assert constant[1] == pytest.approx(2) and constant[2] == pytest.approx(0, abs=1e-9)
    with pytest.raises(ValueError):
        fits.least_squares(df.limit(0), [F.col("a")], F.col("y"))


def test_huber_against_numpy(spark):
    df = spark.range(4000).select((uniform(1, "id") * 10).alias("x"), "id")
    y = 2.0 + 3.0 * F.col("x") + 0.1 * normal(2, "id") + F.when(F.col("id") % 20 == 0, 500.0).otherwise(0.0)
    held = np.array([tuple(r) for r in df.select("x", y).collect()])
    x, target, trust = np.c_[np.ones(len(held)), held[:, 0]], held[:, 1], np.ones(len(held))
    for count in range(200):
        root = np.sqrt(trust)
        c = np.linalg.lstsq(x * root[:, None], target * root, rcond=None)[0]
        left = np.abs(target - x @ c)
        scale = scale if count else 1.4826 * np.median(left)
        trust = np.minimum(1, 1.345 * scale / left)
    assert fits.huber(df, [F.col("x")], y, F.lit(1.0), tol=1e-9) == pytest.approx(c, abs=1e-5)
    assert fits.huber(df, [F.col("x")], 1.0 - F.col("x"), F.lit(1.0)) == pytest.approx([1, -1])


@pytest.mark.parametrize("offset", [0.0, 1e3, 1e6])
def test_a_mixture_is_found_wherever_it_lies(spark, offset):
    df = spark.range(3000).select((F.when(F.col("id") % 3 == 0, 18.0).otherwise(0.0) + 0.25 * normal(1, "id") + offset).alias("x"), (0.25 * normal(2, "id")).alias("y"))
    m = fits.mixture(df, [F.col("x"), F.col("y")], 2, tol=1e-6)
    order = m["mean"][:, 0].argsort()
    assert m["weight"][order] == pytest.approx([2 / 3, 1 / 3], abs=1e-6) and m["mean"][order, 0] - offset == pytest.approx([0, 18], abs=0.03)
    assert np.stack([np.diag(c) for c in m["covariance"]]) == pytest.approx(np.full((2, 2), 0.0625), rel=0.1)
    ended = [a for a in m["attempts"] if a["status"] == "converged"]
    assert len(m["attempts"]) == 5 and m["loglik"] == next(a["loglik"] for a in ended if a["loglik"] >= max(b["loglik"] for b in ended) - 1e-6)


def test_mixture_steps_against_numpy(spark):
    """One start's result is a fixed point of plain expectation maximisation, with the likelihood that it states."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal([0, 0], [1, 0.5], (300, 2)), rng.normal([4, 2], [0.5, 1], (200, 2))])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    m = fits.mixture(df, [F.col("a"), F.col("b")], 2, tol=1e-9, starts=3)
    logs = fits.log_densities(x, m["weight"], m["mean"], m["covariance"])
    density = np.log(np.exp(logs).sum(1))
    share = np.exp(logs - density[:, None])
    mean = share.T @ x / share.sum(0)[:, None]
    assert m["loglik"] == pytest.approx(density.mean(), abs=1e-6) and m["mean"] == pytest.approx(mean, abs=1e-3)
    got = fits.mixture_criteria(df, [F.col("a"), F.col("b")], m)
    assert got["entropy"] == pytest.approx(-(share * np.log(share)).sum()) and got["bic"] == pytest.approx(-2 * density.sum() + 11 * np.log(500))
    assert got["icl"] == pytest.approx(got["bic"] + 2 * got["entropy"]) and got["ambiguous"] == (share.max(1) < 0.8).sum()
    best = fits.candidates(df, [F.col("a"), F.col("b")], (1, 2))
    assert min(best, key=lambda c: c["bic"])["k"] == 2
    with pytest.raises(ValueError):
        fits.candidates(df, [F.col("a")], (6,))


def test_starts_that_fail_are_set_aside(spark):
    df = spark.createDataFrame([(0.0,)] * 50 + [(1.0,)] * 50, "x double")
    assert fits.mixture(df, [F.col("x")], 2)["converged"]
    with pytest.raises(ValueError):
        fits.mixture(df, [F.col("x")], 3)
    with pytest.raises(ValueError):
        fits.mixture(df, [F.col("x")], 2, rounds=1)


def test_shapes_over_the_whole_positive_range(spark):
    true = {"zero": 0.0, "one": 1.0, "high": 1.5, "low": -2.0, None: -0.3, "edge": 3.6}
    rows = [(k, b, 0.45 * i, 0.3 * (i * 7 % 200)) for k, b in true.items() for i in range(150)] + [("few", 0.1, 3.0, 9.0)] * 20 + [("same", 0.1, 30.0, 10.0)] * 200
    df = spark.createDataFrame(rows, "k string, b double, first double, second double")
    p, q = physics.limb(F.col("first")) - 1.0, physics.limb(F.col("second")) - 1.0
    out = fits.shape_parameters(df, ["k"], p, q, (1 + F.col("b") * p) / (1 + F.col("b") * q), angles=(F.col("first"), F.col("second")))
    got = {r.k: r for r in out.collect()}
    assert {k: got[k].b for k in true} == pytest.approx(true, abs=1e-7) and all(got[k].rmse < 1e-7 for k in true)
    assert (got["few"].b, got["few"].support, got["same"].support) == (None, "too few pairs", "too little angular diversity")
    noisy = (1 + 5.0 * p) / (1 + 5.0 * q)  # not positive everywhere: the fit stays inside
    assert fits.shape_parameters(df.filter("k = 'one'"), ["k"], p, q, noisy).first().b <= fits.positive_bounds([physics.limb_value(90.0) - 1])[1]


def test_noisy_shapes_against_a_search(spark):
    df = spark.range(800).select((uniform(1, "id") * 70).alias("a"), (uniform(2, "id") * 70).alias("c"), normal(3, "id").alias("z"))
    p, q = physics.limb(F.col("a")) - 1.0, physics.limb(F.col("c")) - 1.0
    r = (1 - 1.2 * p) / (1 - 1.2 * q) + 0.05 * F.col("z")
    got = fits.shape_parameters(df, [], p, q, r).first()
    held = np.array([tuple(x) for x in df.select(p, q, r).collect()])
    cost = lambda b: np.mean(((1 + b * held[:, 0]) / (1 + b * held[:, 1]) - held[:, 2]) ** 2)
    grid = np.linspace(-6, 3.7, 4001)
    assert got.b == pytest.approx(grid[np.argmin([cost(b) for b in grid])], abs=0.01) and got.rmse == pytest.approx(np.sqrt(cost(got.b)), rel=1e-4)


def greedy(sizes, folds):
    loads, out = [0] * folds, {}
    for group in sorted(sizes, key=lambda g: (-sizes[g], g)):
        out[group] = loads.index(min(loads))
        loads[out[group]] += sizes[group]
    return out


def test_folds_are_dealt_to_the_lightest(spark):
    rng = np.random.default_rng(7)
    for folds, kinds in ((3, [1, 2, 3]), (5, [1, 7, 40]), (4, list(range(1, 30))), (6, [5])):
        sizes = {g: int(rng.choice(kinds)) for g in range(120)}
        counts = {s: list(sizes.values()).count(s) for s in set(sizes.values())}
        dealt = fits.deal_sizes(counts, folds)
        for size in counts:
            assert len([d for d in dealt if d[0] == size]) <= folds + 1
        df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g int")
        got = {r.g: r.fold for r in fits.group_folds(df, "g", folds).collect()}
        assert got == greedy(sizes, folds)
    assert fits.deal_sizes({1: 10**9, 3: 10**6}, 3)[-1][0] == 1
