import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermalake.operators import constrained, fits
from thermalake.operators.constrained import Geometry, basis


def cases(geometry, seed=1, n=80):
    rng = np.random.default_rng(seed)
    b = rng.normal(size=(n, geometry.parameters)) * ([6.0] if geometry.parameters == 1 else [2.5, 1.5])
    level = 60 + 30 * rng.random(n)
    x = level[:, None] * (1 + b @ geometry.design[:, 1:].T) * (1 + 0.02 * rng.normal(size=(n, geometry.views)))
    return x[(x > 1).all(1)]


@pytest.mark.parametrize("parameters, angles", [(1, (0, 35, 70)), (2, (0, 20, 40, 55, 68)), (2, (0, 35, 70))])
def test_constrained_fits_are_the_best_allowed(parameters, angles):
    g = Geometry(angles, parameters)
    x = cases(g)
    c, held = g.constrained(x)
    assert 2 < held.sum() < len(x)
    assert ((c @ g.bounds.T) >= -1e-9 * np.abs(c).max(1, keepdims=True)).all() and (c[:, 0] > 0).all()
    free = x @ g.inverse.T
    assert np.allclose(c[~held], free[~held])
    loss = lambda c, x: ((g.design @ c - x) ** 2).sum()
    rng = np.random.default_rng(2)
    for i in np.flatnonzero(held):
        own = loss(c[i], x[i])
        near = c[i] + rng.normal(size=(4000, parameters + 1)) * np.abs(c[i]) * 10.0 ** -rng.integers(1, 6, (4000, 1))
        near = near[(near @ g.bounds.T >= 0).all(1)]
        assert len(near) and min(loss(v, x[i]) for v in near) >= own * (1 - 1e-7) - 1e-9
        # the condition of the best: what is left pushes along active bounds only, and outwards
        gap = g.design.T @ (g.design @ c[i] - x[i])
        active = np.flatnonzero(g.bounds @ c[i] < 1e-7 * np.abs(c[i]).max())
        push = np.linalg.lstsq(g.bounds[active].T, gap, rcond=None)[0]
        assert np.allclose(g.bounds[active].T @ push, gap, atol=1e-5 * np.abs(x[i]).max())


def test_the_plan_equals_the_solver(spark):
    g = Geometry((0, 20, 40, 55, 68), 2)
    x = cases(g, 5, 200)
    df = spark.createDataFrame([(i, [float(v) for v in r], "a") for i, r in enumerate(x)], "id int, l array<double>, row string").repartition(3)
    c, held = g.constrained(x)
    got = constrained.retrieve(df, "l", g).collect()
    assert len(got) == len(x)
    for r in got:
        assert r.constrained == held[r.id] and r.row == "a"
        assert r.amplitude == pytest.approx(c[r.id, 0]) and r["shape"] == pytest.approx(list(c[r.id, 1:] / c[r.id, 0]), abs=1e-7)
        assert r.rmse == pytest.approx(math.sqrt(np.mean((g.design @ c[r.id] - x[r.id]) ** 2)))
        u = np.cos(np.radians(np.linspace(0, 90, 901)))
        profile = c[r.id] @ np.column_stack([np.ones(901), basis(np.linspace(0, 90, 901), 2)]).T
        w = np.ones(901)
        w[1:-1:2], w[2:-1:2] = 4, 2
        assert r.flux == pytest.approx(math.pi * (w * 2 * profile * u * np.sqrt(1 - u * u)).sum() * math.radians(0.1) / 3, rel=1e-6)
    assert constrained.retrieve(df.limit(0), "l", g).count() == 0


def test_lowest_value_in_closed_form(spark):
    rng = np.random.default_rng(3)
    b = np.r_[rng.normal(size=(500, 2)) * 4, [[0, 0], [0, 1], [1, 0], [-1, 1e-12]]]
    df = spark.createDataFrame([tuple(map(float, r)) for r in b], "p double, q double")
    fine = basis(np.linspace(0, 90, 200_001), 2)
    for r in df.select("p", "q", constrained.lowest([F.col("p"), F.col("q")]).alias("low")).collect():
        assert r.low == pytest.approx((1 + fine @ [r.p, r.q]).min(), abs=1e-7)


def test_geometries_are_checked(spark):
    for angles, p, message in (((0, 70), 2, "identify"), ((50, 50), 1, "different"), ((0, 75), 1, "different"), ((0, 30), 3, "one or two")):
        with pytest.raises(ValueError, match=message):
            Geometry(angles, p)
    wide, close = Geometry((0, 35, 70), 2), Geometry((45, 50, 60), 2)
    assert close.condition > wide.condition and close.noise_gain > wide.noise_gain and wide.diagnostics["degrees_of_freedom"] == 0
    g = Geometry((0, 15, 35, 50, 70), 2)
    steps = []
    for i in range(5):
        x = np.full((1, 5), 80.0)
        x[0, i] += 1e-3
        steps.append(math.pi * g.integral @ ((g.constrained(x)[0] - g.constrained(np.full((1, 5), 80.0))[0])[0] / 1e-3))
    assert np.linalg.norm(steps) == pytest.approx(g.noise_gain, rel=1e-6)
    for bad in ([1.0, 2.0], None, [1.0, 2.0, -3.0], [1.0, None, 2.0]):
        df = spark.createDataFrame([(bad,)], "l array<double>")
        with pytest.raises(Exception, match="one positive radiance"):
            constrained.retrieve(df, "l", Geometry((0, 35, 70), 1)).collect()


def test_pooled_shapes_are_held_positive():
    rng = np.random.default_rng(4)
    grid = basis(np.linspace(0, 90, 901), 2)
    design = np.column_stack([np.ones(6), basis((0, 15, 30, 45, 55, 68), 2)])
    s = design.T @ design
    found = 0
    for _ in range(12):
        shapes = 1 + basis((0, 15, 30, 45, 55, 68), 2) @ (rng.normal(size=2) * [5, 3])
        x = np.abs(shapes) + 0.05 * rng.random((20, 6))
        m = sum(np.outer(design.T @ r, design.T @ r) / r.mean() ** 2 for r in x)
        value = lambda v: v @ m @ v / (v @ s @ v)  # noqa: B023, E731
        b = fits.best_positive(m, s, grid)
        own = np.r_[1, b]
        assert (1 + grid @ b >= 1e-6 - 1e-8).all()
        near = np.column_stack([np.ones(3000), b + rng.normal(size=(3000, 2)) * 10.0 ** -rng.integers(0, 5, (3000, 1))])
        near = near[(near[:, 1:] @ grid.T + 1 >= 1e-6).all(1)]
        edge = min(1 + grid @ b) < 1e-5
        found += edge
        if edge and len(near):
            free = np.linalg.eigh(np.linalg.inv(np.linalg.cholesky(s)) @ m @ np.linalg.inv(np.linalg.cholesky(s)).T)
            lead = np.linalg.inv(np.linalg.cholesky(s)).T @ free[1][:, -1]
            if (1 + grid @ (lead[1:] / lead[0]) < 1e-6).any():
                assert max(value(v) for v in near) <= value(own) * (1 + 1e-9)
    assert found > 2
