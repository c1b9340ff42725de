"""Two-parameter shapes and retrievals against known answers."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from thermalake.functions import physics
from thermalake.operators import retrieval
from thermalake.plans.retrievals import hemisphere


def test_nearest_positive_against_search():
    rng = np.random.default_rng(4)
    grid = hemisphere(91)
    mesh = np.stack(np.meshgrid(np.linspace(-12, 12, 801), np.linspace(-12, 12, 801)), -1).reshape(-1, 2)
    mesh = mesh[(1 + mesh @ grid.T >= 1e-6).all(1)]
    for _ in range(5):
        root = rng.normal(size=(2, 2))
        h, target = root @ root.T + np.eye(2) * 0.1, rng.normal(size=2) * 4
        got = retrieval.nearest_positive(h, target, grid, 1e-6)
        cost = lambda b: np.einsum("...i,ij,...j", b - target, h, b - target)
        assert (1 + grid @ got >= 0).all() and cost(got) <= cost(mesh).min() + 1e-6


def test_quadratic_shapes(spark):
    angles = [(float(a), float(b)) for a in range(0, 70, 7) for b in range(3, 70, 9)]
    basis = lambda a: hemisphere(9001)[int(round(a * 100))]
    rows = [(g, a, b, float((1 + basis(a) @ v) / (1 + basis(b) @ v))) for g, v in (("x", np.array([-0.3, 0.1])), (None, np.array([-0.1, 0.0]))) for a, b in angles]
    rows += [("same", 10.0, 10.0, 1.0)] * 3 + [("x", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double, r double")
    got = {r.g: r for r in retrieval.quadratic_shapes(df, ["g"], physics.angular_basis(F.col("a"), True), physics.angular_basis(F.col("b"), True), F.col("r"), hemisphere()).collect()}
    assert (got["x"].b1, got["x"].b2) == (pytest.approx(-0.3, abs=1e-6), pytest.approx(0.1, abs=1e-6)) and got["x"].n == len(angles)
    assert (got[None].b1, got[None].b2) == (pytest.approx(-0.1, abs=1e-6), pytest.approx(0, abs=1e-6))
    assert got["same"].b1 is None and got["same"].n == 3


def test_library_flux_and_table(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (1, 1.0, 0.5), (1, None, 0.5), (2, None, 1.0)], "k int, l double, s double")
    got = {r.k: r for r in retrieval.library_flux(df, ["k"], F.col("l"), F.col("s"), F.lit(1.0)).collect()}
    assert (got[1].views, got[1].amplitude, got[1].flux) == (2, pytest.approx(2), pytest.approx(2 * np.pi)) and got[2].flux is None
    budget = spark.createDataFrame([("a", 0.5, 1.0), ("b", -0.25, 2.0)], "component string, bias double, rmse double")
    assert [tuple(r) for r in retrieval.budget_table(budget, ["b", "a"]).orderBy("position").collect()] == [(0, "b", "-0.250", "+2.000"), (1, "a", "+0.500", "+1.000")]
    with pytest.raises(PySparkException):
        retrieval.budget_table(budget, ["a", "c"]).collect()
