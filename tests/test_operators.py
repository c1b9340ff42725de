"""Known answers, edge cases and independence of partitioning."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from thermalake.functions import geo, physics
from thermalake.functions.rng import normal, uniform
from thermalake.operators import fits, grid, integrate, joins, moments, sampling, scenes, weighted
from thermalake.plans import models

NAN = float("nan")


def one(df):
    return df.collect()[0]


def test_angle_bins(spark):
    angles = [0.0, 9.9, 10.0, 69.0, 70.0, 75.0, -1.0, NAN, None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(angles)], "i int, a double")
    got = [r.b for r in df.select("i", physics.angle_bin(F.col("a"), [0, 10, 20, 70]).alias("b")).orderBy("i").collect()]
    assert got == [0, 0, 1, 2, 2, 3, 3, 3, 3]


def test_temperature_and_flux_guards(spark):
    df = spark.createDataFrame([(80.0,), (0.0,), (-1.0,), (NAN,), (float("inf"),), (None,)], "l double")
    got = [r.t for r in df.select(physics.brightness_temperature(F.col("l"), 2e4, 1300.0).alias("t")).collect()]
    assert got[0] == pytest.approx(1300 / math.log1p(2e4 / 80)) and got[1:] == [None] * 5
    row = one(spark.range(1).select(physics.broadband_flux(F.lit(255.0)).alias("a"), physics.broadband_flux(F.lit(-255.0)).alias("b"), physics.broadband_flux(F.lit(400.0)).alias("c")))
    assert row.a == pytest.approx(5.670374e-8 * 255**4) and row.b is None and row.c is None


def test_shapes():
    assert physics.angular_integral([0.0]) == pytest.approx(1, abs=1e-10)
    with pytest.raises(ValueError):
        physics.angular_integral([10.0])
    assert [len(physics.polynomial_terms(list(range(6)), d)) for d in (1, 2, 3)] == [6, 27, 83]


def test_lognormal_keeps_moments(spark):
    df = spark.range(40000).select(physics.lognormal_radiance(F.lit(50.0), F.lit(10.0), normal(1, "id")).alias("x"))
    row = one(df.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.min("x").alias("low")))
    assert row.m == pytest.approx(50, rel=0.01) and row.s == pytest.approx(10, rel=0.03) and row.low > 0
    assert one(spark.range(1).select(physics.lognormal_radiance(F.lit(7.0), F.lit(0.0), F.lit(3.0)).alias("x"))).x == 7.0


def test_geodesy_round_trip(spark):
    view = geo.View(-75.0)
    df = spark.createDataFrame([(a, b) for a in (-60.0, 0.0, 33.3) for b in (-120.0, -75.0, -20.0)], "lat double, lon double")
    x, y = geo.to_scan_angles(F.col("lat"), F.col("lon"), view)
    df = df.withColumns({"x": x, "y": y})
    lat, lon = geo.from_scan_angles(F.col("x"), F.col("y"), view)
    for r in df.select("lat", "lon", lat.alias("a"), lon.alias("b"), geo.local_zenith(F.col("lat"), F.col("lon"), view).alias("z")).collect():
        assert (r.a, r.b) == (pytest.approx(r.lat, abs=1e-6), pytest.approx(r.lon, abs=1e-6)) and 0 <= r.z < 90
    hidden = geo.to_scan_angles(F.lit(0.0), F.lit(105.0), view)[0]
    row = one(spark.range(1).select(hidden.alias("h"), geo.normalize_longitude(F.lit(190.0)).alias("w"), geo.normalize_longitude(F.lit(-180.0)).alias("e")))
    assert row.h is None and row.w == -170 and row.e == -180


def test_draws_do_not_depend_on_partitions(spark):
    sums = {one(spark.range(1000).repartition(n).agg(F.sum(F.floor(uniform(9, "id") * 1e6)).alias("s"))).s for n in (1, 3, 17)}
    assert len(sums) == 1


def test_moments_merge_in_any_partition(spark):
    rng = np.random.default_rng(0)
    values = [(int(g), float(v) + 1e6) for g, v in zip(rng.integers(0, 3, 400), rng.normal(size=400), strict=True)] + [(9, NAN), (9, None)]
    df = spark.createDataFrame(values, "g int, v double").withColumn("part", F.monotonically_increasing_id() % 7)
    whole = {r.g: r for r in moments.state(df, ["g"], F.col("v")).collect()}
    merged = {r.g: r for r in moments.merge(moments.state(df, ["g", "part"], F.col("v")), ["g"]).collect()}
    assert whole[9].n == 0 and 9 not in merged
    for g, r in merged.items():
        assert (r.n, r["mean"]) == (whole[g].n, pytest.approx(whole[g]["mean"])) and r.m2 == pytest.approx(whole[g].m2, rel=1e-6)
    with pytest.raises(PySparkException):
        moments.sample_summary(df, ["g"], F.col("v")).collect()


def test_error_classes_known_answer(spark):
    df = spark.createDataFrame([(1, 1.0, 0.2), (2, 2.0, 0.3), (3, -1.0, 0.5)], "f int, e double, w double")
    r = one(weighted.error_classes(df, "f", F.col("e"), F.col("w")))
    assert r.bias == pytest.approx(0.3) and r.random_variance == 0 and r.rmse**2 == pytest.approx(0.2 + 1.2 + 0.5)


def test_population_weights_known_answers(spark):
    labels = spark.createDataFrame([(0,), (0,), (1,)], "label int")
    for shares, want, cover in (([0.6, 0.3, 0.1], [1 / 3, 1 / 3, 1 / 3], 0.9), ([0.8, 0.2], [0.2, 0.4, 0.4], 1.0)):
        pop = spark.createDataFrame(list(enumerate(shares)), "label int, share double")
        got = weighted.population_weights(labels, "label", pop, "share").collect()
        assert sorted(r.weight for r in got) == pytest.approx(sorted(want)) and got[0].coverage == pytest.approx(cover)


def test_paired_covariance_known_answer(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0), (5.0, 5.0)], "a double, b double")
    r = one(weighted.paired_covariance(df, [], F.col("a"), F.col("b"), F.lit(1.0)))
    assert (r.mean_first, r.covariance, r.var_total) == (pytest.approx(3), pytest.approx(4), pytest.approx(16))


def test_votes(spark):
    df = spark.createDataFrame([(1, 0, 0.8), (1, 1, 0.6), (2, 0, 0.7), (2, 0, 0.9)], "file int, label int, p double")
    got = {r.file: r for r in scenes.majority(df, "file", "label", F.col("p")).collect()}
    assert (got[1].label, got[1].vote_fraction, got[1].tied_labels) == (0, 0.5, "0;1") and (got[2].label, got[2].vote_fraction) == (0, 1.0)


def test_adjusted_rand(spark):
    a, b = [0, 1, 1, 2, 2, 0, 1, 0], [1, 0, 0, 2, 0, 1, 0, 2]
    r = one(scenes.adjusted_rand(scenes.contingency(spark.createDataFrame(list(zip(a, b, strict=True)), "x int, y int"), "x", "y")))
    n = np.zeros((3, 3))
    np.add.at(n, (a, b), 1)
    pairs = lambda x: (x * (x - 1) / 2).sum()
    expected = pairs(n.sum(1)) * pairs(n.sum(0)) / 28
    assert r.ari == pytest.approx((pairs(n) - expected) / ((pairs(n.sum(1)) + pairs(n.sum(0))) / 2 - expected))
    same = spark.createDataFrame([(1, 1)] * 4, "x int, y int")
    assert one(scenes.adjusted_rand(scenes.contingency(same, "x", "y"))).ari == 1


def test_block_means_and_footprints(spark):
    df = spark.range(100).select((F.col("id") / 10).cast("int").alias("y"), (F.col("id") % 10).cast("int").alias("x"), F.col("id").cast("double").alias("v"))
    got = {(r.cy, r.cx): r["mean"] for r in grid.cell_sums(df, [], "y", "x", F.col("v"), 5).collect()}
    assert got == {(0, 0): 22, (0, 1): 27, (1, 0): 72, (1, 1): 77}
    assert grid.complete_footprints(df.filter("v <> 55"), [], "y", "x", F.lit(True), 5).count() == 3
    assert grid.complete_footprints(df, [], "y", "x", F.col("v") != 0, 5).count() == 3


def test_integrals(spark):
    df = spark.createDataFrame([(x, 1.0) for x in (2.0, 5.0, 50.0, 110.0)], "x double, y double")
    assert one(integrate.integrals(df, [], "x", F.col("y"), 4.0, 100.0)).integral == pytest.approx(96)
    with pytest.raises(PySparkException):
        integrate.integrals(df, [], "x", F.col("y"), 1.0, 100.0).collect()
    for n in (1, 2, 5, 8):
        cubic = spark.createDataFrame([(float(i), float(i) ** 2) for i in range(n)], "x double, y double")
        want = (n - 1) ** 3 / 3 if n > 2 else 0.5 * (n - 1)
        assert one(integrate.integrals(cubic, [], "x", F.col("y"))).integral == pytest.approx(want)


def test_pairing_is_strict(spark):
    rows = [(1, "a", 1.0), (1, "b", 2.0), (2, "a", 1.0)]
    df = spark.createDataFrame(rows, "k int, stage string, v double")
    assert joins.strict_pairs(df.filter("k = 1"), ["k"], "stage", "a", "b", ["v"]).count() == 1
    with pytest.raises(PySparkException):
        joins.strict_pairs(df, ["k"], "stage", "a", "b", ["v"]).collect()


def test_switch_exactly(spark):
    df = spark.range(101).select("id", F.lit(2).alias("label"), F.lit(1).alias("second"))
    out = sampling.switch_labels(df, "label", "second", 0.1, uniform(3, "id"), ["id"])
    assert out.filter("label = 1").count() == 10 == out.filter("switched").count()


def test_fits_recover_known_models(spark):
    df = spark.range(4000).select(normal(1, "id").alias("a"), normal(2, "id").alias("b"), "id")
    c = fits.least_squares(df, [F.col("a"), F.col("b")], 1 + 2 * F.col("a") - F.col("b"))
    assert c == pytest.approx([1, 2, -1])
    two = df.select(F.when(F.col("id") % 4 == 0, F.col("a") * 0.2 + 5).otherwise(F.col("a") * 0.5).alias("x"), F.col("b"))
    m = fits.mixture(two, [F.col("x"), F.col("b")], 2, tol=1e-5)
    order = m["mean"][:, 0].argsort()
    assert m["converged"] and m["weight"][order] == pytest.approx([0.75, 0.25], abs=0.01) and m["mean"][order][:, 0] == pytest.approx([0, 5], abs=0.05)
    with pytest.raises(ValueError):
        fits.mixture(two.limit(1), [F.col("x")], 2)
    robust = one(models.robust_regression(spark, "/root/testdata/sf0.001"))
    assert abs(robust.intercept - 2) < 5 and abs(robust.slope - 3) < 0.5  # least squares are off by 25


def test_matching_and_axes(spark):
    assert fits.best_matching(np.array([[0, 1.0, 0], [1, 0.5, 0], [0, 0, 1]])) == [1, 0, 2]
    cells = scenes.contingency(spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 0)], "x int, y int"), "x", "y")
    assert fits.stability(cells) == {0: 1.0, 1: 1.0}
    axes, values = fits.principal_axes(np.array([[1, 0.999], [0.999, 1.0]]), np.ones(2))
    assert len(axes) == 1 and values[0] == pytest.approx(1.999)


def test_tolerance_and_interpolation(spark):
    wanted, held = (spark.createDataFrame([(x,) for x in v], "a double") for v in ([55.0, 10.0000001, 30.0], [55.0, 10.0, 20.0]))
    assert {r.a: r.matches for r in joins.within_tolerance(wanted, held, "a").collect()} == {55.0: 1, 10.0000001: 1, 30.0: 0}
    large = spark.createDataFrame([(1e9 + 5000.0,), (1e9 + 20000.0,)], "a double")
    assert sorted(r.matches for r in joins.within_tolerance(large, spark.createDataFrame([(1e9,)], "a double"), "a").collect()) == [0, 1]
    assert sorted(r.matches for r in joins.within_tolerance(wanted.union(wanted), held, "a").collect()) == [0, 0, 1, 1, 1, 1]
    series = spark.createDataFrame([(1.0, 10.0), (3.0, 30.0)], "k double, v double")
    points = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,), (4.0,)], "k double")
    assert {r.k: r.v for r in joins.interpolate(points, series, "k", "v").collect()} == {0.0: 0, 1.0: 10, 2.0: 20, 3.0: 30, 4.0: 0}


def test_cross_validation_against_numpy(spark):
    rng = np.random.default_rng(6)
    x, fold = rng.normal(size=(300, 2)), rng.integers(0, 3, 300)
    y = x @ [1.5, -2] + 0.3 + rng.normal(size=300) * 0.1
    df = spark.createDataFrame([(i, float(a), float(b), float(c), int(f)) for i, ((a, b), c, f) in enumerate(zip(x, y, fold, strict=True))], "i int, a double, b double, y double, f int")
    got = fits.cross_validated(df, [F.col("a"), F.col("b")], F.col("y"), F.lit(1.0), F.col("f"), 3).orderBy("i").collect()
    full = np.c_[np.ones(300), x]
    for k in range(3):
        c = np.linalg.lstsq(full[fold != k], y[fold != k], rcond=None)[0]
        assert [got[i].prediction for i in np.flatnonzero(fold == k)] == pytest.approx(full[fold == k] @ c)


def test_pooled_shape_of_two_parameters(spark):
    angles = np.arange(0, 75, 5.0)
    basis = lambda a: np.stack([np.log(np.cos(np.radians(a)) + 2) / np.log(np.cos(np.radians(55)) + 2) - 1, np.cos(np.radians(a)) ** 2 - np.cos(np.radians(55)) ** 2], 1)
    rows = [(f, float(a), float((f + 1) * (1 + r))) for f in range(4) for a, r in zip(angles, basis(angles) @ [-0.3, 0.1], strict=True)]
    df = spark.createDataFrame(rows, "f int, angle double, l double")
    fit = lambda d: fits.pooled_shape(d, [], "f", physics.angular_basis(F.col("angle"), True), F.col("l"), basis(np.linspace(0, 90, 901)))
    assert fit(df)[0]["parameters"] == pytest.approx([-0.3, 0.1], abs=1e-6)
    with pytest.raises(ValueError):
        fit(df.filter("f <> 1 OR angle <> 10"))


def test_quantiles_and_folds_from_ranges(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("g"),
        F.when(F.col("id") % 11 > 0, (F.col("id") * 7919 % 2003).cast("double")).alias("v"),
    )
    df = df.union(spark.createDataFrame([("empty", None), ("one", 4.0)], "g string, v double")).repartition(5)
    shares = [0.0, 0.013, 0.5, 0.95, 1.0]
    want = df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()
    got = {x.g: list(x)[1:] for x in sampling.quantiles(df, ["g"], F.col("v"), shares).collect()}
    assert len(got) == len(want) == 5
    for w in want:
        assert got[w.g] == (pytest.approx(w.q) if w.q else [None] * 5)
    assert sampling.quantiles(df, [], F.col("v"), [0.5]).first()[0] == df.agg(F.median("v")).first()[0]
    assert sampling.quantiles(df.limit(0), [], F.col("v"), [0.5]).first()[0] is None

    folds = fits.group_folds(spark.range(1000).select((F.col("id") * 31 % 500).alias("u")), "u", 5)
    assert {x.u: (x.size, x.fold) for x in folds.collect()} == {u: (2, u % 5) for u in range(500)}
    plan = folds._jdf.queryExecution().toString()
    assert "Window" in plan and "_part" in plan  # one window per range, not one of all groups of a size
