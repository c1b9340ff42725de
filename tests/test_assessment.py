"""Spectra, assessment, predicates and reports against direct computation."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from thermalake.functions import geo, physics
from thermalake.operators import assessment, fits, grid, integrate, joins, moments, retrieval, sampling, scenes, spectra, weighted
from thermalake.plans import training
from thermalake.sources import records

NAN = float("nan")


def test_simpson_weights_are_those_of_the_rule(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 4, 7, 8):
        x, y = np.sort(rng.random(n)) * 10, rng.random(n)
        df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
        assert spectra.simpson_weights(x) @ y == pytest.approx(integrate.integrals(df, [], "x", F.col("y")).first().integral)


def test_band_integrals(spark):
    x = np.linspace(5.0, 9.0, 41)
    response = {"a": ([5.5, 6.5, 7.5], [0.0, 1.0, 0.0]), "b": ([8.0, 9.0], [0.5, 0.5])}
    kernels = spectra.band_kernels(spark, x, response)
    rows = [(k, float(w), float(np.exp(-k * w / 9))) for k in (1, 2) for w in x]
    df = spark.createDataFrame(rows, "k int, w double, v double")
    got = {(r.k, r.channel): r.integral for r in spectra.band_integrals(df, ["k"], F.col("w"), F.col("v"), kernels, 41).collect()}
    for k in (1, 2):
        for name, (at, r) in response.items():
            assert got[k, name] == pytest.approx(spectra.simpson_weights(x) @ (np.exp(-k * x / 9) * np.interp(x, at, r, 0, 0)))
    for bad in (df.filter("w < 8.95"), df.union(df.limit(1)), df.withColumn("v", F.when(F.col("w") > 5.05, F.col("v"))), df.withColumn("v", -F.col("v"))):
        with pytest.raises(PySparkException):
            spectra.band_integrals(bad, ["k"], F.col("w"), F.col("v"), kernels, 41).collect()
    for grid_, bands in ((x[::-1], response), (x, {"c": ([20.0, 21.0], [1.0, 1.0])})):
        with pytest.raises(ValueError):
            spectra.band_kernels(spark, grid_, bands)
    flat = spectra.band_kernels(spark, x, {"a": ([5.0, 9.0], [1.0, 1.0])}, equivalent=True)
    per_number = spark.createDataFrame([(float(w), float(1e4 / w**2 / 1000)) for w in x], "w double, v double")
    assert spectra.band_integrals(per_number, [], F.col("w"), F.col("v"), flat, 41).first().integral == pytest.approx(1)


def test_channel_scenarios():
    assert spectra.channel_scenarios({"goal": {"b": [8, 9], "a": [5, 6.5]}}) == {"goal": {"b": (8.0, 9.0), "a": (5.0, 6.5)}}
    for bad in ({"x": {}}, {"x": {"a": [6, 5]}}, {"x": {"a": [5, 7], "b": [6, 8]}}):
        with pytest.raises(ValueError):
            spectra.channel_scenarios(bad)


def test_training_tables(spark, tmp_path):
    df = spark.range(400).select("id", (F.col("id") % 7 * 2.0 + 250).alias("a"), (F.col("id") % 11 * 1.0).alias("b"), F.lit(3.0).alias("c"))
    about = training.prepare_training(df, ["id"], ["a", "b", "c"], str(tmp_path / "z"))
    again = records.replayed(spark, str(tmp_path / "z"), about["rows"], about["columns"])
    row = again.agg(*[f(F.col("z0")) for f in (F.count, F.avg, F.stddev_pop)]).first()
    assert row[0] == 400 and abs(row[1]) < 1e-9 and row[2] == pytest.approx(1, abs=0.1)
    with pytest.raises(PySparkException):
        training.prepare_training(df.withColumn("b", F.when(F.col("id") != 5, F.col("b"))), ["id"], ["a", "b"], str(tmp_path / "y"))
    days = df.select("id", (F.col("id") % 4).alias("day"), (F.when(F.col("id") % 3 == 0, 30.0).otherwise(0.0) + F.col("id") % 10 / 10.0).alias("v"))
    scored, held = training.sampled_comparison(days, "day", "id", ["v"], 2, 30)
    counts = scored.groupBy(F.col("v") > 15, "label").count().collect()
    assert len(counts) == 2 and scored.filter(F.col("density") < held["threshold"]).count() < 40


def test_planck_functions(spark):
    row = spark.range(1).select(
        physics.planck_derivative(F.lit(11e-6), F.lit(280.0)).alias("slope"),
        ((physics.blackbody(F.lit(11e-6), F.lit(280.5)) - physics.blackbody(F.lit(11e-6), F.lit(279.5))) / math.pi).alias("step"),
        physics.channel_response(F.lit(6.0), 5.0, 7.0, 40.0).alias("inside"), physics.channel_response(F.lit(5.0), 5.0, 7.0, 40.0).alias("edge"),
    ).first()
    assert row.slope == pytest.approx(row.step, rel=1e-4) and row.inside == pytest.approx(1) and row.edge == pytest.approx(0.5)
    wide = spectra.band_radiance(spark, ([4.0, 20.0], [1.0, 1.0]), [250.0, 300.0]).orderBy("temperature").collect()
    x = np.linspace(4e-6, 20e-6, 20001)
    for r in wide:
        flux = 2 * physics.PLANCK_H * physics.PLANCK_C**2 / x**5 / np.expm1(physics.PLANCK_H * physics.PLANCK_C / physics.PLANCK_K / x / r.temperature)
        assert r.radiance == pytest.approx(np.trapezoid(flux, x), rel=1e-6)


def test_power_law(spark):
    df = spark.range(1, 60).select((F.col("id") * 5.0).alias("x"))
    assert spectra.power_law_fit(df, F.col("x"), physics.power_law(F.col("x"), 0.013, 4.7)) == pytest.approx((0.013, 4.7))
    y = physics.power_law(F.col("x"), 0.02, 1.5) + F.when(F.col("x") > 100, 0.1).otherwise(-0.1)
    a, b = spectra.power_law_fit(df, F.col("x"), y)
    held = np.array([tuple(r) for r in df.select("x", y).collect()])
    cost = lambda p, q: (((p * held[:, 0]) ** q - held[:, 1]) ** 2).sum()
    assert all(cost(a, b) <= cost(a * (1 + s), b * (1 + t)) for s in (-1e-3, 0, 1e-3) for t in (-1e-3, 0, 1e-3))


def cases(spark, n=120):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        f = rng.random(2) * 50 + 100
        rows.append((i, i // 2, i % 3, float(f[0]), float(f[1]), float(f[0] + 0.5 * f[1] + 1e-3 * f[0] * f[1] + rng.normal()), float(rng.random() + 0.5)))
    return rows, spark.createDataFrame(rows, "case int, pair int, scene int, a double, b double, truth double, weight double")


def test_stages_against_numpy(spark):
    rows, df = cases(spark)
    folded = assessment.with_folds(df, "pair", 4)
    fold = {r.case: r.fold for r in folded.collect()}
    assert all(fold[2 * i] == fold[2 * i + 1] for i in range(60)) and {list(fold.values()).count(k) for k in range(4)} == {30}
    values = [F.col("a"), F.col("b")]
    got = assessment.stage_residuals(folded, ["case"], {"one": values, "two": [v + 1.0 for v in values]}, "one", F.col("truth"), 4)
    held = {(r.case, r.degree, r.stage): r.residual for r in got.collect()}
    x, y, w = np.array([r[3:5] for r in rows]), np.array([r[5] for r in rows]), np.sqrt([r[6] for r in rows])
    at = np.array([fold[i] for i in range(120)])
    mean, scale = x.mean(0), x.std(0)
    monomials = lambda v, d: np.stack([np.prod([(v[:, i] - mean[i]) / scale[i] for i in c], axis=0) for s in range(1, d + 1) for c in __import__("itertools").combinations_with_replacement(range(2), s)], 1)
    for d in (1, 2, 3):
        for k in range(4):
            train = at != k
            full = np.c_[np.ones(120), monomials(x, d)]
            c = np.linalg.lstsq(full[train] * w[train, None], y[train] * w[train], rcond=None)[0]
            for stage, v in (("one", x), ("two", x + 1)):
                want = np.c_[np.ones(120), monomials(v, d)] @ c - y
                assert [held[i, d, stage] for i in np.flatnonzero(at == k)] == pytest.approx(want[at == k], abs=1e-7)
    covariance = {r.degree: r for r in assessment.chain_increments(got, ["case"], "one", "two").collect()}
    assert all(r.var_total == pytest.approx(r.var_first + r.var_second + 2 * r.covariance) for r in covariance.values())
    with pytest.raises(PySparkException):
        assessment.chain_increments(got.filter("case <> 3 OR stage = 'one'"), ["case"], "one", "two").collect()
    with pytest.raises(PySparkException):
        assessment.chain_increments(got.withColumn("fold", F.when(F.col("stage") == "one", F.col("fold")).otherwise(9)), ["case"], "one", "two").collect()


def test_selected_terms(spark):
    df = spark.createDataFrame([("b", "goal", 3, 1.0), ("a", "goal", 3, 2.0), ("a", "goal", 2, 3.0), ("b", "goal", 1, 3.0)], "scenario string, mode string, degree int, rmse double")
    assert [r.scenario for r in assessment.selected_terms(df, "scenario", F.col("degree") == 3).collect()] == ["a", "b"]
    for where in (F.col("degree") == 2, F.col("degree") >= 2):
        with pytest.raises(PySparkException):
            assessment.selected_terms(df, "scenario", where).collect()


def test_weights_state_coverage_and_missing_labels(spark):
    _, df = cases(spark, 9)
    own, about = assessment.case_weights(df.drop("weight").filter("scene < 2"), "scene", spark.createDataFrame([(0, 0.5), (1, 0.3), (2, 0.2)], "scene int, share double"), "share")
    weights = [r.weight for r in own.collect()]
    assert about["missing"] == ["2"] and about["coverage"] == pytest.approx(0.8) and sum(weights) == pytest.approx(1)
    assert about["ess"] == pytest.approx(1 / sum(w * w for w in weights))


def test_four_components_close(spark):
    """With shapes that vary within scenes, a curved truth and hash draws; against numpy for one draw."""
    rng = np.random.default_rng(3)
    angles, basis = (0.0, 30.0, 50.0, 65.0), None
    basis = np.array([physics.limb_value(a) - 1 for a in angles])
    rows = []
    for i in range(90):
        amplitude, b = rng.random(2) * 3 + 2, np.array([-0.2 - 0.1 * (i % 3), 0.3]) + rng.normal(size=2) * 0.02
        fluxes = math.pi * amplitude * [physics.angular_integral([x]) for x in b]
        rows.append((i, i // 2, i % 3, [[float(v) for v in amplitude * (1 + b * g)] for g in basis], [float(f) for f in fluxes], float(fluxes.sum() + 0.01 * fluxes[0] ** 2), 1.0))
    df = spark.createDataFrame(rows, "case int, pair int, scene int, views array<array<double>>, fluxes array<double>, truth double, weight double")
    df = assessment.with_folds(df.withColumn("view", F.col("views")[2]), "pair", 3)
    shapes = assessment.fold_shapes(df, "case", "views", angles, "scene", 2, 3)
    models = fits.fold_models(df, [F.get("fluxes", 0), F.get("fluxes", 1)], F.col("truth"), F.col("weight"), F.col("fold"), 3)
    transitions = spark.createDataFrame([(s, [0, 1, 2], [[0.8, 0.9, 1.0], [0.1, 0.9, 1.0], [0.1, 0.2, 1.0]][s]) for s in range(3)], "_from int, labels array<int>, cumulative array<double>")
    run = lambda d: assessment.four_components(d, "case", "scene", "view", "fluxes", "truth", 50.0, shapes, models, transitions, (0.05, 0.1), 20, 7)
    errors = run(df)
    row = assessment.closure(errors).first()
    assert row.n == 1800 and row.largest < 1e-9
    again = {(r.case, r.draw): r.total for r in run(df.repartition(7)).collect()}
    assert again == {(r.case, r.draw): r.total for r in errors.collect()}
    held = {(r["_fold"], r["_scene"]): r for r in shapes.collect()}
    for r in errors.filter("draw = 1").collect():
        own, fold = rows[r.case], r.fold
        s = held[fold, own[2]]
        clean = [math.pi * v * i / (1 + b * basis[2]) for v, i, b in zip(own[3][2], s.integrals, s.shapes, strict=True)]
        m = models[fold]
        predict = lambda f: m.intercept + sum(c * (v - a) / q for c, v, a, q in zip(m.coefficients, f, m.mean, m.scale, strict=True))
        assert r.spectral == pytest.approx(predict(own[4]) - own[5]) and r.angular == pytest.approx(predict(clean) - predict(own[4]), abs=1e-9)
    classes = {r.component: r for r in assessment.budget_classes(errors, "case").collect()}
    assert classes["spectral"].random_variance == pytest.approx(0, abs=1e-12) and classes["noise"].random_variance > 0
    assert classes["total"].bias == pytest.approx(sum(classes[c].bias for c in assessment.COMPONENTS))
    assert assessment.budget_classes(errors, "case", ["scene"]).count() == 15


def test_noisy_geometry_against_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(c, v, float(10 * v), float(30 + c + rng.normal())) for c in range(5) for v in range(1, 7)]
    df = spark.createDataFrame(rows, "c int, v int, angle double, l double")
    basis, integrals = physics.angular_basis(F.col("angle"), True), (0.03, -0.02)
    noise = [F.sin(F.col("v") * 5.0 + F.col("c"))]
    out = retrieval.noisy_geometry_study(df, "c", "v", {"all": range(1, 7), "two": (1, 4), "one": (2,)}, basis, F.col("l"), integrals, F.lit(100.0), noise)
    got = {(r.geometry, r.form, r.realization): r for r in out.collect()}
    assert got["one", 1, 0].unidentifiable == got["two", 2, 0].unidentifiable == 5 and got["two", 1, 1].unidentifiable == 0
    for form in (1, 2):
        errors = []
        for c in range(5):
            own = [r for r in rows if r[0] == c]
            x = np.array([[1, physics.limb_value(r[2]) - 1, math.cos(math.radians(r[2])) ** 2 - math.cos(math.radians(55)) ** 2][: 1 + form] for r in own])
            fit = np.linalg.lstsq(x, [r[3] + math.sin(r[1] * 5.0 + c) for r in own], rcond=None)[0]
            errors.append(math.pi * (fit @ np.array([1, *integrals])[: 1 + form]) - 100)
        r = got["all", form, 1]
        assert r.bias == pytest.approx(np.mean(errors)) and r.rmse == pytest.approx(np.sqrt(np.mean(np.square(errors))))


def test_retrievals_against_numpy(spark):
    rng = np.random.default_rng(8)
    rows = [(c, float(v), float(10 * (1 + b * v) + rng.normal() * 0.01)) for c, b in enumerate((-0.2, 0.5, 3.0, -4.0)) for v in (-0.3, -0.1, 0.0, 0.15)]
    df = spark.createDataFrame([*rows, (9, 0.1, 5.0)], "c int, x double, y double")
    bounds = (-1.0, 1.0)
    got = {r.c: r for r in fits.view_retrieval(df, ["c"], F.col("x"), F.col("y"), 0.1, bounds).collect()}
    for c in range(4):
        x, y = np.array([r[1:] for r in rows if r[0] == c]).T
        cost = lambda b: np.min(((y[:, None] - np.outer(1 + b * x, np.linspace(5, 15, 20001))) ** 2).sum(0))
        at = np.linspace(*bounds, 401)
        assert got[c].b == pytest.approx(at[np.argmin([cost(b) for b in at])], abs=0.006) and got[c].constrained == (c > 1)
        assert got[c].flux == pytest.approx(math.pi * got[c].amplitude * (1 + 0.1 * got[c].b))
    assert got[9].flux is None or got[9].b is None
    views = df.withColumn("angle", F.when(F.col("x") == 0, 55.0).otherwise(20.0))
    norm = {r.c: r for r in fits.normalised_retrieval(views.filter("c < 4"), ["c"], F.col("angle"), F.col("x"), F.col("y"), 0.1).collect()}
    for c in range(4):
        x, y = np.array([r[1:] for r in rows if r[0] == c]).T
        ratio = y / y[2] - 1
        b = (x * ratio).sum() / (x * x).sum()
        assert norm[c].b == pytest.approx(b) and norm[c].rms_percent == pytest.approx(100 * np.sqrt(np.mean((ratio - b * x) ** 2)), abs=1e-6)
    with pytest.raises(PySparkException):
        fits.normalised_retrieval(views, ["c"], F.col("angle"), F.col("x"), F.col("y"), 0.1).collect()


def test_predicates(spark):
    df = spark.createDataFrame([(50.0, 30.0), (0.0, 30.0), (NAN, 30.0), (None, 30.0), (999.0, 30.0), (50.0, 71.0), (float("inf"), 3.0)], "l double, a double")
    both = physics.overlap([F.col("l")], [F.col("l") * 1.5], [physics.brightness_temperature(F.col("l"), 2e4, 1300.0)], [F.col("a")])
    assert [r.b for r in df.select(both.alias("b")).collect()] == [True, False, False, False, False, False, False]
    assert [r.b for r in df.select(physics.legacy_mask([F.col("l")]).alias("b")).collect()] == [True, False, False, False, True, True, False]
    with pytest.raises(PySparkException):
        df.limit(1).select(*physics.noisy_features([F.col("l")] * 6, [F.col("l")] * 6, [(F.lit(-60.0), F.lit(0.0))] * 6, 2e4, 1300.0)).collect()
    with pytest.raises(PySparkException):
        df.limit(2).select(physics.lognormal_radiance(F.col("l"), F.lit(1.0), F.lit(0.0))).collect()


def test_parallax(spark):
    view = geo.View(-75.0)
    df = spark.createDataFrame([(0.0, -75.0, 12000.0), (30.0, -60.0, 0.0), (30.0, -60.0, None), (30.0, -60.0, NAN), (40.0, -95.0, 10000.0)], "lat double, lon double, h double")
    lat, lon = geo.parallax(F.col("lat"), F.col("lon"), F.col("h"), view)
    got = df.select(lat.alias("lat"), lon.alias("lon")).collect()
    assert all((g.lat, g.lon) == (pytest.approx(a, abs=1e-6), pytest.approx(o, abs=1e-6)) for g, (a, o) in zip(got, [(0, -75), (30, -60), (30, -60), (30, -60)], strict=False))
    assert 0 < 40 - got[4].lat < 0.5 and 0 < got[4].lon + 95 < 0.5  # towards the satellite


def test_cells_and_neighbours(spark):
    df = spark.range(42).select((F.col("id") / 7).cast("int").alias("y"), (F.col("id") % 7).cast("int").alias("x"), (F.col("id") * 1.0).alias("v"))
    whole = grid.whole_footprints(df, [], "y", "x", 3)
    assert whole.count() == 36 and grid.block_means(whole, [], "y", "x", F.col("v"), 3).count() == 4
    with pytest.raises(PySparkException):
        grid.block_means(df, [], "y", "x", F.col("v"), 3).collect()
    assert grid.whole_footprints(df.withColumn("day", F.lit(1)), ["day"], "y", "x", 4).count() == 16
    assert grid.strided(df, "y", "x", 3).count() == 6
    far = df.withColumn("v", F.col("v") % 5 + 1e8)
    got = {(r.y, r.x): r for r in grid.box_statistics(far, [], "y", "x", "v", 1).collect()}
    keyed = {(r.y, r.x): r for r in grid.box_statistics(far.withColumn("day", F.lit(None).cast("int")).withColumn("day", F.lit(3)), ["day"], "y", "x", "v", 1).collect()}
    held = np.array([(i % 5) + 1e8 for i in range(42)]).reshape(6, 7)
    for (y, x), r in got.items():
        box = held[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]
        assert (r.box_n, r.box_mean, r.box_sd) == (box.size, pytest.approx(box.mean()), pytest.approx(box.std(), abs=1e-6))
        assert keyed[y, x].box_sd == pytest.approx(r.box_sd, abs=1e-6)
    targets = spark.createDataFrame([(1, 89.9, 10.0), (2, 0.0, 179.9), (3, 0.0, 0.0)], "k int, lat double, lon double")
    sources = spark.createDataFrame([(89.9, -170.0, 7), (0.0, -179.9, 8), (0.1, 179.0, 9)], "lat double, lon double, value int")
    assert grid.nearest_within(targets.union(targets), sources, "lat", "lon", "value", 50_000.0).count() == 6
    near = {r.k: r for r in grid.nearest_within(targets, sources, "lat", "lon", "value", 50_000.0).collect()}
    assert (near[1].value, near[2].value, near[3].value) == (7, 8, None) and near[2].distance == pytest.approx(22239, abs=10)


def test_moments_keep_their_digits_at_large_levels(spark):
    rng = np.random.default_rng(9)
    e, f, w = rng.normal(size=500), rng.normal(size=500), rng.random(500)
    df = spark.createDataFrame([(float(a) + 1e8, float(b) - 1e8, float(c)) for a, b, c in zip(e, f, w, strict=True)], "e double, f double, w double")
    e, f = e + 1e8 - 1e8, f
    u = w / w.sum()
    cov = lambda x, y: (u * (x - u @ x) * (y - u @ y)).sum() / (1 - (u * u).sum())
    r = weighted.weighted_errors(df, [], F.col("e"), F.col("w")).first()
    assert r.sd == pytest.approx(math.sqrt(cov(e, e)), rel=1e-5) and r.bias == pytest.approx(1e8 + u @ e, abs=1e-6)
    r = weighted.paired_covariance(df, [], F.col("e"), F.col("f"), F.col("w")).first()
    assert (r.var_first, r.covariance) == (pytest.approx(cov(e, e), rel=1e-5), pytest.approx(cov(e, f), rel=1e-4))
    parts = {r.component: r for r in weighted.component_budget(df, ["e", "f"], F.col("w")).collect()}
    assert parts["e"].variance == pytest.approx(cov(e, e) * (1 - (u * u).sum()), rel=1e-5) and abs(parts["total"].closure) < 1e-6


def test_variances(spark):
    row = spark.range(1).select(
        weighted.combined_variance([F.lit(1.0), F.lit(2.0)]).alias("a"), weighted.combined_variance([F.lit(1.0), F.lit(None).cast("double")]).alias("b"),
        weighted.propagated([F.lit(1.0), F.lit(-1.0)], [[F.lit(1.0), F.lit(1.0)], [F.lit(1.0), F.lit(1.0)]]).alias("c"), weighted.variance_shares(F.lit(1.0), F.lit(2.0), F.lit(0.5), F.lit(4.0)).alias("d"),
        weighted.component_statistics(F.lit(3.0), F.lit(4.0), F.lit(2)).alias("e"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e.rmse) == (3.0, None, 0.0, [1.0, 2.0, 1.0], pytest.approx(math.sqrt(17)))
    for bad in (weighted.combined_variance([F.lit(-1.0)]), weighted.propagated([F.lit(1.0)], [[F.lit(-1.0)]]), weighted.variance_shares(F.lit(1.0), F.lit(2.0), F.lit(0.5), F.lit(5.0))):
        with pytest.raises(PySparkException):
            spark.range(1).select(bad).collect()
    df = spark.createDataFrame([(1.0, 0.25), (3.0, 0.75)], "v double, w double")
    assert tuple(weighted.weighted_moments(df, [], F.col("v"), F.col("w")).first()) == (2.5, pytest.approx(math.sqrt(7)))


def test_thresholds_take_exactly_so_many(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") * 37 % 1009 * 1.0).alias("key"))
    order = [r.id for r in df.orderBy("key", "id").collect()]
    for take in (0, 1, 40, 1700, 4999, 5000):
        for few in (10, 20_000):
            got = df.filter(sampling.smallest_keys(df, F.col("key"), ["id"], take, few=few, steps=16))
            assert sorted(r.id for r in got.collect()) == sorted(order[:take])
    parts = sampling.split(df, 3, ["id"], 0.8).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts}["train"] == pytest.approx(4000, abs=150)


def test_resampling_without_copies(spark):
    df = spark.range(3000).select("id", (F.col("id") % 2).alias("g"), (F.col("id") % 7 * 1.0).alias("v"))
    draws = [F.rand(i) for i in range(3)]
    kept = df.select("*", *[d.alias(f"u{i}") for i, d in enumerate(draws)]).cache()
    got = {(r.g, r.replicate): r for r in sampling.bootstrap_sums(kept, ["g"], [F.col(f"u{i}") for i in range(3)], F.col("v")).collect()}
    assert len(got) == 6 and all(r.n == pytest.approx(1500, abs=200) for r in got.values())
    one = kept.select("g", sampling.poisson(F.col("u1")).alias("n"), "v").groupBy("g").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("t")).collect()
    assert all((got[r.g, 1].n, got[r.g, 1].total) == (r.n, r.t) for r in one)


def test_sets_and_pairs(spark):
    df = spark.createDataFrame([(1, "clear"), (1, "cloudy"), (2, "clear"), (3, "clear"), (3, "cloudy"), (3, "cloudy")], "id int, kind string")
    assert {r.id: r.problem for r in joins.paired_ids(df, "id", "kind", ["clear", "cloudy"]).collect()} == {2: "without cloudy", 3: "repeated or of another kind"}
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "k int")
    assert {r.k: r.status for r in joins.covers([ids(1, 2), ids(2, 5)], ids(1, 2, 3), "k").collect()} == {2: "shared", 5: "unexpected", 3: "missing"}
    assert joins.require(df, F.col("id") > 3, "too large").count() == 6
    with pytest.raises(PySparkException):
        joins.require(df, F.col("id") > 2, "too large").collect()


def test_reports(spark):
    d = spark.createDataFrame([(2, True, 3.0), (3, False, 1.0), (4, True, 2.0), (5, False, 0.5)], "k int, ok boolean, worst double")
    assert [r.k for r in scenes.shortlist(d, "k", "ok", "worst", 1).collect()] == [2]
    assert [r.k for r in scenes.shortlist(d.withColumn("ok", F.lit(False)), "k", "ok", "worst", 2).collect()] == [5, 3]
    views = spark.createDataFrame([(1, 0)] * 3 + [(2, 1)] * 2, "file int, label int")
    assert scenes.complete_views(views.filter("file = 1"), "file", 3).count() == 3
    with pytest.raises(PySparkException):
        scenes.complete_views(views, "file", 3).collect()
    pairs = spark.createDataFrame([("s", 0, 1), ("s", 0, 1), ("s", 6, 6), ("s", 7, 1)], "s string, a int, b int")
    row = scenes.paired_support(pairs, "s", "a", "b", 7).first()
    assert (row.n, row.occupied, row.effective_bins) == (3, 2, pytest.approx(9 / 5))
    held = scenes.criteria(spark.createDataFrame([(1, 0.5), (2, 2.0), (3, None)], "k int, v double"), {"small": F.col("v") < 1, "known": F.col("k") > 0})
    assert [r.all_criteria for r in held.orderBy("k").collect()] == [True, False, False]
    wide = scenes.classification_rows(spark.createDataFrame([(1, 0, [0.7, 0.3])], "f int, label int, p array<double>"), ["f"], "label", "p", 2)
    assert tuple(wide.first()) == (1, 0, 0.7, 0.3)
    days = spark.createDataFrame([(1, "a", 0.1, 1.0), (2, "a", 0.2, 1.0)], "day int, c string, b double, n double")
    with pytest.raises(PySparkException):
        scenes.shape_spread(days, "day", ["c"], "b", "n", 3, (0.0,)).collect()
    level = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 10.0)], "day int, l double")
    assert tuple(scenes.weighted_log_likelihood(level, "day", F.col("l")).first()) == (2, 3, pytest.approx(14 / 3))
    df = spark.createDataFrame([(0, 1.0, 1.1, 5.0, 4.0, 9.0, 4.0), (1, 1.0, 0.8, 5.0, 5.0, 9.0, 5.5)], "s int, p double, o double, a double, b double, ra double, rb double")
    r = scenes.ratio_diagnostics(df, "s", {"c": (F.col("p"), F.col("o"))}, F.col("a"), F.col("b"), F.col("ra"), F.col("rb")).first()
    assert (r.ratio_rmse, r.worst_scene, r.raw, r.corrected) == (pytest.approx(math.sqrt(0.025)), pytest.approx(0.2), pytest.approx(0.75), pytest.approx(0.5))
    assert {v.variant: v.n for v in moments.variant_summaries(df, [], F.col("a"), {"x": F.col("b"), "y": F.when(F.col("s") == 0, F.col("b"))}, F.col("a")).collect()} == {"x": 2, "y": 1}


def test_the_flagship_stays_compiled(spark):
    """A generated method of 8,000 bytes and more is never compiled by the virtual machine."""
    from thermalake.plans import products

    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = products.gridded_flux_budget(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
        debug = spark._jvm.org.apache.spark.sql.execution.debug
        codes = getattr(getattr(debug, "package$"), "MODULE$").codegenStringSeq(plan)
        assert max(codes.apply(i)._3().maxMethodCodeSize() for i in range(codes.size())) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_overlap_features_stay_compiled(spark):
    from thermalake.plans import assessments

    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = assessments.overlap_features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
        debug = spark._jvm.org.apache.spark.sql.execution.debug
        codes = getattr(getattr(debug, "package$"), "MODULE$").codegenStringSeq(plan)
        assert max(codes.apply(i)._3().maxMethodCodeSize() for i in range(codes.size())) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_masks_and_noisy_features_of_odd_radiances(spark):
    """Null, NaN, infinite and negative values are a no in every group; features are null where a radiance isn't finite."""
    odd = [None, float("nan"), float("inf"), -1.0, 0.0, 900.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "i int, v double").coalesce(1)
    good, v = F.lit(10.0), F.col("v")
    for raw, corrected, bt, angle, want in (
        (v, good, good, good, [False, False, False, False, False, True]), (good, v, good, good, [False, False, False, False, False, True]),
        (good, good, v, good, [False, False, False, False, False, True]), (good, good, good, v, [False, False, False, False, True, False]),
    ):
        rows = df.orderBy("i").select(physics.overlap([good, raw], [good, corrected], [bt], [angle]).alias("b")).collect()
        assert [r.b for r in rows] == want
    f = physics.noisy_features([v] * 6, [good] * 6, [(F.lit(2.0), F.lit(0.0))] * 6, 2e4, 1300.0)
    found = [r[0] for r in df.orderBy("i").select(f[0]).collect()]
    assert found[:3] == [None] * 3
    temperature = lambda x: 1300.0 / math.log1p(2e4 / x)
    assert found[3:] == [pytest.approx((temperature(x + 2.0) + temperature(10.0)) / 2) for x in odd[3:]]
