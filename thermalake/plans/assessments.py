"""Assessment, budgets, predicates and reports over the driver's tables: customers stand for spectra, line items for views."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermalake.functions import physics
from thermalake.operators import assessment, fits, moments, retrieval, scenes, variants, weighted
from thermalake.plans.models import _lattice, lattice
from thermalake.plans.products import FK1, FK2
from thermalake.plans.retrievals import GEOMETRIES, hemisphere
from thermalake.sources import records
from thermalake.sources.tables import cut, table
from thermalake.streaming.incremental import shared_folder


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with a true and a retrieved channel flux, folds and weights."""
    c = table(spark, sf_dir, "customer")
    flux = F.lit(80.0) + F.col("c_custkey") % 211 / 3.0
    cases = c.select(
        "c_custkey", (F.col("c_nationkey") % 5).alias("scene"), F.pmod("c_custkey", F.lit(5)).cast("int").alias("fold"), (F.col("c_custkey") % 4 + 1.0).alias("weight"),
        flux.alias("f"), (flux * 1.01 + F.col("c_custkey") % 13 / 10.0).alias("g"), (2.5 * flux + F.col("c_acctbal") / 500.0).alias("truth"),
    )
    return assessment.stage_residuals(cases, ["c_custkey", "scene"], {"n2bc_only": [F.col("f")], "end_to_end": [F.col("g")]}, "n2bc_only", F.col("truth"), 5, (1,))


_STAGES = """c AS (SELECT c_custkey, c_nationkey % 5 AS scene, (c_custkey % 5)::INTEGER AS fold, c_custkey % 4 + 1.0::DOUBLE AS w, 80.0 + c_custkey % 211 / 3.0 AS f, (80.0 + c_custkey % 211 / 3.0) * 1.01 + c_custkey % 13 / 10.0 AS g,
  2.5 * (80.0 + c_custkey % 211 / 3.0) + c_acctbal / 500.0 AS t FROM customer),
k AS (SELECT DISTINCT fold FROM c), q AS (SELECT k.fold, sum(w) AS w1, sum(w * f) / sum(w) AS mf, sum(w * t) / sum(w) AS mt FROM k JOIN c ON c.fold <> k.fold GROUP BY 1),
m AS (SELECT q.fold, any_value(mt) - any_value(mf) * sum(w * (f - mf) * (t - mt)) / sum(w * (f - mf) * (f - mf)) AS a, sum(w * (f - mf) * (t - mt)) / sum(w * (f - mf) * (f - mf)) AS b FROM q JOIN c ON c.fold <> q.fold GROUP BY 1),
e AS (SELECT c.*, a + b * f - t AS e1, a + b * g - t AS e2 FROM c JOIN m USING (fold))"""


def stage_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out errors of both stages, weighted."""
    out = assessment.stage_summary(_stages(spark, sf_dir))
    return out.select("degree", "stage", "n", *[F.round(c, 5).alias(c) for c in ("bias", "sd", "sd2", "rmse", "max_abs", "ess")])


_ERRORS = """SELECT 1::INTEGER AS degree, '{0}' AS stage, count(*) AS n, round(sum(w * {1}) / sum(w), 5) AS bias,
  round(sqrt((sum(w * {1} * {1}) / sum(w) - pow(sum(w * {1}) / sum(w), 2)) / (1 - sum(w * w) / pow(sum(w), 2))), 5) AS sd, round(2 * sqrt((sum(w * {1} * {1}) / sum(w) - pow(sum(w * {1}) / sum(w), 2)) / (1 - sum(w * w) / pow(sum(w), 2))), 5) AS sd2,
  round(sqrt(sum(w * {1} * {1}) / sum(w)), 5) AS rmse, round(max(abs({1})), 5) AS max_abs, round(pow(sum(w), 2) / sum(w * w), 5) AS ess FROM e"""
STAGE_ASSESSMENT = f"WITH {_STAGES} " + " UNION ALL ".join(_ERRORS.format(s, e) for s, e in (("n2bc_only", "e1"), ("end_to_end", "e2")))


def chain_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The covariance of the first stage's errors and the second's additions, whose parts must add up to the total."""
    out = assessment.chain_increments(_stages(spark, sf_dir), ["c_custkey", "scene"], "n2bc_only", "end_to_end")
    parts = weighted.variance_shares(F.col("var_first"), F.col("var_second"), F.col("covariance"), F.col("var_total"))
    return out.select("degree", *[F.round(c, 5).alias(c) for c in ("mean_first", "mean_second", "var_total")], *[F.round(parts[i], 5).alias(n) for i, n in enumerate(("spectral", "increment", "cross"))])


CHAIN_COVARIANCE = f"""WITH {_STAGES}, s AS (SELECT sum(w) AS w1, sum(w * w) AS w2, sum(w * e1) / sum(w) AS ma, sum(w * (e2 - e1)) / sum(w) AS mb FROM e),
v AS (SELECT any_value(ma) AS ma, any_value(mb) AS mb, sum(w / w1 * pow(e1 - ma, 2)) / (1 - any_value(w2 / w1 / w1)) AS a, sum(w / w1 * pow(e2 - e1 - mb, 2)) / (1 - any_value(w2 / w1 / w1)) AS b, 2 * sum(w / w1 * (e1 - ma) * (e2 - e1 - mb)) / (1 - any_value(w2 / w1 / w1)) AS c FROM e, s)
SELECT 1::INTEGER AS degree, round(ma, 5) AS mean_first, round(mb, 5) AS mean_second, round(a + b + c, 5) AS var_total, round(a, 5) AS spectral, round(b, 5) AS increment, round(c, 5) AS "cross" FROM v"""


def scene_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per scene the band of the end-to-end residuals."""
    out = assessment.scene_residuals(_stages(spark, sf_dir).filter("stage = 'end_to_end'"), "scene")
    return out.select("scene", "n", *[F.round(c, 5).alias(c) for c in ("mean", "low", "high", "share")])


SCENE_RESIDUALS = f"""WITH {_STAGES} SELECT scene, count(*) AS n, round(avg(e2), 5) AS mean, round(avg(e2) - 2 * stddev_samp(e2), 5) AS low, round(avg(e2) + 2 * stddev_samp(e2), 5) AS high,
  round(sum(w) / (SELECT sum(w) FROM e), 5) AS share FROM e GROUP BY 1"""

#: Shapes of three scenes in two channels, the regression, the noise, the transitions and the population.
SHAPES = ((-0.1, -0.3), (-0.25, 0.2), (0.4, -0.5))
MODEL, NOISE, ANGLES, ANGLE, DRAWS = (20.0, 0.4, 0.7), (0.02, 0.05), (0.0, 25.0, 40.0, 55.0, 65.0), 40.0, 30
STAY = ((0.9, 0.98, 1.0), (0.1, 0.95, 1.0), (0.02, 0.1, 1.0))
POPULATION = (0.5, 0.3, 0.2)


def _budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    basis = [physics.limb_value(a) - 1 for a in ANGLES]
    b = F.element_at(F.array(*[F.array(*map(F.lit, s)) for s in SHAPES]), F.col("scene") + 1)
    i = F.element_at(F.array(*[F.array(*[F.lit(physics.angular_integral([x])) for x in s]) for s in SHAPES]), F.col("scene") + 1)
    cases = table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_nationkey") % 3).cast("int").alias("scene"), F.floor(F.col("c_custkey") / 2).alias("pair"), F.array(2.0 + F.col("c_custkey") % 97 / 50.0, 5.0 + F.col("c_custkey") % 89 / 30.0).alias("amplitude")
    )
    cases = cases.withColumns({"b": b, "i": i})
    seen = lambda g: F.transform("amplitude", lambda a, k: a * (1.0 + F.get("b", k) * F.lit(g)))
    views = F.array(*[seen(g) for g in basis])
    cases = cases.withColumns({"views": views, "fluxes": F.transform("amplitude", lambda a, k: F.lit(math.pi) * a * F.get("i", k))})
    cases = cases.withColumns({"view": F.get("views", ANGLES.index(ANGLE)), "truth": MODEL[0] + MODEL[1] * F.get("fluxes", 0) + MODEL[2] * F.get("fluxes", 1)})
    population = spark.createDataFrame(list(enumerate(POPULATION)), "scene int, share double")
    cases, _ = assessment.case_weights(cases, "scene", population, "share")
    cases = assessment.with_folds(cases, "pair", 5)
    shapes = assessment.fold_shapes(cases, "c_custkey", "views", ANGLES, "scene", 2, 5)
    models = fits.fold_models(cases, [F.get("fluxes", 0), F.get("fluxes", 1)], F.col("truth"), F.col("weight"), F.col("fold"), 5)
    transitions = spark.createDataFrame([(s, [0, 1, 2], list(row)) for s, row in enumerate(STAY)], "_from int, labels array<int>, cumulative array<double>")
    return assessment.four_components(
        cases, "c_custkey", "scene", "view", "fluxes", "truth", ANGLE, shapes, models, transitions, NOISE, DRAWS, 42,
        noise=lambda case, channel, draw: lattice(case.cast("long"), channel, draw) * 2.0 - 1.0, pick=lambda case, draw: lattice(draw, case.cast("long")),
    )


def nominal_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error classes of four paired components and their total, and per scene; shapes and regressions are fitted per fold."""
    errors = cut(_budget(spark, sf_dir))  # both summaries read the draws, which are made once
    out = assessment.budget_classes(errors, "c_custkey").withColumn("scene", F.lit(-1)).unionByName(assessment.budget_classes(errors, "c_custkey", ["scene"]))
    return out.select("scene", "component", *[(F.round(c, 5) + 0.0).alias(c) for c in ("bias", "random_variance", "scene_variance", "rmse")])


def budget_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """That the four components add up to the total in every draw."""
    return assessment.closure(_budget(spark, sf_dir)).select("n", (F.col("largest") < 1e-9).alias("closed"))


BUDGET_CLOSURE = f"SELECT count(*) * {DRAWS} AS n, true AS closed FROM customer"

_G = physics.limb_value(ANGLE) - 1
_NOISY = "{c} * pi() * {sd!r} * ({u} * 2 - 1) * {i} / (1 + {b} * {g!r})"


def _budget_sql() -> str:
    values = ", ".join(f"({s}, " + ", ".join(f"{v!r}::DOUBLE" for v in (*b, *[physics.angular_integral([x]) for x in b], POPULATION[s])) + ")" for s, b in enumerate(SHAPES))
    stay = ", ".join(f"({s}, {k}, {row[k - 1] if k else 0.0!r}::DOUBLE, {row[k]!r}::DOUBLE)" for s, row in enumerate(STAY) for k in range(3))
    u = [_lattice("k::BIGINT", str(c), "draw") for c in (0, 1)]
    noise = " + ".join(_NOISY.format(c=MODEL[c + 1], sd=NOISE[c], u=f"u{c}", i=f"s.i{c}", b=f"s.b{c}", g=_G) for c in (0, 1))
    moved = " + ".join(f"{MODEL[c + 1]!r} * pi() * (a{c} * (1 + s.b{c} * {_G!r}) + {NOISE[c]!r} * (u{c} * 2 - 1)) * o.i{c} / (1 + o.b{c} * {_G!r})" for c in (0, 1))
    clean = " + ".join(f"{MODEL[c + 1]!r} * pi() * a{c} * s.i{c}" for c in (0, 1))
    classes = """SELECT {scene} AS scene, component, round(any_value(bias), 5) + 0.0 AS bias, round(sum(w * v) / any_value(w1), 5) + 0.0 AS random_variance,
  round(sum(w * (m - bias) * (m - bias)) / any_value(w1) - sum(w / w1 * (1 - w / w1) * v / r), 5) + 0.0 AS scene_variance, round(sqrt(sum(w * q) / any_value(w1)), 5) + 0.0 AS rmse FROM {source} GROUP BY 1, 2"""
    return f"""WITH s(s, b0, b1, i0, i1, share) AS (VALUES {values}), t(f, l, low, high) AS (VALUES {stay}),
c AS (SELECT c_custkey AS k, c_nationkey % 3 AS s, 2.0 + c_custkey % 97 / 50.0 AS a0, 5.0 + c_custkey % 89 / 30.0 AS a1 FROM customer), n AS (SELECT s, count(*) AS n FROM c GROUP BY 1),
d AS (SELECT k, c.s, draw, a0, a1, {u[0]} AS u0, {u[1]} AS u1, {_lattice("draw", "k::BIGINT")} AS p FROM c, generate_series(1, {DRAWS}) AS g(draw)),
e AS (SELECT k, d.s, s.share / n.n AS w, {noise} AS noise, {moved} - ({clean} + {noise}) AS scene_assignment FROM d JOIN s ON s.s = d.s JOIN n ON n.s = d.s JOIN t ON t.f = d.s AND p <= high AND (p > low OR low = 0) JOIN s o ON o.s = t.l),
x AS (SELECT k, s, w, unnest(['spectral', 'angular', 'noise', 'scene_assignment', 'total']) AS component, unnest([0.0, 0.0, noise, scene_assignment, noise + scene_assignment]) AS e FROM e),
f AS (SELECT k, s, component, any_value(w) AS w, count(*) AS r, avg(e) AS m, var_samp(e) AS v, avg(e * e) AS q FROM x GROUP BY 1, 2, 3),
h AS (SELECT *, sum(w * m) OVER z / sum(w) OVER z AS bias, sum(w) OVER z AS w1 FROM f WINDOW z AS (PARTITION BY component)),
j AS (SELECT *, sum(w * m) OVER z / sum(w) OVER z AS bias, sum(w) OVER z AS w1 FROM f WINDOW z AS (PARTITION BY component, s))
{classes.format(scene="(-1)::INTEGER", source="h")} UNION ALL {classes.format(scene="s::INTEGER", source="j")}"""


NOMINAL_BUDGET = _budget_sql()


def overlap_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that both satellites see, those of the legacy mask, and mean features with noise, per flag."""
    radiances = [F.col("l_extendedprice") / 1000.0 * f + 5.0 for f in (0.2, 0.5, 0.6, 0.7, 0.8, 0.4)]
    # columns of their own, as they are read many times: written out in every condition they make a method too long to be compiled
    df = table(spark, sf_dir, "lineitem").withColumns({f"a{i}": x for i, x in enumerate(radiances)})
    df = df.withColumns({f"b{i}": F.when(F.col("l_discount") < 0.09, F.col(f"a{i}") * 1.02) for i in range(6)})
    a, b = ([F.col(f"{s}{i}") for i in range(6)] for s in "ab")
    bt = [physics.brightness_temperature(x, FK1, FK2) for x in (*a, *b)]
    angles = [F.col("l_quantity") * 1.5, F.col("l_tax") * 900.0]
    noise = [((F.col("l_orderkey") % 7 - 3) / 10.0, (F.col("l_partkey") % 5 - 2) / 10.0)] * 6
    both = physics.overlap([*a, *b], [x * 1.1 for x in (*a, *b)], bt, angles)
    df = df.select("l_returnflag", both.alias("both"), physics.legacy_mask([*a, *b]).alias("legacy"), *[f.alias(f"f{i}") for i, f in enumerate(physics.noisy_features(a, b, noise, FK1, FK2))])
    means = [F.round(F.avg(F.when(F.col("both"), F.col(f"f{i}"))), 4).alias(f"f{i}") for i in (0, 3, 6, 9)]
    return df.groupBy("l_returnflag").agg(F.count_if("both").alias("overlapping"), F.count_if("legacy").alias("legacy"), *means)


def _overlap_sql() -> str:
    f = (0.2, 0.5, 0.6, 0.7, 0.8, 0.4)
    t = lambda i: f"({FK2} / ln(1 + {FK1} / (r * {f[i]} + 5.0 + z1)) + {FK2} / ln(1 + {FK1} / ((r * {f[i]} + 5.0) * 1.02 + z2))) / 2"
    features = {0: t(0), 3: t(3), 6: f"{t(3)} - {t(1)}", 9: f"{t(3)} - {t(5)}"}
    return """WITH l AS (SELECT *, l_extendedprice / 1000.0 AS r, (l_orderkey % 7 - 3) / 10.0 AS z1, (l_partkey % 5 - 2) / 10.0 AS z2, l_discount < 0.09 AS seen, l_discount < 0.09 AND l_quantity * 1.5 <= 70 AND l_tax * 900.0 <= 70 AS inside FROM lineitem)
SELECT l_returnflag, count(*) FILTER (inside) AS overlapping, count(*) FILTER (seen) AS legacy, """ + ", ".join(f"round(avg({e}) FILTER (inside), 4) AS f{i}" for i, e in features.items()) + " FROM l GROUP BY 1"


OVERLAP = _overlap_sql()


def choice_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day one-choice variants of a flux against the nominal one: another shape, regression, label and precision, in one pass."""
    angle = F.col("l_quantity") * 1.3
    df = table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), angle.alias("angle"), (F.col("l_extendedprice") / 300.0 + 40.0).alias("l"), F.col("l_returnflag").alias("scene"), "l_tax")
    shape = lambda b: F.lit(physics.angular_integral([b])) / physics.radiance_shape(F.col("angle"), [F.lit(b)])
    nominal = F.when(F.col("l_tax") < 0.08, F.col("l") * shape(-0.2))
    variants = {
        "shape": F.when(F.col("l_tax") < 0.08, F.col("l") * shape(-0.3)), "regression": F.when(F.col("l_tax") < 0.07, 1.5 + 0.99 * F.col("l") * shape(-0.2)),
        "label": F.col("l") * F.when(F.col("scene") == "R", shape(-0.1)).otherwise(shape(-0.2)), "identity": nominal,
    }
    out = moments.variant_summaries(df, ["month"], nominal, variants, nominal)
    return out.select("month", "variant", "n", "lost", "gained", *[F.round(c, 5).alias(c) for c in ("mean", "sd", "rmse", "rmse_percent")])


def _variants_sql() -> str:
    shape = lambda b: f"({physics.angular_integral([b])!r} / (1 + {b!r} * (ln(cos(radians(angle)) + 2.0) / {math.log(math.cos(math.radians(55.0)) + 2.0)!r} - 1)))"
    variants = {
        "shape": f"CASE WHEN l_tax < 0.08 THEN l * {shape(-0.3)} END", "regression": f"CASE WHEN l_tax < 0.07 THEN 1.5 + 0.99 * l * {shape(-0.2)} END",
        "label": f"l * CASE WHEN l_returnflag = 'R' THEN {shape(-0.1)} ELSE {shape(-0.2)} END", "identity": f"CASE WHEN l_tax < 0.08 THEN l * {shape(-0.2)} END",
    }
    each = " UNION ALL ".join(f"SELECT month, '{n}' AS variant, {e} AS v, b FROM d" for n, e in variants.items())
    return f"""WITH p AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, l_quantity * 1.3 AS angle, l_extendedprice / 300.0 + 40.0 AS l, l_returnflag, l_tax FROM lineitem),
d AS (SELECT *, CASE WHEN l_tax < 0.08 THEN l * {shape(-0.2)} END AS b FROM p), v AS ({each})
SELECT month, variant, count(v - b) AS n, count(*) FILTER (b IS NOT NULL AND v IS NULL) AS lost, count(*) FILTER (b IS NULL AND v IS NOT NULL) AS gained, round(avg(v - b), 5) AS mean, round(stddev_samp(v - b), 5) AS sd,
  round(sqrt(avg(pow(v - b, 2))), 5) AS rmse, round(sqrt(avg(pow(100 * (v - b) / CASE WHEN b > 0 THEN b END, 2))), 5) AS rmse_percent FROM v GROUP BY 1, 2"""


VARIANTS = _variants_sql()


def _basis_integrals(points: int = 901) -> list[float]:
    """Twice the integral of each basis function, cosine and sine over the hemisphere, by Simpson's rule."""
    step, grid = math.pi / 2 / (points - 1), hemisphere(points)
    weights = [(1 if k in (0, points - 1) else 4 if k % 2 else 2) * 2 * math.cos(k * step) * math.sin(k * step) for k in range(points)]
    return [float(sum(w * g for w, g in zip(weights, grid[:, c], strict=True))) * step / 3 for c in (0, 1)]


INTEGRALS = _basis_integrals()


def noisy_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sets of views, two forms, one clean and two noisy realizations: errors of retrieved fluxes and cases that can't be told apart."""
    basis = physics.angular_basis(F.col("l_linenumber") * 10.0 - 5.0, True)
    amplitude = 40.0 + F.col("l_orderkey") % 50
    radiance = amplitude * (1.0 - 0.2 * basis[0] + 0.1 * basis[1])
    truth = F.lit(math.pi) * amplitude * (1.0 - 0.2 * INTEGRALS[0] + 0.1 * INTEGRALS[1])
    noise = [(lattice(F.col("l_orderkey"), F.col("l_linenumber"), k) - 0.5) * 2.0 for k in (1, 2)]
    df = table(spark, sf_dir, "lineitem")
    out = retrieval.noisy_geometry_study(df, "l_orderkey", "l_linenumber", GEOMETRIES, basis, radiance, INTEGRALS, truth, noise)
    return out.select("geometry", "form", F.col("realization").cast("long").alias("realization"), "cases", "unidentifiable", (F.round("bias", 4) + 0.0).alias("bias"), F.round("rmse", 4).alias("rmse"))


def _geometry_sql() -> str:
    views = ", ".join(f"('{name}', {v})" for name, held in GEOMETRIES.items() for v in held)
    base, square = math.log(math.cos(math.radians(55.0)) + 2.0), math.cos(math.radians(55.0)) ** 2
    draws = [_lattice("l_orderkey", "l_linenumber", str(k)) for k in (1, 2)]
    return f"""WITH g(geometry, view) AS (VALUES {views}),
b AS (SELECT l_orderkey AS k, l_linenumber AS v, ln(cos(radians(l_linenumber * 10.0 - 5.0)) + 2.0) / {base!r} - 1 AS x, pow(cos(radians(l_linenumber * 10.0 - 5.0)), 2) - {square!r} AS y, 40.0 + l_orderkey % 50 AS a, {draws[0]} AS u1, {draws[1]} AS u2 FROM lineitem),
r AS (SELECT k, v, x, y, pi() * a * {1.0 - 0.2 * INTEGRALS[0] + 0.1 * INTEGRALS[1]!r} AS t, unnest([0, 1, 2]) AS realization, unnest([a * (1 - 0.2 * x + 0.1 * y), a * (1 - 0.2 * x + 0.1 * y) + (u1 - 0.5) * 2, a * (1 - 0.2 * x + 0.1 * y) + (u2 - 0.5) * 2]) AS l FROM b),
s AS (SELECT geometry, realization, k, max(t) AS t, avg(x) AS mx, avg(y) AS my, avg(l) AS ml, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, l) AS xl, covar_pop(y, l) AS yl FROM r JOIN g ON view = v GROUP BY 1, 2, 3),
f AS (SELECT geometry, realization, 1 AS form, CASE WHEN xx > 1e-12 THEN pi() * (ml + xl / xx * ({INTEGRALS[0]!r} - mx)) END - t AS e FROM s
  UNION ALL SELECT geometry, realization, 2, CASE WHEN xx * yy - xy * xy > 1e-6 * xx * yy THEN pi() * (ml + (xl * yy - yl * xy) / (xx * yy - xy * xy) * ({INTEGRALS[0]!r} - mx) + (yl * xx - xl * xy) / (xx * yy - xy * xy) * ({INTEGRALS[1]!r} - my)) END - t FROM s)
SELECT geometry, form::INTEGER AS form, realization::BIGINT AS realization, count(*) AS cases, count(*) FILTER (e IS NULL) AS unidentifiable, round(avg(e), 4) + 0.0 AS bias, round(sqrt(avg(e * e)), 4) AS rmse FROM f GROUP BY 1, 2, 3"""


NOISY_GEOMETRY = _geometry_sql()


def population_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How consistently users' events have one type."""
    files = scenes.majority(table(spark, sf_dir, "events"), "user_id", "event_type", F.col("value"))
    out = scenes.population_report(files, "event_type", "vote_fraction")
    return out.select("event_type", "files", *[F.round(c, 4).alias(c) for c in ("mean_consistency", "median_consistency", "fully_consistent")])


POPULATION_REPORT = """WITH v AS (SELECT user_id, event_type, count(*) AS votes, avg(value) AS m FROM events GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, m DESC, event_type) AS k, 100.0 * votes / sum(votes) OVER (PARTITION BY user_id) AS c FROM v)
SELECT event_type, count(*) AS files, round(avg(c), 4) AS mean_consistency, round(quantile_cont(c, 0.5), 4) AS median_consistency, round(100.0 * avg(CASE WHEN c >= 100 THEN 1 ELSE 0 END), 4) AS fully_consistent FROM k WHERE k = 1 GROUP BY 1"""


def classification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, confidence and rare rows of a labelling, overall and by label of the vectors."""
    e = F.col("embedding")
    df = table(spark, sf_dir, "embeddings").select(F.coalesce(F.col("label").cast("string"), F.lit("none")).alias("kind"), (F.col("vec_id") % 4).cast("int").alias("scene"), *[e[i].cast("double").alias(f"f{i}") for i in range(3)])
    out = scenes.classification_summary(df, ["kind"], "scene", ["f0", "f1", "f2"], F.array(F.abs("f0"), F.abs("f1")), F.col("f2"), 0.0)
    return out.select("set_id", "kind", "scene", "n", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("set_id", "kind", "scene", "n")])


CLASSIFICATION = """WITH e AS (SELECT coalesce(label::VARCHAR, 'none') AS kind, (vec_id % 4)::INTEGER AS scene, embedding[1]::DOUBLE AS f0, embedding[2]::DOUBLE AS f1, embedding[3]::DOUBLE AS f2 FROM embeddings),
g AS (SELECT grouping(kind, scene)::BIGINT AS set_id, kind, scene, count(*) AS n, avg(greatest(abs(f0), abs(f1))) AS posterior, avg(CASE WHEN f2 < 0 THEN 1.0 ELSE 0.0 END) AS below,
  avg(f0) AS f0_mean, stddev_samp(f0) AS f0_sd, avg(f1) AS f1_mean, stddev_samp(f1) AS f1_sd, avg(f2) AS f2_mean, stddev_samp(f2) AS f2_sd FROM e GROUP BY GROUPING SETS ((scene), (kind, scene)))
SELECT set_id, kind, scene, n, round(posterior, 6) AS posterior, round(below, 6) AS below, round(f0_mean, 6) AS f0_mean, round(f0_sd, 6) AS f0_sd, round(f1_mean, 6) AS f1_mean, round(f1_sd, 6) AS f1_sd, round(f2_mean, 6) AS f2_mean, round(f2_sd, 6) AS f2_sd,
  round(n / sum(n) OVER (PARTITION BY set_id, kind), 6) AS share FROM g"""


def centroid_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the daily centroids of event types lie from their mean."""
    e = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", F.col("value").alias("a"), (F.col("user_id") % 10).cast("double").alias("b"))
    out = scenes.centroid_shift(e, "day", "event_type", ["a", "b"])
    return out.select("event_type", "groups", F.round("shift", 6).alias("shift"))


CENTROID_SHIFT = """WITH c AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, avg(value) AS a, avg((user_id % 10)::DOUBLE) AS b FROM events GROUP BY 1, 2), m AS (SELECT event_type, avg(a) AS ma, avg(b) AS mb FROM c GROUP BY 1)
SELECT event_type, count(*) AS "groups", round(avg(sqrt(pow(a - ma, 2) + pow(b - mb, 2))), 6) AS "shift" FROM c JOIN m USING (event_type) GROUP BY 1"""


def residual_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals written as CSV, read with their schema, and one setting's terms selected."""
    path = shared_folder(spark, "residuals")
    s = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), F.col("s_nationkey")).alias("scenario"), F.lit("goal").alias("mode"), F.when(F.col("s_suppkey") % 2 == 0, "n2bc_only").otherwise("end_to_end").alias("stage"), (F.col("s_suppkey") % 3 + 1).cast("int").alias("degree"),
        F.col("s_suppkey").cast("int").alias("scene_index"), F.lit("clear").alias("regime"), (F.col("s_nationkey") % 5).cast("int").alias("abi_scene"), F.lit(0).alias("fold"), F.lit(1.0).alias("weight"), F.col("s_acctbal").alias("truth"), (F.col("s_acctbal") * 0.01).alias("residual"),
    )
    records.write_residuals(s, path)
    out = records.residuals(spark, path, stage="n2bc_only", degree=3)
    return out.groupBy("abi_scene").agg(F.count("*").alias("n"), F.round(F.avg("residual"), 5).alias("mean"))


RESIDUAL_SCAN = "SELECT (s_nationkey % 5)::INTEGER AS abi_scene, count(*) AS n, round(avg(s_acctbal * 0.01), 5) AS mean FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 = 2 GROUP BY 1"

BOUNDS = (-0.4, 0.6)


def constrained_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a case, its line items are views; shapes stay within bounds."""
    df = table(spark, sf_dir, "lineitem")
    out = fits.view_retrieval(df, ["l_orderkey"], F.col("l_quantity") / 50.0 - 0.5, F.col("l_extendedprice") / 1000.0, 0.1, BOUNDS)
    return out.select("l_orderkey", "views", "constrained", *[F.round(c, 4).alias(c) for c in ("amplitude", "b", "flux")])


CONSTRAINED = f"""WITH v AS (SELECT l_orderkey, l_quantity / 50.0 - 0.5 AS x, l_extendedprice / 1000.0 AS y FROM lineitem),
s AS (SELECT l_orderkey, count(*) AS n, CASE WHEN var_pop(x) > 0 THEN regr_intercept(y, x) END AS a, CASE WHEN var_pop(x) > 0 THEN regr_slope(y, x) END AS s, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy FROM v GROUP BY 1),
c AS (SELECT *, s IS NOT NULL AND (a <= 0 OR s / a < {BOUNDS[0]} OR s / a > {BOUNDS[1]}) AS c, pow(sy + {BOUNDS[0]} * sxy, 2) / (n + 2 * {BOUNDS[0]} * sx + {BOUNDS[0] ** 2!r} * sxx) >= pow(sy + {BOUNDS[1]} * sxy, 2) / (n + 2 * {BOUNDS[1]} * sx + {BOUNDS[1] ** 2!r} * sxx) AS low FROM s),
f AS (SELECT *, CASE WHEN NOT c THEN s / a WHEN low THEN {BOUNDS[0]} ELSE {BOUNDS[1]} END AS b FROM c),
g AS (SELECT *, CASE WHEN NOT c THEN a ELSE (sy + b * sxy) / (n + 2 * b * sx + b * b * sxx) END AS amplitude FROM f)
SELECT l_orderkey, n AS views, c AS constrained, round(amplitude, 4) AS amplitude, round(b, 4) AS b, round(pi() * amplitude * (1 + 0.1 * b), 4) AS flux FROM g"""


VIEWS = (10.0, 25.0, 40.0, 55.0, 65.0)


def normalised_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer is a case with five views, one of them at the reference angle."""
    views = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.explode(F.array(*map(F.lit, VIEWS))).alias("angle"))
    basis = physics.limb(F.col("angle")) - 1.0
    radiance = (40.0 + F.col("c_acctbal") / 1000.0) * (1.0 + (F.col("c_custkey") % 11 / 10.0 - 0.7) * basis) + F.col("c_custkey") * F.col("angle").cast("int") % 13 / 10.0
    out = fits.normalised_retrieval(views, ["c_custkey"], F.col("angle"), basis, radiance, 0.03)
    return out.select("c_custkey", "views", *[F.round(c, 4).alias(c) for c in ("b", "flux")], F.round("rms_percent", 3).alias("rms_percent"))


NORMALISED = f"""WITH v AS (SELECT c_custkey, a, CASE WHEN a = 55 THEN 0 ELSE ln(cos(radians(a)) + 2.0) / {math.log(math.cos(math.radians(55.0)) + 2.0)!r} - 1 END AS x, c_acctbal FROM customer, (VALUES """ + ", ".join(f"({a}::DOUBLE)" for a in VIEWS) + """) AS t(a)),
y AS (SELECT *, (40.0 + c_acctbal / 1000.0) * (1.0 + (c_custkey % 11 / 10.0 - 0.7) * x) + c_custkey * a::INTEGER % 13 / 10.0 AS y FROM v), n AS (SELECT c_custkey, y AS l FROM y WHERE a = 55),
s AS (SELECT c_custkey, count(*) AS n, any_value(l) AS l, sum(x * (y / l - 1)) / sum(x * x) AS b FROM y JOIN n USING (c_custkey) GROUP BY 1)
SELECT c_custkey, any_value(n) AS views, round(any_value(b), 4) AS b, round(any_value(pi() * l * (1 + 0.03 * b)), 4) AS flux, round(100 * sqrt(avg(pow(y / l - 1 - b * x, 2))), 3) AS rms_percent FROM y JOIN s USING (c_custkey) GROUP BY 1"""


def shape_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How shapes of twelve monthly libraries spread, by channel, scene and angle."""
    o = table(spark, sf_dir, "orders").groupBy(F.month("o_orderdate").alias("month"), F.col("o_orderpriority").alias("channel"), (F.col("o_orderkey") % 3).alias("scene"))
    library = o.agg((F.avg("o_totalprice") / 1e6 - 0.3).alias("b")).withColumn("norm", 1.0 / (1.0 + 0.05 * F.col("b")))
    out = scenes.shape_spread(library, "month", ["channel", "scene"], "b", "norm", 12, (0.0, 30.0, 60.0))
    return out.select("channel", "scene", "angle", "days", *[F.round(c, 7).alias(c) for c in out.columns[4:]])


SHAPE_SPREAD = f"""WITH l AS (SELECT month(o_orderdate) AS m, o_orderpriority AS channel, o_orderkey % 3 AS scene, avg(o_totalprice) / 1e6 - 0.3 AS b FROM orders GROUP BY 1, 2, 3),
a(angle) AS (VALUES (0.0::DOUBLE), (30.0), (60.0)), s AS (SELECT *, 1 + b * (ln(cos(radians(angle)) + 2.0) / {math.log(math.cos(math.radians(55.0)) + 2.0)!r} - 1) AS s, 1 / (1 + 0.05 * b) AS n FROM l, a)
SELECT channel, scene, angle, count(*) AS days, round(avg(b), 7) AS mean, round(stddev_samp(b), 7) AS sd, round(min(b), 7) AS low, round(max(b), 7) AS high, round(stddev_samp(n), 7) AS norm_sd,
  round(avg(s), 7) AS "shape", round(stddev_samp(s), 7) AS shape_sd, round(stddev_samp(s) / avg(s), 7) AS relative, round(2 * stddev_samp(s) / avg(s), 7) AS relative2 FROM s GROUP BY 1, 2, 3"""

def held_out_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items predicted by the other folds under four one-choice variants; a regime of one fold alone has no prediction by regime."""
    regime = F.when(F.col("l_orderkey") % 5 == 2, F.when(F.col("l_linenumber") == 7, "rare").otherwise(F.col("l_returnflag"))).otherwise(F.col("l_returnflag"))
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax", regime.alias("regime"), (F.col("l_orderkey") % 5).alias("fold"), (1.0 + F.col("l_discount")).alias("w"))
    x, tax = F.col("l_quantity"), F.col("l_tax")
    wanted = [variants.Variant("nominal", [x]), variants.Variant("other input", [x * (1.0 + tax)]), variants.Variant("by regime", [x], regime=F.col("regime")), variants.Variant("positive", [F.when(tax > 0, F.log(x) * 10.0)])]
    keys = ["l_orderkey", "l_linenumber"]
    out = variants.held_out_variants(df, keys, wanted, F.col("l_extendedprice") / 100.0, F.col("w"), F.col("fold"), 5)
    return out.select(*keys, F.col("fold").cast("int").alias("fold"), "variant", "supported", F.round("prediction", 4).alias("prediction"), F.round("residual", 4).alias("residual"))


_SUMS = ", ".join(f"sum({e}) AS {n}" for n, e in (("n", "1"), ("w", "w"), ("x", "w * x"), ("y", "w * y"), ("xx", "w * x * x"), ("xy", "w * x * y")))
HELD_OUT_VARIANTS = f"""WITH c AS (SELECT l_orderkey, l_linenumber, (l_orderkey % 5)::INTEGER AS fold, 1.0 + l_discount AS w, l_extendedprice / 100.0 AS y, l_quantity AS q, l_tax AS t,
  CASE WHEN l_orderkey % 5 = 2 AND l_linenumber = 7 THEN 'rare' ELSE l_returnflag END AS regime FROM lineitem),
v AS (SELECT *, 'nominal' AS variant, 'all' AS g, q - 25.0 AS x FROM c UNION ALL SELECT *, 'other input', 'all', q * (1.0 + t) - 25.0 FROM c UNION ALL SELECT *, 'by regime', regime, q - 25.0 FROM c
  UNION ALL SELECT *, 'positive', 'all', CASE WHEN t > 0 THEN ln(q) * 10.0 - 25.0 END FROM c),
s AS (SELECT variant, g, fold, {_SUMS} FROM v WHERE x IS NOT NULL GROUP BY 1, 2, 3),
k AS (SELECT f.fold, s.variant, s.g, sum(n) AS n, sum(w) AS w, sum(x) AS x, sum(y) AS y, sum(xx) AS xx, sum(xy) AS xy FROM s, (SELECT unnest(range(5))::INTEGER AS fold) f WHERE s.fold <> f.fold GROUP BY 1, 2, 3),
m AS (SELECT *, (w * xy - x * y) / (w * xx - x * x) AS slope FROM k WHERE n >= 2)
SELECT l_orderkey, l_linenumber, v.fold, v.variant, coalesce(m.slope IS NOT NULL AND v.x IS NOT NULL, false) AS supported, round((m.y - m.slope * m.x) / m.w + m.slope * v.x, 4) AS prediction,
  round((m.y - m.slope * m.x) / m.w + m.slope * v.x - v.y, 4) AS residual FROM v LEFT JOIN m ON m.fold = v.fold AND m.variant = v.variant AND m.g = v.g"""


QUERIES = {
    "held_out_variants": (held_out_variants, HELD_OUT_VARIANTS),
    "stage_assessment": (stage_assessment, STAGE_ASSESSMENT),
    "chain_covariance": (chain_covariance, CHAIN_COVARIANCE),
    "scene_residuals": (scene_residuals, SCENE_RESIDUALS),
    "nominal_budget": (nominal_budget, NOMINAL_BUDGET),
    "budget_closure": (budget_closure, BUDGET_CLOSURE),
    "overlap_features": (overlap_features, OVERLAP),
    "choice_variants": (choice_variants, VARIANTS),
    "constrained_retrieval": (constrained_retrieval, CONSTRAINED),
    "normalised_retrieval": (normalised_retrieval, NORMALISED),
    "shape_spread": (shape_spread, SHAPE_SPREAD),
    "noisy_geometry": (noisy_geometry, NOISY_GEOMETRY),
    "population_report": (population_report, POPULATION_REPORT),
    "classification_summary": (classification_summary, CLASSIFICATION),
    "centroid_shift": (centroid_shift, CENTROID_SHIFT),
    "residual_scan": (residual_scan, RESIDUAL_SCAN),
}
