"""Fits over the driver's tables. Where SQL can't iterate, tests hold them against direct solutions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermalake.functions import physics
from thermalake.functions.numbers import rounded
from thermalake.functions.rng import normal, passed, uniform
from thermalake.operators import fits, grid, labelers, moments, sampling, scenes, weighted
from thermalake.sources.tables import table


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[e[i].cast("double").alias(f"f{i}") for i in range(4)])


def mixture_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and means of a mixture fitted to every row, the best of five starts."""
    df = _features(spark, sf_dir)
    m = fits.mixture(df, [F.col("f0"), F.col("f1")], 3)
    rows = [(int(i), float(m["weight"][i]), *map(float, m["mean"][i]), float(m["loglik"]), m["rounds"]) for i in m["mean"][:, 0].argsort()]
    return spark.createDataFrame(rows, "component int, weight double, mean0 double, mean1 double, loglik double, rounds int")


OFFSETS = (0.0, 1e3, 1e6)


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three clusters far from each other, made of keys."""
    k = F.col("o_orderkey") % 7
    place = F.when(k < 4, 0).when(k < 6, 1).otherwise(2)
    x = place * 18.0 + F.col("o_custkey") % 10 / 10.0
    return table(spark, sf_dir, "orders").select(place.alias("place"), x.alias("x"), (place * place - 2.0 * place + F.col("o_totalprice") / 100000.0).alias("y"))


def mixture_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same clusters are found wherever they lie; weights, means and variances of each."""
    df, rows = _clusters(spark, sf_dir), []
    for offset in OFFSETS:
        m = fits.mixture(df, [F.col("x") + offset, F.col("y")], 3)
        for place, i in enumerate(m["mean"][:, 0].argsort()):
            rows.append((offset, place, round(float(m["weight"][i]), 6), round(float(m["mean"][i, 0]) - offset, 4), round(float(m["mean"][i, 1]), 4), round(float(m["covariance"][i, 0, 0]), 4)))
    return spark.createDataFrame(rows, "offset double, component int, weight double, mean0 double, mean1 double, variance0 double")


MIXTURE_OFFSETS = """WITH c AS (SELECT CASE WHEN o_orderkey % 7 < 4 THEN 0 WHEN o_orderkey % 7 < 6 THEN 1 ELSE 2 END AS k, o_custkey % 10 / 10.0 AS j, o_totalprice / 100000.0 AS p FROM orders),
o(v) AS (VALUES """ + ", ".join(f"({v!r}::DOUBLE)" for v in OFFSETS) + """)
SELECT v AS "offset", k::INTEGER AS component, round(count(*) / (SELECT count(*) FROM orders), 6) AS weight, round(avg(k * 18.0 + j), 4) AS mean0, round(avg(k * k - 2.0 * k + p), 4) AS mean1,
  round(var_pop(j) + 1e-6, 4) AS variance0 FROM c, o GROUP BY v, k"""


def mixture_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best start for each number of components with its criteria, and which one the information criterion chooses."""
    df = _clusters(spark, sf_dir)
    got = fits.candidates(df, [F.col("x"), F.col("y")], (1, 3), least_rows=10)
    best = min(got, key=lambda c: c["bic"])["k"]
    rows = [(c["k"], c["n"], round(c["loglik"] / c["n"], 5), round(c["entropy"], 3), c["ambiguous"], c["k"] == best, c["icl"] >= c["bic"]) for c in got]
    return spark.createDataFrame(rows, "k int, n long, loglik double, entropy double, ambiguous long, chosen boolean, ordered boolean")


def mixture_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to four components over clusters that overlap, all fitted in the same passes: criteria of each and the choice of both."""
    df = _clusters(spark, sf_dir).withColumn("x", F.col("x") / 12.0)
    got = fits.candidates(df, [F.col("x"), F.col("y")], (1, 2, 3, 4), least_rows=10)
    best = {c: min(got, key=lambda g: g[c])["k"] for c in ("bic", "icl")}  # noqa: B023
    rows = [(c["k"], c["n"], *(round(c[v], 3) for v in ("loglik", "entropy", "bic", "icl")), c["ambiguous"], min(c["rows"]), c["k"] == best["bic"], c["k"] == best["icl"]) for c in got]
    return spark.createDataFrame(rows, "k int, n long, loglik double, entropy double, bic double, icl double, ambiguous long, least_rows int, chosen_bic boolean, chosen_icl boolean")


def refit_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a mixture against those of its refits to ten resamplings: agreement, matched overlap of each label, and the worst and the spread over all."""
    df = _clusters(spark, sf_dir).withColumn("x", F.col("x") / 12.0)
    columns = [F.col("x"), F.col("y")]
    m = fits.mixture(df, columns, 3)
    labelled = labelers.labelled(df, columns, {"label": labelers.MixtureLabeler(m["weight"], m["mean"], m["covariance"])})
    got = fits.refit_stability(labelled, columns, F.col("label"), 3, replicates=10)
    ari = np.array([g["ari"] for g in got])
    rows = [(g["replicate"], g["ari"], g["jaccard"], g["least"], g["converged"], float(ari.min()), float(ari.std())) for g in got]
    return spark.createDataFrame(rows, "replicate int, ari double, jaccard array<double>, least double, converged boolean, worst_ari double, sd_ari double")


def labelled_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by what three labelers say: a mixture as expressions, the same mixture as a model of batches, and thresholds of batches."""
    df = _clusters(spark, sf_dir).withColumn("x", F.when(F.col("y") < 4.5, F.col("x")))
    # a mixture of known parameters, so that the labels can be stated in SQL
    weight, mean, cov = np.array([0.5, 0.3, 0.2]), np.array([[0.5, 0.0], [18.5, 0.0], [36.5, 0.0]]), np.stack([np.diag([4.0, 9.0])] * 3)
    cuts = np.array([9.5, 27.5])
    found = labelers.labelled(
        df,
        [F.col("x"), F.col("y")],
        {
            "mixture": labelers.MixtureLabeler(weight, mean, cov),
            "batches": labelers.ModelLabeler(lambda x: fits.log_densities(x, weight, mean, cov).argmax(1), 3, "mixture"),
            "thresholds": labelers.ModelLabeler(lambda x: np.searchsorted(cuts, x[:, 0]), 3, "thresholds"),
        },
    )
    return found.groupBy("place", "mixture", "batches", "thresholds").agg(F.count("*").alias("n"))


LABELLED_SCENES = """WITH c AS (SELECT CASE WHEN o_orderkey % 7 < 4 THEN 0 WHEN o_orderkey % 7 < 6 THEN 1 ELSE 2 END AS place, o_totalprice / 100000.0 AS p FROM orders)
SELECT place::INTEGER AS place, CASE WHEN place * place - 2.0 * place + p < 4.5 THEN place::INTEGER END AS mixture, CASE WHEN place * place - 2.0 * place + p < 4.5 THEN place::INTEGER END AS batches,
CASE WHEN place * place - 2.0 * place + p < 4.5 THEN place::INTEGER END AS thresholds, count(*) AS n FROM c GROUP BY 1, 2, 3, 4"""

_CLUSTERS = """c AS (SELECT CASE WHEN o_orderkey % 7 < 4 THEN 0 WHEN o_orderkey % 7 < 6 THEN 1 ELSE 2 END AS k, o_custkey % 10 / 10.0 AS j, o_totalprice / 100000.0 AS p FROM orders),
r AS (SELECT k, k * 18.0 + j AS x, k * k - 2.0 * k + p AS y FROM c)"""
_LEVEL = "ln({share}) - ln(2 * pi()) - ln((var_pop(x) + 1e-6) * (var_pop(y) + 1e-6) - pow(covar_pop(x, y), 2)) / 2 - ((var_pop(x) * (var_pop(y) + 1e-6) + var_pop(y) * (var_pop(x) + 1e-6) - 2 * pow(covar_pop(x, y), 2)) / ((var_pop(x) + 1e-6) * (var_pop(y) + 1e-6) - pow(covar_pop(x, y), 2))) / 2"
MIXTURE_CANDIDATES = f"""WITH {_CLUSTERS}, n AS (SELECT count(*) AS n FROM r),
g AS (SELECT k, count(*) AS m, {_LEVEL.format(share="count(*) / (SELECT n FROM n)")} AS level FROM r GROUP BY k)
SELECT 1::INTEGER AS k, count(*) AS n, round({_LEVEL.format(share="1.0")}, 5) AS loglik, 0.0::DOUBLE AS entropy, 0::BIGINT AS ambiguous, false AS chosen, true AS ordered FROM r
UNION ALL SELECT 3, (SELECT n FROM n), round(sum(m * level) / (SELECT n FROM n), 5), 0.0, 0, true, true FROM g"""


def principal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores on the axes that hold over 98 % of the standardised variance."""
    df = _features(spark, sf_dir)
    names = [f"f{i}" for i in range(4)]
    mean, scale, cov = fits.standardise(moments.scatter(df, {n: F.col(n) for n in names}).collect(), names)
    axes, _ = fits.principal_axes(cov, scale)
    score = lambda axis: sum(((F.col(n) - float(m)) / float(s) * float(a) for n, m, s, a in zip(names, mean, scale, axis, strict=True)), F.lit(0.0))
    return df.select("vec_id", *[F.round(score(a), 6).alias(f"z{i}") for i, a in enumerate(axes)])


#: Shape parameters from the whole range in which shapes are positive, by line number; the last group has a null key.
TRUE_SHAPES = (0.0, -0.3, 0.3, -0.6, 1.0, 1.5, -2.0)


def shape_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovers the shapes that the ratios were made with."""
    first, second = F.col("l_quantity") * 1.3, F.col("l_tax") * 800.0
    p, q = physics.limb(first) - 1.0, physics.limb(second) - 1.0
    b = F.element_at(F.array(*[F.lit(v) for v in TRUE_SHAPES]), F.col("l_linenumber"))
    df = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") < 7, F.col("l_linenumber")).alias("scene"), first.alias("first"), second.alias("second"), p.alias("p"), q.alias("q"), b.alias("true"))
    ratio = (1.0 + F.col("true") * F.col("p")) / (1.0 + F.col("true") * F.col("q"))
    out = fits.shape_parameters(df, ["scene"], F.col("p"), F.col("q"), ratio, angles=(F.col("first"), F.col("second")))
    return out.select("scene", "n", F.round("b", 6).alias("b"), F.round("rmse", 6).alias("rmse"), "support")


SHAPE_LIBRARY = f"""WITH l AS (SELECT CASE WHEN l_linenumber < 7 THEN l_linenumber END AS scene, ([{', '.join(f'{v!r}::DOUBLE' for v in TRUE_SHAPES)}])[l_linenumber] AS b FROM lineitem)
SELECT scene, count(*) AS n, CASE WHEN count(*) >= 100 THEN avg(b) END AS b, CASE WHEN count(*) >= 100 THEN 0.0::DOUBLE END AS rmse, CASE WHEN count(*) >= 100 THEN 'ok' ELSE 'too few pairs' END AS support FROM l GROUP BY 1"""


def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    c = fits.least_squares(df, [F.col("l_quantity")], F.col("l_extendedprice"))
    return spark.createDataFrame([(round(float(c[0]), 3), round(float(c[1]), 5))], "intercept double, slope double")


REGRESSION = "SELECT round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope FROM lineitem"

#: Temperatures in Kelvin made of measures, and their exact polynomials of degree 1 to 3.
TEMPERATURES = ("220.0 + l_quantity * 1.5", "230.0 + l_discount * 500.0", "240.0 + l_tax * 700.0", "225.0 + l_extendedprice / 1500.0", "221.0 + l_suppkey % 53", "250.0 + l_partkey % 41")
_T = [f"({t})" for t in TEMPERATURES]
EXACT = {
    1: f"(3.0 + 0.2 * {_T[0]} - 0.1 * {_T[1]} + 0.3 * {_T[2]} + 0.25 * {_T[3]} + 0.15 * {_T[4]} + 0.2 * {_T[5]})",
    2: f"(0.002 * {_T[0]} * {_T[1]} - 0.001 * {_T[3]} * {_T[3]} + 0.4 * {_T[4]} - 0.0015 * {_T[2]} * {_T[5]})",
    3: f"(0.00001 * {_T[0]} * {_T[1]} * {_T[2]} - 0.00002 * {_T[3]} * {_T[3]} * {_T[5]} + 0.003 * {_T[4]} * {_T[0]} - {_T[2]})",
}


def temperature_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regressions of degree 1 to 3 in raw temperatures find exact polynomials: mean predictions per flag, and whether all are within a millionth of a spread."""
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", *[F.expr(t).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)], *[F.expr(e).alias(f"y{d}") for d, e in EXACT.items()])
    values, out = [F.col(f"t{i}") for i in range(6)], []
    for degree, fit in fits.fit_polynomials(df, values, {d: F.col(f"y{d}") for d in EXACT}).items():
        y = F.col(f"y{degree}")
        got = df.select("l_returnflag", y.alias("y"), fit.column(values).alias("p")).groupBy("l_returnflag")
        got = got.agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.max(F.abs(F.col("p") - F.col("y"))).alias("far"), F.stddev_pop("y").alias("sd"))
        out.append(got.select(F.lit(degree).alias("degree"), "l_returnflag", "n", F.round("p", 5).alias("prediction"), (F.col("far") < 1e-6 * F.col("sd")).alias("exact")))
    return out[0].unionByName(out[1]).unionByName(out[2])


TEMPERATURE_REGRESSIONS = " UNION ALL ".join(f"SELECT {d}::INTEGER AS degree, l_returnflag, count(*) AS n, round(avg({e}), 5) AS prediction, true AS exact FROM lineitem GROUP BY 2" for d, e in EXACT.items())


def robust_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100 / 10.0).alias("x"), "o_orderkey")
    df = df.withColumn("y", 2.0 + 3.0 * F.col("x") + normal(5, "o_orderkey") * 0.1 + F.when(F.col("o_orderkey") % 20 == 0, 500.0).otherwise(0.0))
    c = fits.huber(df, [F.col("x")], F.col("y"), F.lit(1.0))
    return spark.createDataFrame([(float(c[0]), float(c[1]))], "intercept double, slope double")


def view_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a case, its line items are views."""
    df = table(spark, sf_dir, "lineitem").withColumn("basis", F.col("l_quantity") / 50.0 - 1.0)
    out = fits.view_retrieval(df, ["l_orderkey"], F.col("basis"), F.col("l_extendedprice") / 1000.0, 0.1)
    return out.filter("views >= 3").select("l_orderkey", "views", F.round("amplitude", 4).alias("amplitude"), F.round("flux", 4).alias("flux"))


VIEW_RETRIEVAL = """WITH v AS (SELECT l_orderkey, l_quantity / 50.0 - 1.0 AS b, l_extendedprice / 1000.0 AS r FROM lineitem)
SELECT l_orderkey, count(*) AS views, round(regr_intercept(r, b), 4) AS amplitude, round(pi() * (regr_intercept(r, b) + 0.1 * regr_slope(r, b)), 4) AS flux FROM v GROUP BY 1 HAVING count(*) >= 3"""


def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits.group_folds(table(spark, sf_dir, "orders"), "o_custkey", 5)


GROUP_FOLDS = """WITH RECURSIVE s AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1),
g AS (SELECT *, row_number() OVER (ORDER BY size DESC, o_custkey) AS i FROM s),
r AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS loads, NULL::INTEGER AS fold
  UNION ALL SELECT g.i, [loads[k] + CASE WHEN k = list_position(loads, list_min(loads)) THEN size ELSE 0 END FOR k IN range(1, 6)], (list_position(loads, list_min(loads)) - 1)::INTEGER FROM r JOIN g ON g.i = r.i + 1)
SELECT o_custkey, size, fold FROM r JOIN g USING (i)"""


def lattice(*keys: Column | int) -> Column:
    """A draw in [0, 1) by arithmetic that SQL can repeat; the library's own draws are hashes."""
    total = F.lit(0)
    for i, k in enumerate(keys):
        total = total + (k if isinstance(k, Column) else F.lit(k)) * (48271 + 20610 * i)
    mixed = F.pmod(total * 69621 + 12345, F.lit(2147483647))
    return F.pmod(F.pmod(mixed * mixed, F.lit(2147483629)) * 16807, F.lit(2147483647)) / F.lit(2147483647.0)


def _lattice(*keys: str) -> str:
    total = " + ".join(f"{k} * {48271 + 20610 * i}" for i, k in enumerate(keys))
    mixed = f"((({total}) * 69621 + 12345) % 2147483647)"
    return f"(((({mixed} * {mixed}) % 2147483629) * 16807) % 2147483647 / 2147483647.0)"


def monte_carlo_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn label changes: thirty draws of every event against its type's transition row."""
    e = table(spark, sf_dir, "events")
    cells = scenes.transition_matrix(e, "user_id", "ts", "event_type")
    rows = cells.groupBy(F.col("a").alias("_a")).agg(F.array_sort(F.collect_list(F.struct("b", "cumulative"))).alias("row"))
    rows = rows.select("_a", F.col("row")["b"].alias("labels"), F.slice(F.col("row")["cumulative"], F.lit(1), F.size("row") - 1).alias("steps"))
    # one row per label; Spark takes the draws for as small as the events that they are made of, and would broadcast them
    own = e.select("event_id", "event_type").repartition(4 * spark.sparkContext.defaultParallelism)  # a small file is thirty times as many draws
    met = own.join(F.broadcast(rows), F.col("event_type") == F.col("_a")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(30))))
    at = passed(F.col("steps"), lattice(F.col("event_id").cast("long"), F.col("draw")))
    return met.groupBy("event_type", F.element_at("labels", at + 1).alias("drawn")).agg(F.count("*").alias("n"))


MONTE_CARLO = f"""WITH l AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events), c AS (SELECT a, b, count(*) AS n FROM l WHERE b IS NOT NULL GROUP BY 1, 2),
p AS (SELECT a, b, sum(n) OVER (PARTITION BY a ORDER BY b) / sum(n) OVER (PARTITION BY a) AS high, (sum(n) OVER (PARTITION BY a ORDER BY b) - n) / sum(n) OVER (PARTITION BY a) AS low FROM c),
d AS (SELECT event_type, {_lattice("event_id::BIGINT", "draw")} AS u FROM events, generate_series(1, 30) AS g(draw))
SELECT event_type, b AS drawn, count(*) AS n FROM d JOIN p ON event_type = a AND u <= high AND (u > low OR low = 0) GROUP BY 1, 2"""


def bootstrap_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of each type's number and mean value over twenty resamplings."""
    draws = [lattice(F.col("event_id").cast("long"), i) for i in range(20)]
    sums = sampling.bootstrap_sums(table(spark, sf_dir, "events"), ["event_type"], draws, F.col("value"))
    level = F.col("total") / F.col("n")
    return sums.groupBy("event_type").agg(*[F.round(f(c), 5).alias(name) for name, f, c in (("mean", F.avg, "n"), ("sd", F.stddev_samp, "n"), ("level", F.avg, level), ("level_sd", F.stddev_samp, level))])


_STEPS = ", ".join(repr(sum(0.36787944117144233 / math.factorial(k) for k in range(n + 1))) for n in range(9))
BOOTSTRAP = f"""WITH d AS (SELECT event_type, value, i, {_lattice("event_id::BIGINT", "i")} AS u FROM events, generate_series(0, 19) AS g(i)),
c AS (SELECT event_type, i, value, len([s FOR s IN [{_STEPS}] IF u >= s]) AS n FROM d),
s AS (SELECT event_type, i, sum(n) AS n, sum(n * value) / sum(n) AS level FROM c GROUP BY 1, 2)
SELECT event_type, round(avg(n), 5) AS mean, round(stddev_samp(n), 5) AS sd, round(avg(level), 5) AS level, round(stddev_samp(level), 5) AS level_sd FROM s GROUP BY 1"""


def noise_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of keyed draws; the same whatever the partitioning."""
    d = table(spark, sf_dir, "orders").select(normal(1, "o_orderkey").alias("z"), uniform(1, "o_orderkey").alias("u"))
    return d.agg(*[F.round(f(c), 3).alias(f"{n}_{c}") for c in ("z", "u") for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])


def cross_validated_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out errors per fold of a quadratic regression of the price on three measures."""
    df = table(spark, sf_dir, "lineitem").withColumn("fold", F.pmod("l_orderkey", F.lit(5)).cast("int"))
    values = [F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")]
    out = fits.cross_validated(df, values, F.col("l_extendedprice"), F.lit(1.0), F.col("fold"), 5, 2)
    e = F.col("prediction") - F.col("l_extendedprice")
    return out.groupBy("fold").agg(F.count(e).alias("n"), F.round(F.avg(e), 3).alias("bias"), F.round(F.sqrt(F.avg(e * e)), 3).alias("rmse"))


def cross_validated_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out errors per fold of a straight line, each fitted to the other folds."""
    df = table(spark, sf_dir, "lineitem").withColumn("fold", F.pmod("l_orderkey", F.lit(5)).cast("int"))
    out = fits.cross_validated(df, [F.col("l_quantity")], F.col("l_extendedprice"), F.lit(1.0), F.col("fold"), 5)
    e = F.col("prediction") - F.col("l_extendedprice")
    return out.groupBy("fold").agg(F.count(e).alias("n"), F.round(F.avg(e), 3).alias("bias"), F.round(F.sqrt(F.avg(e * e)), 3).alias("rmse"))


CROSS_VALIDATED_LINE = """WITH l AS (SELECT (l_orderkey % 5)::INTEGER AS fold, l_quantity AS x, l_extendedprice AS y FROM lineitem), f AS (SELECT DISTINCT fold FROM l),
m AS (SELECT f.fold, regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM f JOIN l ON l.fold <> f.fold GROUP BY 1)
SELECT fold, count(*) AS n, round(avg(a + b * x - y), 3) AS bias, round(sqrt(avg(pow(a + b * x - y, 2))), 3) AS rmse FROM l JOIN m USING (fold) GROUP BY 1"""


def pooled_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape shared by simulated files of known shape and free brightness, per region."""
    views = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.explode(F.sequence(F.lit(0), F.lit(70), F.lit(5))).alias("angle"))
    basis = physics.limb(F.col("angle")) - 1.0
    true = -0.1 - 0.1 * F.col("n_regionkey")
    views = views.withColumn("radiance", (F.col("n_nationkey") + 10.0) * (1.0 + true * basis))
    hemisphere = np.array([[math.log(math.cos(math.radians(a / 10)) + 2) / math.log(math.cos(math.radians(55)) + 2) - 1] for a in range(901)])
    got = fits.pooled_shape(views, ["n_regionkey"], "n_nationkey", [basis], F.col("radiance"), hemisphere)
    return spark.createDataFrame([(g["n_regionkey"], g["files"], round(g["parameters"][0], 6)) for g in got], "n_regionkey int, files long, b double")


POOLED = "SELECT n_regionkey, count(*) AS files, round(-0.1 - 0.1 * n_regionkey, 6)::DOUBLE AS b FROM nation GROUP BY 1"


def scene_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 22 classification features over the grid of all parts and suppliers; null where a temperature is invalid."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("y"), F.col("l_suppkey").alias("x"))
    grids = lines.agg(*[(F.avg("l_extendedprice") / 397.0 + 180.0 + i).alias(f"c{i}") for i in range(6)])
    grids = grids.withColumn("c2", F.when((F.col("x") + 2 * F.col("y")) % 17 != 0, F.col("c2")))
    out = grid.scene_features(grids, [], "y", "x", [f"c{i}" for i in range(6)], keep_invalid=True)
    return out.select("y", "x", *[rounded(F.col(c), 3).alias(c) for c in out.columns if c not in ("y", "x")])


_FEATURE_GRID = """WITH g AS (SELECT l_partkey AS y, l_suppkey AS x, avg(l_extendedprice) / 397.0 + 180.0 AS c0 FROM lineitem GROUP BY 1, 2), v AS (SELECT * FROM g WHERE (x + 2 * y) % 17 <> 0),
d AS (SELECT unnest(range(-4, 5)) AS d), a AS (SELECT v.y, v.x, v.y + d AS o, d FROM v, d),
s9 AS (SELECT a.y, a.x, stddev_pop(b.c0) AS s, stddev_pop(b.c0) FILTER (abs(d) <= 2 AND abs(b.x - a.x) <= 2) AS s5 FROM a JOIN v b ON b.y = a.o AND b.x BETWEEN a.x - 4 AND a.x + 4 GROUP BY 1, 2)
SELECT g.y, g.x, """ + ", ".join(
    [f"round(v.c0 + {i}, 3) AS c{i}" for i in range(6)]
    + [f"CASE WHEN v.y IS NOT NULL THEN {d}.0::DOUBLE END AS btd_{n}" for n, d in (("14_11", 2), ("14_15", -1), ("14_08", 3), ("14_16", -2))]
    + [f"round(s9.{s}, 3) AS c{i}_std{n}" for s, n in (("s5", "5x5"), ("s", "9x9")) for i in range(6)]
) + " FROM g LEFT JOIN v ON v.y = g.y AND v.x = g.x LEFT JOIN s9 ON s9.y = g.y AND s9.x = g.x"


def component_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three paired error sources, their sum, and its closure."""
    o = table(spark, sf_dir, "orders").select(
        (F.col("o_totalprice") / 100000.0 - 1.5).alias("spectral"), (F.col("o_orderkey") % 13 / 13.0).alias("angular"), (F.col("o_custkey") % 7 / 7.0 - 0.4).alias("noise"), (F.col("o_orderkey") % 5 + 1.0).alias("w")
    )
    out = weighted.component_budget(o, ["spectral", "angular", "noise"], F.col("w"))
    return out.select("component", *[F.round(c, 5).alias(c) for c in ("bias", "variance", "rmse")], (F.abs("closure") < 1e-9).alias("closed"))


COMPONENT_BUDGET = """WITH o AS (SELECT o_totalprice / 100000.0 - 1.5 AS spectral, o_orderkey % 13 / 13.0 AS angular, o_custkey % 7 / 7.0 - 0.4 AS noise, o_orderkey % 5 + 1.0 AS w FROM orders),
l AS (SELECT *, spectral + angular + noise AS total FROM o) """ + " UNION ALL ".join(
    f"SELECT '{c}' AS component, round(sum(w * {c}) / sum(w), 5) AS bias, round(sum(w * {c} * {c}) / sum(w) - pow(sum(w * {c}) / sum(w), 2), 5) AS variance, round(sqrt(sum(w * {c} * {c}) / sum(w)), 5) AS rmse, true AS closed FROM l"
    for c in ("spectral", "angular", "noise", "total")
)

QUERIES = {
    "mixture_fit": (mixture_fit, None),
    "mixture_offsets": (mixture_offsets, MIXTURE_OFFSETS),
    "mixture_candidates": (mixture_candidates, MIXTURE_CANDIDATES),
    "mixture_sweep": (mixture_sweep, None),
    "labelled_scenes": (labelled_scenes, LABELLED_SCENES),
    "refit_stability": (refit_stability, None),
    "temperature_regressions": (temperature_regressions, TEMPERATURE_REGRESSIONS),
    "cross_validated_line": (cross_validated_line, CROSS_VALIDATED_LINE),
    "principal_scores": (principal_scores, None),
    "shape_library": (shape_library, SHAPE_LIBRARY),
    "regression": (regression, REGRESSION),
    "robust_regression": (robust_regression, None),
    "view_retrieval": (view_retrieval, VIEW_RETRIEVAL),
    "group_folds": (group_folds, GROUP_FOLDS),
    "monte_carlo_transitions": (monte_carlo_transitions, MONTE_CARLO),
    "bootstrap_stability": (bootstrap_stability, BOOTSTRAP),
    "noise_draws": (noise_draws, None),
    "cross_validated_regression": (cross_validated_regression, None),
    "pooled_shapes": (pooled_shapes, POOLED),
    "scene_features": (scene_features, _FEATURE_GRID),
    "component_budget": (component_budget, COMPONENT_BUDGET),
}
