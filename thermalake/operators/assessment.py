"""Assessment of flux models on spectra by grouped folds, and the budget of four paired error sources.

A case is one spectrum: its true channel fluxes, its true broadband flux, its
group and its weight. Folds hold whole groups. A model is fitted per fold on
all other folds and applied to the fold's own cases by a join on the fold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermalake.functions import physics
from thermalake.functions.rng import normal, passed, uniform
from thermalake.operators import fits, joins, weighted


def with_folds(cases: DataFrame, group: str, folds: int) -> DataFrame:
    """The cases with `fold`; every group is in one."""
    dealt = fits.group_folds(cases, group, folds).select(F.col(group).alias("_group"), "fold")
    return cases.join(dealt, F.col(group) == F.col("_group")).drop("_group")


def case_weights(cases: DataFrame, label: str, population: DataFrame, share: str) -> tuple[DataFrame, dict]:
    """The cases of known labels with `weight` by the population, and coverage, missing labels and effective sample size."""
    own = weighted.population_weights(cases, label, population, share).filter("weight IS NOT NULL")
    row = own.agg(F.max("coverage").alias("coverage"), (F.pow(F.sum("weight"), F.lit(2.0)) / F.sum(F.col("weight") * F.col("weight"))).alias("ess"), F.count("*").alias("n")).first()
    missing = population.join(cases.select(F.col(label).alias("_l")).distinct(), F.col(label) == F.col("_l"), "left_anti")
    names = sorted(str(r[label]) for r in missing.select(label).collect())  # a few labels
    return own.drop("coverage"), {"coverage": row["coverage"], "missing": names, "ess": row["ess"], "n": row["n"]}


def stage_residuals(cases: DataFrame, case: Sequence[str], inputs: dict[str, Sequence[Column]], fitted: str, truth: Column, folds: int, degrees: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """(case, fold, weight, degree, stage, truth, residual): predictions of every case by its fold's model, less the truth.

    `inputs` has the channel fluxes of each stage, as the true ones of the stage
    `fitted` alone and retrieved ones of a later stage; all stages use the
    models fitted to that one. Needs the columns fold and weight; a case whose
    fold has no model raises.
    """
    names = {stage: [f"_{stage}{i}" for i in range(len(columns))] for stage, columns in inputs.items()}
    wide = cases.select(*case, "fold", "weight", truth.cast("double").alias("truth"), *[c.cast("double").alias(n) for stage, columns in inputs.items() for c, n in zip(columns, names[stage], strict=True)])
    out = None
    for degree in degrees:
        values = [F.col(n) for n in names[fitted]]
        models = fits.fold_models(wide, values, F.col("truth"), F.col("weight"), F.col("fold"), folds, degree)
        for stage in inputs:
            # every case is predicted once, by its own fold's model; one without is an error, not a null that aggregates drop
            prediction = F.raise_error(F.lit("a case has no model of its fold")).cast("double")
            for k, model in models.items():
                prediction = F.when(F.col("fold") == k, model.column([F.col(n) for n in names[stage]])).otherwise(prediction)
            own = wide.select(*case, "fold", "weight", F.lit(degree).alias("degree"), F.lit(stage).alias("stage"), "truth", (prediction - F.col("truth")).alias("residual"))
            out = own if out is None else out.unionByName(own)
    return out


def stage_summary(residuals: DataFrame, keys: Sequence[str] = ("degree", "stage")) -> DataFrame:
    """Weighted bias, sd, twice the sd, rmse, largest error and effective sample size per set of residuals."""
    out = weighted.weighted_errors(residuals, list(keys), F.col("residual"), F.col("weight"))
    return out.withColumn("sd2", 2.0 * F.col("sd"))


def chain_increments(residuals: DataFrame, case: Sequence[str], first: str, second: str) -> DataFrame:
    """Per degree the covariance of the first stage's error and of what the second adds; stages are paired strictly, with equal folds and weights."""
    paired = joins.strict_pairs(residuals, [*case, "degree"], "stage", first, second, ["residual"], equal=("fold", "weight"))
    return weighted.paired_covariance(paired, ["degree"], F.col("residual_first"), F.col("residual_second") - F.col("residual_first"), F.col("weight"))


def selected_terms(terms: DataFrame, scenario: str, where: Column) -> DataFrame:
    """The terms of one setting, in the order of the scenarios; raises unless each scenario has exactly one."""
    counts = terms.groupBy(F.col(scenario).alias("_s")).agg(F.count_if(where).alias("_n"))
    met = terms.filter(where).join(counts, F.col(scenario) == F.col("_s"), "right")
    bad = F.when(F.col("_n") != 1, F.raise_error(F.concat(F.lit("not exactly one term of "), F.col("_s").cast("string"))).cast("boolean"))
    return met.withColumn("_bad", bad).filter("_bad IS NULL").select(*terms.columns).orderBy(scenario)


def scene_residuals(residuals: DataFrame, scene: str) -> DataFrame:
    """Per scene the mean residual and the band of twice the sample sd around it, and the share of all weight."""
    sums = residuals.groupBy(scene).agg(F.count("*").alias("n"), F.avg("residual").alias("mean"), F.stddev_samp("residual").alias("sd"), F.sum("weight").alias("_w"))
    total = residuals.agg(F.sum("weight")).first()[0]
    return sums.select(scene, "n", "mean", (F.col("mean") - 2 * F.col("sd")).alias("low"), (F.col("mean") + 2 * F.col("sd")).alias("high"), (F.col("_w") / F.lit(float(total or 1.0))).alias("share"))


def fold_shapes(cases: DataFrame, case: str, views: str, angles: Sequence[float], scene: str, channels: int, folds: int) -> DataFrame:
    """(fold, scene, shapes): the radiance shape parameter of each channel, fitted to the cases of all other folds.

    `views` is an array column of one array of channel radiances per angle. A
    case enters once per fold that it trains, with its own amplitude.
    """
    grid = np.array([[physics.limb_value(90 * i / 900) - 1] for i in range(901)])
    trains = F.explode(F.array_except(F.sequence(F.lit(0), F.lit(folds - 1)), F.array(F.col("fold")))).alias("_fold")
    long = cases.select(F.col(case).alias("_case"), F.col(scene).alias("_scene"), F.col(views).alias("_views"), trains)
    long = long.select("_case", "_fold", "_scene", F.posexplode("_views").alias("_v", "_radiances")).select("_case", "_fold", "_scene", "_v", F.posexplode("_radiances").alias("_channel", "_l"))
    basis = F.element_at(F.array(*[F.lit(physics.limb_value(a) - 1) for a in angles]), F.col("_v") + 1)
    got = fits.pooled_shape(long, ["_fold", "_scene", "_channel"], "_case", [basis], F.col("_l"), grid)
    held: dict[tuple, list] = {}
    for g in got:  # folds x scenes x channels of a model
        held.setdefault((g["_fold"], g["_scene"]), [None] * channels)[g["_channel"]] = g["parameters"][0]
    kind = dict(cases.dtypes)[scene]
    rows = [(f, s, b, [physics.angular_integral([x]) for x in b]) for (f, s), b in sorted(held.items())]
    return cases.sparkSession.createDataFrame(rows, f"_fold int, _scene {kind}, shapes array<double>, integrals array<double>")


def channel_fluxes(radiances: Column, angle: float, shapes: Column, integrals: Column) -> Column:
    """Array of channel fluxes from directional radiances: pi L I / (1 + b basis)."""
    basis = physics.limb_value(angle) - 1.0
    return F.transform(radiances, lambda l, i: F.lit(math.pi) * l * F.get(integrals, i) / (1.0 + F.get(shapes, i) * F.lit(basis)))


def four_components(
    cases: DataFrame, case: str, scene: str, view: str, true_fluxes: str, truth: str, angle: float, shapes: DataFrame, models: dict[int, fits.Polynomial],
    transitions: DataFrame, noise_sd: Sequence[float], draws: int, seed: int,
    noise: Callable[[Column, Column, Column], Column] | None = None, pick: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """(case, draw, fold, scene, weight, spectral, angular, noise, scene_assignment, total): paired errors of every draw of every case.

    spectral: the model on the true channel fluxes, less the truth. angular:
    what retrieving those fluxes from the view under the scene's shapes adds.
    noise: what noise of the view's radiances adds. scene_assignment: what a
    scene drawn from the transitions adds. total is the error with all four.
    `transitions` has _from, labels and cumulative probabilities; `noise` and
    `pick` make the draws from (case, channel, draw), by hashes of these if left
    out, so they don't depend on partitions or folds.
    """
    noise = noise or (lambda c, channel, draw: normal(seed, F.lit(2), c, channel, draw))
    pick = pick or (lambda c, draw: uniform(seed, F.lit(4), c, draw))
    channels = len(noise_sd)
    # shapes and transitions are tables of a model, of folds x scenes rows
    own = cases.select(F.col(case).alias("_case"), F.col(scene).alias("_own"), "fold", "weight", F.col(view).alias("_view"), F.col(true_fluxes).alias("_true"), F.col(truth).alias("_truth"))
    table = shapes.withColumnsRenamed({"_fold": "_f", "_scene": "_s"})
    own = own.join(F.broadcast(table), (F.col("fold") == F.col("_f")) & (F.col("_own") == F.col("_s")), "left")
    found = F.when(F.col("_f").isNull(), F.raise_error(F.lit("a case's scene has no shape in its fold")).cast("array<double>")).otherwise(F.col("shapes"))
    own = own.withColumn("shapes", found).drop("_f", "_s")
    own = own.withColumn("_clean", channel_fluxes(F.col("_view"), angle, F.col("shapes"), F.col("integrals")))
    own = own.join(F.broadcast(transitions), F.col("_own") == F.col("_from")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    place = passed(F.slice("cumulative", F.lit(1), F.size("cumulative") - 1), pick(F.col("_case"), F.col("draw")))
    shaken = F.array(*[F.get("_view", i) + F.lit(float(s)) * noise(F.col("_case"), F.lit(i), F.col("draw")) for i, s in enumerate(noise_sd)])
    own = own.withColumns({"_drawn": F.element_at("labels", place + 1), "_shaken": shaken})
    own = own.withColumn("_noisy", channel_fluxes(F.col("_shaken"), angle, F.col("shapes"), F.col("integrals")))
    other = shapes.select(F.col("_fold").alias("_f"), F.col("_scene").alias("_s"), F.col("shapes").alias("_b"), F.col("integrals").alias("_i"))
    own = own.join(F.broadcast(other), (F.col("fold") == F.col("_f")) & (F.col("_drawn") == F.col("_s")))
    own = own.withColumn("_moved", channel_fluxes(F.col("_shaken"), angle, F.col("_b"), F.col("_i")))

    def predicted(fluxes: str) -> Column:
        out = F.lit(None).cast("double")
        for k, model in models.items():
            out = F.when(F.col("fold") == k, model.column([F.get(fluxes, i) for i in range(channels)])).otherwise(out)
        return out

    own = own.select("_case", "draw", "fold", "_own", "weight", "_truth", *[predicted(c).alias(f"p{c}") for c in ("_true", "_clean", "_noisy", "_moved")])
    return own.select(
        F.col("_case").alias(case), "draw", "fold", F.col("_own").alias(scene), "weight",
        (F.col("p_true") - F.col("_truth")).alias("spectral"), (F.col("p_clean") - F.col("p_true")).alias("angular"),
        (F.col("p_noisy") - F.col("p_clean")).alias("noise"), (F.col("p_moved") - F.col("p_noisy")).alias("scene_assignment"),
        (F.col("p_moved") - F.col("_truth")).alias("total"),
    )


COMPONENTS = ("spectral", "angular", "noise", "scene_assignment")


def budget_classes(errors: DataFrame, case: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, component, bias, random_variance, scene_variance, rmse): error classes of each component and of the total.

    With keys, as the scene, weights count within each group.
    """
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("error")) for c in (*COMPONENTS, "total")])).alias("c")
    long = errors.select(*keys, F.col(case).alias("_case"), "weight", named).select(*keys, "_case", "weight", "c.component", "c.error")
    return weighted.error_classes(long, "_case", F.col("error"), F.col("weight"), [*keys, "component"])


def closure(errors: DataFrame) -> DataFrame:
    """One row: draws of cases, and by how much the four components miss the total at most."""
    miss = F.abs(sum((F.col(c) for c in COMPONENTS), F.lit(0.0)) - F.col("total"))
    return errors.agg(F.count("*").alias("n"), F.max(miss).alias("largest"))
