"""Weighted statistics, error classes and budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermalake.operators.sampling import running


def _about_mean(a: Column, b: Column, w: Column) -> tuple[Column, Column]:
    """Aggregates: the sum of w (a - mean a), and of w (a - mean a)(b - mean b), with plain means.

    They are made of covariances, which Spark updates around running means, so
    a large common level costs no digits.
    """
    n = F.count("*").cast("double")
    return n * F.covar_pop(w, a), n * (F.covar_pop(w * a, b) - F.avg(a) * F.covar_pop(w, b))


def weighted_errors(df: DataFrame, keys: Sequence[str], error: Column, weight: Column) -> DataFrame:
    """Reliability-weighted bias, sd and rmse per group, weights scaled to sum 1; ess = 1 / sum of squared weights."""
    own = df.select(*keys, error.cast("double").alias("_e"), weight.cast("double").alias("_w")).filter("_e IS NOT NULL AND _w IS NOT NULL")
    e, w = F.col("_e"), F.col("_w")
    first, second = _about_mean(e, e, w)
    sums = own.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(w).alias("w1"),
        F.sum(w * w).alias("w2"),
        F.avg(e).alias("level"),
        first.alias("wd"),
        second.alias("wdd"),
        F.max(F.when(w > 0, F.abs(e))).alias("max_abs"),
    )
    shift = F.try_divide("wd", "w1")
    bias = F.col("level") + shift
    spread = F.greatest(F.try_divide("wdd", "w1") - shift * shift, F.lit(0.0))
    used = F.try_divide("w2", F.col("w1") * F.col("w1"))
    return sums.select(
        *keys,
        "n",
        bias.alias("bias"),
        F.sqrt(F.try_divide(spread, 1.0 - used)).alias("sd"),
        F.sqrt(bias * bias + spread).alias("rmse"),
        "max_abs",
        F.try_divide(F.lit(1.0), used).alias("ess"),
    )


def weighted_breakdown(df: DataFrame, first: str, second: str, error: Column, weight: Column) -> DataFrame:
    """The weighted bias, rmse and share of all weight: overall, by each of two columns; renormalised in each set."""
    own = df.select(F.col(first), F.col(second), error.alias("_e"), weight.alias("_w"))
    sets = own.groupingSets([[], [F.col(first)], [F.col(second)]], F.col(first), F.col(second)).agg(
        F.grouping_id().alias("set_id"),
        F.count("*").alias("n"),
        F.sum("_w").alias("w"),
        (F.sum(F.col("_w") * F.col("_e")) / F.sum("_w")).alias("bias"),
        F.sqrt(F.sum(F.col("_w") * F.col("_e") * F.col("_e")) / F.sum("_w")).alias("rmse"),
    )
    return sets.withColumn("share", F.col("w") / F.max("w").over(Window.partitionBy())).drop("w")


def error_classes(df: DataFrame, file: str, error: Column, weight: Column, keys: Sequence[str] = ()) -> DataFrame:
    """One row per group of keys: bias, random and scene-dependent variance and rmse of realizations of files.

    random is the weighted mean of the files' sample variances, scene the
    weighted spread of their means less what the realizations contribute to it.
    """
    files = df.groupBy(*keys, file).agg(
        F.count(error).alias("r"),
        F.avg(error).alias("m"),
        F.coalesce(F.var_samp(error), F.lit(0.0)).alias("v"),
        F.avg(error * error).alias("s"),
        F.max(weight).alias("w"),
    )
    files = files.filter("r > 0 AND w IS NOT NULL")
    w, m = F.col("w").cast("double"), F.col("m")
    first, second = _about_mean(m, m, w)
    sums = files.groupBy(*keys).agg(
        F.sum(w).alias("w1"),
        F.avg(m).alias("level"),
        first.alias("wd"),
        second.alias("wdd"),
        F.sum(w * F.col("v")).alias("wv"),
        F.sum(w * F.col("s")).alias("ws"),
        F.sum(w * F.try_divide("v", F.col("r").cast("double"))).alias("wvr"),
        F.sum(w * w * F.try_divide("v", F.col("r").cast("double"))).alias("wwvr"),
    )
    shift = F.col("wd") / F.col("w1")
    spread = F.col("wdd") / F.col("w1") - shift * shift
    scene = spread - (F.col("wvr") / F.col("w1") - F.col("wwvr") / (F.col("w1") * F.col("w1")))
    return sums.select(
        *keys,
        (F.col("level") + shift).alias("bias"),
        (F.col("wv") / F.col("w1")).alias("random_variance"),
        scene.alias("scene_variance"),
        F.sqrt(F.col("ws") / F.col("w1")).alias("rmse"),
        (scene < 0).alias("scene_negative"),
    )


def weighted_quantile(df: DataFrame, keys: Sequence[str], value: str, weight: str, q: float) -> DataFrame:
    """Quantile by linear interpolation on the midpoint distribution, clamped to the extreme values.

    Equal values are put together first; weights are added up over ranges of
    the values, so that no task holds a key.
    """
    points = df.filter((F.col(weight) > 0) & F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    ranked = running(points, keys, value, "_w")
    total = ranked.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.sum("_w").alias("_total"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    placed = ranked.join(total, on).withColumn("_p", (F.col("so_far") - F.col("_w") / 2.0) / F.col("_total"))
    point, below = F.struct(F.col("_p").alias("p"), F.col(value).alias("v")), F.col("_p") < q
    ends = placed.groupBy(*keys).agg(F.max(F.when(below, point)).alias("low"), F.min(F.when(~below, point)).alias("high"))
    low, high = F.col("low"), F.col("high")
    inside = low["v"] + (F.lit(q) - low["p"]) / (high["p"] - low["p"]) * (high["v"] - low["v"])
    return ends.select(*keys, F.when(low.isNull(), high["v"]).when(high.isNull(), low["v"]).otherwise(inside).alias("quantile"))


def population_weights(df: DataFrame, label: str, population: DataFrame, share: str) -> DataFrame:
    """The rows with weight = share of their label / rows of the label / share of all labels that occur.

    `population` has one row per label: it is a small dimension, joined to the
    labels' counts and not to the rows.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    known = counts.join(population.withColumnRenamed(label, "_label"), F.col(label) == F.col("_label"))
    cover = known.withColumn("_cover", F.sum(share).over(Window.partitionBy()))  # over one row per label
    weights = cover.select(
        F.col(label).alias("_label"), (F.col(share) / F.col("_n") / F.col("_cover")).alias("weight"), F.col("_cover").alias("coverage")
    )
    return df.join(weights, F.col(label) == F.col("_label"), "left").drop("_label")


def paired_covariance(df: DataFrame, keys: Sequence[str], first: Column, second: Column, weight: Column) -> DataFrame:
    """Weighted means and unbiased 2 x 2 covariance, and the variance of the sum as its quadratic form with (1, 1)."""
    own = df.select(*keys, first.cast("double").alias("_a"), second.cast("double").alias("_b"), weight.cast("double").alias("_w")).na.drop(subset=["_a", "_b", "_w"])
    w, a, b = F.col("_w"), F.col("_a"), F.col("_b")
    (da, daa), (db, dbb), (_, dab) = _about_mean(a, a, w), _about_mean(b, b, w), _about_mean(a, b, w)
    sums = own.groupBy(*keys).agg(
        F.sum(w).alias("w1"), F.sum(w * w).alias("w2"), F.avg(a).alias("la"), F.avg(b).alias("lb"),
        da.alias("da"), db.alias("db"), daa.alias("daa"), dbb.alias("dbb"), dab.alias("dab"),
    )
    w1 = F.col("w1")
    ma, mb = F.col("da") / w1, F.col("db") / w1
    free = 1.0 - F.col("w2") / (w1 * w1)
    cell = lambda s, x, y: F.try_divide(F.col(s) / w1 - x * y, free)
    vaa, vbb, vab = cell("daa", ma, ma), cell("dbb", mb, mb), cell("dab", ma, mb)
    return sums.select(
        *keys,
        (F.col("la") + ma).alias("mean_first"),
        (F.col("lb") + mb).alias("mean_second"),
        vaa.alias("var_first"),
        vbb.alias("var_second"),
        vab.alias("covariance"),
        (vaa + vbb + 2.0 * vab).alias("var_total"),
    )


def budget(components: DataFrame, requirement: str, averaging: str | None = None) -> DataFrame:
    """Quadrature sum of the variances and algebraic sum of the biases that count for a requirement.

    `components` has kind ('variance' or 'bias'), averaging_class, requirement_ids and value.
    """
    own = components.filter(F.array_contains("requirement_ids", requirement))
    if averaging is not None:
        own = own.filter(F.col("averaging_class") == averaging)
    variance = F.sum(F.when(F.col("kind") == "variance", F.col("value")))
    return own.agg(
        F.count("*").alias("n"),
        variance.alias("variance"),
        F.sqrt(variance).alias("uncertainty"),
        F.sum(F.when(F.col("kind") == "bias", F.col("value"))).alias("bias"),
    )


def component_budget(df: DataFrame, components: Sequence[str], weight: Column) -> DataFrame:
    """(component, bias, variance, rmse) of paired error sources and their sum, with all covariances in the total's variance.

    `closure` is what the total's variance misses of the sum of all variances
    and covariances; it is rounding alone unless a source is missing in places.
    """
    total = sum((F.col(c) for c in components[1:]), F.col(components[0]))
    own = df.select(*[F.col(c).cast("double").alias(c) for c in components], weight.alias("_w")).withColumn("total", total.cast("double")).na.drop()
    names = [*components, "total"]
    w = F.col("_w")
    pairs = [(a, b) for i, a in enumerate(components) for b in components[i:]] + [("total", "total")]
    about = {(a, b): _about_mean(F.col(a), F.col(b), w) for a, b in pairs}
    sums = own.agg(
        F.sum(w).alias("w1"),
        *[F.avg(c).alias(f"l_{c}") for c in names],
        *[about[c, c][0].alias(f"m_{c}") for c in names],
        *[second.alias(f"x_{a}_{b}") for (a, b), (_, second) in about.items()],
    )
    shift = lambda c: F.col(f"m_{c}") / F.col("w1")
    mean = lambda c: F.col(f"l_{c}") + shift(c)
    cross = lambda a, b: F.col(f"x_{a}_{b}") / F.col("w1") - shift(a) * shift(b)
    spread = lambda c: cross(c, c)
    whole = F.lit(0.0)
    for a, b in pairs[:-1]:
        whole = whole + (cross(a, b) if a == b else 2.0 * cross(a, b))
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("component"), mean(c).alias("bias"), spread(c).alias("variance"), F.sqrt(mean(c) * mean(c) + F.greatest(spread(c), F.lit(0.0))).alias("rmse"),
                (spread(c) - whole if c == "total" else F.lit(0.0)).alias("closure"),
            )
            for c in names
        ]
    )
    return sums.select(F.inline(rows))


def weighted_moments(df: DataFrame, keys: Sequence[str], value: Column, weight: Column) -> DataFrame:
    """(keys, mean, root_mean_square): sums of weight times value, and the root of those of weight times its square."""
    return df.groupBy(*keys).agg(F.sum(weight * value).alias("mean"), F.sqrt(F.sum(weight * value * value)).alias("root_mean_square"))


def combined_variance(parts: Sequence[Column]) -> Column:
    """Sum of independent variances; null if one is null, an error if one is negative."""
    total = F.lit(0.0)
    for p in parts:
        total = total + F.when(p < 0, F.raise_error(F.lit("a variance is negative")).cast("double")).otherwise(p)
    return total


def propagated(jacobian: Sequence[Column], covariance: Sequence[Sequence[Column]], tolerance: float = 1e-12) -> Column:
    """J C J^T; rounding below zero becomes zero, more of it is an error."""
    total, scale = F.lit(0.0), F.lit(0.0)
    for i, a in enumerate(jacobian):
        for j, b in enumerate(jacobian):
            part = a * b * covariance[i][j]
            total, scale = total + part, scale + F.abs(part)
    wrong = F.raise_error(F.lit("the covariance is not positive")).cast("double")
    return F.when(total >= 0, total).when(total >= -tolerance * scale, F.lit(0.0)).when(total.isNotNull(), wrong)


def variance_shares(first: Column, second: Column, covariance: Column, total: Column, tolerance: float = 1e-9) -> Column:
    """The array [variance, variance, twice the covariance] of a sum; an error if they don't add up to the total."""
    parts = F.array(first, second, 2.0 * covariance)
    off = F.abs(first + second + 2.0 * covariance - total) > tolerance * F.greatest(F.abs(total), F.lit(1.0))
    return F.when(off, F.raise_error(F.lit("variances don't add up to the total")).cast("array<double>")).otherwise(parts)


def component_statistics(bias: Column, sd: Column, n: Column, rmse: Column | None = None) -> Column:
    """(bias, sd, rmse) with the rmse of n values from bias and sample sd where it is not stored."""
    made = F.sqrt(bias * bias + (n - 1) / n * sd * sd)
    return F.struct(bias.alias("bias"), sd.alias("sd"), (made if rmse is None else F.coalesce(rmse, made)).alias("rmse"))
