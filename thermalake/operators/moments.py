"""Mergeable moments and summaries of errors.

A state is one row per group with n, mean and m2 (the centred second moment).
States of disjoint parts merge exactly, so a day's state can be stored and a
month be put together from stored days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermalake.functions.physics import nullify


def state(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """(keys, n, mean, m2); values that are not finite are not counted, groups without values keep n = 0."""
    x = nullify(value)
    return df.groupBy(*keys).agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        (F.var_pop(x) * F.count(x)).alias("m2"),
    )


def merge(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One state per key of states of disjoint parts.

    m2 = sum(m2) + sum(n * mean^2) - N * MEAN^2, with the means taken relative
    to one of them, so that a large common level does not cancel digits.
    """
    held = states.filter("n > 0").withColumn("_at", F.col("mean"))
    level = held.groupBy(*keys).agg(F.min("_at").alias("_level"))
    pairs = [F.col(f"_k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    level = level.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_level")
    on = F.lit(True)
    for p in pairs:
        on = on & p
    d = F.col("mean") - F.col("_level")
    sums = (
        held.join(level, on)
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * d).alias("_s"),
            F.sum(F.col("m2") + F.col("n") * d * d).alias("_ss"),
            F.min("_level").alias("_level"),
        )
    )
    return sums.select(
        *keys,
        "n",
        (F.col("_level") + F.col("_s") / F.col("n")).alias("mean"),
        F.greatest(F.col("_ss") - F.col("_s") * F.col("_s") / F.col("n"), F.lit(0.0)).alias("m2"),
    )


def population_summary(states: DataFrame, reference: Column | None = None) -> DataFrame:
    """bias, population sd and rmse of each state, in percent of a positive reference too."""
    sd = F.sqrt(F.try_divide("m2", F.col("n").cast("double")))
    out = states.withColumns({"bias": F.col("mean"), "sd": sd, "rmse": F.sqrt(F.col("mean") * F.col("mean") + sd * sd)})
    if reference is None:
        return out
    share = lambda c: F.when(reference > 0, 100.0 * F.col(c) / reference)
    return out.withColumns({f"{c}_percent": share(c) for c in ("bias", "sd", "rmse")})


def sample_summary(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """n, mean, sample sd and rmse; raises for a group of fewer than two finite values."""
    x = nullify(value)
    out = df.groupBy(*keys).agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("sd"),
        F.sqrt(F.avg(x * x)).alias("rmse"),
    )
    short = F.raise_error(F.lit("a summary needs two finite values")).cast("double")
    return out.withColumn("sd", F.when(F.col("n") < 2, short).otherwise(F.col("sd")))


def paired_summary(df: DataFrame, keys: Sequence[str], variant: Column, baseline: Column, reference: Column) -> DataFrame:
    """Statistics of variant minus baseline where both are valid, and how many values either has alone."""
    a, b = nullify(variant), nullify(baseline)
    d, p = a - b, 100.0 * (a - b) / F.when(reference > 0, reference)
    return df.groupBy(*keys).agg(
        F.count(d).alias("n"),
        F.avg(d).alias("mean"),
        F.stddev_samp(d).alias("sd"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.avg(p).alias("mean_percent"),
        F.sqrt(F.avg(p * p)).alias("rmse_percent"),
        F.count_if(b.isNotNull() & a.isNull()).alias("lost"),
        F.count_if(a.isNotNull() & b.isNull()).alias("gained"),
    )


def pixel_means(df: DataFrame, keys: Sequence[str], first: Column, second: Column) -> DataFrame:
    """Mean of each of two satellites where it is valid, and the population sd of their difference where both are."""
    a, b = nullify(first), nullify(second)
    return df.groupBy(*keys).agg(
        F.avg(a).alias("mean_first"), F.avg(b).alias("mean_second"), F.stddev_pop(a - b).alias("std_diff"), F.count(a - b).alias("n_both")
    )


def scatter(df: DataFrame, values: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, i, j, n, mean_i, mean_j, covariance) for all pairs i <= j of named values, in one aggregation."""
    names = list(values)
    own = df.select(*keys, *[v.alias(f"v{i}") for i, v in enumerate(values.values())])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    cells = F.array(
        *[
            F.struct(
                F.lit(names[i]).alias("i"),
                F.lit(names[j]).alias("j"),
                F.count(F.col(f"v{i}") + F.col(f"v{j}")).alias("n"),
                F.avg(f"v{i}").alias("mean_i"),
                F.avg(f"v{j}").alias("mean_j"),
                F.covar_pop(f"v{i}", f"v{j}").alias("covariance"),
            )
            for i, j in pairs
        ]
    )
    return own.groupBy(*keys).agg(cells.alias("cells")).select(*keys, F.inline("cells"))


def variant_summaries(df: DataFrame, keys: Sequence[str], baseline: Column, variants: dict[str, Column], reference: Column) -> DataFrame:
    """(keys, variant, n, mean, sd, rmse, rmse_percent, lost, gained): each variant against one baseline, all in one pass."""
    own = df.select(*keys, nullify(baseline).alias("_b"), reference.alias("_r"), *[nullify(c).alias(f"_v{i}") for i, c in enumerate(variants.values())])
    cells = []
    for i, name in enumerate(variants):
        d = F.col(f"_v{i}") - F.col("_b")
        p = 100.0 * d / F.when(F.col("_r") > 0, F.col("_r"))
        cells.append(
            F.struct(
                F.lit(name).alias("variant"), F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"), F.sqrt(F.avg(d * d)).alias("rmse"), F.sqrt(F.avg(p * p)).alias("rmse_percent"),
                F.count_if(F.col("_b").isNotNull() & F.col(f"_v{i}").isNull()).alias("lost"), F.count_if(F.col("_b").isNull() & F.col(f"_v{i}").isNotNull()).alias("gained"),
            )
        )
    return own.groupBy(*keys).agg(F.array(*cells).alias("cells")).select(*keys, F.inline("cells"))
