"""Joins by tolerance, by order and by strict pairing, and comparisons of sets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interpolate(points: DataFrame, series: DataFrame, key: str, value: str, outside: float | None = 0.0, most: int = 1_000_000) -> DataFrame:
    """`points` (key) with `value` by linear interpolation between the rows of `series` around it; null keys give null.

    A series is a response or a spectrum's grid: of at most `most` rows, which
    is checked, so it goes to every task, and the points stay where they are.
    """
    rows = series.select(F.col(key).cast("double").alias("k"), F.col(value).cast("double").alias("v")).na.drop().limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"a series of more than {most} rows; give it keys and join by range")
    rows = rows.sort_values("k")
    held = points.sparkSession.sparkContext.broadcast((rows["k"].to_numpy(), rows["v"].to_numpy()))
    beyond = np.nan if outside is None else outside

    @F.pandas_udf("double")
    def between(at: pd.Series) -> pd.Series:
        x, y = held.value
        inside = np.interp(at, x, y, beyond, beyond) if len(x) else np.full(len(at), beyond)
        return pd.Series(np.where(at.isna(), np.nan, inside))

    got = between(F.col(key).cast("double"))
    return points.select(F.col(key).cast("double").alias(key), got.alias("_v")).select(key, F.when(~F.isnan("_v"), F.col("_v")).alias(value))


def within_tolerance(wanted: DataFrame, available: DataFrame, column: str, absolute: float = 1e-8, relative: float = 1e-5) -> DataFrame:
    """Each wanted value with the available one within tolerance of it, and how many there are.

    Values meet over bins as wide as the largest tolerance in reach, not over all pairs.
    """
    a, b = F.col(column), F.col("_b")
    largest = available.agg(F.max(F.abs(F.col(column).cast("double")))).first()[0] or 0.0
    width = max(absolute + relative * largest, 1e-12)
    bins = lambda c: F.floor(c / F.lit(width))
    spread = available.select(F.col(column).cast("double").alias("_b")).withColumn(
        "_bin", F.explode(F.array(*[bins(F.col("_b")) + d for d in (-1, 0, 1)]))
    )
    own = wanted.withColumn("_id", F.monotonically_increasing_id())  # wanted values may repeat
    met = own.join(spread, (bins(a.cast("double")) == F.col("_bin")) & (F.abs(a - b) <= absolute + relative * F.abs(b)), "left")
    one = met.groupBy("_id").agg(F.first(F.struct(*wanted.columns)).alias("_row"), F.count("_b").alias("matches"), F.min("_b").alias("matched"))
    return one.select("_row.*", "matches", "matched")


def strict_pairs(df: DataFrame, keys: Sequence[str], stage: str, first: str, second: str, columns: Sequence[str], equal: Sequence[str] = ()) -> DataFrame:
    """One row per key with the columns of both stages, suffixed; raises for keys that lack or repeat a stage.

    `equal` names columns, such as folds and weights, that must agree between
    the stages.
    """
    own = df.filter(F.col(stage).isin(first, second))
    is_first, is_second = F.col(stage) == first, F.col(stage) == second
    aggs = [F.count_if(is_first).alias("_n1"), F.count_if(is_second).alias("_n2")]
    for c in columns:
        aggs += [F.max(F.when(is_first, F.col(c))).alias(f"{c}_first"), F.max(F.when(is_second, F.col(c))).alias(f"{c}_second")]
    for c in equal:
        aggs += [(~F.max(F.when(is_first, F.col(c))).eqNullSafe(F.max(F.when(is_second, F.col(c))))).alias(f"_differ_{c}"), F.max(c).alias(c)]
    paired = own.groupBy(*keys).agg(*aggs)
    bad = (F.col("_n1") != 1) | (F.col("_n2") != 1)
    for c in equal:
        bad = bad | F.col(f"_differ_{c}")
    checked = F.when(bad, F.raise_error(F.lit("unmatched or duplicate pair")).cast("double")).otherwise(F.lit(0.0))
    return paired.withColumn("_ok", checked).filter("_ok = 0.0").drop("_n1", "_n2", "_ok", *[f"_differ_{c}" for c in equal])


def crossing_groups(df: DataFrame, group: str, fold: str) -> DataFrame:
    """Groups whose rows lie in more than one fold."""
    return df.groupBy(group).agg(F.count_distinct(fold).alias("folds")).filter("folds > 1")


def closure(recomputed: DataFrame, written: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row: compared keys, the largest difference, values valid on one side only, keys on one side only."""
    other = written.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(value).alias("_value"), F.lit(True).alias("_in"))
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    met = recomputed.withColumn("_own", F.lit(True)).join(other, on, "full_outer")
    both = F.col("_own").isNotNull() & F.col("_in").isNotNull()
    a, b = F.col(value), F.col("_value")
    return met.agg(
        F.count_if(both).alias("n"),
        F.max(F.when(both, F.abs(a - b))).alias("max_difference"),
        F.count_if(both & (a.isNull() != b.isNull())).alias("validity_mismatch"),
        F.count_if(~both).alias("unmatched"),
    )


def difference(expected: DataFrame, observed: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, status) of keys that are missing, unexpected or differ in a field; null equals null."""
    e = expected.select(F.col(key).alias("_e"), *[F.col(f).alias(f"_e_{f}") for f in fields])
    o = observed.select(F.col(key).alias("_o"), *[F.col(f).alias(f"_o_{f}") for f in fields])
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"_e_{f}").eqNullSafe(F.col(f"_o_{f}"))
    status = F.when(F.col("_o").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(~same, "mismatch")
    met = e.join(o, F.col("_e") == F.col("_o"), "full_outer")
    return met.select(F.coalesce("_e", "_o").alias(key), status.alias("status")).filter("status IS NOT NULL")


def require(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """The table, raising when a row is bad."""
    return df.withColumn("_bad", F.when(bad, F.raise_error(F.lit(message)).cast("boolean"))).filter("_bad IS NULL").drop("_bad")


def paired_ids(df: DataFrame, key: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """(key, problem) of ids that don't have exactly one row of each kind, or that have another kind; empty if all are paired."""
    counts = [F.count_if(F.col(kind) == k).alias(f"_n{i}") for i, k in enumerate(kinds)]
    got = df.groupBy(key).agg(*counts, F.count("*").alias("_n"))
    missing = F.array_compact(F.array(*[F.when(F.col(f"_n{i}") == 0, F.lit(k)) for i, k in enumerate(kinds)]))
    problem = F.when(F.size(missing) > 0, F.concat(F.lit("without "), F.array_join(missing, ", "))).when(F.col("_n") != len(kinds), F.lit("repeated or of another kind"))
    return got.select(key, problem.alias("problem")).filter("problem IS NOT NULL")


def covers(parts: Sequence[DataFrame], whole: DataFrame, key: str) -> DataFrame:
    """(key, status) of keys that are in several parts, in none, or not in the whole; empty if the parts divide it."""
    tagged = None
    for part in parts:
        own = part.select(key).distinct()
        tagged = own if tagged is None else tagged.unionByName(own)
    met = tagged.groupBy(F.col(key).alias("_p")).agg(F.count("*").alias("_n")).join(whole.select(F.col(key).alias("_w")).distinct(), F.col("_p") == F.col("_w"), "full_outer")
    status = F.when(F.col("_w").isNull(), "unexpected").when(F.col("_p").isNull(), "missing").when(F.col("_n") > 1, "shared")
    return met.select(F.coalesce("_w", "_p").alias(key), status.alias("status")).filter("status IS NOT NULL")
