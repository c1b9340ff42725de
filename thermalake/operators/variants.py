"""Held-out predictions of one-choice variants of a regression.

A variant changes one choice of the nominal regression: other inputs (fluxes
from another shape), another degree, or a regression for each regime instead of
one for all. All variants, folds and regimes are fitted from one pass over the
cases. What a variant has no training data for is returned without a
prediction, as unsupported, not left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermalake.functions.physics import polynomial_terms
from thermalake.operators.exact import exact_products
from thermalake.operators.fits import _symmetric, solve, spread


@dataclass(frozen=True)
class Variant:
    """A regression of the target on inputs; `regime` fits one for each of its values."""

    name: str
    inputs: Sequence[Column]
    degree: int = 1
    regime: Column | None = None


def held_out_variants(cases: DataFrame, keys: Sequence[str], variants: Sequence[Variant], target: Column, weight: Column, fold: Column, folds: int) -> DataFrame:
    """(keys, fold, variant, supported, prediction, residual): each case once for each variant, predicted by the cases of all other folds.

    A case without all inputs of a variant, or whose regime has fewer cases of
    positive weight in the other folds than the regression has coefficients, is
    not supported. Cases without a target train nothing and have no residual.
    Regimes are the few values of a column; null is one. Only sums whose size
    depends on the variants reach the driver, the same for any partitioning.
    """
    if len({v.name for v in variants}) != len(variants):
        raise ValueError("variants share a name")
    own = cases.select(*keys, target.cast("double").alias("_y"), weight.cast("double").alias("_w"), fold.cast("int").alias("_fold"), *_columns(variants))
    regimes = {v.name: _values(own, f"_r{i}") if v.regime is not None else [None] for i, v in enumerate(variants)}
    plans, columns = [], []
    for i, v in enumerate(variants):
        inputs = [F.col(f"_x{i}_{j}") for j in range(len(v.inputs))]
        complete = F.col("_y").isNotNull() & (F.col("_w") > 0)
        for x in inputs:
            complete = complete & x.isNotNull() & ~F.isnan(x)
        train = F.when(complete, F.col("_w")).otherwise(0.0)
        mean, scale = spread(own, [F.when(complete, x) for x in inputs], train)
        scaled = [(x - float(m)) / float(s) for x, m, s in zip(inputs, mean, scale, strict=True)]
        terms = [F.lit(1.0), *polynomial_terms(scaled, v.degree)]
        place = F.lit(0)
        for at, value in enumerate(regimes[v.name]):
            place = F.when(F.col(f"_r{i}").eqNullSafe(F.lit(value)), at).otherwise(place) if v.regime is not None else place
        plans.append((v, terms, place, complete))
        columns += [*[F.when(complete, t).otherwise(0.0) for t in terms], train, place.cast("double")]
    columns += [F.coalesce("_y", F.lit(0.0)), F.col("_fold").cast("double")]

    layout = [(len(terms), len(regimes[v.name])) for v, terms, *_ in plans]  # columns don't travel to tasks

    def grams(block: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        found, at = [], 0
        for size, groups in layout:
            x = np.column_stack([block[:, at : at + size], block[:, -2]])
            w, regime = block[:, at + size], block[:, at + size + 1]
            at += size + 2
            for g in range(groups):
                for k in range(folds):
                    rows = (regime == g) & (block[:, -1] == k) & (w > 0)
                    # the last line counts the rows: each begins with a one
                    found.append((np.column_stack([x[rows] * w[rows, None], np.ones(rows.sum())]), x[rows]))
        return found

    sums, models, at = exact_products(own, columns, grams), [], 0
    for v, terms, *_ in plans if sums else ():
        groups = len(regimes[v.name])
        held, at = np.array(sums[at : at + groups * folds]).reshape(groups, folds, len(terms) + 2, len(terms) + 1), at + groups * folds
        for g in range(groups):
            for k in range(folds):
                train = held[g].sum(0) - held[g, k]
                if train[-1, 0] >= len(terms):
                    models.append((v.name, g, k, solve(_symmetric(train[:-1])).tolist()))
    table = cases.sparkSession.createDataFrame(models, "_variant string, _regime int, _k int, _c array<double>")
    each = F.array(*[F.struct(F.lit(v.name).alias("variant"), place.cast("int").alias("place"), F.when(_present(i, v), F.array(*terms)).alias("terms")) for i, (v, terms, place, _) in enumerate(plans)])
    long = own.select(*keys, "_y", F.col("_fold").alias("fold"), F.explode(each).alias("_e")).select(*keys, "_y", "fold", "_e.*")
    met = long.join(F.broadcast(table), (F.col("variant") == F.col("_variant")) & (F.col("place") == F.col("_regime")) & (F.col("fold") == F.col("_k")), "left")
    prediction = F.aggregate(F.zip_with("terms", "_c", lambda t, c: t * c), F.lit(0.0), lambda s, x: s + x)
    met = met.withColumn("prediction", prediction)
    return met.select(*keys, "fold", "variant", F.col("prediction").isNotNull().alias("supported"), "prediction", (F.col("prediction") - F.col("_y")).alias("residual"))


def _columns(variants: Sequence[Variant]) -> list[Column]:
    inputs = [x.cast("double").alias(f"_x{i}_{j}") for i, v in enumerate(variants) for j, x in enumerate(v.inputs)]
    return inputs + [v.regime.alias(f"_r{i}") for i, v in enumerate(variants) if v.regime is not None]


def _present(i: int, v: Variant) -> Column:
    good = F.lit(True)
    for j in range(len(v.inputs)):
        good = good & F.col(f"_x{i}_{j}").isNotNull() & ~F.isnan(f"_x{i}_{j}")
    return good


def _values(df: DataFrame, column: str, most: int = 100) -> list:
    found = [r[0] for r in df.select(column).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} regimes")
    return sorted(found, key=lambda v: (v is None, str(v)))


def checked_closure(variants: DataFrame, keys: Sequence[str], nominal: str, residuals: DataFrame, residual: str, tol: float = 1e-6) -> DataFrame:
    """The variants, raising if the nominal one's residuals are not those that are stored, or lack or add a case."""
    own = variants.filter((F.col("variant") == nominal) & F.col("supported")).select(*keys, F.col("residual").alias("_own"))
    other = residuals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(residual).alias("_stored"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    far = own.join(other, on, "full").filter(~F.coalesce(F.abs(F.col("_own") - F.col("_stored")) <= tol, F.lit(False))).limit(1).count()
    if far:
        raise ValueError(f"the {nominal} variant does not close with the stored residuals")
    return variants
