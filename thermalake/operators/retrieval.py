"""Shapes of two parameters, fluxes from a shape library, view-subset studies and budget tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest_positive(curvature: np.ndarray, target: np.ndarray, grid: np.ndarray, margin: float) -> np.ndarray:
    """The two parameters nearest to `target` in the curvature's norm under which 1 + grid @ b keeps the margin everywhere.

    Outside the allowed polygon the answer lies on one of its edges, so the
    least cost along each constraint's feasible segment is compared.
    """
    room = margin - 1.0
    if (grid @ target >= room).all():
        return target
    best, least = None, np.inf
    for a in grid[np.abs(grid).max(1) > 1e-12]:
        base, along = a * room / (a @ a), np.array([-a[1], a[0]])
        rate, gap = grid @ along, room - 1e-12 - grid @ base
        if (gap[rate == 0] > 0).any():
            continue
        low = max((gap[rate > 0] / rate[rate > 0]).tolist(), default=-np.inf)
        high = min((gap[rate < 0] / rate[rate < 0]).tolist(), default=np.inf)
        if low > high:
            continue
        off = base - target
        at = base + np.clip(-(along @ curvature @ off) / (along @ curvature @ along), low, high) * along
        cost = (at - target) @ curvature @ (at - target)
        if cost < least:
            best, least = at, cost
    if best is None:
        raise ValueError("no shape is positive everywhere")
    return best


def quadratic_shapes(
    df: DataFrame, keys: Sequence[str], first: Sequence[Column], second: Sequence[Column], ratio: Column, grid: np.ndarray, rounds: int = 30, margin: float = 1e-6
) -> DataFrame:
    """(keys, n, b1, b2, rmse): the two-parameter shape of each group whose ratios between two angles are nearest to the observed.

    Gauss-Newton for all groups at once, one aggregation a round; every pair
    enters exactly. `grid` holds the two basis functions over the hemisphere,
    where the shape must stay positive. Groups whose angles don't tell the two
    parameters apart return null. Groups are those of a model, a few. Raises if
    a shape still moves after the last round.
    """
    names = ["_p1", "_p2", "_q1", "_q2", "_r"]
    rows = df.select(*keys, *[c.cast("double").alias(n) for n, c in zip(names, (*first, *second, ratio), strict=True)]).na.drop(subset=names).persist()
    spark, kinds = df.sparkSession, dict(df.dtypes)
    now: dict[tuple, np.ndarray | None] = {}
    schema = ", ".join([*(f"_k{i} {kinds[k]}" for i, k in enumerate(keys)), "_b1 double", "_b2 double"])
    got, settled = [], False
    try:
        for _ in range(rounds):
            if now:
                table = spark.createDataFrame([(*k, *map(float, b)) for k, b in now.items() if b is not None], schema)
                own = rows.join(F.broadcast(table), [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
            else:
                own = rows.withColumns({"_b1": F.lit(0.0), "_b2": F.lit(0.0)})
            top = 1.0 + F.col("_b1") * F.col("_p1") + F.col("_b2") * F.col("_p2")
            low = 1.0 + F.col("_b1") * F.col("_q1") + F.col("_b2") * F.col("_q2")
            own = own.withColumns({"_top": top, "_low": low})
            slope = lambda i: (F.col(f"_p{i}") * F.col("_low") - F.col(f"_q{i}") * F.col("_top")) / (F.col("_low") * F.col("_low"))
            own = own.withColumns({"_e": F.col("_top") / F.col("_low") - F.col("_r"), "_s1": slope(1), "_s2": slope(2)})
            cross = lambda a, b: F.sum(F.col(a) * F.col(b))
            sums = own.groupBy(*keys).agg(
                F.count("*").alias("n"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.first("_b1").alias("b1"), F.first("_b2").alias("b2"),
                cross("_s1", "_s1").alias("h11"), cross("_s1", "_s2").alias("h12"), cross("_s2", "_s2").alias("h22"), cross("_s1", "_e").alias("g1"), cross("_s2", "_e").alias("g2"),
            )
            step, moved = sums.collect(), 0.0
            got = got or step
            rmse = {tuple(g[k] for k in keys): g["rmse"] for g in step}
            for g in step:
                key = tuple(g[k] for k in keys)
                h, b = np.array([[g["h11"], g["h12"]], [g["h12"], g["h22"]]]), np.array([g["b1"], g["b2"]])
                if np.linalg.cond(h) > 1e12:
                    now[key] = None
                    continue
                now[key] = nearest_positive(h, b - np.linalg.solve(h, [g["g1"], g["g2"]]), grid, margin)
                moved = max(moved, float(np.abs(now[key] - b).max()))
            if moved < 1e-9 or all(b is None for b in now.values()):
                settled = True
                break
    finally:
        rows.unpersist()
    if not settled:
        raise ValueError(f"the shapes did not settle in {rounds} rounds")
    out = []
    for g in got:
        key = tuple(g[k] for k in keys)
        b = now[key]
        out.append((*key, g["n"], *((None, None, None) if b is None else (*map(float, b), rmse[key]))))
    return spark.createDataFrame(out, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n long, b1 double, b2 double, rmse double"]))


def library_flux(df: DataFrame, keys: Sequence[str], radiance: Column, shape: Column, integral: Column) -> DataFrame:
    """(keys, views, amplitude, flux) of each case from its views under known shapes, by the best common amplitude."""
    amplitude = F.try_divide(F.sum(radiance * shape), F.sum(F.when(radiance.isNotNull(), shape * shape)))
    out = df.groupBy(*keys).agg(F.count(radiance * shape).alias("views"), amplitude.alias("amplitude"), F.max(integral).alias("_i"))
    return out.select(*keys, "views", "amplitude", (F.lit(np.pi) * F.col("amplitude") * F.col("_i")).alias("flux"))


def geometry_study(
    df: DataFrame, case: str, view: str, subsets: dict[str, Sequence], basis: Column, radiance: Column, basis_integral: float, truth: Column
) -> DataFrame:
    """(geometry, cases, unidentifiable, bias, rmse): retrieval with free amplitude from subsets of the views.

    Each row is copied once per subset that holds its view; cases whose views
    in a subset share one angle are counted as unidentifiable there.
    """
    names = F.array_compact(F.array(*[F.when(F.col(view).isin(list(held)), F.lit(name)) for name, held in subsets.items()]))
    own = df.select(case, F.explode(names).alias("geometry"), basis.alias("_b"), radiance.alias("_l"), truth.alias("_t"))
    fit = own.groupBy("geometry", case).agg(
        F.when(F.var_pop("_b") > 1e-12, F.lit(np.pi) * (F.regr_intercept("_l", "_b") + F.lit(basis_integral) * F.regr_slope("_l", "_b"))).alias("flux"),
        F.max("_t").alias("truth"),
    )
    error = F.col("flux") - F.col("truth")
    return fit.groupBy("geometry").agg(
        F.count("*").alias("cases"), F.count_if(F.col("flux").isNull()).alias("unidentifiable"), F.avg(error).alias("bias"), F.sqrt(F.avg(error * error)).alias("rmse")
    )


def noisy_geometry_study(
    df: DataFrame, case: str, view: str, subsets: dict[str, Sequence], basis: Sequence[Column], radiance: Column, integrals: Sequence[float], truth: Column, noise: Sequence[Column]
) -> DataFrame:
    """(geometry, form, realization, cases, unidentifiable, bias, rmse) of retrievals with free amplitude.

    form 1 fits the first basis function, form 2 both; realization 0 is without
    noise. A realization's noise belongs to the view, so all geometries and
    forms see the same. Least squares per case from sums of products about the
    views' means; a case whose views don't tell the parameters apart is counted
    as unidentifiable.
    """
    names = F.array_compact(F.array(*[F.when(F.col(view).isin(list(held)), F.lit(name)) for name, held in subsets.items()]))
    drawn = F.posexplode(F.array(radiance, *[radiance + z for z in noise])).alias("realization", "_l")
    # one exchange of the rows as they are: copies for subsets and realizations are made behind it and meet without another
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // 200_000))
    own = df.repartition(parts, case).select(case, names.alias("_names"), *[b.cast("double").alias(f"_b{i}") for i, b in enumerate(basis)], truth.alias("_t"), drawn)
    own = own.select(case, F.explode("_names").alias("geometry"), "realization", "_b0", "_b1", "_l", "_t")
    x, y, l = F.col("_b0"), F.col("_b1"), F.col("_l")
    sums = own.groupBy("geometry", "realization", case).agg(
        F.max("_t").alias("t"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(l).alias("ml"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy"), F.covar_pop(x, l).alias("xl"), F.covar_pop(y, l).alias("yl"),
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    one = F.when(F.col("xx") > 1e-12, F.col("xl") / F.col("xx"))
    apart = det > 1e-6 * F.col("xx") * F.col("yy")
    two = [F.when(apart, (F.col("xl") * F.col("yy") - F.col("yl") * F.col("xy")) / det), F.when(apart, (F.col("yl") * F.col("xx") - F.col("xl") * F.col("xy")) / det)]
    pi = F.lit(float(np.pi))
    flux1 = pi * (F.col("ml") - one * F.col("mx") + float(integrals[0]) * one)
    flux2 = pi * (F.col("ml") - two[0] * F.col("mx") - two[1] * F.col("my") + float(integrals[0]) * two[0] + float(integrals[1]) * two[1])
    forms = F.explode(F.array(F.struct(F.lit(1).alias("form"), flux1.alias("flux")), F.struct(F.lit(2).alias("form"), flux2.alias("flux")))).alias("f")
    error = F.col("f.flux") - F.col("t")
    got = sums.select("geometry", "realization", "t", forms).select("geometry", "realization", F.col("f.form").alias("form"), error.alias("e"))
    return got.groupBy("geometry", "form", "realization").agg(
        F.count("*").alias("cases"), F.count_if(F.col("e").isNull()).alias("unidentifiable"), F.avg("e").alias("bias"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse")
    )


def budget_table(budget: DataFrame, order: Sequence[str]) -> DataFrame:
    """(position, component, bias, rmse) as report cells with signs, in the given order; a component without a row raises."""
    places = F.array(*[F.lit(c) for c in order])
    rows = budget.sparkSession.createDataFrame(list(enumerate(order)), "position int, name string")
    met = rows.join(budget.filter(F.array_contains(places, F.col("component"))), F.col("name") == F.col("component"), "left")
    cell = lambda c: F.when(F.col("component").isNull(), F.raise_error(F.concat(F.lit("no row of "), F.col("name"))).cast("string")).otherwise(F.format_string("%+.3f", F.col(c)))
    return met.select("position", F.col("name").alias("component"), cell("bias").alias("bias"), cell("rmse").alias("rmse"))
