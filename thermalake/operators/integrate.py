"""Simpson integration over ordered samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def simpson(points: Column) -> Column:
    """Composite Simpson over an array of structs (x, y) in the order of x, on any grid.

    With an even number of samples the last interval takes the parabola through
    the last three. Two samples give a trapezoid, one gives 0.
    """
    n = F.size(points)
    at = lambda i, f: F.element_at(points, i)[f]

    def parabola(i: Column) -> Column:
        x0, x1, x2 = at(i, "x"), at(i + 1, "x"), at(i + 2, "x")
        y0, y1, y2 = at(i, "y"), at(i + 1, "y"), at(i + 2, "y")
        h0, h1 = x1 - x0, x2 - x1
        return (h0 + h1) / 6.0 * (y0 * (2.0 - h1 / h0) + y1 * (h0 + h1) * (h0 + h1) / (h0 * h1) + y2 * (2.0 - h0 / h1))

    whole = n - F.when(n % 2 == 0, 1).otherwise(0)
    starts = F.sequence(F.lit(1), whole - 2, F.lit(2))
    body = F.aggregate(F.transform(starts, parabola), F.lit(0.0), lambda a, b: a + b)
    h1, h0 = at(n, "x") - at(n - 1, "x"), at(n - 1, "x") - at(n - 2, "x")
    a = (2.0 * h1 * h1 + 3.0 * h0 * h1) / (6.0 * (h0 + h1))
    b = (h1 * h1 + 3.0 * h0 * h1) / (6.0 * h0)
    c = h1 * h1 * h1 / (6.0 * h0 * (h0 + h1))
    last = a * at(n, "y") + b * at(n - 1, "y") - c * at(n - 2, "y")
    trapezoid = (at(2, "x") - at(1, "x")) * (at(1, "y") + at(2, "y")) / 2.0
    return (
        F.when(n < 2, F.lit(0.0)).when(n == 2, trapezoid).when(n % 2 == 1, body).otherwise(body + last)
    )


def integrals(df: DataFrame, keys: Sequence[str], x: str, y: Column, low: float | None = None, high: float | None = None) -> DataFrame:
    """(keys, n, integral) of each ordered series; equal x are averaged first.

    With bounds, samples at them are interpolated in, and a series that does
    not reach a bound raises.
    """
    one = df.groupBy(*keys, F.col(x).cast("double").alias("x")).agg(F.avg(y).alias("y"))
    points = F.array_sort(F.collect_list(F.struct("x", "y")))
    series = one.groupBy(*keys).agg(points.alias("points"))
    if low is not None and high is not None:
        series = series.withColumn("points", clip(F.col("points"), low, high))
    return series.select(*keys, F.size("points").alias("n"), simpson(F.col("points")).alias("integral"))


def clip(points: Column, low: float, high: float) -> Column:
    """The samples within the bounds and interpolated ones at the bounds."""

    def at(bound: float) -> Column:
        before = F.element_at(F.filter(points, lambda p: p["x"] <= bound), -1)
        after = F.element_at(F.filter(points, lambda p: p["x"] >= bound), 1)
        y = F.when(before["x"] == after["x"], before["y"]).otherwise(
            before["y"] + (F.lit(bound) - before["x"]) * (after["y"] - before["y"]) / F.nullif(after["x"] - before["x"], F.lit(0.0))
        )
        return F.struct(F.lit(float(bound)).alias("x"), y.alias("y"))

    covered = F.exists(points, lambda p: p["x"] <= low) & F.exists(points, lambda p: p["x"] >= high)
    inner = F.filter(points, lambda p: (p["x"] > low) & (p["x"] < high))
    whole = F.concat(F.array(at(low)), inner, F.array(at(high)))
    return F.when(covered, whole).otherwise(F.raise_error(F.lit("the samples do not cover the bounds")))
