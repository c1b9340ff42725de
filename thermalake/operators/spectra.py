"""Spectra to bands: integrals over channel responses as one aggregation with fixed kernels.

Spectra share a wavelength grid. An integral by Simpson's rule of a spectrum
times a response is then a sum of samples times fixed weights, so bands are
sums over a small table joined by wavelength, with partial sums in every task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermalake.functions import physics


def simpson_weights(x: np.ndarray) -> np.ndarray:
    """What each sample of an ordered grid counts for in the composite rule of `integrate.simpson`."""
    w, n = np.zeros(len(x)), len(x)
    if n == 2:
        return np.full(2, (x[1] - x[0]) / 2)
    for i in range(0, n - 2, 2):
        h0, h1 = x[i + 1] - x[i], x[i + 2] - x[i + 1]
        w[i : i + 3] += (h0 + h1) / 6 * np.array([2 - h1 / h0, (h0 + h1) ** 2 / (h0 * h1), 2 - h0 / h1])
    if n > 2 and n % 2 == 0:
        h0, h1 = x[-2] - x[-3], x[-1] - x[-2]
        w[-3:] += [-(h1**3) / (6 * h0 * (h0 + h1)), (h1 * h1 + 3 * h0 * h1) / (6 * h0), (2 * h1 * h1 + 3 * h0 * h1) / (6 * (h0 + h1))]
    return w


def _key(wavelength: Column) -> Column:
    """A wavelength in micrometres as a whole number of picometres, so that it can be joined."""
    return F.round(wavelength * 1e6).cast("long")


def band_kernels(spark: SparkSession, grid: Sequence[float], responses: dict[str, tuple[Sequence[float], Sequence[float]]], equivalent: bool = False) -> DataFrame:
    """(channel, at, kernel): weights of the samples of a grid (micrometres) in each channel's integral.

    Responses are interpolated on the grid, zero outside their own. With
    `equivalent` the integral becomes the equivalent radiance per wavenumber,
    1000 times the integral of radiance times response over that of response
    times 1e4 / wavelength^2. Raises for a response that the grid doesn't see.
    """
    x = np.asarray(grid, float)
    if (np.diff(x) <= 0).any():
        raise ValueError("the grid does not rise")
    weights, rows = simpson_weights(x), []
    for channel, (at, response) in responses.items():
        kernel = weights * np.interp(x, at, response, 0.0, 0.0)
        if not kernel.any():
            raise ValueError(f"{channel}: no response on the grid")
        if equivalent:
            kernel = 1000.0 * kernel / (kernel * 1e4 / x**2).sum()
        rows += [(channel, int(round(a * 1e6)), float(k)) for a, k in zip(x, kernel, strict=True)]
    return spark.createDataFrame(rows, "channel string, at long, kernel double")


def logistic_bands(grid: Sequence[float], bands: dict[str, tuple[float, float]], slope: float) -> dict[str, tuple[Sequence[float], Sequence[float]]]:
    """Responses of bands with logistic edges, sampled on a grid."""
    x = np.asarray(grid, float)
    edge = lambda d: 1.0 / (1.0 + np.exp(-slope * d))
    return {name: (x, edge(x - low) * edge(high - x)) for name, (low, high) in bands.items()}


def channel_scenarios(settings: dict[str, dict[str, Sequence[float]]]) -> dict[str, dict[str, tuple[float, float]]]:
    """Passbands (low, high) by channel of each scenario; raises for bands that are empty or overlap, and scenarios without any."""
    out = {}
    for scenario, bands in settings.items():
        held = {c: (float(b[0]), float(b[1])) for c, b in bands.items()}
        order = sorted(held.values())
        if not order or any(not 0 < low < high for low, high in order) or any(a[1] > b[0] for a, b in zip(order, order[1:], strict=False)):
            raise ValueError(f"{scenario}: passbands are missing, empty or overlap")
        out[scenario] = held
    return out


def band_integrals(spectra: DataFrame, keys: Sequence[str], wavelength: Column, value: Column, kernels: DataFrame, points: int) -> DataFrame:
    """(keys, channel, integral) of each spectrum; raises for one that lacks, repeats or has null samples, or has no positive integral."""
    own = spectra.select(*keys, _key(wavelength).alias("_at"), value.cast("double").alias("_v"))
    # from the left, so that a spectrum none of whose samples lie on the grid is seen: it comes with a null channel
    # the kernels are a fixed number of rows; a join by shuffle would put a spectrum's samples, and all spectra's, into as many tasks as the grid has wavelengths
    met = own.join(F.broadcast(kernels), F.col("_at") == F.col("at"), "left")
    sums = met.groupBy(*keys, "channel").agg(F.count("_v").alias("_n"), F.count("*").alias("_all"), F.sum(F.col("_v") * F.col("kernel")).alias("integral"))
    bad = F.col("channel").isNull() | (F.col("_n") != points) | (F.col("_all") != points) | ~(F.col("integral") > 0)
    checked = F.when(bad, F.raise_error(F.lit("a spectrum is incomplete or has no positive integral")).cast("double")).otherwise(F.col("integral"))
    return sums.select(*keys, "channel", checked.alias("integral"))


def blackbody_spectra(cases: DataFrame, temperature: Column, grid: Sequence[float]) -> DataFrame:
    """The rows with `wavelength` (micrometres) and `radiance` (per micrometre) of a black body of their temperature."""
    spread = cases.repartition(4 * cases.sparkSession.sparkContext.defaultParallelism)  # a small file of cases is a large one of samples
    wide = spread.withColumn("wavelength", F.explode(F.array(*[F.lit(float(x)) for x in grid])))
    return wide.withColumn("radiance", physics.blackbody(F.col("wavelength") * 1e-6, temperature) * (1e-6 / np.pi))


def roundtrip(spark: SparkSession, grid: Sequence[float], responses: dict[str, tuple[Sequence[float], Sequence[float]]], coefficients: dict[str, tuple[float, float]], low: float = 180.0, high: float = 330.0, cases: DataFrame | None = None) -> DataFrame:
    """(channel, temperatures, error): the largest error of black bodies' temperatures found from their equivalent radiances.

    `coefficients` are fk1 and fk2 of each channel. The temperatures are the
    different ones of the column `temperature` of `cases`, or whole degrees from
    `low` to `high`.
    """
    whole = spark.range(int(high - low) + 1).select((F.col("id") + F.lit(low)).alias("temperature"))
    cases = whole if cases is None else cases.select(F.col("temperature").cast("double").alias("temperature")).na.drop().distinct()
    got = band_integrals(blackbody_spectra(cases, F.col("temperature"), grid), ["temperature"], F.col("wavelength"), F.col("radiance"), band_kernels(spark, grid, responses, True), len(grid))
    fk = spark.createDataFrame([(c, *map(float, k)) for c, k in coefficients.items()], "_channel string, fk1 double, fk2 double")
    met = got.join(F.broadcast(fk), F.col("channel") == F.col("_channel"))
    back = F.col("fk2") / F.log1p(F.col("fk1") / F.col("integral"))
    return met.groupBy("channel").agg(F.count("*").alias("temperatures"), F.max(F.abs(back - F.col("temperature"))).alias("error"))


def band_radiance(spark: SparkSession, response: tuple[Sequence[float], Sequence[float]], temperatures: Sequence[float], points: int = 1601) -> DataFrame:
    """(temperature, radiance) of a black body over a response within 4 to 20 micrometres, on a dense grid."""
    at = np.asarray(response[0], float)
    grid = np.linspace(max(4.0, at.min()), min(20.0, at.max()), points)
    cases = spark.createDataFrame([(float(t),) for t in temperatures], "temperature double")
    got = band_integrals(blackbody_spectra(cases, F.col("temperature"), grid), ["temperature"], F.col("wavelength"), F.col("radiance"), band_kernels(spark, grid, {"band": response}), points)
    return got.select("temperature", F.col("integral").alias("radiance"))


def power_law_fit(points: DataFrame, x: Column, y: Column, start: tuple[float, float] = (1e-2, 5.0), rounds: int = 60) -> tuple[float, float]:
    """a and b of y = (a x)^b by damped Gauss-Newton; each step is one aggregation of five sums.

    The first step fits a line to the logarithms where all values are positive.
    """
    own = points.select(x.cast("double").alias("x"), y.cast("double").alias("y")).na.drop()
    logs = own.filter("x > 0 AND y > 0").agg(F.regr_slope(F.log("y"), F.log("x")).alias("b"), F.regr_intercept(F.log("y"), F.log("x")).alias("c")).first()
    b = logs["b"] or start[1]
    at = np.array([np.exp(logs["c"] / b) if logs["b"] else start[0], b])

    def sums(p: np.ndarray):
        value = F.pow(F.lit(float(p[0])) * F.col("x"), F.lit(float(p[1])))
        ja, jb, e = value * (p[1] / p[0]), value * F.log(F.lit(float(p[0])) * F.col("x")), F.col("y") - value
        row = own.agg(*[F.sum(c).alias(n) for n, c in (("aa", ja * ja), ("ab", ja * jb), ("bb", jb * jb), ("ae", ja * e), ("be", jb * e), ("ee", e * e))]).first()
        return np.array([[row["aa"], row["ab"]], [row["ab"], row["bb"]]]), np.array([row["ae"], row["be"]]), row["ee"]

    damp, (h, g, cost) = 1e-6, sums(at)
    for _ in range(rounds):
        new = at + np.linalg.solve(h + damp * np.diag(np.diag(h)), g)
        if new[0] > 0:
            found = sums(new)
            if found[2] <= cost:
                done = np.abs(new / at - 1).max() < 1e-10
                at, damp, (h, g, cost) = new, damp / 10, found
                if done:
                    break
                continue
        damp *= 10
        if damp > 1e12:
            break
    return float(at[0]), float(at[1])
