"""Radiometric column functions; all stay inside generated code."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the retrieval.
STEFAN_BOLTZMANN = 5.670374e-8
FLUX_RANGE = (50.0, 1000.0)
BT_LIMIT = 1000.0
MAX_ZENITH = 70.0
REFERENCE_ANGLE = 55.0
PLANCK_H, PLANCK_C, PLANCK_K = 6.62607015e-34, 2.99792458e8, 1.380649e-23


def finite(x: Column) -> Column:
    """Neither null nor NaN nor infinite; NaN compares as the largest value, so it needs its own test."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def nullify(x: Column) -> Column:
    """Null for anything that is not finite, so that aggregates skip it."""
    return F.when(finite(x), x)


def brightness_temperature(radiance: Column, fk1, fk2, bc1=0.0, bc2=1.0) -> Column:
    """Inverse Planck function with band corrections; null unless the radiance is positive and finite."""
    good = (radiance > 0) & (radiance < float("inf"))  # NaN compares as the largest value
    value = F.lit(fk1) / F.when(good, radiance)
    return (F.lit(fk2) / F.log1p(value) - F.lit(bc1)) / F.lit(bc2)


def temperature_of_positive(radiance: Column, fk1, fk2, bc1=0.0, bc2=1.0) -> Column:
    """`brightness_temperature` of a radiance that is known to be positive and finite."""
    value = F.lit(fk2) / F.log1p(F.lit(fk1) / radiance)
    return value if (bc1, bc2) == (0.0, 1.0) else (value - F.lit(bc1)) / F.lit(bc2)


def planck_radiance(temperature: Column, fk1, fk2, bc1=0.0, bc2=1.0) -> Column:
    """Radiance of a brightness temperature."""
    return F.lit(fk1) / F.expm1(F.lit(fk2) / (F.lit(bc2) * temperature + F.lit(bc1)))


def blackbody(wavelength_m: Column, temperature: Column) -> Column:
    """Hemispheric spectral flux of a black body."""
    x = F.lit(PLANCK_H * PLANCK_C / PLANCK_K) / (wavelength_m * temperature)
    return F.lit(2 * math.pi * PLANCK_H * PLANCK_C**2) / F.pow(wavelength_m, F.lit(5.0)) / F.expm1(x)


def planck_derivative(wavelength_m: Column, temperature: Column) -> Column:
    """Derivative by temperature of the spectral radiance of a black body."""
    x = F.lit(PLANCK_H * PLANCK_C / PLANCK_K) / (wavelength_m * temperature)
    radiance = blackbody(wavelength_m, temperature) / F.lit(math.pi)
    return radiance * x * F.exp(x) / (temperature * F.expm1(x))


def valid_bt(bt: Column) -> Column:
    """Whether a temperature is in its range; null for null, false for NaN, which compares as the largest value."""
    return (bt > 0) & (bt < BT_LIMIT)


def limb_value(angle: float) -> float:
    """`limb` of one angle, on the driver."""
    return math.log(math.cos(math.radians(angle)) + 2.0) / math.log(math.cos(math.radians(REFERENCE_ANGLE)) + 2.0)


def limb(angle: Column) -> Column:
    """Logarithmic limb function of a zenith angle in degrees, 1 at the reference angle."""
    return F.log(F.cos(F.radians(angle)) + 2.0) / F.lit(math.log(math.cos(math.radians(REFERENCE_ANGLE)) + 2.0))


def angular_basis(angle: Column, quadratic: bool = False) -> list[Column]:
    """Basis functions of the radiance shape, zero at the reference angle."""
    basis = [limb(angle) - 1.0]
    if quadratic:
        cosine = F.cos(F.radians(angle))
        basis.append(cosine * cosine - math.cos(math.radians(REFERENCE_ANGLE)) ** 2)
    return basis


def radiance_shape(angle: Column, parameters: Sequence) -> Column:
    """1 + sum of parameter times basis function."""
    shape = F.lit(1.0)
    for value, basis in zip(parameters, angular_basis(angle, len(parameters) == 2), strict=True):
        shape = shape + value * basis
    return shape


def shape_from_ratio(ratio: Column, first: Column, second: Column) -> Column:
    """The one-parameter shape under which radiances at two angles have this ratio."""
    a, b = limb(first) - 1.0, limb(second) - 1.0
    return F.try_divide(ratio - 1.0, a - ratio * b)


def angular_integral(parameters: Sequence[float], points: int = 901) -> float:
    """Twice the integral of shape, cosine and sine over the hemisphere, by Simpson's rule; the shape must be positive."""
    base = math.log(math.cos(math.radians(REFERENCE_ANGLE)) + 2.0)
    step = math.pi / 2 / (points - 1)
    total = 0.0
    for i in range(points):
        cosine = math.cos(i * step)
        shape = 1 + parameters[0] * (math.log(cosine + 2.0) / base - 1)
        if len(parameters) == 2:
            shape += parameters[1] * (cosine * cosine - math.cos(math.radians(REFERENCE_ANGLE)) ** 2)
        if shape <= 0:
            raise ValueError("the radiance shape is not positive everywhere")
        weight = 1 if i in (0, points - 1) else 4 if i % 2 else 2
        total += weight * 2 * shape * cosine * math.sin(i * step)
    return total * step / 3


def correct_radiance(radiance: Column, angle: Column, parameters: Sequence, integral) -> Column:
    """Hemispheric mean radiance from a directional one; null where the shape is not positive."""
    shape = radiance_shape(angle, parameters)
    return F.when(shape > 0, radiance * integral / shape)


def polynomial_terms(values: Sequence[Column], degree: int) -> list[Column]:
    """All monomials of degree 1 to `degree`: single factors, then pairs i <= j, then triples i <= j <= l."""
    terms = []
    for size in range(1, degree + 1):
        for chosen in itertools.combinations_with_replacement(range(len(values)), size):
            term = values[chosen[0]]
            for i in chosen[1:]:
                term = term * values[i]
            terms.append(term)
    return terms


def polynomial(values: Sequence[Column], coefficients: Sequence[float], intercept: float, degree: int) -> Column:
    """Intercept plus coefficients times monomials, added in order."""
    total = F.lit(float(intercept))
    for c, term in zip(coefficients, polynomial_terms(values, degree), strict=True):
        total = total + F.lit(float(c)) * term
    return total


def stored(x: Column) -> Column:
    """Single precision, as products are stored; the rounding is part of the result."""
    return x.cast("float").cast("double")


def broadband_flux(effective: Column) -> Column:
    """Flux of an effective temperature; null unless both are in their valid ranges."""
    flux = F.lit(STEFAN_BOLTZMANN) * effective * effective * effective * effective
    return F.when((effective > 0) & flux.between(*FLUX_RANGE), flux)


def spectral_irradiance(radiance: Column) -> Column:
    return F.lit(math.pi) * radiance / 1000.0


def noise_sd(nedt: Column, fk1, fk2, bc1=0.0, bc2=1.0, at: float = 255.0) -> Column:
    """Radiance noise from a temperature noise at one scene temperature."""
    base = F.lit(bc1) + F.lit(bc2) * at
    a = F.lit(fk2) / base
    return nedt * F.lit(fk1) * F.exp(a) * F.lit(fk2) * F.lit(bc2) / F.pow(F.expm1(a) * base, F.lit(2.0))


def lognormal_radiance(radiance: Column, sd: Column, z: Column) -> Column:
    """Positive noise that keeps the mean and the standard deviation; exact where the latter is zero.

    An error where a radiance is not positive, or the result is zero or infinite.
    """
    v = F.log1p(F.pow(sd / F.when(radiance > 0, radiance), F.lit(2.0)))
    value = F.exp(F.log(radiance) + F.sqrt(v) * z - v / 2.0)
    wrong = (radiance <= 0) | (value <= 0) | (value == float("inf"))
    return F.when(sd == 0, radiance).when(wrong, F.raise_error(F.lit("noise leaves the range of radiances")).cast("double")).otherwise(value)


def power_law(x: Column, a: float, b: float) -> Column:
    return F.pow(F.lit(a) * x, F.lit(b))


def inverse_power_law(y: Column, a: float, b: float) -> Column:
    return F.pow(y, F.lit(1.0 / b)) / a


def channel_response(wavelength: Column, low: float, high: float, slope: float) -> Column:
    """A band with logistic edges."""
    edge = lambda x: 1.0 / (1.0 + F.exp(-F.lit(slope) * x))
    return edge(wavelength - low) * edge(F.lit(high) - wavelength)


def safe_ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(b.isNotNull() & (b != 0), a / F.nullif(b, F.lit(0.0))).otherwise(F.lit(0.0))


def angle_bin(angle: Column, edges: Sequence[float]) -> Column:
    """Number of the right-open bin, the last one closed; anything else, NaN and null too, gets one past the last."""
    bins = len(edges) - 1
    out = F.lit(bins)
    for i in reversed(range(bins)):
        upper = angle <= edges[i + 1] if i == bins - 1 else angle < edges[i + 1]
        out = F.when((angle >= edges[i]) & upper, i).otherwise(out)
    return F.when(finite(angle), out).otherwise(F.lit(bins))


def spectral_features(bt: Sequence[Column]) -> list[Column]:
    """Six temperatures of channels 8, 11, 12, 14, 15, 16, and the differences of 14 to 11, 15, 8 and 16."""
    return [*bt, bt[3] - bt[1], bt[3] - bt[4], bt[3] - bt[0], bt[3] - bt[5]]


def _all_within(*groups: tuple[Sequence[Column], float]) -> Column:
    """Whether all columns of each group are above 0 and below its limit; a null is a no.

    A null becomes NaN, which compares as the largest value: no comparison then
    carries a null along, which keeps the generated code small.
    """
    good = F.lit(True)
    for columns, limit in groups:
        for c in columns:
            value = F.coalesce(c, F.lit(float("nan")))
            good = good & (value > 0.0) & (value < limit)
    return good


def overlap(raw: Sequence[Column], corrected: Sequence[Column], temperatures: Sequence[Column], angles: Sequence[Column]) -> Column:
    """Whether both satellites see a pixel: raw radiances positive, corrected ones between 0 and 1,000, temperatures and angles in range.

    The columns are those of both satellites; a null is a no. NaN compares as the largest value.
    """
    good = _all_within((raw, float("inf")), (corrected, 1000.0), (temperatures, BT_LIMIT))
    for c in angles:
        good = good & F.coalesce(c.between(0.0, MAX_ZENITH), F.lit(False))
    return good


def legacy_mask(radiances: Sequence[Column]) -> Column:
    """Whether all radiances are between 0 and 1,000, at any angle."""
    return _all_within((radiances, 1000.0))


def noisy_features(first: Sequence[Column], second: Sequence[Column], noise: Sequence[tuple[Column, Column]], fk1, fk2) -> list[Column]:
    """The ten features of the mean temperatures of two satellites with noise added to their radiances; an error where noise leaves none."""

    def temperature(radiance: Column, extra: Column) -> Column:
        shaken = radiance + extra
        none = F.raise_error(F.lit("noise leaves no radiance")).cast("double")
        return F.when(shaken <= 0, none).when(shaken < float("inf"), temperature_of_positive(shaken, fk1, fk2))

    means = [(temperature(a, x) + temperature(b, y)) / 2.0 for a, b, (x, y) in zip(first, second, noise, strict=True)]
    return spectral_features(means)
