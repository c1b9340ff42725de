"""Model tables: shapes, polynomials and mixtures beside what is known about them, checked when they are read."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from thermalake.functions.physics import angular_integral, limb_value
from thermalake.operators.fits import Polynomial

FORMS = {"linear": 1, "quadratic": 2}


def write_model(table: DataFrame, path: str, **about) -> None:
    """A model's rows and, beside them, one JSON line that says what they are."""
    table.write.mode("overwrite").parquet(f"{path}/rows")
    line = json.dumps(about, sort_keys=True, allow_nan=False)
    table.sparkSession.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def read_model(spark: SparkSession, path: str, most: int, **wanted) -> list:
    """The rows of a model of at most `most` rows; raises if it has more, or is about something else than wanted."""
    wrong = differences(spark, path, wanted)
    if wrong is None:
        raise FileNotFoundError(f"there is no model at {path}")
    if wrong:
        raise ValueError("the model differs in " + ", ".join(wrong))
    rows = spark.read.parquet(f"{path}/rows").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the model has more than {most} rows")
    return rows


def differences(spark: SparkSession, path: str, wanted: dict) -> list[str] | None:
    """In what the model at the path is about something else than wanted; None if there is no model."""
    try:
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    except Exception as why:
        if "PATH_NOT_FOUND" in str(why):
            return None
        raise
    return [f"{k}: {about.get(k)!r} instead of {wanted[k]!r}" for k in sorted(wanted) if about.get(k) != wanted[k]]


def stored_or_fitted(spark: SparkSession, path: str, fit: Callable[[], DataFrame], read: Callable[[], object], **about):
    """What `read` makes of the model at the path, which is fitted and written first if there is none that is about the same."""
    if differences(spark, path, about) != []:
        write_model(fit(), path, **about)
    return read()


def hemisphere(points: int = 901) -> np.ndarray:
    """The two basis functions of radiance shapes over zenith angles from 0 to 90 degrees."""
    angles = np.linspace(0, 90, points)
    return np.stack([np.array([limb_value(a) for a in angles]) - 1, np.cos(np.radians(angles)) ** 2 - math.cos(math.radians(55)) ** 2], 1)


def write_shapes(shapes: DataFrame, path: str, form: str, **about) -> None:
    """(scene, channel, parameters) of a shape library."""
    write_model(shapes.selectExpr("CAST(scene AS int) AS scene", "channel", "parameters"), path, kind="shapes", form=form, **about)


def read_shapes(spark: SparkSession, path: str, scenes: int, channels: Sequence[str], form: str = "linear", **wanted) -> DataFrame:
    """(scene, channel, parameters, integral): one row for each scene and channel, of shapes positive over the hemisphere.

    Raises if a scene or channel is missing, repeated or unknown, if parameters
    are not finite or of another number, or if the library is of another form.
    """
    size, basis = FORMS[form], hemisphere()[:, : FORMS[form]]
    rows = read_model(spark, path, scenes * len(channels), kind="shapes", form=form, **wanted)
    held = {(r["scene"], r["channel"]): list(r["parameters"]) for r in rows}
    expected = {(s, c) for s in range(scenes) for c in channels}
    if len(rows) != len(expected) or held.keys() != expected:
        raise ValueError("the library lacks, repeats or adds scenes or channels")
    out = []
    for (scene, channel), b in sorted(held.items()):
        if len(b) != size or not np.isfinite(b).all():
            raise ValueError(f"scene {scene}, {channel}: parameters are not {size} finite numbers")
        if (1 + basis @ b <= 0).any():
            raise ValueError(f"scene {scene}, {channel}: the shape is not positive everywhere")
        out.append((scene, channel, b, angular_integral(b)))
    return spark.createDataFrame(out, "scene int, channel string, parameters array<double>, integral double")


def write_polynomial(spark: SparkSession, fit: Polynomial, path: str, **about) -> None:
    row = (fit.degree, fit.intercept, list(fit.coefficients), list(fit.mean), list(fit.scale))
    table = spark.createDataFrame([row], "degree int, intercept double, coefficients array<double>, mean array<double>, scale array<double>")
    write_model(table, path, kind="polynomial", degree=fit.degree, **about)


def read_polynomial(spark: SparkSession, path: str, values: int, **wanted) -> Polynomial:
    """A polynomial in `values` variables; raises if it hasn't a coefficient for each term or one is not finite."""
    row = read_model(spark, path, 1, kind="polynomial", **wanted)[0]
    fit = Polynomial(tuple(row["mean"]), tuple(row["scale"]), row["degree"], row["intercept"], tuple(row["coefficients"]))
    if len(fit.mean) != values or len(fit.scale) != values or len(fit.coefficients) != math.comb(values + fit.degree, fit.degree) - 1:
        raise ValueError(f"not a polynomial of degree {fit.degree} in {values} variables")
    if not np.isfinite([fit.intercept, *fit.coefficients, *fit.mean, *fit.scale]).all() or min(fit.scale) <= 0:
        raise ValueError("the polynomial has numbers that are not finite, or no scale")
    return fit


def write_mixture(spark: SparkSession, model: dict, path: str, **about) -> None:
    rows = [(j, float(w), list(map(float, m)), [list(map(float, r)) for r in c]) for j, (w, m, c) in enumerate(zip(model["weight"], model["mean"], model["covariance"], strict=True))]
    write_model(spark.createDataFrame(rows, "component int, weight double, mean array<double>, covariance array<array<double>>"), path, kind="mixture", **about)


def read_mixture(spark: SparkSession, path: str, components: int, **wanted) -> dict:
    """weight, mean and covariance by component, with precision_cholesky as the scoring expressions take it."""
    rows = sorted(read_model(spark, path, components, kind="mixture", **wanted), key=lambda r: r["component"])
    weight, mean, cov = (np.array([r[k] for r in rows]) for k in ("weight", "mean", "covariance"))
    if [r["component"] for r in rows] != list(range(components)) or (weight <= 0).any() or abs(weight.sum() - 1) > 1e-8:
        raise ValueError("the mixture's components are incomplete, or their weights don't sum to 1")
    if not np.isfinite(mean).all() or cov.shape != (components, mean.shape[1], mean.shape[1]) or any(np.linalg.eigvalsh(c).min() <= 0 for c in cov):
        raise ValueError("a component has no finite mean or no positive covariance")
    # precision = U U^T with U upper triangular
    upper = [np.linalg.inv(np.linalg.cholesky(c)).T for c in cov]
    return {"weight": weight, "mean": mean, "covariance": cov, "components": [{"weight": float(w), "mean": m.tolist(), "precision_cholesky": u.tolist()} for w, m, u in zip(weight, mean, upper, strict=True)]}
