"""Training tables and exploratory comparisons: compositions of samples, scores, mixtures and summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermalake.functions.rng import uniform
from thermalake.operators import fits, moments, sampling, scenes
from thermalake.sources import records
from thermalake.sources.tables import table


def scores(values: Sequence[Column], mean: Sequence[float], scale: Sequence[float], axes: Sequence[Sequence[float]]) -> list[Column]:
    """Scores of standardised values on each axis."""
    z = [(v - F.lit(float(m))) / F.lit(float(s)) for v, m, s in zip(values, mean, scale, strict=True)]
    return [sum((c * F.lit(float(a)) for c, a in zip(z, axis, strict=True)), F.lit(0.0)) for axis in axes]


def prepare_training(df: DataFrame, keys: Sequence[str], names: Sequence[str], path: str, keep: float = 0.98, least: int = 100) -> dict:
    """Fits scaler and axes to every row and writes the scores; raises if a value is not finite or rows get lost on the way.

    Returns mean, scale, axes and rows, by which the table can be replayed with
    `records.replayed` and other tables be scored.
    """
    clean = records.checked_numbers(df.select(*keys, *names), names)
    mean, scale, cov = fits.standardise(moments.scatter(clean, {n: F.col(n) for n in names}).collect(), list(names))
    axes, _ = fits.principal_axes(cov, scale, keep)
    out = clean.select(*keys, *[s.alias(f"z{i}") for i, s in enumerate(scores([F.col(n) for n in names], mean, scale, axes))])
    return {"mean": mean.tolist(), "scale": scale.tolist(), "axes": axes.tolist(), "rows": records.write_counted(out, path, least), "columns": out.columns}


def sampled_comparison(df: DataFrame, day: str, key: str, names: Sequence[str], k: int, cap: int, seed: int = 42) -> tuple[DataFrame, dict]:
    """Rows with label, posterior and density under a mixture fitted to a bounded sample of each day, and what was fitted.

    The sample has the `cap` rows of the smallest keyed draws of each day. The
    density below which one sampled row of a hundred lies marks unusual rows.
    """
    sample = sampling.capped(df.select(day, key, *names), day, uniform(seed, day, key), cap, [key])
    values = [F.col(n).cast("double") for n in names]
    model = fits.mixture(sample, values, k, seed)
    parts = [{"weight": float(w), "mean": m.tolist(), "precision_cholesky": np.linalg.inv(np.linalg.cholesky(c)).T.tolist()} for w, m, c in zip(model["weight"], model["mean"], model["covariance"], strict=True)]
    density, post = scenes.responsibilities(values, parts)
    scored = df.withColumns({"density": density, "posterior": post}).withColumn("label", scenes.first_argmax(F.col("posterior")).cast("int"))
    threshold = sampling.quantiles(sample, [], density, [0.01]).first()[0]
    return scored, {"model": model, "threshold": threshold}


def sample_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture of a sample of each day's events labels all events: summaries overall and by type."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_id", "event_type", F.col("value").alias("a"), (F.col("user_id") % 17).cast("double").alias("b"))
    scored, about = sampled_comparison(e.filter("a IS NOT NULL"), "day", "event_id", ["a", "b"], 2, 50)
    return scenes.classification_summary(scored, ["event_type"], "label", ["a", "b"], F.col("posterior"), F.col("density"), about["threshold"])


QUERIES = {"sample_comparison": (sample_comparison, None)}
