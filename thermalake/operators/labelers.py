"""Scene labels by any fitted model.

A labeler turns feature columns into a whole-number label column. A mixture is
a few expressions; any other model is a function of a batch of features, which
runs once per Arrow batch under a contract that is checked for every batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermalake.operators.constrained import made
from thermalake.operators.scenes import first_argmax, log_sum, log_weights, responsibilities


class Labeler(Protocol):
    """Anything with labels of features: 0 to `classes` - 1, null where a feature is null or not finite."""

    classes: int

    def label(self, features: Sequence[Column]) -> Column: ...


def _complete(features: Sequence[Column]) -> Column:
    good = F.lit(True)
    for f in features:
        good = good & F.coalesce(F.abs(f.cast("double")) < float("inf"), F.lit(False))
    return good


class MixtureLabeler:
    """The likeliest component of a Gaussian mixture, as expressions inside the plan; ties go to the smaller label."""

    def __init__(self, weight: np.ndarray, mean: np.ndarray, covariance: np.ndarray):
        self.classes = len(weight)
        self.components = [
            {"weight": float(w), "mean": m.tolist(), "precision_cholesky": np.linalg.inv(np.linalg.cholesky(c)).T.tolist()} for w, m, c in zip(weight, mean, covariance, strict=True)
        ]

    def label(self, features: Sequence[Column]) -> Column:
        _, shares = responsibilities([f.cast("double") for f in features], self.components)
        return F.when(_complete(features), first_argmax(shares).cast("int"))

    def added(self, df: DataFrame, features: Sequence[Column], name: str) -> DataFrame:
        """The rows with the label, made in steps that name their results: as one expression the features' logs come 96 times at three components."""
        at = range(self.classes)
        rows = made(df, **{f"_z{i}": f.cast("double") for i, f in enumerate(features)}, _good=_complete(features))
        rows = made(rows, **{f"_log{i}": log for i, log in enumerate(log_weights([F.col(f"_z{i}") for i in range(len(features))], self.components))})
        rows = made(rows, _density=log_sum([F.col(f"_log{i}") for i in at]))
        rows = made(rows, _shares=F.array(*[F.exp(F.col(f"_log{i}") - F.col("_density")) for i in at]))
        rows = made(rows, _label=F.when(F.col("_good"), first_argmax(F.col("_shares")).cast("int")))
        return rows.select(*[c for c in df.columns if c != name], F.col("_label").alias(name))


class ModelLabeler:
    """A model with `predict(features)`: one whole number from 0 to `classes` - 1 for each row of a matrix of doubles.

    `predict` gets complete rows only, at least one, as a read-only matrix, and
    travels to the executors by value. A result of another length, one that
    isn't whole, or a label out of range raises with the name of the model.
    """

    def __init__(self, predict: Callable[[np.ndarray], np.ndarray], classes: int, name: str = "model"):
        self.predict, self.classes, self.name = predict, classes, name

    def checked(self, features: np.ndarray) -> np.ndarray:
        features.setflags(write=False)
        labels = np.asarray(self.predict(features))
        if labels.shape != (len(features),):
            raise ValueError(f"{self.name} returned labels of shape {labels.shape} for {len(features)} rows")
        if labels.dtype.kind not in "iu":
            raise TypeError(f"{self.name} returned {labels.dtype}, not whole numbers")
        if labels.min() < 0 or labels.max() >= self.classes:
            raise ValueError(f"{self.name} returned a label outside 0 to {self.classes - 1}")
        return labels

    def label(self, features: Sequence[Column]) -> Column:
        checked = self.checked

        @F.pandas_udf("int")
        def apply(*columns: pd.Series) -> pd.Series:
            x = np.stack([c.to_numpy(np.float64) for c in columns], 1)
            good = np.isfinite(x).all(1)
            out = np.full(len(x), np.nan)
            if good.any():
                out[good] = checked(x[good])
            return pd.Series(out).astype("Int32")

        return apply(*[f.cast("double") for f in features])


def labelled(df: DataFrame, features: Sequence[Column], labelers: dict[str, Labeler]) -> DataFrame:
    """The rows with one label column for each labeler. The labels must not be called as a column of the features is."""
    models = {name: labeler.label(features) for name, labeler in labelers.items() if not isinstance(labeler, MixtureLabeler)}
    out = df.withColumns(models)
    for name, labeler in labelers.items():
        if isinstance(labeler, MixtureLabeler):
            out = labeler.added(out, features, name)
    return out
