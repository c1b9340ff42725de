"""Retrievals of single cases from a fixed geometry, with shapes that stay positive.

The geometry is the same for all cases, so its pseudo-inverse is a handful of
constants and the free fit a projection. Where the lowest value of the fitted
shape over the hemisphere, which has a closed form, is not positive, the case
alone goes to a solver of its small constrained problem, in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermalake.functions.physics import angular_integral, limb_value

MARGIN, WORST = 1e-6, 1e8  # least value of a shape relative to its amplitude, and the largest condition of a geometry
_GRID = np.linspace(0.0, 90.0, 901)
_BATCH, _TINY = 2048, 1e-13  # cases on their worst bound at a time, and how far below a bound counts as on it


def basis(angles: Sequence[float], parameters: int) -> np.ndarray:
    """One or two functions of the zenith angle that vanish at 55 degrees: limb darkening, and the squared cosine."""
    if parameters not in (1, 2):
        raise ValueError("a shape has one or two parameters")
    columns = [[limb_value(a) - 1.0 for a in angles], [math.cos(math.radians(a)) ** 2 - math.cos(math.radians(55.0)) ** 2 for a in angles]]
    return np.array(columns[:parameters], float).T


class Geometry:
    """The views' angles and what follows from them: raises if they don't tell amplitude and shape apart."""

    def __init__(self, angles: Sequence[float], parameters: int):
        a = np.asarray(angles, float)
        if len(set(a.tolist())) != len(a) or not ((a >= 0) & (a <= 70)).all():
            raise ValueError("views need different angles from 0 to 70 degrees")
        self.parameters, self.views = parameters, len(a)
        self.design = np.column_stack([np.ones(len(a)), basis(a, parameters)])
        if np.linalg.matrix_rank(self.design) < parameters + 1:
            raise ValueError("the angles do not identify amplitude and shape")
        self.condition = float(np.linalg.cond(self.design / np.linalg.norm(self.design, axis=0)))
        if self.condition > WORST:
            raise ValueError("the geometry is ill-conditioned")
        self.inverse = np.linalg.pinv(self.design)
        level = angular_integral([0.0] * parameters)
        self.integral = np.array([level, *[angular_integral(np.eye(parameters)[i].tolist()) - level for i in range(parameters)]])
        # flux per unit of independent, equal noise of the radiances
        self.noise_gain = float(np.linalg.norm(math.pi * self.integral @ self.inverse))
        self.bounds = np.column_stack([np.full(len(_GRID), 1.0 - MARGIN), basis(_GRID, parameters)])

    @property
    def diagnostics(self) -> dict:
        return {"views": self.views, "parameters": self.parameters, "condition": self.condition, "noise_gain": self.noise_gain, "degrees_of_freedom": self.views - self.parameters - 1}

    def constrained(self, radiances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(coefficients, held): for each case the least squares among shapes positive over the hemisphere, and whether that differs from the free one."""
        free = radiances @ self.inverse.T
        out, held = free.copy(), (free @ self.bounds.T < 0).any(1) | (free[:, 0] <= 0)
        _, upper = np.linalg.qr(self.design)
        cone = self.bounds @ np.linalg.inv(upper)  # in coordinates in which least squares is distance
        unit = cone / np.linalg.norm(cone, axis=1, keepdims=True)
        touched = np.flatnonzero(held)
        for at in range(0, len(touched), _BATCH):
            own = touched[at : at + _BATCH]
            scale = radiances[own].mean(1, keepdims=True)
            point = free[own] @ upper.T / scale
            # mostly one bound holds the shape: all cases of a batch are put on their worst one at once, and the others go on from there
            heights = point @ unit.T
            worst = heights.argmin(1)
            z = point - heights[np.arange(len(own)), worst, None] * unit[worst]
            for i in np.flatnonzero((z @ unit.T).min(1) < -_TINY * np.maximum(1.0, np.abs(point).max(1))):
                z[i] = nearest_in_cone(unit, point[i])
            out[own] = np.linalg.solve(upper, z.T).T * scale
        return out, held


def nearest_in_cone(normals: np.ndarray, point: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The point of {z: normals z >= 0} nearest to a given one, by an active set.

    z = point + sum of pushes along active normals: the most violated constraint
    joins, and those whose push would turn negative leave, until none is violated.
    """
    unit = normals / np.linalg.norm(normals, axis=1, keepdims=True)
    active: list[int] = []
    push = np.zeros(0)
    z = point
    for _ in range(rounds):
        worst = int((unit @ z).argmin())
        if unit[worst] @ z >= -_TINY * max(1.0, float(np.abs(point).max())) or worst in active:
            return z
        active.append(worst)
        push = np.r_[push, 0.0]
        while True:
            rows = unit[active]
            wanted = np.linalg.lstsq(rows @ rows.T, -(rows @ point), rcond=None)[0]
            if (wanted > 0).all():
                push = wanted
                break
            # go towards the wanted pushes until the first one vanishes, and let that constraint go
            low = wanted <= 0
            step = np.min(push[low] / np.maximum(push[low] - wanted[low], 1e-300))
            push = push + step * (wanted - push)
            kept = push > 1e-15
            kept[-1] |= not kept.any()
            active, push = [a for a, k in zip(active, kept, strict=True) if k], push[kept]
        z = point + push @ unit[active]
    raise RuntimeError("the constrained fit did not settle")


def lowest(b: Sequence[Column]) -> Column:
    """The lowest value of 1 + b basis over the hemisphere, in closed form.

    With u the cosine of the angle it is at u = 0, at u = 1, or where the
    derivative b1 / (k (u + 2)) + 2 b2 u vanishes.
    """
    k = math.log(math.cos(math.radians(55.0)) + 2.0)
    fifty_five = math.cos(math.radians(55.0)) ** 2

    def at(u: Column) -> Column:
        value = 1.0 + b[0] * (F.log(u + 2.0) / k - 1.0)
        return value + b[1] * (u * u - fifty_five) if len(b) > 1 else value

    ends = F.least(at(F.lit(0.0)), at(F.lit(1.0)))
    if len(b) == 1:
        return ends
    inside = 1.0 - F.try_divide(b[0], 2.0 * k * b[1])
    u = F.when(inside >= 1.0, F.sqrt(inside) - 1.0)
    return F.least(ends, F.when((u > 0) & (u < 1), at(u)))


def made(df: DataFrame, **columns: Column) -> DataFrame:
    """The rows with new columns, each computed once: later uses name the column instead of repeating its expression."""
    return df.select(*df.columns, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def retrieve(df: DataFrame, radiances: str, geometry: Geometry) -> DataFrame:
    """The rows with amplitude, shape (its parameters), flux, rmse and constrained, from an array of one radiance for each view.

    Raises for a case whose radiances are null, not positive or not as many as
    the views. Only cases whose free shape isn't positive leave the plan's
    expressions; the array column must not be called by one of the new names.
    """
    names = df.columns
    taken = {"amplitude", "shape", "flux", "rmse", "constrained"} & set(names)
    if taken:
        raise ValueError(f"columns of these names are there already: {', '.join(sorted(taken))}")
    values = F.col(radiances)
    good = F.coalesce((F.size(values) == geometry.views) & F.forall(values, lambda x: x.isNotNull() & (x > 0) & (x < float("inf"))), F.lit(False))
    checked = F.when(good, values.cast("array<double>")).otherwise(F.raise_error(F.lit("a case needs one positive radiance for each view")).cast("array<double>"))
    own = made(df, _l=checked)
    dot = lambda weights: sum((F.col("_l")[i] * float(w) for i, w in enumerate(weights)), F.lit(0.0))
    free = made(own, _c=F.array(*[dot(row) for row in geometry.inverse]))
    level = F.col("_c")[0]
    shaped = made(free, **{f"_b{j}": F.try_divide(F.col("_c")[j + 1], level) for j in range(geometry.parameters)})
    low = lowest([F.col(f"_b{j}") for j in range(geometry.parameters)])
    flagged = made(shaped, _flag=F.coalesce((level <= 0) | (low < MARGIN * (1.0 + 1e-9)), F.lit(True)))
    held = flagged.filter("_flag").select(F.struct(*[F.col(n) for n in names]).alias("row"), "_l")
    fields = f"row {held.schema['row'].dataType.simpleString()}, _l array<double>, _c array<double>, constrained boolean"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, geometry.views)
            found, touched = geometry.constrained(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, found.shape[1]), pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(touched)], names=["row", "_l", "_c", "constrained"])

    rest = held.mapInArrow(solve, fields).select("row.*", "_l", "_c", "constrained")
    out = flagged.filter("NOT _flag").select(*names, "_l", "_c", F.lit(False).alias("constrained")).unionByName(rest)
    left = [F.col("_l")[i] - sum((F.col("_c")[j] * float(v) for j, v in enumerate(row)), F.lit(0.0)) for i, row in enumerate(geometry.design)]
    flux = math.pi * sum((F.col("_c")[j] * float(v) for j, v in enumerate(geometry.integral)), F.lit(0.0))
    return out.select(
        *names, F.col("_c")[0].alias("amplitude"), F.array(*[F.col("_c")[j + 1] / F.col("_c")[0] for j in range(geometry.parameters)]).alias("shape"),
        flux.alias("flux"), F.sqrt(sum((e * e for e in left), F.lit(0.0)) / geometry.views).alias("rmse"), "constrained",
    )
