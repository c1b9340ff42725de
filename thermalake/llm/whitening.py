"""Embedding whitening from a compensated covariance.

Vectors become whole numbers, so their number and sums are exact, and each
distinct one counts once in the fit. Tasks centre their rows on the mean as
pairs of doubles, split the pairs into slices whose products sum without any
rounding (error-free transformations), and add these sums in double-double
arithmetic. High and low parts travel side by side and are merged in steps of
bounded size. The driver holds one matrix per dimension of vectors and solves
its eigenproblem by tridiagonal divide and conquer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalake.llm.common import discard, stored
from thermalake.llm.tiles import floats

SHIFT = 1_000_000  # added to every whole number
_REPRESENTABLE = float(1 << 46)  # entries times the scale below it keep exact sums
_ROWS = 1024  # rows whose slices are multiplied at a time
_SLICES, _BITS = 3, 21  # 2 * 21 bits of products and 10 of their number fit into the 53 of a double
_MERGED = 64  # partial matrices that one step adds
_PART = pa.schema([("dim", pa.int32()), ("row", pa.int32()), ("part", pa.int64()), ("high", pa.binary()), ("low", pa.binary())])
_SUMS = pa.schema([("dim", pa.int32()), ("row", pa.int32()), ("n", pa.int64()), ("upper", pa.int64()), ("lower", pa.int64())])
_WHITE = pa.schema(
    [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]
)


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and its exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add_double_double(high: np.ndarray, low: np.ndarray, more: np.ndarray, less: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(high, low) + (more, less) as a pair of doubles."""
    s, e = two_sum(high, more)
    t, f = two_sum(low, less + np.zeros_like(low))
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """x - sums / n as pairs of doubles, for whole numbers x below 2^53."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    high = np.array([r / n for r in rest])  # Python divides whole numbers with one rounding
    low = np.array([float(_fraction_error(r, n, h)) for r, h in zip(rest, high.tolist(), strict=True)])
    c, e = two_sum((x - whole).astype(np.float64), -high)
    return two_sum(c, e - low)


def _fraction_error(r: int, n: int, h: float) -> float:
    p, q = h.as_integer_ratio()
    return (r * q - p * n) / (n * q)


def slices(c: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """c as slices of at most `_BITS` bits under each column's largest value, and what remains of it."""
    parts = []
    _, top = np.frexp(np.abs(c).max(0, initial=0.0))
    for i in range(1, _SLICES + 1):
        unit = np.ldexp(1.0, top - _BITS * i)
        part = np.rint(c / unit) * unit
        parts.append(part)
        c = c - part
    return parts, c


def outer_products(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the outer products of rows high + low, as a pair of matrices of doubles."""
    d = high.shape[1]
    total, error = np.zeros((d, d)), np.zeros((d, d))
    for at in range(0, len(high), _ROWS):
        parts, rest = slices(high[at : at + _ROWS])
        for a in parts:
            for b in parts:
                total, error = add_double_double(total, error, a.T @ b)  # the product itself is exact
        small = (rest + low[at : at + _ROWS]).T @ high[at : at + _ROWS]
        total, error = add_double_double(total, error, small + small.T)
    return total, error


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(dim, x as rows) of each batch of (dim, x)."""
    for batch in batches:
        dims = batch.column(0).to_numpy()
        for dim in np.unique(dims):
            column = batch.column(1).filter(pa.array(dims == dim))
            yield int(dim), column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and exact sums of a task's rows, the latter in two halves."""
    held: dict[int, list] = {}
    for dim, x in _matrices(batches):
        n, upper, lower = held.get(dim, (0, 0, 0))
        held[dim] = [n + len(x), upper + (x >> 24).sum(0), lower + (x & 0xFFFFFF).sum(0)]
    for dim, (n, upper, lower) in held.items():
        columns = ([dim] * dim, range(dim), [n] * dim, upper, lower)
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _SUMS, strict=True)], schema=_SUMS)


def _partials(batches: Iterator[pa.RecordBatch], rows_of) -> Iterator[pa.RecordBatch]:
    """The outer products of a task's rows, one output row per row of the matrix."""
    from pyspark import TaskContext

    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim, x in _matrices(batches):
        if (pair := rows_of(dim, x)) is not None:
            total = outer_products(*pair)
            held[dim] = add_double_double(*held[dim], *total) if dim in held else total
    for dim, (high, low) in held.items():
        yield _part_rows(dim, np.arange(len(high)), TaskContext.get().partitionId(), high, low)


def _part_rows(dim: int, row: np.ndarray, part: int, high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    columns = ([dim] * len(row), row, [part] * len(row), [h.tobytes() for h in high], [e.tobytes() for e in low])
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _PART, strict=True)], schema=_PART)


def _merge(table: pa.Table) -> pa.Table:
    """The sum of the parts of one row of a matrix, in the order of their numbers."""
    order = np.argsort(table["part"].to_numpy(), kind="stable").tolist()
    highs, lows = table["high"].to_pylist(), table["low"].to_pylist()
    high, low = np.frombuffer(highs[order[0]]), np.frombuffer(lows[order[0]])
    for i in order[1:]:
        high, low = add_double_double(high, low, np.frombuffer(highs[i]), np.frombuffer(lows[i]))
    first = {c: table[c][0].as_py() for c in ("dim", "row", "part")}
    return pa.Table.from_batches([_part_rows(first["dim"], np.array([first["row"]]), first["part"] // _MERGED, high[None, :], low[None, :])])


def _collected(vectors: DataFrame, rows_of) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each dimension the merged matrix of outer products; what reaches the driver depends on the dimension alone."""
    spark = vectors.sparkSession
    parts, path = stored(vectors.mapInArrow(lambda batches: _partials(batches, rows_of), "dim int, row int, part long, high binary, low binary"))
    last = parts.agg(F.max("part")).first()[0] or 0
    while True:
        # `part` is the number of the group of parts that are added next
        merged = parts.groupBy("dim", "row", F.floor(F.col("part") / _MERGED).alias("_step")).applyInArrow(_merge, parts.schema)
        last //= _MERGED
        if not last:
            break
        new, new_path = stored(merged)
        discard(spark, path)
        parts, path = new, new_path
    found: dict[int, list] = {}
    for r in merged.collect():
        found.setdefault(r.dim, []).append((r.row, np.frombuffer(r.high), np.frombuffer(r.low)))
    discard(spark, path)
    return {dim: tuple(np.array(v) for v in zip(*[(h, e) for _, h, e in sorted(rows, key=lambda r: r[0])], strict=True)) for dim, rows in found.items()}


class Whitening:
    """What a dimension's rows are whitened by: their number and sums, eigenvalues, and unit eigenvectors as columns."""

    def __init__(self, n: int, sums: list[int], high: np.ndarray, low: np.ndarray, most: int):
        self.n, self.sums = n, sums
        v = (high / n) + (low / n)
        v = (v + v.T) / 2
        # LAPACK's syevd: reduction to a tridiagonal matrix, then divide and conquer
        values, axes = np.linalg.eigh(v)
        k = min(most, len(values))
        self.values, self.axes = values[::-1][:k], axes[:, ::-1][:, :k]
        self.trace = math.fsum(np.diag(v))
        # below this an eigenvalue is rounding: the fit list doesn't spread along its component
        self.live = self.values > len(values) * np.finfo(float).eps * max(values[-1], 0.0)
        self.identity_error: float | None = None

    @property
    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Rows on the components, over the square roots of their eigenvalues; NaN where the fit list doesn't spread."""
        whole, rest = self.whole
        scale = np.sqrt(np.where(self.live, self.values, np.nan))
        return ((x - whole) - rest) @ self.axes / scale

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n * x - sums)^2 per row; None where that is no long."""
        # with x = mean + small whole numbers the products stay small however large the level is
        whole = np.array([s // self.n for s in self.sums], np.int64)
        y, rest = x - whole, np.array([s % self.n for s in self.sums], np.int64)
        if (int(np.abs(y).max(initial=0)) + 1) ** 2 * self.n**2 * x.shape[1] < 1 << 63:
            return ((self.n * y - rest) ** 2).sum(1).tolist()
        exact = ((self.n * y.astype(object) - rest.astype(object)) ** 2).sum(1).tolist()
        return [e if e < 1 << 63 else None for e in exact]


def whole_vectors(vecs: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, dim, x): vectors of whole numbers floor(scale * entry) + SHIFT."""
    table = floats(vecs).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    fits = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < _REPRESENTABLE))
    x = F.transform("e", lambda c: F.floor(c * F.lit(float(scale))) + F.lit(SHIFT))
    return table.filter(F.coalesce(fits, F.lit(False)) & (F.size("e") > 0)).select("vec_id", F.size("e").alias("dim"), x.cast("array<bigint>").alias("x"))


def fit(rows: DataFrame, most: int = 16) -> dict[int, Whitening]:
    """A whitening for each dimension of (dim, x), over its distinct x."""
    spark = rows.sparkSession
    distinct, path = stored(rows.select("dim", "x").distinct())
    sums = distinct.mapInArrow(_sums, "dim int, row int, n long, upper long, lower long").groupBy("dim", "row")
    wide = "decimal(38,0)"
    known: dict[int, list] = {}
    for r in sums.agg(F.sum("n").alias("n"), F.sum(F.col("upper").cast(wide)).alias("upper"), F.sum(F.col("lower").cast(wide)).alias("lower")).collect():
        known.setdefault(r.dim, []).append((r.row, int(r.n), int(r.upper) * (1 << 24) + int(r.lower)))
    level = {dim: (held[0][1], [s for _, _, s in sorted(held)]) for dim, held in known.items()}
    matrices = _collected(distinct, lambda dim, x: centred(x, *level[dim]))
    models = {dim: Whitening(*level[dim], *matrices[dim], most) for dim in level}

    def whitened(dim: int, x: np.ndarray):
        # a column of ones beside the components gives their sums
        w = models[dim].project(x)[:, models[dim].live]
        w = np.concatenate([w, np.ones((len(x), 1))], axis=1)
        return w, np.zeros_like(w)

    for dim, (high, low) in _collected(distinct, whitened).items():
        moments = (high + low) / models[dim].n
        spread = moments[:-1, :-1] - np.outer(moments[-1, :-1], moments[-1, :-1])  # their means are zero but for rounding
        models[dim].identity_error = float(np.abs(spread - np.eye(len(spread))).max(initial=0.0))
    discard(spark, path)
    return models


def whiten(vecs: DataFrame, scale: int = 64, most: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each vector on its first `most` components.

    Rows whose vector is null, empty, or holds null or non-finite entries are
    left out, as are those with entries of 2^46 / scale or more, whose whole
    numbers would leave the exact range. Equal vectors count once in the fit and
    are all returned; rows that repeat a vec_id, or have none, are returned each
    for itself. Vectors of each length are fitted among themselves. Components
    along which the fit list doesn't spread (one vector, flat dimensions) have
    a null `whitened` and explain nothing; they take no part in identity_error.
    deviation is null where it exceeds a long. Components of equal eigenvalues
    may be any basis. An empty table gives an empty one; extra columns are not
    read.
    """
    rows = whole_vectors(vecs, scale)
    models = fit(rows, most)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                model, n = models[int(dim)], part.num_rows
                x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                k = len(model.values)
                share = np.where(model.live, model.values, 0.0) / (model.trace if model.trace > 0 else 1.0)
                deviation = pa.array(model.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(n), k)))
                vec_id = part.column(0).take(pa.array(np.repeat(np.arange(n), k)))
                whitened = model.project(x).ravel()
                columns = (
                    vec_id,
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, model.n)),
                    deviation,
                    pa.array(whitened, mask=np.isnan(whitened)),
                    pa.array(np.tile(share, n)),
                    pa.array(np.full(n * k, model.identity_error)),
                )
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _WHITE, strict=True)], schema=_WHITE)

    return rows.mapInArrow(project, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
