"""Int8 quantised tile products with rigorous error bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest run of components whose int8 products sum exactly in single precision.
_EXACT = 1024
CELLS = 1 << 21  # components of the pairs that are recomputed at a time
#: Above what rounding in the few double operations of a bound can make up, relative to the vectors' lengths, and in absolute terms.
_SLACK, _TINY = 1e-9, 1e-300


class Quantised:
    """Rows x as codes * scale + error, with the length of each row and of its error."""

    @np.errstate(over="ignore")
    def __init__(self, rows: np.ndarray):
        top = np.abs(rows).max(1, initial=0.0)
        self.scale = np.where(top > 0, top / 127.0, 1.0)
        codes = np.rint(rows / self.scale[:, None])
        self.codes = codes.astype(np.int8)
        self.error = np.sqrt(((rows - codes * self.scale[:, None]) ** 2).sum(1))
        self.length = np.sqrt((rows**2).sum(1))


@np.errstate(over="ignore", invalid="ignore")
def tile_product(a: Quantised, b: Quantised) -> tuple[np.ndarray, np.ndarray]:
    """Approximate inner products of all rows of a with all of b, and bounds of their errors.

    x.y - x'.y' = (x - x').y + x'.(y - y'), so the error is at most
    |e_x| |y| + (|x| + |e_x|) |e_y|. The sums of int8 products are exact.
    """
    total = np.zeros((len(a.codes), len(b.codes)))
    for at in range(0, a.codes.shape[1], _EXACT):
        part = slice(at, at + _EXACT)
        total += a.codes[:, part].astype(np.float32) @ b.codes[:, part].astype(np.float32).T
    total *= a.scale[:, None]
    total *= b.scale[None, :]
    longer = a.length + a.error
    bound = a.error[:, None] * b.length[None, :] + longer[:, None] * b.error[None, :]
    bound += _SLACK * longer[:, None] * (b.length + b.error)[None, :] + _TINY
    # lengths past the range of doubles bound nothing: such pairs always count as possible
    open_ = ~(np.isfinite(total) & np.isfinite(bound))
    total[open_], bound[open_] = 0.0, np.inf
    return total, bound


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest components to between 1/2 and 1, so that their squares keep in range."""
    _, power = np.frexp(np.abs(rows).max(1, initial=0.0))
    return np.ldexp(rows, -power[:, None])


def pairs_at_once(dim: int) -> int:
    """How many pairs of vectors are recomputed at a time: their components, not their number, are bounded."""
    return max(1, CELLS // max(dim, 1))


@np.errstate(over="ignore", invalid="ignore")
def dot_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Double precision inner products of aligned rows, summed from the first component to the last."""
    return (a * b).cumsum(1)[:, -1]


def vectors(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column of `dim` components each, as doubles."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def floats(table: DataFrame) -> DataFrame:
    """The table with `embedding` as an array of float or double."""
    kind = table.schema["embedding"].dataType.simpleString()
    if kind in ("array<float>", "array<double>"):
        return table
    return table.withColumn("embedding", F.col("embedding").cast("array<double>"))


def usable(embedding: str):
    """True for vectors without null or non-finite components that are not zero or empty."""
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(e, lambda x: x != 0), F.lit(False))


def one_row_per_id(table: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per id: of rows that repeat an id, the one with the largest columns. Rows without an id are left out."""
    best = table.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias(key)).agg(
        F.max(F.struct(*columns)).alias("_best")
    )
    return best.select(key, *[F.col(f"_best.{c}").alias(c) for c in columns])
