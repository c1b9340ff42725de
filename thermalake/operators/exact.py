"""Sums that don't depend on how rows are partitioned.

Built-in sums of doubles depend on the order in which rows and partial sums
arrive. Two ways around that:

- `exact_sums` writes every term as whole multiples of two units, fine enough
  for the largest term and the number of rows, and sums whole numbers.
- `blocked` deals rows into blocks of bounded size by a hash of their values
  and sorts these, so that the same rows meet in the same order wherever they
  lie. `block_sums` reduces each block, takes its numbers apart into digits of
  2^32, and sums the digits as whole numbers.
- `exact_products` writes columns as three slices of 18 bits below their
  largest value, so that products of slices add up without rounding in any
  order, and rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4096  # rows of a block on average
_TASK_BLOCKS, _FEW_TASKS = 128, 64  # blocks of a task, unless cores would be idle, and tasks whose sums the driver adds by itself
_DIGIT = 32
_NOT_FINITE = 1 << 20  # the digit that marks a term without a value
_DIGITS = pa.schema([("at", pa.int32()), ("place", pa.int32()), ("digit", pa.int64())])


def exact_sums(df: DataFrame, terms: Mapping[str, Column]) -> dict[str, float]:
    """The sum of each term over its rows that are not null, correct to the last place but one, for any partitioning.

    Two passes: the first finds the largest terms and the number of rows. Terms
    that are not finite make their sum NaN. No rows give zero.
    """
    named = df.select(*[c.cast("double").alias(f"t{i}") for i, c in enumerate(terms.values())])
    at = range(len(terms))
    first = named.agg(F.count("*").alias("n"), *[F.max(F.abs(f"t{i}")).alias(f"t{i}") for i in at]).first()
    room = 61 - max(1, first["n"]).bit_length()
    wanted, units, out = [], {}, {}
    for i, name in enumerate(terms):
        top = first[f"t{i}"]
        if top is None or top == 0.0:
            out[name] = 0.0
        elif not np.isfinite(top):
            out[name] = float("nan")
        else:
            power = int(np.frexp(top)[1]) - room
            power = max(power, -1000)
            finer = max(power - room, -1074)
            coarse = F.rint(F.col(f"t{i}") / F.lit(2.0**power))
            rest = F.col(f"t{i}") - coarse * F.lit(2.0**power)
            units[name] = power, finer
            wanted += [F.sum(coarse.cast("long")).alias(f"c{i}"), F.sum(F.rint(rest / F.lit(2.0**finer)).cast("long")).alias(f"f{i}")]
    if wanted:
        row = named.agg(*wanted).first()
        for i, name in enumerate(terms):
            if name in units:
                power, finer = units[name]
                out[name] = float(Fraction(row[f"c{i}"]) * Fraction(2) ** power + Fraction(row[f"f{i}"]) * Fraction(2) ** finer)
    return out


def blocked(df: DataFrame, columns: Sequence[Column], size: int = BLOCK) -> DataFrame:
    """(block, n, c0, c1, ...): the different rows without nulls and how often each comes, block by block and sorted within.

    One exchange. Rows that repeat are counted before it, so a value that a
    third of all rows share is one row.
    """
    named = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).na.drop()
    names = named.columns
    rows = named.groupBy(*names).agg(F.count("*").alias("n"))
    blocks = max(1, -(-named.count() // size))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(*names), F.lit(blocks)).cast("int")).select("block", "n", *names)
    # a pass over few blocks costs what its tasks cost to start, so they are no more than the cores
    tasks = max(min(blocks, df.sparkSession.sparkContext.defaultParallelism), -(-blocks // _TASK_BLOCKS))
    return dealt.repartition(tasks, "block").sortWithinPartitions("block", *names)


def _parted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x columns, how often each row comes), both of a layout of their own: products of views can differ from theirs in the last bit."""
    return np.ascontiguousarray(rows[:, 1:]), np.ascontiguousarray(rows[:, 0])


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The whole blocks of batches that are sorted by block, without the block's number."""
    waiting: list[np.ndarray] = []
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], 1)
        for part in np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1):
            if waiting and len(part) and waiting[0][0, 0] != part[0, 0]:
                yield np.concatenate(waiting)[:, 1:]
                waiting = []
            if len(part):
                waiting.append(part)
    if waiting:
        yield np.concatenate(waiting)[:, 1:]


def kept(blocks: DataFrame) -> RDD:
    """The blocks of `blocked` for repeated passes: (rows x columns, how often each row comes), kept by the executors as arrays.

    A pass over them plans no query and makes no arrays of rows again.
    """
    width = len(blocks.columns) - 1

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _each_block(batches):
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(block).tobytes()], pa.binary())], names=["rows"])

    def arrays(row) -> tuple[np.ndarray, np.ndarray]:
        return _parted(np.frombuffer(row["rows"]).reshape(-1, width))

    return blocks.mapInArrow(packed, "rows binary").rdd.map(arrays).persist(StorageLevel.MEMORY_AND_DISK)


def taken_apart(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place, digits): whole numbers below 2^32 in size with values = sum(digits * 2^(32 * place)), without any rounding."""
    mantissa, exponent = np.frexp(values)
    whole = np.ldexp(mantissa, 53).astype(np.int64)
    exponent = exponent - 53
    for part, power in ((whole & 0x3FFFFFF, exponent), (whole >> 26, exponent + 26)):
        place, shift = np.floor_divide(power, _DIGIT), np.mod(power, _DIGIT)
        moved = part << shift
        for digits, places in ((moved & 0xFFFFFFFF, place), (moved >> _DIGIT, place + 1)):
            for p in np.unique(places[digits != 0]):
                yield int(p), np.where(places == p, digits, 0)


def put_together(rows) -> np.ndarray:
    """The doubles nearest to sums of digits, from rows of (at, place, digit)."""
    total: dict[int, Fraction] = {}
    broken = set()
    for r in rows:
        if r["place"] == _NOT_FINITE:
            broken.add(r["at"])
        else:
            total[r["at"]] = total.get(r["at"], Fraction(0)) + Fraction(r["digit"]) * Fraction(2) ** (_DIGIT * r["place"])
    out = np.zeros(max([*total, *broken], default=-1) + 1)
    for at, value in total.items():
        out[at] = float(value)
    out[list(broken)] = np.nan
    return out


def _added(held: dict[int, np.ndarray], values: np.ndarray) -> dict[int, np.ndarray]:
    """`held`, digits by place, with those of further values; place 0 is there whatever the values are."""
    own = np.asarray(values, float).ravel()
    if own.size:
        held.setdefault(0, np.zeros(own.size, np.int64))
    finite = np.isfinite(own)
    if not finite.all():
        held[_NOT_FINITE] = held.get(_NOT_FINITE, 0) + (~finite).astype(np.int64)
    for place, digits in taken_apart(np.where(finite, own, 0.0)):
        held[place] = held.get(place, 0) + digits
    return held


def _joined(a: dict[int, np.ndarray], b: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    return {place: a.get(place, 0) + b.get(place, 0) for place in {**a, **b}}


def _seen(held: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, positions, digits) without the zeros, but for place 0, which tells how many numbers there are."""
    for place, digits in held.items():
        seen = np.flatnonzero(digits) if place else np.arange(len(digits))
        if len(seen):
            yield place, seen, digits[seen]


def block_sums(blocks: DataFrame | RDD, reduce: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum over the blocks of `blocked` or `kept` of what `reduce` makes of (rows x columns, how often each row comes); empty without rows.

    The result is the same to the last bit for any partitioning: the blocks
    are, and their sums are added without rounding. What reaches the driver
    depends on the size of one result alone, of kept blocks times a bounded
    number of tasks.
    """
    if isinstance(blocks, RDD):

        def digits(arrays: Iterator[tuple[np.ndarray, ...]]) -> Iterator[dict[int, np.ndarray]]:
            held: dict[int, np.ndarray] = {}
            for block in arrays:
                held = _added(held, reduce(*block))
            return iter([held])

        if not blocks.getNumPartitions():  # Spark has found out that there are no rows
            return put_together([])
        depth = 1 if blocks.getNumPartitions() <= _FEW_TASKS else 2
        total = blocks.mapPartitions(digits).treeReduce(_joined, depth)
        return put_together({"at": at, "place": place, "digit": digit} for place, seen, found in _seen(total) for at, digit in zip(seen.tolist(), found.tolist(), strict=True))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for block in _each_block(batches):
            held = _added(held, reduce(*_parted(block)))
        for place, seen, found in _seen(held):
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(np.full(len(seen), place), pa.int32()), pa.array(found)], schema=_DIGITS)

    rows = blocks.mapInArrow(partial, "at int, place int, digit long").groupBy("at", "place").agg(F.sum("digit").alias("digit"))
    return put_together(rows.collect())


_SLICE, _CHUNK = 18, 2048  # bits of a slice, and rows taken at a time: a double holds the products of 2^16, and these stay in the cache


def _sliced(x: np.ndarray, power: np.ndarray) -> list[np.ndarray]:
    """Three whole numbers of 18 bits with x = (a + b / 2^18 + c / 2^36) * 2^(power - 17), to the last bit of the largest x."""
    rest, out = x * np.ldexp(1.0, np.minimum(_SLICE - 1 - power, 1000)), []  # powers of two, so products are exact
    for _ in range(3):
        out.append(np.rint(rest))
        rest = (rest - out[-1]) * 2.0**_SLICE
    return out


def exact_products(df: DataFrame, columns: Sequence[Column], pairs: Callable[[np.ndarray], Sequence[tuple[np.ndarray, np.ndarray]]]) -> list[np.ndarray]:
    """first.T @ second over all rows, for each (first, second) that `pairs` makes of any part of the rows x columns; the same for any partitioning.

    Two passes and no exchange: the first finds the largest value of each
    column, the second adds products of slices as whole numbers. Products are
    right to about 2^-52 of the largest. Rows with nulls are left out; a column
    with a value that is not finite makes its products NaN. No rows give an
    empty list. `pairs` must return the same shapes for parts without rows of a
    kind.
    """
    named = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).na.drop()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Sequence[tuple[np.ndarray, np.ndarray]]]:
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            for at in range(0, len(rows), _CHUNK):
                yield pairs(rows[at : at + _CHUNK])

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = None
        for made in parts(batches):
            own = [np.abs(m).max(0, initial=0.0) for pair in made for m in pair]
            top = own if top is None else [np.maximum(a, b) for a, b in zip(top, own, strict=True)]
        for place, tops in enumerate(top or []):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tops), place), pa.int32()), pa.array(np.arange(len(tops)), pa.int32()), pa.array(tops)], names=["place", "at", "top"])

    found: dict[int, dict[int, float]] = {}
    for r in named.mapInArrow(largest, "place int, at int, top double").groupBy("place", "at").agg(F.max("top").alias("top")).collect():
        found.setdefault(r["place"], {})[r["at"]] = r["top"]
    tops = [np.array([found[p][i] for i in range(len(found[p]))]) for p in range(len(found))]
    finite = [np.isfinite(t) for t in tops]
    powers = [np.frexp(np.where(f, t, 0.0))[1] for t, f in zip(tops, finite, strict=True)]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] | None = None
        for made in parts(batches):
            sums = []
            for i, pair in enumerate(made):
                a, b = (_sliced(m if f.all() else np.where(f, m, 0.0), p) for m, f, p in zip(pair, finite[2 * i : 2 * i + 2], powers[2 * i : 2 * i + 2], strict=True))
                sums.append([sum(a[j].T @ b[level - j] for j in range(level + 1)).astype(np.int64) for level in range(3)])
            if held is None:
                held = [[(s & 0xFFFFFFFF, s >> _DIGIT) for s in own] for own in sums]
            else:
                held = [[(low + (s & 0xFFFFFFFF), high + (s >> _DIGIT)) for (low, high), s in zip(before, own, strict=True)] for before, own in zip(held, sums, strict=True)]
        for i, own in enumerate(held or []):
            for level, digits in enumerate(own):
                for place, digit in enumerate(digits):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(digit.size, 6 * i + 2 * level + place), pa.int32()), pa.array(np.arange(digit.size), pa.int32()), pa.array(digit.ravel())], names=["place", "at", "digit"])

    out = [np.zeros((len(tops[i]), len(tops[i + 1]))) for i in range(0, len(tops), 2)]
    whole: dict[tuple[int, int], int] = {}
    for r in named.mapInArrow(products, "place int, at int, digit long").groupBy("place", "at").agg(F.sum("digit").alias("digit")).collect():
        pair, rest = divmod(r["place"], 6)
        level, high = divmod(rest, 2)
        key = pair, r["at"]
        whole[key] = whole.get(key, 0) + (r["digit"] << _DIGIT * high + _SLICE * (2 - level))
    for (pair, at), value in whole.items():
        i, j = divmod(at, out[pair].shape[1])
        power = int(powers[2 * pair][i]) + int(powers[2 * pair + 1][j]) - 2 * (_SLICE - 1) - 2 * _SLICE
        good = finite[2 * pair][i] and finite[2 * pair + 1][j]
        out[pair][i, j] = float(Fraction(value) * Fraction(2) ** power) if good else np.nan
    return out
