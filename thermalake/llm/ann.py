"""Nearest neighbours by a block matrix join.

Query blocks meet candidate blocks in tiles of bounded size. A tile's int8
product gives every inner product within a known error; per query the k-th
largest lower bound rules out all candidates whose upper bound is below it. The
survivors are recomputed in double precision and the tile keeps k per query.
The tiles' short lists stream past their query, which holds the k best so far.
No candidate that could be among the k nearest is ever left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalake.llm.common import cut, shuffle_partitions
from thermalake.llm.tiles import Quantised, dot_pairs, floats, one_row_per_id, pairs_at_once, tile_product, usable, vectors

QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 4096
STRIP = 1 << 19  # pairs of a tile that are bounded at a time
MERGED = 64  # short lists that are merged at a time
_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_RANKED = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])


def k_best(who: np.ndarray, what: np.ndarray, scores: np.ndarray, k: int) -> list[np.ndarray]:
    """The k best of each query: larger scores first, then smaller ids."""
    order = np.lexsort((what, -scores, who))
    who, what, scores = who[order], what[order], scores[order]
    first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.empty(0, np.int64)
    place = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)]))
    return [v[place < k] for v in (who, what, scores)]


def _strip_nearest(rows: np.ndarray, ids: np.ndarray, q: np.ndarray, c: np.ndarray, offered: Quantised, k: int) -> list[np.ndarray]:
    """The k best of a few of a tile's queries, which are the rows q, among all its candidates, the rows c."""
    near, bound = tile_product(Quantised(rows[q]), offered)
    own = ids[q][:, None] == ids[c][None, :]
    if len(c) > k:
        floor = np.where(own, -np.inf, near - bound)
        floor = np.partition(floor, len(c) - k, axis=1)[:, len(c) - k]
    else:
        floor = np.full(len(q), -np.inf)
    near += bound
    x, y = np.nonzero((near >= floor[:, None]) & ~own)
    step, found = pairs_at_once(rows.shape[1]), [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    for at in range(0, len(x), step):
        i, j = q[x[at : at + step]], c[y[at : at + step]]
        more = ids[i], ids[j], dot_pairs(rows[i], rows[j])
        found = k_best(*(np.concatenate([a, b]) for a, b in zip(found, more, strict=True)), k)
    return found


def merged(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, rank, vec_id, score): the k best of each query, from short lists that come query by query.

    What is held are the k best so far of one query and `MERGED` short lists.
    """
    held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]

    def done(rows: list[np.ndarray]) -> pa.RecordBatch:
        first = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])
        rank = np.arange(len(rows[0])) - np.repeat(first, np.diff(np.r_[first, len(rows[0])])) + 1
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (rows[0], rank.astype(np.int32), *rows[1:])], schema=_RANKED)

    for batch in batches:
        columns = [batch.column(n).to_numpy() for n in ("query_id", "vec_id", "score")]
        for at in range(0, batch.num_rows, MERGED * k):
            part = [np.concatenate([h, v[at : at + MERGED * k]]) for h, v in zip(held, columns, strict=True)]
            last = part[0][-1]
            best = k_best(*part, k)
            ends = best[0] != last  # the last query may go on
            if ends.any():
                yield done([v[ends] for v in best])
            held = [v[~ends] for v in best]
    if len(held[0]):
        yield done(held)


def tile_nearest(table: pa.Table, k: int) -> pa.Table:
    """The k best candidates (side 1) of every query (side 0) in one tile; ties go to smaller ids."""
    dim = table["dim"][0].as_py()
    ids, side = table["vec_id"].to_numpy(), table["side"].to_numpy()
    rows = vectors(table["embedding"], dim)
    q, c = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    found: list[tuple[np.ndarray, ...]] = []
    if len(q) and len(c):
        offered, strip = Quantised(rows[c]), max(1, STRIP // len(c))
        for at in range(0, len(q), strip):
            found.append(_strip_nearest(rows, ids, q[at : at + strip], c, offered, k))
    who, what, scores = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return pa.Table.from_arrays([pa.array(v) for v in (who, what, scores)], schema=_SCHEMA)


def nearest(vecs: DataFrame, queries, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by inner product of each row where `queries` holds.

    Scores are double precision inner products of the original vectors; ties go
    to the smaller vec_id. Fewer candidates than k give fewer rows. Vectors that
    are null, zero or have null or non-finite components take no part, nor do
    rows without an id; vectors meet only those of their own dimension. Of rows
    that repeat a vec_id, the one with the largest embedding counts.
    """
    # rows become many copies, so they are dealt by number: few bytes would be put together into few tasks
    parts = shuffle_partitions(vecs.sparkSession)
    known = floats(vecs).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id IS NOT NULL").repartition(parts, "vec_id")
    rows = one_row_per_id(known, "vec_id", "embedding").filter(usable("embedding"))
    rows = cut(rows.withColumns({"dim": F.size("embedding"), "asks": F.coalesce(queries, F.lit(False))}))
    counts = rows.groupBy(F.col("dim").alias("_dim")).agg(
        F.ceil(F.count_if("asks") / QUERY_BLOCK).cast("int").alias("q_blocks"),
        F.ceil(F.count("*") / CANDIDATE_BLOCK).cast("int").alias("c_blocks"),
    )
    # n dimensions need n * n / 2 components, so their table is small; an exchange by dimension would be one task's
    placed = rows.join(F.broadcast(counts.filter("q_blocks > 0")), F.col("dim") == F.col("_dim")).withColumn("h", F.xxhash64("vec_id"))
    base = ("dim", "vec_id", "embedding")
    asking = placed.filter("asks").select(
        *base,
        F.lit(0).alias("side"),
        F.pmod("h", "q_blocks").cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("c_blocks") - 1)).alias("j"),
    )
    offered = placed.select(
        *base,
        F.lit(1).alias("side"),
        F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("i"),
        F.pmod("h", "c_blocks").cast("int").alias("j"),
    )
    # a tile's work is far above its bytes, so the tiles are dealt by number, not put together by size
    tiles = asking.unionByName(offered).repartition(parts, "dim", "i", "j")
    short = tiles.groupBy("dim", "i", "j").applyInArrow(lambda tile: tile_nearest(tile, k), "query_id long, vec_id long, score double")
    return short.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(lambda batches: merged(batches, k), "query_id long, rank int, vec_id long, score double")
