"""Embedding near-duplicates by int8 tile products.

The vectors of a label are dealt into blocks of bounded size by a hash of the
id, and every pair of blocks is one tile. A tile multiplies int8 codes, adds
the error bound of each pair, and recomputes in double precision those that may
reach the threshold. It returns at most one row per vector: how many links it
saw and the smallest id that these links lead to, so that dense groups of
copies leave a tile as compactly as sparse ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalake.llm.common import cut, shuffle_partitions
from thermalake.llm.components import connected_components
from thermalake.llm.tiles import Quantised, dot_pairs, floats, one_row_per_id, pairs_at_once, scaled, tile_product, usable, vectors

BLOCK = 2048
_SCHEMA = pa.schema([("vec_id", pa.int64()), ("links", pa.int64()), ("low", pa.int64())])


def tile_links(table: pa.Table, threshold: float) -> pa.Table:
    """(vec_id, links, low) for the linked vectors of one tile: rows of side 0, and of side 1 unless it meets itself."""
    dim = table["dim"][0].as_py()
    ids, side = table["vec_id"].to_numpy(), table["side"].to_numpy()
    rows = scaled(vectors(table["embedding"], dim))  # by powers of two, which leaves every cosine as it is
    units = rows / np.sqrt((rows**2).sum(1))[:, None]
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    own = right is left
    links = np.zeros(len(ids), np.int64)
    order = np.argsort(ids)
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    label = np.arange(len(ids))  # by rank of the id, so that the smallest label is the smallest id
    if len(left) and len(right):
        a, b = Quantised(units[left]), Quantised(units[right])
        near, bound = tile_product(a, b)
        near += bound
        step = pairs_at_once(dim)
        lengths = np.sqrt(np.concatenate([dot_pairs(rows[at : at + step], rows[at : at + step]) for at in range(0, len(rows), step)]))
        x, y = np.nonzero(near >= threshold)
        if own:
            x, y = x[x < y], y[x < y]
        for at in range(0, len(x), step):
            i, j = left[x[at : at + step]], right[y[at : at + step]]
            true = dot_pairs(rows[i], rows[j]) / (lengths[i] * lengths[j]) >= threshold
            i, j = i[true], j[true]
            links += np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
            label = _merge(label, rank[i], rank[j])
    seen = np.flatnonzero(links)
    return pa.Table.from_arrays([pa.array(ids[seen]), pa.array(links[seen]), pa.array(ids[order[label[rank[seen]]]])], schema=_SCHEMA)


def _merge(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels that are at most their positions, lowered until linked positions share one."""
    while True:
        p, q = label[u], label[v]
        live = p != q
        if not live.any():
            return label
        u, v, p, q = u[live], v[live], p[live], q[live]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while ((shorter := label[label]) != label).any():
            label = shorter


def near_duplicates(vecs: DataFrame, threshold: float = 0.93, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per vec_id.

    Vectors link when their labels are equal and not null and their cosine in
    double precision is at least `threshold`. Null and zero vectors, those with
    null or non-finite components, and vectors of another dimension link with
    nothing. component_id is the smallest vec_id reachable. Of rows that repeat
    a vec_id, the one with the largest label, then embedding counts; rows
    without an id are returned one by one, unlinked. An empty table gives an
    empty one; extra columns are not read.
    """
    table = floats(vecs).select("vec_id", "embedding", F.col("label").cast("string"))
    rows = cut(one_row_per_id(table, "vec_id", "label", "embedding"))
    live = rows.filter(F.col("label").isNotNull() & usable("embedding")).withColumn("dim", F.size("embedding"))
    counts = live.groupBy(F.col("label").alias("_label"), F.col("dim").alias("_dim")).agg(
        F.ceil(F.count("*") / block).cast("int").alias("blocks")
    )
    placed = live.join(counts, (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim"))).withColumn(
        "own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiles = placed.select("label", "dim", "vec_id", "embedding", "own", other).select(
        "label",
        "dim",
        "vec_id",
        "embedding",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"),
    )
    # a tile's work is far above its bytes, so the tiles are dealt by number, not put together by size
    tiles = tiles.repartition(shuffle_partitions(vecs.sparkSession), "label", "dim", "i", "j")
    found = cut(
        tiles.groupBy("label", "dim", "i", "j").applyInArrow(
            lambda tile: tile_links(tile, threshold), "vec_id long, links long, low long"
        )
    )
    parts = connected_components(found.select(F.col("vec_id").alias("a"), F.col("low").alias("b")))
    degree = found.groupBy(F.col("vec_id").alias("_id")).agg(F.sum("links").alias("links"))
    one = rows.select("vec_id").join(degree, F.col("vec_id") == F.col("_id"), "left")
    one = one.join(parts, F.col("vec_id") == F.col("node"), "left")
    unnamed = vecs.filter("vec_id IS NULL").select(
        F.col("vec_id").cast("long"), F.lit(0).cast("long").alias("links"), F.lit(None).cast("long").alias("component")
    )
    return one.select("vec_id", "links", "component").unionByName(unnamed).select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce("component", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"),
    )
