"""Hard negatives over one-dimensional distance keys.

Vectors of whole numbers get one more coordinate that brings all of them to the
length of the longest, which turns the largest inner product into the smallest
distance. Each lies nearest to one of a few pivots, and the table is stored
sorted by (pivot, distance to it), in bands of neighbouring distances. By the
triangle inequality a band's interval of keys bounds the scores that its
members can have with an anchor. A search scans the anchor's own key interval
first, then expands to the annuli that can still hold one of its k best, and
ends when the bound of all that remains is below them. What it returns is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalake.llm.common import cut, discard, shuffle_partitions, stored
from thermalake.llm.tiles import floats, one_row_per_id

PIVOTS, BANDS = 16, 64  # so that the directory of bands has 1,024 rows at most
SAMPLE = 2048  # vectors among which the pivots are chosen
BLOCK, ANCHORS = 2048, 512  # vectors and anchors of one tile at most
_EXACT = float(1 << 53)
_NONE = np.iinfo(np.int64).min
_TILE = "score long, vec_id long, anchor_id long, ask long"
_FOUND = pa.schema([("score", pa.int64()), ("vec_id", pa.int64()), ("anchor_id", pa.int64()), ("ask", pa.int64())])
_INDEX = "vec_id long, label long, x array<long>, pivot int, distance double"
_ASK = "vec_id long, label long, x array<long>, least array<long>, most array<long>"


def whole_vectors(vecs: DataFrame, scale: int, relabel_every: int, labels: int) -> DataFrame:
    """(vec_id, label, x, square): labelled vectors as whole numbers, their labels shifted where the id is divisible."""
    table = floats(vecs).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = one_row_per_id(table, "vec_id", "label", "embedding")
    e = F.col("embedding").cast("array<double>")
    fits = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < float(1 << 31)))
    x = F.transform(e, lambda c: F.floor(c * F.lit(float(scale)))).cast("array<bigint>")
    shifted = F.when(F.pmod("vec_id", F.lit(relabel_every)) == 0, F.pmod(F.col("label") + 1, F.lit(labels))).otherwise(F.col("label"))
    rows = rows.filter(F.col("label").isNotNull() & F.coalesce(fits & (F.size("embedding") > 0), F.lit(False))).select("vec_id", shifted.alias("label"), x.alias("x"))
    square = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return rows.withColumn("square", square).filter(F.col("square") < float(1 << 62))


def farthest(points: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` of the points, each the farthest from those before it; the first is the farthest from the mean."""
    gap, chosen = ((points - points.mean(0)) ** 2).sum(1), []
    for i in range(min(most, len(points))):
        at = int(gap.argmax())
        if i and gap[at] <= 0:
            break
        chosen.append(at)
        new = ((points - points[at]) ** 2).sum(1)
        gap = new if i == 0 else np.minimum(gap, new)
    return points[chosen]


class Pivots:
    """Pivots of one dimension in the lengthened space, all of whose vectors have the squared length `most`."""

    def __init__(self, points: np.ndarray, most: float):
        self.most = most
        self.points = farthest(self.lengthened(points), PIVOTS)

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.concatenate([x, np.sqrt(np.maximum(self.most - (x**2).sum(1), 0.0))[:, None]], axis=1)

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Of each point to each pivot."""
        out = np.empty((len(points), len(self.points)))
        for j, p in enumerate(self.points):
            out[:, j] = np.sqrt(((points - p) ** 2).sum(1))
        return out

    def asked(self, x: np.ndarray) -> np.ndarray:
        """Distances of anchors to the pivots; their own added coordinate is zero."""
        return self.distances(np.concatenate([x.astype(np.float64), np.zeros((len(x), 1))], axis=1))

    def scores(self, x: np.ndarray, pivot: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) inner product of each anchor with members of each band (pivot, low to high distance), rounded outwards."""
        away = self.asked(x)[:, pivot]
        near, far = np.maximum(np.maximum(away - high, low - away), 0.0), away + high
        total = (x.astype(np.float64) ** 2).sum(1)[:, None] + self.most
        slack = 1e-9 * total + 1.0
        return (total - far**2) / 2 - slack, (total - near**2) / 2 + slack


def _rows(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers: by doubles where all partial sums keep within 2^53, else by longs."""
    if len(a) and len(b) and float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best(owner: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Positions of each owner's k best: larger scores first, then smaller ids."""
    order = np.lexsort((vec_id, -score, owner))
    new = np.r_[True, owner[order][1:] != owner[order][:-1]] if len(order) else np.empty(0, bool)
    first = np.flatnonzero(new)
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[place < k]


def tile_best(table: pa.Table, k: int, same: bool) -> pa.Table:
    """(score, vec_id, anchor_id, ask): the k best members of one tile for each ask of each anchor.

    side 0 are anchors, each with the scores (least, most) that it asks for;
    side 1 the members of one block of a band. Labels must be equal (`same`) or
    differ. An ask's least rises to its k-th score before members are listed.
    """
    side = table["side"].to_numpy()
    asks, members = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
    found: list[tuple] = []
    if asks.num_rows and members.num_rows:
        dim = table["dim"][0].as_py()
        ids, labels = members["vec_id"].to_numpy(), members["label"].to_numpy()
        x = _rows(members["x"], dim)
        anchors, own = asks["vec_id"].to_numpy(), asks["label"].to_numpy()
        score = products(_rows(asks["x"], dim), x)
        able = (labels[None, :] == own[:, None]) == same
        able &= ids[None, :] != anchors[:, None]
        for i, (least, most) in enumerate(zip(asks["least"].to_pylist(), asks["most"].to_pylist(), strict=True)):
            at = np.flatnonzero(able[i])
            s = score[i, at]
            for ask, (low, high) in enumerate(zip(least, most, strict=True)):
                hit = (s >= low) & (s <= high)
                if hit.sum() > k:
                    hit &= s >= np.partition(s[hit], hit.sum() - k)[hit.sum() - k]
                where = at[hit]
                where = where[best(np.zeros(len(where), np.int64), score[i, where], ids[where], k)]
                found.append((score[i, where], ids[where], np.full(len(where), anchors[i]), np.full(len(where), ask)))
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 4
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)


def _step(n: int) -> int:
    """How many of `BANDS` equal parts of n rows make a band of about BLOCK."""
    return max(1, round(BANDS * BLOCK / n))


class Index:
    """The stored table of one dimension, sorted by (pivot, distance), and its directory of bands."""

    def __init__(self, rows: DataFrame, dim: int):
        spark = rows.sparkSession
        self.dim = dim
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("x").limit(SAMPLE).toPandas()["x"]
        longest = rows.agg(F.max("square")).first()[0]
        self.pivots = pivots = Pivots(np.array(sample.tolist(), np.int64).reshape(-1, dim), longest)

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                away = pivots.distances(pivots.lengthened(_rows(batch.column(2), dim)))
                pivot = away.argmin(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2), pa.array(pivot), pa.array(away[np.arange(len(away)), pivot])], names=["vec_id", "label", "x", "pivot", "distance"]
                )

        keyed_rows = rows.select("vec_id", "label", "x").mapInArrow(keyed, _INDEX)
        table = keyed_rows.repartitionByRange(shuffle_partitions(spark), "pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance")
        self.table, self.path = stored(table)
        # bands of about BLOCK vectors, or BANDS for each pivot; each is dealt into blocks of BLOCK at most
        steps = self.table.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("distance", [i / BANDS for i in range(1, BANDS)], 2000).alias("edges")).collect()
        edges = {r.pivot: sorted({r.edges[j] for j in range(_step(r.n) - 1, BANDS - 1, _step(r.n))}) if r.n > BLOCK else [] for r in steps}
        band = F.lit(0)
        for pivot, cuts in edges.items():
            # the number of edges up to a distance; equal distances share a band
            within = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("distance"))) if cuts else F.lit(0)
            band = F.when(F.col("pivot") == pivot, within).otherwise(band)
        self.banded = self.table.withColumn("band", (F.col("pivot") * BANDS + band).cast("int"))
        self.bands = self.banded.groupBy("band").agg(F.first("pivot").alias("pivot"), F.min("distance").alias("low"), F.max("distance").alias("high"), F.count("*").alias("n")).orderBy("band").collect()

    def search(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """(score, vec_id, anchor_id, ask): the k best of every ask, exactly.

        anchors: (vec_id, label, x, least array, most array), an ask for each
        pair of scores.
        """
        spark = anchors.sparkSession
        pivots, dim = self.pivots, self.dim
        number = np.array([b.band for b in self.bands], np.int32)
        pivot = np.array([b.pivot for b in self.bands])
        low, high = (np.array([b[c] for b in self.bands]) for c in ("low", "high"))
        blocks = np.array([-(-b.n // BLOCK) for b in self.bands], np.int32)
        def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(pivots.asked(_rows(batch.column(0), dim)).argmin(1).astype(np.int32))], names=["home"])

        asked = {r.home: r["count"] for r in anchors.select("x").mapInArrow(homes, "home int").groupBy("home").count().collect()}
        parts = np.array([max(1, -(-asked.get(h, 0) // ANCHORS)) for h in range(len(pivots.points))])
        before = np.r_[0, np.cumsum(parts)[:-1]]
        slots = int(blocks.sum() ** 0.5) + 1

        def reached(expanding: bool):
            def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                """The bands that an anchor scans, as rows of (row, group, band, blocks); anchors of one group are nearest to one pivot."""
                for batch in batches:
                    x = _rows(batch.column(batch.schema.get_field_index("x")), dim)
                    away = pivots.asked(x)
                    bottom, top = pivots.scores(x, pivot, low, high)
                    least = [min(v) if v else np.inf for v in batch.column(batch.schema.get_field_index("least")).to_pylist()]
                    most = [max(v) if v else -np.inf for v in batch.column(batch.schema.get_field_index("most")).to_pylist()]
                    home = away.argmin(1)
                    gap = np.maximum(np.maximum(low[None, :] - away[:, pivot], away[:, pivot] - high[None, :]), 0.0)
                    own = np.where(pivot[None, :] == home[:, None], gap, np.inf).argmin(1)
                    first = np.arange(len(number))[None, :] == own[:, None]
                    can = (top >= np.array(least, float)[:, None]) & (bottom <= np.array(most, float)[:, None])
                    i, j = np.nonzero(can & ~first if expanding else first)
                    rows = batch.take(pa.array(i))
                    spread = (rows.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)
                    group = before[home[i]] + spread % parts[home[i]]
                    columns = [*rows.columns, pa.array(group.astype(np.int32)), pa.array(number[j]), pa.array(blocks[j])]
                    yield pa.RecordBatch.from_arrays(columns, names=[*rows.schema.names, "group", "band", "blocks"])

            return bands

        def scanned(asking: DataFrame, expanding: bool) -> DataFrame:
            routed = asking.mapInArrow(reached(expanding), f"{_ASK}, group int, band int, blocks int")
            routed = routed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            wanted = routed.select(F.col("group"), F.col("band").alias("_band"), "blocks").distinct()
            members = self.banded.join(wanted, F.col("band") == F.col("_band")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
            empty = F.array().cast("array<long>")
            tiles = routed.select("group", "band", "block", F.lit(0).alias("side"), "vec_id", "label", "x", "least", "most").unionByName(
                members.select("group", "band", "block", F.lit(1).alias("side"), "vec_id", "label", "x", empty.alias("least"), empty.alias("most"))
            )
            tiles = tiles.withColumn("dim", F.lit(dim)).repartition(shuffle_partitions(spark), "group", "band", "block")
            return tiles.groupBy("group", "band", "block").applyInArrow(lambda t: tile_best(t, k, same), _TILE)

        def kept(found: DataFrame) -> DataFrame:
            """The k best of each ask, in two steps, so that no list grows with the table but by its square root."""
            hit = F.struct((-F.col("score")).alias("less"), "vec_id")
            some = found.groupBy("anchor_id", "ask", F.pmod(F.xxhash64("vec_id"), F.lit(slots)).alias("slot")).agg(F.slice(F.sort_array(F.collect_list(hit)), 1, k).alias("hits"))
            top = some.groupBy("anchor_id", "ask").agg(F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits"))
            return top.select("anchor_id", "ask", F.slice("hits", 1, k).alias("hits"))

        near = cut(kept(scanned(anchors, expanding=False)))
        bound = near.filter(F.size("hits") == k).select("anchor_id", "ask", (-F.col("hits")[k - 1]["less"]).alias("kth"))
        bounds = bound.groupBy(F.col("anchor_id").alias("_id")).agg(F.map_from_entries(F.collect_list(F.struct("ask", "kth"))).alias("kth"))
        tighter = anchors.join(bounds, F.col("vec_id") == F.col("_id"), "left").withColumn(
            "least", F.transform("least", lambda v, i: F.greatest(v, F.coalesce(F.col("kth")[i.cast("long")], v)))
        )
        more = scanned(tighter.select("vec_id", "label", "x", "least", "most"), expanding=True)
        one = near.select("anchor_id", "ask", F.explode("hits").alias("hit")).select((-F.col("hit.less")).alias("score"), "hit.vec_id", "anchor_id", "ask")
        return cut(kept(more.unionByName(one)))


def hard_negatives(vecs: DataFrame, anchors, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256, relabel_every: int = 7, labels: int = 10) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each row where `anchors` holds.

    Scores are exact inner products of floor(scale * x). An anchor's positives
    are its best `positives` other rows of the same label; for each, the best
    `negatives` rows of other labels between `least` and `most` percent of its
    score are returned, ties by smaller id. Labels of ids divisible by
    `relabel_every` are first shifted by one modulo `labels`. Rows without an id,
    a label or a vector, with empty vectors, null or non-finite components, or whose whole
    numbers leave 31 bits (or squared lengths 62, so that scores are longs) take
    no part; vectors meet only those of their own dimension. Of rows that repeat
    a vec_id, the one with the largest label, then embedding counts. An empty table gives an empty one; extra
    columns are not read.
    """
    spark = vecs.sparkSession
    rows, path = stored(whole_vectors(vecs, scale, relabel_every, labels).withColumns({"asks": F.coalesce(anchors, F.lit(False)), "dim": F.size("x")}))
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for dim in [r.dim for r in rows.filter("asks").select("dim").distinct().orderBy("dim").collect()]:
        own = rows.filter(F.col("dim") == dim)
        index = Index(own, dim)
        asking = own.filter("asks").select("vec_id", "label", "x")
        low, high = F.array(F.lit(_NONE + 1)), F.array(F.lit(-(_NONE + 1)))
        first = index.search(asking.withColumns({"least": low, "most": high}), positives, same=True)
        # score bounds of negatives in whole numbers: least * p <= 100 * s <= most * p
        hit = F.posexplode("hits").alias("ask", "hit")
        picked = first.select("anchor_id", hit).select("anchor_id", F.col("ask").cast("long").alias("ask"), F.col("hit.vec_id").alias("positive_id"), (-F.col("hit.less")).alias("positive_score"))
        limits = picked.groupBy(F.col("anchor_id").alias("_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ask", "positive_score"))), lambda s: s["positive_score"]).alias("p"))
        wide = F.transform("p", lambda p: p.cast("decimal(30,0)"))
        windows = limits.select("_id", F.transform(wide, lambda p: F.ceil(p * least / 100).cast("long")).alias("least"), F.transform(wide, lambda p: F.floor(p * most / 100).cast("long")).alias("most"))
        second = index.search(asking.join(windows, F.col("vec_id") == F.col("_id")).drop("_id"), negatives, same=False)
        negative = second.select(F.col("anchor_id").alias("_anchor"), F.col("ask").alias("_ask"), F.posexplode("hits").alias("place", "hit"))
        met = picked.join(negative, (F.col("anchor_id") == F.col("_anchor")) & (F.col("ask") == F.col("_ask")))
        out = out.unionByName(
            met.select(
                "anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("negative_id"), "positive_score", (-F.col("hit.less")).alias("negative_score")
            )
        )
        discard(spark, index.path)
    discard(spark, path)
    return out
