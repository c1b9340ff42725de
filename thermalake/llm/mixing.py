"""Mixing sources to target weights by cube-method balanced sampling.

Every source gets a target in words. A document is taken a whole number of
times plus once more with an inclusion probability, the same for all documents
of its source. The flight phase of the cube method moves these probabilities
through the null space of two constraints, the words and the documents taken,
until all but two of a block are 0 or 1. Blocks of bounded size fly side by
side; what they leave flies again in fewer blocks until a source has one block
left, whose last two documents are landed by enumeration.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermalake.llm.common import carried, cut, shuffle_partitions, word_count

BLOCK = 1024
_LEFT = 2  # documents that a flight may leave open
_COPIES = 4096  # of a row that one task makes
_SNAP = 1e-9


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """(source, n_units, source_size, target) per source of (source, size, rows).

    Sources are ordered by code point, null last, and weigh `weights` in turn.
    They share `share` times all sizes by weight; no target exceeds `most`
    times its source's size, and the excess is shared again among the others.
    In closed form: target = min(most * size, level * weight) with the one
    level that spends all; the sources fill up in the order of size / weight.
    """
    totals = sizes.groupBy("source").agg(F.count("*").alias("n_units"), F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    ranked = totals.withColumn(
        "_w",
        F.element_at(
            F.array(*[F.lit(float(w)) for w in weights]),
            ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"),
        ),
    )
    # one row per source stands behind these windows, not one per document
    cap = F.col("source_size") * most
    filling = Window.orderBy(F.col("source_size") / F.col("_w"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    spend = F.least(F.sum("source_size").over(every) * share, F.sum(cap).over(every))
    level = F.try_divide(
        spend - F.coalesce(F.sum(cap).over(before), F.lit(0.0)),
        F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
    )
    return (
        ranked.withColumn("_level", level)
        .withColumn("_open", F.when(F.col("_level") * F.col("_w") < cap, F.col("_level")))
        .withColumn("_open", F.max("_open").over(every))
        .withColumn("target", F.least(cap, F.coalesce(F.col("_open") * F.col("_w"), cap)).cast("double"))
        .select("source", "n_units", "source_size", "target")
    )


def fly(pi: np.ndarray, size: np.ndarray, draws: np.random.Generator) -> np.ndarray:
    """Probabilities moved, in order, until at most two are left between 0 and 1.

    Each step takes the first three open documents and the direction that keeps
    their words and number; of the two ends of the line one is drawn so that
    every expectation stays.
    """
    pi = pi.tolist()
    size = size.tolist()
    held: list[int] = []
    for at, p in enumerate(pi):
        if not _SNAP < p < 1 - _SNAP:
            pi[at] = float(round(p))
            continue
        held.append(at)
        if len(held) < 3:
            continue
        a, b, c = held
        step = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if step == (0, 0, 0):
            step = (1, -1, 0)
        up = min((1 - pi[k]) / s if s > 0 else pi[k] / -s for k, s in zip(held, step, strict=True) if s)
        down = min(pi[k] / s if s > 0 else (1 - pi[k]) / -s for k, s in zip(held, step, strict=True) if s)
        move = up if draws.random() * (up + down) < down else -down
        for k, s in zip(held, step, strict=True):
            pi[k] += move * s
            if not _SNAP < pi[k] < 1 - _SNAP:
                pi[k] = float(round(pi[k]))
        held = [k for k in held if 0 < pi[k] < 1]
    return np.array(pi)


def land(pi: np.ndarray, size: np.ndarray, due: float) -> np.ndarray:
    """All documents at 0 or 1, with words as near to `due` as a short search finds.

    The open documents take the best of their roundings. If one of them is much
    larger than the rest, that leaves a gap; then documents of the block change
    sides, from the largest on, where that narrows the gap.
    """
    pi = pi.copy()
    open_ = np.flatnonzero((pi > 0) & (pi < 1))
    fixed = float(pi @ size - pi[open_] @ size[open_])
    choices = itertools.product((0.0, 1.0), repeat=len(open_))
    pi[open_] = min(choices, key=lambda z: (abs(fixed + float(np.array(z) @ size[open_]) - due), z))
    gap = due - float(pi @ size)
    for k in np.argsort(-size, kind="stable").tolist():
        change = size[k] if pi[k] == 0 else -size[k]
        if abs(gap - change) < abs(gap):
            pi[k] = 1 - pi[k]
            gap -= change
    return pi


def _flight(group: pa.Table) -> pa.Table:
    """One block. Large documents go first, so that the smallest are left; a block that is its source's only one lands."""
    group = group.sort_by([("size", "descending"), ("tie", "ascending"), ("doc_id", "ascending")])
    size = group["size"].to_numpy().astype(np.float64)
    start = group["pi"].to_numpy()
    seed = [group[name][0].as_py() & 0xFFFFFFFF for name in ("tie", "block")] + [len(size)]
    pi = fly(start, size, np.random.default_rng(seed))
    if group["blocks"][0].as_py() == 1:
        pi = land(pi, size, float(start @ size))
    return group.set_column(group.schema.get_field_index("pi"), "pi", pa.array(pi))


def _fly_blocks(units: DataFrame, salt: int) -> DataFrame:
    dealt = units.withColumn("block", F.pmod(F.xxhash64("tie", F.lit(salt)), F.col("blocks")))
    schema = ", ".join(f"{name} {kind}" for name, kind in dealt.dtypes)
    return dealt.groupBy("source", "block").applyInArrow(_flight, schema).drop("block")


def repeated(df: DataFrame, times: str, at: str) -> DataFrame:
    """Each row as often as its column `times` says, numbered from 0 in `at`; very many copies are made by many tasks."""
    number = lambda first, n: F.explode(F.sequence(first, first + n - 1))
    few = df.filter(F.col(times).between(1, _COPIES)).withColumn(at, number(F.lit(0).cast("long"), F.col(times)))
    chunks = df.filter(F.col(times) > _COPIES).withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(_COPIES))))
    chunks = chunks.repartition(shuffle_partitions(df.sparkSession))
    many = chunks.withColumn(at, number(F.col(at), F.least(F.lit(_COPIES), F.col(times) - F.col(at))))
    return few.unionByName(many)


def mixed_units(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    block: int = BLOCK,
) -> DataFrame:
    """(doc_id, text_hash, source, size, source_size, target, rows, taken): one row per different (doc_id, text, source) of the input.

    rows is how many input rows it stands for, taken how often the mix takes
    any of them, all in all. So rows that repeat fly once, with their number,
    and no block holds many of them.
    """
    sizes = docs.select(
        F.col("doc_id").cast("long"),
        F.xxhash64("text").alias("text_hash"),
        F.col("source").cast("string"),
        word_count("text").alias("size"),
    )
    sizes = cut(sizes.groupBy("doc_id", "text_hash", "source", "size").agg(F.count("*").alias("rows")))
    targets = cut(source_targets(sizes, weights, share, most)).withColumnRenamed("source", "_source")
    ratio = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    blocks = F.ceil(F.col("n_units") / block).cast("long")
    units = (
        sizes.join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("whole", F.floor(ratio * F.col("rows")).cast("long"))
        .withColumn("pi", ratio * F.col("rows") - F.col("whole"))
        .withColumn("tie", F.xxhash64("doc_id", "text_hash"))
        .withColumn("blocks", blocks)
    )
    units = units.select("doc_id", "text_hash", "source", "size", "rows", "source_size", "target", "whole", "pi", "tie", "blocks")
    most_blocks = targets.agg(F.max(blocks)).first()[0] or 1
    open_ = F.col("pi") * F.col("size")
    giant = F.col("size") * block > F.col("source_size")
    giants = cut(_fly_blocks(units.filter(giant).withColumn("blocks", F.lit(1).cast("long")), 0))
    # what the giants' landing adds to or takes from the words due is spread over the others
    due = units.groupBy(F.col("source").alias("_source")).agg(F.sum(open_).alias("_due"), F.sum(F.when(~giant, open_)).alias("_open"))
    spent = giants.groupBy(F.col("source").alias("_of")).agg(F.sum(open_).alias("_spent"))
    scale = due.join(spent, F.col("_source").eqNullSafe(F.col("_of"))).select(
        "_source", F.coalesce(F.try_divide(F.col("_due") - F.col("_spent"), F.col("_open")), F.lit(1.0)).alias("_scale")
    )
    rest = units.filter(~giant).join(scale, F.col("source").eqNullSafe(F.col("_source")), "left")
    scaled = F.least(F.greatest(F.col("pi") * F.coalesce("_scale", F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    units = rest.withColumn("pi", scaled).select(units.columns)
    settled, rounds = [giants], 1
    while True:
        flown = cut(_fly_blocks(units, rounds))
        settled.append(flown.filter("pi = 0 OR pi = 1"))
        if most_blocks == 1:
            break
        units = flown.filter("pi > 0 AND pi < 1").withColumn(
            "blocks", F.greatest(F.ceil(F.col("blocks") * _LEFT / block), F.lit(1)).cast("long")
        )
        most_blocks = max(1, -(-most_blocks * _LEFT // block))
        rounds += 1
    whole = functools.reduce(DataFrame.unionByName, settled)
    return whole.select(
        "doc_id", "text_hash", "source", "size", "source_size", "target", "rows", (F.col("whole") + F.col("pi").cast("long")).alias("taken")
    )


def mix_sources(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, text_hash, size, source_size, target, copies) per input row.

    copies times size words of the row go into the mix; null and empty texts
    have size 0. Draws depend on hashes of the ids and texts alone, so reruns
    agree however the input is partitioned. Rows that repeat an id, a text and
    a source share what is taken of them evenly. A null source is a source;
    null ids are drawn like others. An empty table gives an empty one; extra
    columns are not read. Settings are those of `mixed_units`.
    """
    each = repeated(mixed_units(docs, **settings), "rows", "_at")
    copies = F.expr("taken div rows") + F.when(F.col("_at") < F.col("taken") % F.col("rows"), 1).otherwise(0)
    return each.select("doc_id", "text_hash", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The input rows and columns, each as often as the mix takes it.

    Null and empty texts come as often as drawn, with their null or empty text;
    long ones come whole. Of rows that repeat an id, a text and a source, one
    comes as often as the mix takes all of them together. An empty table gives
    an empty one. Extra columns of any name are carried along.
    """
    units = mixed_units(docs, **settings).filter("taken > 0").select("doc_id", "text_hash", "source", "rows", "taken")
    rows = carried(docs, _id=F.col("doc_id").cast("long"), _hash=F.xxhash64("text"), _of=F.col("source").cast("string"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash")) & F.col("_of").eqNullSafe(F.col("source"))
    met = rows.join(units, same).select("row", "_id", "_hash", "_of", "rows", "taken")
    one = met.filter("rows > 1").groupBy("_id", "_hash", "_of", "rows", "taken").agg(F.first("row").alias("row"))
    whole = met.filter("rows = 1").select("row", "taken").unionByName(one.select("row", "taken"))
    return repeated(whole, "taken", "_at").select("row.*")
