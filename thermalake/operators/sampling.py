"""Samples by keyed hashes and exact caps; the same rows whatever the partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermalake.functions.rng import uniform
from thermalake.sources.tables import cut


def smallest(df: DataFrame, key: Column, n: int, order: Sequence[str]) -> DataFrame:
    """The n rows of the smallest keys, in the given order."""
    return df.withColumn("_key", key).orderBy("_key", *order).limit(n).drop("_key").orderBy(*order)


def capped(df: DataFrame, group: str, key: Column, cap: int, order: Sequence[str]) -> DataFrame:
    """At most `cap` rows per group, those of the smallest keys, with their rank.

    The rank window keeps `cap` rows per group and task before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(key, *order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= cap)


def split(df: DataFrame, seed: int, keys: Sequence[str], share: float) -> DataFrame:
    """The rows with `part`: 'train' for about `share` of the keys, else 'test'."""
    return df.withColumn("part", F.when(uniform(seed, *keys) < share, "train").otherwise("test"))


def smallest_keys(df: DataFrame, key: Column, order: Sequence[str], take: int, few: int = 10_000, steps: int = 4096) -> Column:
    """A condition that holds for exactly `take` rows, those of the smallest keys and, among equal ones, of the first in order.

    The key of the last row taken is found by counts of rows per range of the
    keys, and of ranges within the range that holds it, until few rows are left
    to sort. `key` is a number; `order` tells all rows apart.
    """
    number = key.cast("double")
    place = F.struct(number.alias("_key"), *order)
    ends = df.agg(F.min(number).alias("low"), F.max(number).alias("high"), F.count("*").alias("n")).first()
    if take <= 0 or not ends["n"]:
        return F.lit(False)
    if take >= ends["n"]:
        return F.lit(True)
    low, high, before, held = ends["low"], ends["high"], 0, ends["n"]
    while held > few and low < high:
        width = (high - low) / steps
        at = F.least(F.floor((number - low) / width), F.lit(steps - 1))
        counts = df.filter(number.between(low, high)).groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min(number).alias("low"), F.max(number).alias("high"))
        for r in sorted(counts.collect(), key=lambda r: r["at"]):
            if before + r["n"] >= take:
                low, high, held = r["low"], r["high"], r["n"]
                break
            before += r["n"]
    rows = df.filter(number.between(low, high))
    if held <= few:
        last = rows.select(place.alias("p")).orderBy("p").limit(take - before).agg(F.max("p").alias("p")).first()["p"]
    else:  # so many rows have one key
        ranked = running(rows.select(place.alias("p"), F.lit(1).alias("_one")), [], "p", "_one")
        last = ranked.filter(F.col("so_far") == take - before).first()["p"]
    bound = F.struct(F.lit(float(last["_key"])).alias("_key"), *[F.lit(last[o]).cast(dict(df.dtypes)[o]).alias(o) for o in order])
    return place <= bound


def switch_labels(df: DataFrame, label: str, second: str, fraction: float, key: Column, order: Sequence[str]) -> DataFrame:
    """Exactly floor(fraction * n) rows, those of the smallest keys, take their second label.

    Only counts of rows per range of keys and a few rows are gathered; the
    others are neither sorted nor moved.
    """
    switched = smallest_keys(df, key, order, int(fraction * df.count()))
    out = df.withColumn("switched", switched)
    return out.withColumn(label, F.when(F.col("switched"), F.col(second)).otherwise(F.col(label))).select(*df.columns, "switched")


def poisson(draw: Column) -> Column:
    """How often a row is drawn in a resampling with replacement, the Poisson(1) count of a uniform draw."""
    steps, total, term = [], 0.0, 0.36787944117144233
    for k in range(9):
        total += term
        steps.append(total)
        term /= k + 1
    return sum((F.when(draw >= s, 1).otherwise(0) for s in steps), F.lit(0))


def bootstrap_sums(df: DataFrame, keys: Sequence[str], draws: Sequence[Column], value: Column | None = None) -> DataFrame:
    """(keys, replicate, n, total) of each resampling: counts and sums of a value, in one aggregation without copies of rows."""
    x = F.lit(1.0) if value is None else value.cast("double")
    own = df.select(*keys, x.alias("_x"), *[poisson(d).alias(f"_n{i}") for i, d in enumerate(draws)])
    at = range(len(draws))
    sums = own.groupBy(*keys).agg(*[F.sum(f"_n{i}").alias(f"n{i}") for i in at], *[F.sum(F.col(f"_n{i}") * F.col("_x")).alias(f"t{i}") for i in at])
    cells = F.array(*[F.struct(F.lit(i).alias("replicate"), F.col(f"n{i}").alias("n"), F.col(f"t{i}").alias("total")) for i in at])
    return sums.select(*keys, F.inline(cells))


def running(df: DataFrame, keys: Sequence[str], order: str, n: str) -> DataFrame:
    """The rows with `so_far`, the sum of `n` up to each in the order within its keys.

    Rows are dealt by ranges of the order; only one total per range and key is added up in a window of its own.
    """
    dealt = cut(df.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()))
    each = dealt.groupBy("_part", *keys).agg(F.sum(n).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    each = each.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(before, F.lit(0)).alias("_before"))
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = F.sum(n).over(Window.partitionBy("_part", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    out = dealt.withColumn("_inside", inside).join(each, on)
    return out.select(*df.columns, (F.col("_before") + F.col("_inside")).alias("so_far"))


def quantiles(df: DataFrame, keys: Sequence[str], value: Column, shares: Sequence[float]) -> DataFrame:
    """(keys, q0, q1, ...): exact quantiles of the values that are not null, between neighbours by their distance.

    Values are counted and their ranks found by `running`, so that no task holds a group.
    """
    counts = df.select(*keys, value.cast("double").alias("_v")).groupBy(*keys, "_v").agg(F.count("_v").alias("_n"))
    ranked = running(counts, keys, "_v", "_n")
    total = ranked.groupBy(*keys).agg(F.sum("_n").alias("_total")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_total")
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    place = [F.lit(float(p)) * (F.col("_total") - 1) for p in shares]
    at = lambda rank: F.min(F.when(F.col("so_far") > rank, F.col("_v")))
    found = ranked.join(total, on).groupBy(*keys).agg(
        *[at(F.floor(x)).alias(f"_low{i}") for i, x in enumerate(place)],
        *[at(F.ceil(x)).alias(f"_high{i}") for i, x in enumerate(place)],
        *[F.max(x - F.floor(x)).alias(f"_far{i}") for i, x in enumerate(place)],
    )
    between = lambda i: F.when(F.col(f"_far{i}") == 0, F.col(f"_low{i}")).otherwise((1 - F.col(f"_far{i}")) * F.col(f"_low{i}") + F.col(f"_far{i}") * F.col(f"_high{i}"))
    return found.select(*keys, *[between(i).alias(f"q{i}") for i in range(len(shares))])
