"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalake.llm.common import discard, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every node's larger (or not larger) neighbours to the smallest of its neighbourhood.

    The smallest neighbour comes from a map-side combined aggregate, and it
    meets the links in a plain join whose hot keys adaptive execution splits;
    no neighbourhood is ever gathered in one place.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).withColumn("m", F.least("m", "node"))
    met = both.join(low, both["a"] == low["node"])
    if large:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select(F.col("node").alias("a"), F.col("m").alias("b"))
        )
    return out.filter("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of (a long, b long); component is the smallest node reachable.

    Self-links and repeated links are fine, nodes without another neighbour are
    left out, nulls are ignored. Each round is written as a table to the shared
    folder, and the table before it deleted. The loop ends when a round changes
    nothing and raises if `max_rounds` is not enough.
    """
    spark = edges.sparkSession
    links = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    links, path = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    digest = lambda df: df.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_if(F.col("b") > F.col("a"))
    ).first()
    before = digest(links)
    for _ in range(max_rounds):
        links, new = stored(_star(_star(links, large=True), large=False))
        discard(spark, path)
        path, after = new, digest(links)
        if after == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
