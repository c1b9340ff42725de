"""Queries over native image files that Spark writes from the driver's tables and scans again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermalake.operators import moments
from thermalake.sources import native
from thermalake.sources.tables import shared_folder, table

SLAB = 4096  # parts of one file: what one task holds when it writes


def native_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of image files of the line items: a day for each year, a row for each part, a column for each line number.

    Values are mean prices as radiances and quantities as angles; where a cell
    has no line item or its quantity is 49 or more, the radiance is missing.
    """
    folder = f"{shared_folder(spark)}/native-{uuid.uuid4()}"
    cells = table(spark, sf_dir, "lineitem").groupBy((F.year("l_shipdate") - 1990).alias("day"), F.col("l_partkey").alias("y"), F.col("l_linenumber").alias("x"))
    cells = cells.agg((F.avg("l_extendedprice") / 500.0).alias("price"), F.avg("l_quantity").alias("lza"))
    cells = cells.withColumn("Rad", F.when(F.col("lza") < 49, F.col("price")))
    slab = F.floor(F.col("y") / SLAB)
    name = F.format_string("rad_c14_G16_day%03d_%08d.nc", F.col("day"), slab)
    native.write_grids(cells, folder, name, slab * SLAB, "y", "x", ["Rad", "lza"], 8).write.format("noop").mode("overwrite").save()
    return folder


def native_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pixels of the files of days 3 to 6 that hold a radiance; days and rows outside are not opened."""
    df = native.read_grids(spark, native_files(spark, sf_dir), "day int, sat string, channel int, y int, x int, Rad double, lza double", rows=1024)
    kept = df.filter((F.col("day") >= 3) & (F.col("day") <= 6) & (F.col("y") >= 100)).filter("Rad IS NOT NULL")
    return kept.select("day", "sat", "channel", "y", "x", F.round("Rad", 6).alias("rad"), F.round("lza", 6).alias("lza"))


NATIVE_SCAN = """SELECT (year(l_shipdate) - 1990)::INTEGER AS day, 'G16' AS sat, 14 AS channel, l_partkey::INTEGER AS y, l_linenumber::INTEGER AS x,
round(avg(l_extendedprice) / 500.0, 6) AS rad, round(avg(l_quantity), 6) AS lza FROM lineitem
WHERE year(l_shipdate) BETWEEN 1993 AND 1996 AND l_partkey >= 100 GROUP BY 1, 4, 5 HAVING avg(l_quantity) < 49"""


def native_strides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments per day of every third row and column of the files, read with a stride."""
    df = native.read_grids(spark, native_files(spark, sf_dir), "day int, y int, x int, Rad double", rows=1000, stride=3)
    out = moments.population_summary(moments.state(df, ["day"], F.col("Rad")))
    return out.filter("n > 0").select("day", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


NATIVE_STRIDES = """WITH c AS (SELECT (year(l_shipdate) - 1990)::INTEGER AS day, avg(l_extendedprice) / 500.0 AS v, avg(l_quantity) AS q
FROM lineitem WHERE l_partkey % 3 = 0 AND l_linenumber % 3 = 0 GROUP BY 1, l_partkey, l_linenumber)
SELECT day, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS sd FROM c WHERE q < 49 GROUP BY day"""

QUERIES = {
    "native_scan": (native_scan, NATIVE_SCAN),
    "native_strides": (native_strides, NATIVE_STRIDES),
}
