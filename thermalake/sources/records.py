"""Tables of residuals and diagnostics, records and products with their checks, and file catalogues."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESIDUALS = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("scenario", "mode", "stage")],
        *[T.StructField(n, T.IntegerType()) for n in ("degree", "scene_index")],
        T.StructField("regime", T.StringType()),
        *[T.StructField(n, T.IntegerType()) for n in ("abi_scene", "fold")],
        *[T.StructField(n, T.DoubleType()) for n in ("weight", "truth", "residual")],
    ]
)
#: The units of products by the first part of their names.
UNITS = {"rad": "mW m-2 sr-1 (cm-1)-1", "bt": "K", "flux": "W m-2", "lza": "degree", "lat": "degree_north", "lon": "degree_east"}


def write_residuals(df: DataFrame, path: str) -> None:
    df.select(*[f.name for f in RESIDUALS]).write.mode("overwrite").option("header", True).csv(path)


def residuals(spark: SparkSession, path: str, **equal) -> DataFrame:
    """The rows of CSV residuals that equal the given values; a malformed line is an error."""
    df = spark.read.schema(RESIDUALS).option("header", True).option("mode", "FAILFAST").csv(path)
    for column, value in equal.items():
        df = df.filter(F.col(column) == value)
    return df


def diagnostics(spark: SparkSession, path: str, key: str = "n_components") -> DataFrame:
    """CSV diagnostics with a whole number as key; other cells are numbers where they can be, else null. Repeated keys raise."""
    raw = spark.read.option("header", True).csv(path)
    numbers = [F.col(f"`{c}`").try_cast("double").alias(c) for c in raw.columns if c != key]
    df = raw.select(F.col(f"`{key}`").try_cast("int").alias(key), *numbers)
    counts = df.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    bad = F.when((F.col("_n") > 1) | F.col(key).isNull(), F.raise_error(F.lit("diagnostics lack or repeat a key")).cast("boolean"))
    return df.join(counts, F.col(key).eqNullSafe(F.col("_k"))).withColumn("_bad", bad).filter("_bad IS NULL").drop("_k", "_n", "_bad")


def record(spark: SparkSession, path: str, identity: dict) -> dict:
    """A JSON record whose recorded identity is the current one; raises if it is stale, and names what differs."""
    held = json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
    known = held.get("identity", {})
    wrong = sorted(k for k in known.keys() | identity.keys() if known.get(k) != identity.get(k))
    if wrong:
        raise ValueError("the record is stale: " + ", ".join(wrong))
    return held


def write_product(df: DataFrame, path: str, attributes: dict, partitions: Sequence[str] = ()) -> None:
    """Parquet whose columns carry the units of their names, and the attributes as one JSON line beside it."""
    units = lambda name: UNITS.get(name.split("_")[0])
    named = df.select(*[F.col(c).alias(c, metadata={"unit": units(c)}) if units(c) else F.col(c) for c in df.columns])
    writer = named.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(f"{path}/rows")
    line = json.dumps(attributes, sort_keys=True, allow_nan=False)
    df.sparkSession.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def read_product(spark: SparkSession, path: str) -> tuple[DataFrame, dict, dict]:
    """The rows of a product, its attributes, and the units of its columns."""
    df = spark.read.parquet(f"{path}/rows")
    return df, json.loads(spark.read.text(f"{path}/about").first()["value"]), {f.name: f.metadata["unit"] for f in df.schema if f.metadata.get("unit")}


def write_counted(df: DataFrame, path: str, least: int = 100) -> int:
    """Writes a cache, counting and marking the rows as they are written; raises below `least` rows, or if others can be read again.

    The input is computed once. `_identity` beside the rows has the sum of the
    rows' hashes, by which `replayed` tells a cache whose values have changed.
    """
    seen = Observation()
    marked = df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(_row_hash(df)).alias("hash"))
    marked.write.mode("overwrite").parquet(f"{path}/rows")
    n, known = seen.get["n"], str(seen.get["hash"])
    if n < least:
        raise ValueError(f"{n} rows are fewer than {least}")
    again = _contents(df.sparkSession.read.parquet(f"{path}/rows"))
    if again != (n, known):
        raise ValueError(f"{again[0]} rows were written of {n}")
    line = json.dumps({"rows": n, "hash": known})
    df.sparkSession.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_identity")
    return n


def _row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*df.columns).cast("decimal(38,0)")


def _contents(df: DataFrame) -> tuple[int, str]:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(_row_hash(df)).alias("hash")).first()
    return row["n"], str(row["hash"])


def replayed(spark: SparkSession, path: str, rows: int, columns: Sequence[str]) -> DataFrame:
    """A written cache for another pass; raises if its columns, its rows or any of their values are not those that were written."""
    df = spark.read.parquet(f"{path}/rows")
    known = json.loads(spark.read.text(f"{path}/_identity").first()["value"])
    if df.columns != list(columns) or known["rows"] != rows or _contents(df) != (rows, known["hash"]):
        raise ValueError("the cache has changed since it was written")
    return df


def checked_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows, raising for one with a value that is null, NaN or infinite."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.coalesce(~(F.abs(F.col(c).cast("double")) < float("inf")), F.lit(True))
    return df.withColumn("_bad", F.when(bad, F.raise_error(F.lit("a value is not finite")).cast("boolean"))).filter("_bad IS NULL").drop("_bad")


def one_fold_each(df: DataFrame, group: str, fold: str) -> DataFrame:
    """The rows, raising for a group in more than one fold."""
    folds = df.groupBy(F.col(group).alias("_g")).agg((F.max(fold) != F.min(fold)).alias("_two"))
    bad = F.when(F.col("_two"), F.raise_error(F.lit("a group lies in two folds")).cast("boolean"))
    return df.join(folds, F.col(group).eqNullSafe(F.col("_g"))).withColumn("_bad", bad).filter("_bad IS NULL").drop("_g", "_two", "_bad")


def missing_files(catalogue: DataFrame, satellites: Sequence[str], channels: Sequence[int], day: int) -> DataFrame:
    """(satellite, channel) of the expected files of a day that a catalogue hasn't."""
    spark = catalogue.sparkSession
    wanted = spark.createDataFrame([(s, c) for s in satellites for c in channels], "satellite string, channel int")
    held = catalogue.filter(F.col("day") == day).select("satellite", "channel").distinct()
    return wanted.join(held, ["satellite", "channel"], "left_anti")


def paired_scenes(paths: DataFrame, kind: Column) -> DataFrame:
    """(id, path, kind) of scene files: the id is what follows the last underscore of the name, digits only."""
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[A-Za-z0-9]+$", "")
    last = F.substring_index(name, "_", -1)
    checked = F.when(last.rlike("^[0-9]+$"), last).otherwise(F.raise_error(F.concat(F.lit("no id in "), name)).cast("string"))
    return paths.select(checked.cast("long").alias("id"), "path", kind.alias("kind"))


def atomically(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Writes beside the path and renames when all is written, for readers of a fixed path.

    The old output is moved aside, not deleted, before the new one takes its
    place, and is put back if that fails. Between the two renames a reader finds
    nothing; `versions.publish` has no such moment.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    mark = uuid.uuid4()
    new, aside, old = hadoop(f"{path}.new-{mark}"), hadoop(f"{path}.old-{mark}"), hadoop(path)
    files = new.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        write(new.toString())
        held = files.exists(old)
        if held and not files.rename(old, aside):
            raise OSError(f"{path} could not be moved aside")
        if not files.rename(new, old):
            if held:
                files.rename(aside, old)
            raise OSError(f"{path} could not be replaced")
        files.delete(aside, True)
    finally:
        files.delete(new, True)
