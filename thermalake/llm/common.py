"""What the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, the only separators of words and margins of lines.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that driver and executors share: the cluster's `spark.checkpoint.dir`.

    Where the session names none, a local session gets a folder of its own, as
    in tests on one machine; a cluster raises, since its executors could not
    read what others wrote to their own disks.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    present = context._jsc.sc().getCheckpointDir()
    if present.isDefined():
        return present.get()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and forget its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """`df` as a table written to the shared folder and read again, and the table's path.

    Spark knows the size of such a table, so it chooses by its own check whether
    to broadcast it. `discard` deletes it once nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that `stored` wrote."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def carried(docs: DataFrame, **columns) -> DataFrame:
    """(row, *columns): each whole input row as one struct, so that no column name of the input can clash."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in columns.items()])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: str):
    """Number of runs of non-blank characters; null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fold_of(doc_id: str, folds: int):
    """crc32 of the id written as text, modulo `folds`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def most_counted(counts: DataFrame, keys: list[str], entry: str, n: str, room: int) -> DataFrame:
    """The rows with `chosen`, true for the largest counts, about `room` of each group of `keys`: all above the boundary count, and of those that tie there the share that fills the bound.

    A hash of the entry chooses among the tied, so the bound holds in
    expectation and a table of equal counts keeps `room` of them, not none.
    Only the number of rows per count is put in order, which grows with the
    logarithm of the rows at most.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    steps = counts.groupBy(*[F.col(k).alias(a) for k, a in zip(keys, names, strict=True)], F.col(n).alias("_n")).agg(F.count("*").alias("_held"))
    down = Window.partitionBy(*names).orderBy(F.desc("_n")).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("_so_far", F.sum("_held").over(down))
    # the share of each count that stays: all, some at the boundary, none below
    share = F.least(F.lit(1.0), (room - (F.col("_so_far") - F.col("_held"))) / F.col("_held"))
    steps = steps.withColumn("_share", share).filter("_share > 0").drop("_so_far", "_held")
    draw = F.shiftrightunsigned(F.xxhash64(entry, F.lit(21)), 11) / float(1 << 53)
    on = F.col(n) == F.col("_n")
    for k, a in zip(keys, names, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(a))
    met = counts.join(steps, on, "left")
    return met.select(*counts.columns, F.coalesce(draw < F.col("_share"), F.lit(False)).alias("chosen"))
